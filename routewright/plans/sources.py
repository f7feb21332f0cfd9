"""Source and sink queries: write a role of the tables, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import catalog
from routewright.plans import retrieval
from routewright.plans import tables as t
from routewright.session import scratch_path
from routewright.sources import readers, writers

# Records per JSON-array file, by order key, so that a file stays small.
CHUNK = 5000


def _flat(df, *extra):
    return df.select(
        *extra,
        "qid",
        "question",
        "sql",
        F.col("schema.database").alias("db"),
        F.array_join(F.transform("schema.metadata", lambda x: x["name"]), ",").alias("tables"),
    )


def read_instances(spark, d):
    path = scratch_path(spark, "arrays")
    writers.write_json_arrays(t.instances(spark, d), path, F.floor(F.col("qid") / CHUNK))
    return _flat(readers.read_instances(spark, f"{path}/*"))


def read_jsonl(spark, d):
    path = scratch_path(spark, "lines")
    writers.write_instances(t.instances(spark, d), path)
    return _flat(readers.read_jsonl(spark, path))


def write_instances(spark, d):
    path = scratch_path(spark, "records")
    writers.write_instances(t.instances(spark, d), path, "parquet")
    return _flat(spark.read.parquet(path))


def read_catalog(spark, d):
    """Map files of at most ``CHUNK`` databases each."""
    path = scratch_path(spark, "maps")
    nested = catalog.nest_catalog(t.full_columns(spark, d))
    shard = F.floor(F.substring("db", 2, 30).cast("bigint") / CHUNK).alias("shard")
    maps = nested.groupBy(shard).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("db", "tables")))).alias("value")
    )
    maps.write.partitionBy("shard").text(path, compression="gzip")
    return readers.read_catalog(spark, f"{path}/*")


def read_split_family(spark, d):
    """Orders by status: training, test, and a test variant; synthetic ones by priority."""
    root = scratch_path(spark, "family")
    status = t.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("qid"), "o_orderstatus", "o_orderpriority"
    )
    rows = t.instances(spark, d).join(status, "qid")
    at = F.col("o_orderstatus")
    for condition, folder in (
        (at == "F", "shop/train.json"),
        (at == "O", "shop/test.json"),
        (at == "P", "shop_p/test.json"),
        (F.col("o_orderpriority") == "1-URGENT", "shop/synthetic.json"),
    ):
        rows.where(condition).drop("o_orderstatus", "o_orderpriority").write.json(f"{root}/{folder}")
    family = readers.read_split_family(spark, root, "shop", "all", multi_line=False)
    return _flat(family, "split", "variant")


def read_metrics_tree(spark, d):
    """One metrics file per market segment and nation."""
    root = scratch_path(spark, "metrics")
    customers = t.load(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.max(F.floor("c_acctbal")).alias("best")
    )
    customers.select(
        "c_mktsegment", "c_nationkey", F.to_json(F.struct("customers", "best")).alias("value")
    ).repartition("c_mktsegment", "c_nationkey").write.partitionBy("c_mktsegment", "c_nationkey").text(root)
    return readers.read_metrics_tree(spark, root, "part-*")


def write_gold_tsv(spark, d):
    path = scratch_path(spark, "gold")
    writers.write_gold_tsv(t.statements(spark, d), path)
    return spark.read.text(path)


def write_predictions_by_split(spark, d):
    path = scratch_path(spark, "predictions")
    orders = t.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("qid"), F.concat(F.lit("test_"), F.lower("o_orderstatus")).alias("split")
    )
    writers.write_predictions_by_split(retrieval.beam_predictions(spark, d).join(orders, "qid"), path)
    back = spark.read.schema(
        "qid bigint, pred_schemas array<struct<database:string,tables:array<string>>>, split string"
    ).json(path)
    return back.select(
        "split", "qid", F.array_join(F.transform("pred_schemas", lambda s: s["database"]), ",").alias("dbs")
    )


def pred_sql_lines(spark, d):
    rows = t.statements(spark, d)
    return writers.scored_sql_lines(rows.select("qid", "sql"), rows.select("qid", "db"))


QUERIES = {
    f.__name__: f
    for f in (
        read_instances,
        read_jsonl,
        read_catalog,
        read_split_family,
        read_metrics_tree,
        write_instances,
        write_gold_tsv,
        write_predictions_by_split,
        pred_sql_lines,
    )
}

from routewright.plans.catalog import STATEMENTS  # noqa: E402

_INST = f"""WITH {t.LINES}, {STATEMENTS}, {t.GOLD},
g AS (SELECT qid, string_agg(tbl, ',' ORDER BY tbl_pos) AS tables
  FROM (SELECT DISTINCT qid, tbl, tbl_pos FROM gold) GROUP BY qid),
inst AS (SELECT qid, question, sql, db, coalesce(tables, '') AS tables FROM stm LEFT JOIN g USING (qid))"""
_FLAT = f"{_INST} SELECT qid, question, sql, db, tables FROM inst"

ORACLE = {
    "read_instances": _FLAT,
    "read_jsonl": _FLAT,
    "write_instances": _FLAT,
    "read_catalog": f"""WITH {t.CATALOG}
SELECT db, tbl_pos, tbl, tbl_norm,
  row_number() OVER (PARTITION BY db, tbl_pos ORDER BY col_pos) - 1 AS col_pos, col, col_norm, type,
  pk_pos IS NOT NULL AS is_pk, fk_tbl, fk_col FROM cat""",
    "read_split_family": f"""{_INST},
o AS (SELECT inst.*, o_orderstatus AS s, o_orderpriority AS p FROM inst JOIN orders ON o_orderkey = qid)
SELECT 'train' AS split, 'shop' AS variant, qid, question, sql, db, tables FROM o WHERE s = 'F'
UNION ALL SELECT 'train', 'shop', qid, question, sql, db, tables FROM o WHERE p = '1-URGENT'
UNION ALL SELECT 'test', 'shop', qid, question, sql, db, tables FROM o WHERE s = 'O'
UNION ALL SELECT 'test_p', 'shop_p', qid, question, sql, db, tables FROM o WHERE s = 'P'""",
    "read_metrics_tree": """WITH c AS (
  SELECT c_mktsegment AS m, c_nationkey AS n, count(*) AS customers, max(floor(c_acctbal))::BIGINT AS best
  FROM customer GROUP BY ALL)
SELECT 'c_mktsegment=' || m || '/c_nationkey=' || n AS run, unnest(['customers', 'best']) AS key,
  unnest([customers, best])::VARCHAR AS value FROM c""",
    "write_gold_tsv": f"WITH {t.LINES}, {STATEMENTS} SELECT sql || chr(9) || db AS value FROM stm",
    "write_predictions_by_split": f"""{retrieval._beams_sql()}
SELECT 'test_' || lower(o_orderstatus) AS split, qid, string_agg(db, ',' ORDER BY seen) AS dbs
FROM lst JOIN orders ON o_orderkey = qid GROUP BY o_orderstatus, qid""",
    "pred_sql_lines": f"""WITH {t.LINES}, {STATEMENTS}
SELECT qid, sql || chr(10) || chr(9) || '----- bird -----' || chr(9) || db AS line FROM stm""",
}
