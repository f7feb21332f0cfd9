"""Catalog and labelling queries over the order dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.functions.text import normalise_name
from routewright.operators import catalog as c
from routewright.operators import labelling
from routewright.plans import tables as t


def catalog_flatten(spark, d):
    return c.flatten_dump(t.schema_dump(spark, d), type_offset=1).drop("type")


def catalog_lower(spark, d):
    low = c.lower_dump(t.schema_dump(spark, d))
    return low.select(
        F.col("db_id").alias("db"),
        F.array_join("table_names_original", ",").alias("tables"),
        F.array_join(F.transform("column_names_original", lambda x: F.get(x, F.lit(1))), ",").alias(
            "columns"
        ),
    )


def column_type_align(spark, d):
    return c.flatten_dump(t.schema_dump(spark, d), type_offset=1).select("db", "col_pos", "type")


def pk_flatten(spark, d):
    return c.primary_keys(t.schema_dump(spark, d))


def fk_declared(spark, d):
    return c.declared_keys(t.schema_dump(spark, d))


def fk_inferred(spark, d):
    raw = t.schema_dump(spark, d)
    columns = t.plain_columns(spark, d).join(c.primary_keys(raw), ["db", "col_pos"], "left")
    return c.inferred_keys(columns)


def catalog_build(spark, d):
    return t.full_columns(spark, d)


def catalog_nested(spark, d):
    nested = c.nest_catalog(t.full_columns(spark, d))
    return nested.select(
        "db",
        F.array_join(
            F.transform(
                "tables",
                lambda x: F.concat(
                    x["name"], F.lit("("), F.array_join(F.transform(x["columns"], lambda y: y["name"]), ","), F.lit(")")
                ),
            ),
            ";",
        ).alias("tables"),
    )


def name_normalise(spark, d):
    """Part and customer names in camel, snake and dotted form."""
    parts = t.load(spark, d, "part").select(
        F.concat(F.initcap("p_name"), F.lit("Of"), F.col("p_brand"), F.lit("_"), "p_type").alias("name")
    )
    customers = t.load(spark, d, "customer").select(
        F.concat("c_name", F.lit("."), "c_mktsegment", F.lit("-Segment")).alias("name")
    )
    return parts.unionByName(customers).select("name", normalise_name(F.col("name")).alias("words"))


def _raw_records(spark, d):
    rows = t.statements(spark, d)
    return rows.select(
        F.col("db").alias("db_id"),
        F.concat(F.lit("  "), "question", F.lit("\n")).alias("question"),
        F.concat("sql", F.lit(" ")).alias("query"),
        F.split("sql", " ").alias("query_toks"),
        F.split("sql", " ").alias("query_toks_no_value"),
        F.split("question", " ").alias("question_toks"),
    )


def instance_reshape(spark, d):
    return c.reshape_records(_raw_records(spark, d), "finance")


def _checked(spark, d):
    """Orders without returns have no SQL; some databases are renamed away, some quotes cut."""
    rows = t.statements(spark, d).select(
        "qid",
        F.when(F.col("qid") % 7 == 3, F.concat(F.lit("x"), "db")).otherwise(F.col("db")).alias("db"),
        F.when(F.col("qid") % 5 == 1, F.regexp_replace("sql", "'$", "")).otherwise(F.col("sql")).alias("sql"),
    )
    return c.split_bad_records(rows, t.plain_columns(spark, d))


def quarantine_bad_rows(spark, d):
    good, bad = _checked(spark, d)
    return good.withColumn("reason", F.lit("ok")).unionByName(bad)


def sql_mentions(spark, d):
    return labelling.sql_mentions(t.statements(spark, d).select("qid", "db", "sql"), t.plain_columns(spark, d))


def sql_mentions_shapes(spark, d):
    """Sixteen ways to write the statements, from quoted names to nested queries."""
    return labelling.sql_mentions(t.shaped_statements(spark, d), t.plain_columns(spark, d))


def labelled_instances(spark, d):
    nested = labelling.instances(t.statements(spark, d), sql_mentions(spark, d))
    return nested.select(
        "qid",
        "question",
        "sql",
        F.col("schema.database").alias("db"),
        F.array_join(
            F.transform(
                "schema.metadata",
                lambda x: F.concat(x["name"], F.lit("("), F.array_join(x["columns"], ","), F.lit(")")),
            ),
            ";",
        ).alias("metadata"),
    )


def gold_only_columns(spark, d):
    return c.gold_columns(t.plain_columns(spark, d), t.gold_mentions(spark, d)).select(
        "db", "tbl", "col_pos", "col", "type"
    )


QUERIES = {
    f.__name__: f
    for f in (
        catalog_flatten,
        catalog_lower,
        column_type_align,
        pk_flatten,
        fk_declared,
        fk_inferred,
        catalog_build,
        catalog_nested,
        name_normalise,
        instance_reshape,
        quarantine_bad_rows,
        sql_mentions,
        sql_mentions_shapes,
        labelled_instances,
        gold_only_columns,
    )
}

# statements of the orders, as text
STATEMENTS = """
stm AS (
  SELECT ok AS qid, 'o' || ok AS db, 'Which lines of order ' || ok || ' came back?' AS question,
    CASE WHEN count(*) FILTER (rf = 'R') = 0 THEN '' ELSE
      'SELECT count(*)' || coalesce(string_agg(', S' || sk || '.RF AS x', '' ORDER BY j)
        FILTER (rf = 'R' AND ls = 'F'), '')
      || ' FROM ' || (string_agg('S' || sk, ' JOIN ' ORDER BY j) FILTER (rf = 'R' AND fst))
      || ' WHERE note <> ''RO from S0''' END AS sql
  FROM (SELECT *, row_number() OVER (PARTITION BY ok, sk, rf = 'R' ORDER BY j) = 1 AS fst FROM lines)
  GROUP BY ok)"""

# suppliers with returned lines are mentioned; only RF is a mentioned column, if any is
MENTIONS = """
hasf AS (SELECT DISTINCT ok FROM lines WHERE rf = 'R' AND ls = 'F'),
mt AS (SELECT DISTINCT ok, db, tbl_pos, tbl FROM cols WHERE col LIKE 'r%'),
ment AS (
  SELECT mt.ok AS qid, mt.db, mt.tbl_pos, mt.tbl, c.col_pos, c.col
  FROM mt LEFT JOIN (SELECT * FROM cols JOIN hasf USING (ok) WHERE col = 'rf') c
    ON c.db = mt.db AND c.tbl = mt.tbl)"""

ORACLE = {
    "catalog_flatten": f"""WITH {t.LINES}
SELECT db, tbl_pos, tbl, tbl_norm, col_pos, col, col_norm FROM cols""",
    "catalog_lower": f"""WITH {t.LINES},
tb AS (SELECT db, string_agg(tbl, ',' ORDER BY tbl_pos) AS tables
  FROM (SELECT DISTINCT db, tbl, tbl_pos FROM cols) GROUP BY db),
cl AS (SELECT db, '*,' || string_agg(col, ',' ORDER BY col_pos) AS columns FROM cols GROUP BY db)
SELECT db, tables, columns FROM tb JOIN cl USING (db)""",
    "column_type_align": f"WITH {t.LINES} SELECT db, col_pos, type FROM cols",
    "pk_flatten": f"""WITH {t.LINES}
SELECT db, col_pos, pk_pos::INT AS pk_pos FROM cols WHERE pk_pos IS NOT NULL""",
    "fk_declared": f"""WITH {t.LINES}
SELECT c.db, c.col_pos, d.tbl AS fk_tbl, d.col AS fk_col
FROM cols c JOIN cols d ON d.db = c.db AND d.col_pos = c.fk_to""",
    "fk_inferred": f"""WITH {t.LINES}
SELECT a.db, a.col_pos, arg_min(p.tbl, p.pk_pos) AS fk_tbl, arg_min(p.col, p.pk_pos) AS fk_col
FROM cols a JOIN cols p ON p.db = a.db AND p.col = a.col AND p.col_pos <> a.col_pos
WHERE p.pk_pos IS NOT NULL AND p.col <> 'id' GROUP BY a.db, a.col_pos""",
    "catalog_build": f"""WITH {t.CATALOG}
SELECT db, tbl_pos, tbl, tbl_norm, col_pos, col, col_norm, type, pk_pos IS NOT NULL AS is_pk,
  fk_tbl, fk_col FROM cat""",
    "catalog_nested": f"""WITH {t.LINES},
tb AS (SELECT db, tbl_pos, tbl || '(' || string_agg(col, ',' ORDER BY col_pos) || ')' AS s
  FROM cols GROUP BY db, tbl_pos, tbl)
SELECT db, string_agg(s, ';' ORDER BY tbl_pos) AS tables FROM tb GROUP BY db""",
    "name_normalise": r"""WITH n AS (
  SELECT array_to_string(list_transform(string_split(p_name, ' '),
      lambda w: upper(w[1]) || lower(w[2:])), ' ') || 'Of' || p_brand || '_' || p_type AS name FROM part
  UNION ALL SELECT c_name || '.' || c_mktsegment || '-Segment' FROM customer)
SELECT name, lower(trim(regexp_replace(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'),
  '[_\-./\s]+', ' ', 'g'))) AS words FROM n""",
    "instance_reshape": f"WITH {t.LINES}, {STATEMENTS} SELECT db, question, trim(sql) AS sql FROM stm",
    "quarantine_bad_rows": f"""WITH {t.LINES}, {STATEMENTS},
x AS (SELECT qid, CASE WHEN qid % 7 = 3 THEN 'x' || db ELSE db END AS db,
  CASE WHEN qid % 5 = 1 THEN regexp_replace(sql, '''$', '') ELSE sql END AS sql FROM stm)
SELECT *, CASE WHEN sql = '' THEN 'empty sql' WHEN qid % 5 = 1 THEN 'open quote'
  WHEN qid % 7 = 3 THEN 'unknown database' ELSE 'ok' END AS reason FROM x""",
    "sql_mentions": f"WITH {t.LINES}, {MENTIONS} SELECT * FROM ment",
    "sql_mentions_shapes": f"WITH {t.LINES}, {MENTIONS} SELECT * FROM ment",
    "labelled_instances": f"""WITH {t.LINES}, {STATEMENTS}, {MENTIONS},
tb AS (SELECT qid, tbl_pos, tbl || '(' || coalesce(string_agg(col, ',' ORDER BY col_pos), '') || ')' AS s
  FROM ment GROUP BY qid, tbl_pos, tbl),
q AS (SELECT qid, string_agg(s, ';' ORDER BY tbl_pos) AS metadata FROM tb GROUP BY qid)
SELECT qid, question, sql, db, coalesce(metadata, '') AS metadata FROM stm LEFT JOIN q USING (qid)""",
    "gold_only_columns": f"""WITH {t.LINES}
SELECT db, tbl, col_pos, col, type FROM cols WHERE (db, tbl, col) IN (
  SELECT (db, tbl, col) FROM cols WHERE col LIKE 'r%')""",
}
