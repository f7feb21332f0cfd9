"""The test tables in the roles the operators expect, and the same roles in SQL.

Catalog: every order is a database, its suppliers are the tables and its lines
the columns. A schema dump is built per order (an order has a handful of
lines), so the catalog grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routewright.functions.text import tokens
from routewright.operators import catalog, graph, labelling
from routewright.session import cut_lineage, spread

SEP = "<sep>"
# A conversation's turns are numbered below this.
TURNS = 1 << 32


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _lines_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        "l_tax",
    )
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))


def schema_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dumps with parallel arrays; types omit ``*`` (offset 1).

    Written first, as a dump is a file: its arrays are then read, not rebuilt
    for every lookup.
    """
    orders = _lines_by_order(spark, sf_dir).withColumn(
        "ss", F.array_sort(F.array_distinct(F.transform("ls", lambda x: x["l_suppkey"])))
    )
    star = F.array(F.array(F.lit("-1"), F.lit("*")))

    def at(x):
        return (F.array_position("ss", x["l_suppkey"]) - 1).cast("string")

    n = F.size("ls")
    numbered = F.transform("ls", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("j")))
    declared = F.filter(numbered, lambda y: y["x"]["l_returnflag"] == "N")
    again = F.filter(declared, lambda y: y["x"]["l_linestatus"] == "F")
    dump = orders.select(
        _text("o", F.col("l_orderkey")).alias("db_id"),
        F.transform("ss", lambda s: _text("S", s)).alias("table_names_original"),
        F.transform("ss", lambda s: _text("supplier ", s)).alias("table_names"),
        F.concat(
            star,
            F.transform(
                "ls", lambda x: F.array(at(x), F.concat(x["l_returnflag"], x["l_linestatus"]))
            ),
        ).alias("column_names_original"),
        F.concat(
            star, F.transform("ls", lambda x: F.array(at(x), _text("part ", x["l_partkey"])))
        ).alias("column_names"),
        F.transform(
            "ls", lambda x: F.when(x["l_tax"] > 0.04, "number").otherwise("text")
        ).alias("column_types"),
        F.when(n >= 3, F.array(F.lit("1"), F.lit("[2, 3]")))
        .otherwise(F.array(F.lit("1")))
        .alias("primary_keys"),
        F.concat(
            F.transform(declared, lambda y: F.array(y["j"], F.lit(1))),
            F.transform(again, lambda y: F.array(y["j"], F.least(n, F.lit(2)))),
        ).alias("foreign_keys"),
    )
    return keep(dump)


def plain_columns(spark: SparkSession, sf_dir: str, dump: DataFrame | None = None) -> DataFrame:
    """Flat columns without keys, of a dump that is there already or a new one."""
    return catalog.flatten_dump(schema_dump(spark, sf_dir) if dump is None else dump, type_offset=1)


def full_columns(spark: SparkSession, sf_dir: str, dump: DataFrame | None = None) -> DataFrame:
    """Flat columns with primary and foreign keys, of a dump that is there already or a new one."""
    return catalog.build_catalog(schema_dump(spark, sf_dir) if dump is None else dump, type_offset=1)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clique_members(full_columns(spark, sf_dir))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, db, question, sql): one question per order, SQL over its returned lines."""
    orders = _lines_by_order(spark, sf_dir)
    back = F.filter("ls", lambda x: x["l_returnflag"] == "R")
    names = F.transform(
        F.filter(back, lambda x: x["l_linestatus"] == "F"),
        lambda x: F.concat(_text("S", x["l_suppkey"]), F.lit(".RF AS x")),
    )
    suppliers = F.array_distinct(F.transform(back, lambda x: _text("S", x["l_suppkey"])))
    sql = F.concat(
        F.lit("SELECT "),
        F.array_join(F.concat(F.array(F.lit("count(*)")), names), ", "),
        F.lit(" FROM "),
        F.array_join(suppliers, " JOIN "),
        F.lit(" WHERE note <> 'RO from S0'"),
    )
    return orders.select(
        F.col("l_orderkey").alias("qid"),
        _text("o", F.col("l_orderkey")).alias("db"),
        F.concat(
            F.lit("Which lines of order "), F.col("l_orderkey").cast("string"), F.lit(" came back?")
        ).alias("question"),
        F.when(F.size(back) > 0, sql).otherwise("").alias("sql"),
    )


def shaped_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, db, sql): the same mentions in the ways SQL can write them, by turns."""
    back = F.filter("ls", lambda x: x["l_returnflag"] == "R")
    named = F.exists(back, lambda x: x["l_linestatus"] == "F")
    orders = _lines_by_order(spark, sf_dir).select(
        F.col("l_orderkey").alias("qid"),
        F.array_distinct(F.transform(back, lambda x: _text("S", x["l_suppkey"]))).alias("ss"),
        F.when(named, "SELECT count(*), RF").otherwise("SELECT count(*)").alias("pick"),
    )
    one, rest = F.get("ss", F.lit(0)), F.slice("ss", 2, F.size("ss"))

    def listed(of, before: str, after: str = "") -> F.Column:
        """Each name between ``before`` and ``after``, one after another."""
        return F.array_join(F.transform(of, lambda s: F.concat(F.lit(before), s, F.lit(after))), "")

    def sql(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    pick = F.col("pick")
    shapes = [
        sql(pick, " FROM ", one, listed(rest, " JOIN ")),
        sql(pick, " FROM ", one, listed(rest, ", ")),
        sql(pick, " FROM (SELECT * FROM ", one, ") x", listed(rest, ", ")),
        sql(pick, " FROM S0x JOIN ", one, " ON S0x.k = k", listed(rest, ", ")),
        sql(pick, ' FROM "', one, '"', listed(rest, ' JOIN "', '"')),
        sql(pick, " FROM `", one, "`", listed(rest, ", `", "`")),
        sql(pick, " FROM [", one, "]", listed(rest, " CROSS JOIN [", "]")),
        sql(pick, " FROM main.", one, listed(rest, ", main . ")),
        sql(pick, " -- it's from S0\n FROM ", one, listed(rest, ", "), " WHERE n = 'x'"),
        sql(pick, " /* don't read\n from S0 */ FROM ", one, listed(rest, " NATURAL LEFT JOIN ")),
        sql("WITH c AS (SELECT * FROM ", one, ") ", pick, " FROM c", listed(rest, ", ")),
        sql(pick, " FROM ", one, " WHERE k IN (SELECT k FROM x", listed(rest, " JOIN "), ")"),
        sql(pick, " FROM ", one, " AS a", listed(rest, " INNER JOIN ", " b ON a.k = b.k")),
        sql(pick, " FROM ", one, listed(rest, " UNION SELECT 1 FROM ")),
        sql(pick, " FROM ", one, listed(rest, ", "), " WHERE n = 'it''s FROM S0 JOIN S9'"),
        sql(pick, " FROM ((SELECT * FROM (SELECT 1 FROM ", one, ") y)) x",
            listed(rest, " LEFT OUTER JOIN ", " USING (k)")),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("qid") % len(shapes) + 1).cast("int"))
    return orders.select(
        "qid",
        _text("o", F.col("qid")).alias("db"),
        F.when(F.size("ss") > 0, shape).otherwise("").alias("sql"),
    )


def mentioned(columns: DataFrame) -> DataFrame:
    """(qid, db, tbl_pos, tbl, col_pos, col): the returned lines of each order, out of all columns."""
    return columns.where(F.col("col").startswith("r")).select(
        F.substring("db", 2, 30).cast("bigint").alias("qid"),
        "db",
        "tbl_pos",
        "tbl",
        "col_pos",
        "col",
    )


def gold_mentions(spark: SparkSession, sf_dir: str, dump: DataFrame | None = None) -> DataFrame:
    return mentioned(plain_columns(spark, sf_dir, dump))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, db): every order that has lines."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return lines.select(
        F.col("l_orderkey").alias("qid"), _text("o", F.col("l_orderkey")).alias("db")
    )


def instances(spark: SparkSession, sf_dir: str, dump: DataFrame | None = None) -> DataFrame:
    return labelling.instances(statements(spark, sf_dir), gold_mentions(spark, sf_dir, dump))


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, beam, text): one decoded string per line of an order."""
    named = F.transform(
        "ls",
        lambda x, i: F.struct(
            i.alias("beam"),
            F.concat(
                F.lit("<s> "),
                F.when(x["l_returnflag"] == "N", _text("o", F.col("l_orderkey"))).otherwise(
                    _text("o", x["l_partkey"])
                ),
                F.lit(SEP + " "),
                _text("s", x["l_suppkey"]),
                F.lit(SEP),
                _text("s", x["l_linenumber"]),
                F.lit("</s><pad>"),
            ).alias("text"),
        ),
    )
    return _lines_by_order(spark, sf_dir).select(F.col("l_orderkey").alias("qid"), F.inline(named))


def ranked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run(method, qid, db, doc_id, rank): suppliers of an order by price and by quantity.

    The database of a supplier is its nation.
    """
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_partkey"
    )
    nations = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), _text("n", F.col("s_nationkey")).alias("db")
    )
    both = F.array(
        F.struct(F.lit("price").alias("method"), F.col("l_extendedprice").alias("score")),
        F.struct(F.lit("quantity").alias("method"), F.col("l_quantity").alias("score")),
    )
    rows = lines.join(nations, "l_suppkey").select(
        F.inline(both), F.col("l_orderkey").alias("qid"), "db", "l_suppkey", "l_partkey"
    )
    order = Window.partitionBy("method", "qid").orderBy(
        F.desc("score"), "l_suppkey", "l_partkey"
    )
    return rows.withColumn("rank", F.row_number().over(order)).select(
        "method", "qid", "db", _text("s", F.col("l_suppkey")).alias("doc_id"), "rank", "score"
    )


def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and a third method: by price, with the supplier's region as its database."""
    runs = ranked_runs(spark, sf_dir)
    regions = (
        load(spark, sf_dir, "supplier")
        .join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(_text("s", F.col("s_suppkey")).alias("doc_id"), _text("r", F.col("n_regionkey")).alias("db"))
    )
    by_price = runs.where("method = 'price'").drop("db").join(regions, "doc_id")
    third = by_price.withColumn("method", F.lit("region")).select(*runs.columns)
    return runs.unionByName(third)


def ranked_databases(run: DataFrame) -> DataFrame:
    """run(method, qid, doc_id, rank) over databases, in first-seen order."""
    seen = run.groupBy("method", "qid", "db").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("method", "qid").orderBy("first")
    return seen.select(
        "method", "qid", F.col("db").alias("doc_id"), F.row_number().over(order).alias("rank")
    )


def returned_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, db, doc_id): all returned suppliers of the order; the nation is the database."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("qid"), "l_suppkey"
    )
    suppliers = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"
    )
    return (
        lines.join(suppliers, "l_suppkey")
        .distinct()
        .select(
            "qid",
            _text("n", F.col("s_nationkey")).alias("db"),
            _text("s", F.col("l_suppkey")).alias("doc_id"),
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs(doc_id, db, text): the source is the database."""
    docs = load(spark, sf_dir, "documents")
    return spread(docs.select("doc_id", F.col("source").alias("db"), "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


# Words in a row that tell a passage.
SHINGLE = 8


def _runs(words: F.Column, n: F.Column) -> F.Column:
    """All runs of n words, built inside the row, so no text is copied per run."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def text_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id): documents that share a run of eight words with an item.

    An item of fewer words is one run.
    """
    items = (
        questions(spark, sf_dir)
        .select("qid", tokens(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("n", F.least(F.size("w"), F.lit(SHINGLE)))
    )
    passages = items.select("qid", F.explode(_runs(F.col("w"), F.col("n"))).alias("s")).distinct()
    # At most SHINGLE different lengths.
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())
    texts = documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("w"))
    length = F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")
    runs = (
        texts.select("doc_id", "w", length)
        .where(F.size("w") >= F.col("n"))
        .select("doc_id", F.explode(_runs(F.col("w"), F.col("n"))).alias("s"))
    )
    return runs.join(passages, "s").select("qid", "doc_id").distinct()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, segments): the sentences of each item."""
    parts = F.filter(F.split("text", r"[.\n]+"), lambda s: F.trim(s) != "")
    return questions(spark, sf_dir).select("qid", parts.alias("segments"))


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(text_id, pos, vec, mask): a label is a text, its vectors are the tokens.

    The mask leaves out vectors with a small first component.
    """
    return load(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("text_id"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vec"),
        F.when(F.get("embedding", F.lit(0)).cast("double") > -0.2, 1).otherwise(0).alias("mask"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls(call_id, model, prompt_tokens, completion_tokens): one per conversation."""
    n = F.size(tokens(F.col("text")))
    reply = F.col("role") == "assistant"
    per_conv = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(~reply, n).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(reply, n).otherwise(0)).alias("completion_tokens"),
        F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("s"),
        F.count(F.lit(1)).alias("turns"),
    )
    model = (
        F.when(F.col("s") == 1, "gpt-4")
        .when(F.col("turns") > 4, "gpt-3.5-turbo-instruct")
        .otherwise("gpt-3.5-turbo")
    )
    return per_conv.select(
        F.col("conv_id").alias("call_id"), model.alias("model"), "prompt_tokens", "completion_tokens"
    )


# ---- the same roles as SQL fragments (common table expressions) ----

LINES = """
lines AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf,
         l_linestatus AS ls, l_tax AS tax, l_linenumber AS ln,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS j,
         dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS t,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
cols AS (
  SELECT ok, 'o' || ok AS db, t AS tbl_pos, 's' || sk AS tbl, 'supplier ' || sk AS tbl_norm,
         j AS col_pos, lower(rf || ls) AS col, 'part ' || pk AS col_norm,
         CASE WHEN tax > 0.04 THEN 'number' ELSE 'text' END AS type,
         CASE WHEN j = 1 THEN 0 WHEN n >= 3 AND j IN (2, 3) THEN j - 1 END AS pk_pos,
         CASE WHEN rf = 'N' THEN CASE WHEN ls = 'F' THEN least(n, 2) ELSE 1 END END AS fk_to
  FROM lines)"""

CATALOG = (
    LINES
    + """,
cat AS (
  SELECT c.*, coalesce(d.tbl, i.tbl) AS fk_tbl, coalesce(d.col, i.col) AS fk_col
  FROM cols c
  LEFT JOIN cols d ON d.db = c.db AND d.col_pos = c.fk_to
  LEFT JOIN (
    SELECT a.db, a.col_pos, arg_min(p.tbl, p.pk_pos) AS tbl, arg_min(p.col, p.pk_pos) AS col
    FROM cols a JOIN cols p
      ON p.db = a.db AND p.col = a.col AND p.col_pos <> a.col_pos AND p.col <> 'id'
    WHERE p.pk_pos IS NOT NULL
    GROUP BY a.db, a.col_pos) i ON i.db = c.db AND i.col_pos = c.col_pos),
memb0 AS (
  SELECT DISTINCT db, fk_tbl || '.' || fk_col AS key, unnest([tbl, fk_tbl]) AS tbl
  FROM cat WHERE fk_tbl IS NOT NULL),
memb AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY db, key) AS size FROM memb0) WHERE size > 1)"""
)

GOLD = """
gold AS (
  SELECT ok AS qid, db, tbl_pos, tbl, col_pos, col FROM cols WHERE col LIKE 'r%')"""

RUNS = """
scored AS (
  SELECT m.method, l_orderkey AS qid, 'n' || s_nationkey AS db, l_suppkey, l_partkey,
         CASE m.method WHEN 'price' THEN l_extendedprice ELSE l_quantity END AS score
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey,
       (VALUES ('price'), ('quantity')) m(method)),
runs AS (
  SELECT method, qid, db, 's' || l_suppkey AS doc_id, score, row_number() OVER (PARTITION BY method, qid
    ORDER BY score DESC, l_suppkey, l_partkey) AS rank FROM scored),
first AS (
  SELECT method, qid, doc_id, min(db) AS db, min(rank) AS rank FROM runs GROUP BY ALL),
dbfirst AS (
  SELECT method, qid, db AS doc_id,
         row_number() OVER (PARTITION BY method, qid ORDER BY min(rank)) AS rank
  FROM runs GROUP BY method, qid, db),
rel AS (
  SELECT DISTINCT l_orderkey AS qid, 'n' || s_nationkey AS db, 's' || l_suppkey AS doc_id
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'),
dbrel AS (SELECT DISTINCT qid, db AS doc_id FROM rel)"""

WORDS = r"""list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""


def words(text: str) -> str:
    return WORDS.format(text=text)


BM25 = f"""
tok AS (SELECT doc_id, source AS db, unnest({words('text')}) AS term FROM documents),
post AS (SELECT doc_id, db, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, len({words('text')}) AS n FROM documents),
st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM len),
dfs AS (SELECT term, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf
        FROM post, st GROUP BY term, n_docs)"""


def bm25_run(queries: str, keys: str, k: int, k1: float = 1.2, b: float = 0.75) -> str:
    """``run`` of the queries CTE (keys…, text)."""
    return f"""
qt AS (SELECT {keys}, term, count(*) AS qtf FROM (
  SELECT {keys}, unnest({words('text')}) AS term FROM {queries}) GROUP BY ALL),
sc AS (
  SELECT {keys}, doc_id, db, round(sum(qtf * idf * tf * ({k1} + 1)
    / (tf + {k1} * (1 - {b} + {b} * n / avg_len))), 6) AS score
  FROM qt JOIN dfs USING (term) JOIN post USING (term) JOIN len USING (doc_id), st
  GROUP BY {keys}, doc_id, db),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


def slots_sql(least: int) -> str:
    """A clique's members side by side with those that share the same smaller keys."""
    return f"""
meets AS (SELECT a.db, a.key, a.tbl, b.key AS low FROM memb a JOIN memb b USING (db, tbl) WHERE b.key < a.key),
shared AS (SELECT db, key, low FROM meets GROUP BY ALL HAVING count(*) >= {least}),
lows AS (SELECT db, key, tbl, list(low ORDER BY low) AS low FROM meets JOIN shared USING (db, key, low) GROUP BY db, key, tbl),
slots AS (SELECT memb.db, memb.key, memb.tbl, row_number() OVER (PARTITION BY memb.db, memb.key
    ORDER BY coalesce(low, []), substr(md5(memb.tbl), 1, 2), memb.tbl) - 1 AS slot
  FROM memb LEFT JOIN lows USING (db, key, tbl))"""


BENCH = "bench AS (SELECT item_id AS qid, text FROM benchmark)"

TEXT_REL = f"""
iw AS (SELECT qid, w, least(len(w), {SHINGLE}) AS k FROM (
  SELECT item_id AS qid, {words('text')} AS w FROM benchmark) WHERE len(w) > 0),
passages AS (SELECT DISTINCT qid, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM iw)),
dw AS (SELECT doc_id, {words('text')} AS w FROM documents),
grams AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM dw, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
trel AS (SELECT DISTINCT qid, doc_id FROM grams JOIN passages USING (s))"""

SEGMENTS = r"""
seg0 AS (
  SELECT qid, seg, min(i) AS i FROM (
    SELECT qid, unnest(parts) AS seg, generate_subscripts(parts, 1) AS i FROM (
      SELECT item_id AS qid, list_filter(regexp_split_to_array(text, '[.\n]+'),
        lambda x: trim(x, ' ') <> '') AS parts FROM benchmark)) GROUP BY qid, seg),
seg AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS sid, seg FROM seg0),
segq AS (SELECT s.qid, sid, b.text || ' ' || seg AS text FROM seg s JOIN benchmark b ON b.item_id = s.qid)"""

DRAW = "('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296::DOUBLE"


def draw(key: str) -> str:
    return DRAW.format(key=key)


POOLED = """
pooled AS (
  SELECT label AS qid, d AS dim, avg(x) AS x FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d
    FROM embeddings WHERE embedding[1]::DOUBLE > -0.2) GROUP BY ALL),
qvec AS (SELECT qid, list(x ORDER BY dim) AS vec FROM pooled GROUP BY qid)"""


def keep(df: DataFrame) -> DataFrame:
    """Hold a shared intermediate result once, reliably."""
    return cut_lineage(df)
