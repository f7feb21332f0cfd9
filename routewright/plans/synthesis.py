"""Synthetic schema queries: histograms, walks, draws, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import graph as g
from routewright.operators import synth as s
from routewright.plans import tables as t

# Parameters of the weighted walks: weight 1 / RETURN to go back, 1 / IN_OUT to go on.
RETURN, IN_OUT = 0.5, 2.0


def cardinality_histogram(spark, d):
    return s.cardinalities(t.instances(spark, d))


def max_tables(spark, d):
    return s.max_tables(t.instances(spark, d))


def _walks(spark, d, p: float = 1.0, q: float = 1.0, dump=None):
    """One walk per order; the walk length follows from the largest question."""
    dump = t.schema_dump(spark, d) if dump is None else dump
    walk_len = s.max_tables(t.instances(spark, d, dump)).first()["walk_len"]
    columns = t.keep(t.full_columns(spark, d, dump))
    starts = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("walk_id"))
    return s.random_walks(starts, columns, g.clique_members(columns), walk_len, p=p, q=q)


def random_walks(spark, d):
    return _walks(spark, d).select("walk_id", "db", F.array_join("path", ",").alias("path"))


def weighted_walks(spark, d):
    """Walks that rather return and stay near."""
    walks = _walks(spark, d, RETURN, IN_OUT)
    return walks.select("walk_id", "db", F.array_join("path", ",").alias("path"))


def _line_walks(spark, d):
    """The suppliers of an order in line order stand for a walk."""
    lines = t.load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ls")
    )
    key = F.col("l_orderkey")
    return lines.select(
        key.alias("walk_id"),
        F.concat(F.lit("o"), key.cast("string")).alias("db"),
        F.transform("ls", lambda x: F.concat(F.lit("s"), x["l_suppkey"].cast("string"))).alias("path"),
    )


def _joined(df):
    return df.select("walk_id", "db", F.array_join("tables", ",").alias("tables"))


def walk_dedupe(spark, d):
    return _joined(s.dedupe_walks(_line_walks(spark, d)))


def draw_table_count(spark, d):
    walks = s.dedupe_walks(_line_walks(spark, d))
    return _joined(s.truncate_walks(walks, cardinality_histogram(spark, d)))


def draw_columns(spark, d):
    walks, dump = s.dedupe_walks(_line_walks(spark, d)), t.schema_dump(spark, d)
    histogram = s.cardinalities(t.instances(spark, d, dump))
    return s.sample_columns(walks, t.plain_columns(spark, d, dump), histogram)


def assemble_synthetic(spark, d):
    """The whole chain: walks, truncation, columns, nested instances."""
    dump = t.schema_dump(spark, d)
    histogram = t.keep(s.cardinalities(t.instances(spark, d, dump)))
    walks = s.truncate_walks(s.dedupe_walks(_walks(spark, d, dump=dump)), histogram)
    drawn = s.sample_columns(walks, t.plain_columns(spark, d, dump), histogram)
    return s.assemble_synthetic(walks, drawn).select(
        "qid",
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


def train_validation_split(spark, d):
    docs = t.load(spark, d, "documents").select("doc_id", "source")
    return s.train_validation_split(docs, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        cardinality_histogram,
        max_tables,
        random_walks,
        weighted_walks,
        walk_dedupe,
        draw_table_count,
        draw_columns,
        assemble_synthetic,
        train_validation_split,
    )
}

_HIST = """
tsz AS (SELECT ok, count(DISTINCT tbl) FILTER (col LIKE 'r%') AS size FROM cols GROUP BY ok),
csz AS (SELECT ok, tbl, count(*) AS size FROM cols WHERE col LIKE 'r%' GROUP BY ok, tbl),
hist AS (SELECT 'table' AS what, size, count(*) AS n FROM tsz GROUP BY size
  UNION ALL SELECT 'column', size, count(*) FROM csz GROUP BY size),
steps AS (SELECT what, size, sum(n) OVER (PARTITION BY what ORDER BY size) AS hi,
  sum(n) OVER (PARTITION BY what) AS total FROM hist)"""


def _size(what: str, key: str) -> str:
    """Scalar subquery: the size drawn for a key."""
    x = f"floor({t.draw(key)} * total)"
    return f"(SELECT min(size) FROM steps WHERE what = '{what}' AND hi > {x})"


def _below(n: str, key: str) -> str:
    return f"floor({t.draw(key)} * {n})::BIGINT"


def _number(item: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"row_number() OVER ({part}ORDER BY substr(md5({item}), 1, 2), {item}) - 1"


def _walk(p: float = 1.0, q: float = 1.0) -> str:
    """Each walk draws a distinct neighbour by number: by first shared key, then by slot."""
    luck = t.draw("'walk|accept|' || walk_id || '|' || len(path) || '|' || attempt")
    return f"""
most AS (SELECT 2 * max(size) AS most FROM tsz),
tb AS (SELECT db, tbl, {_number('tbl', 'db')} AS tbl_no FROM (SELECT DISTINCT db, tbl FROM cols)),
dbs AS (SELECT db, n_tbl, {_number('db')} AS db_no, count(*) OVER () AS n_db
  FROM (SELECT db, count(*) AS n_tbl FROM tb GROUP BY db)),
{t.slots_sql(2)},
firsts AS (SELECT x.db, x.tbl, y.tbl AS nxt, min(x.key) AS key
  FROM memb x JOIN memb y USING (db, key) WHERE x.tbl <> y.tbl GROUP BY x.db, x.tbl, y.tbl),
nb AS (SELECT f.db, f.tbl, f.nxt, row_number() OVER (PARTITION BY f.db, f.tbl ORDER BY f.key, s.slot) - 1 AS place,
    count(*) OVER (PARTITION BY f.db, f.tbl) AS total
  FROM firsts f JOIN slots s ON s.db = f.db AND s.key = f.key AND s.tbl = f.nxt),
s0 AS (SELECT o_orderkey AS walk_id, {_below('n.n_db', "'walk|' || o_orderkey || '|db'")} AS db_no
  FROM orders, (SELECT count(*) AS n_db FROM dbs) n),
s1 AS (SELECT walk_id, tb.db, tb.tbl FROM s0 JOIN dbs USING (db_no)
  JOIN tb ON tb.db = dbs.db AND tb.tbl_no = {_below('dbs.n_tbl', "'walk|' || walk_id || '|tbl'")}),
walk AS (
  SELECT walk_id, db, tbl, NULL::VARCHAR AS prev, [tbl] AS path, 0 AS attempt FROM s1
  UNION ALL
  SELECT walk_id, db, CASE WHEN ok THEN nxt ELSE tbl END, CASE WHEN ok THEN tbl ELSE prev END,
    CASE WHEN ok THEN list_append(path, nxt) ELSE path END, CASE WHEN ok THEN 0 ELSE attempt + 1 END
  FROM (SELECT w.*, nb.nxt, w.luck * {max(1.0, 1 / p, 1 / q)} < CASE WHEN w.prev IS NULL THEN 1.0
      WHEN nb.nxt = w.prev THEN {1 / p} WHEN g.key IS NOT NULL THEN 1.0 ELSE {1 / q} END AS ok
    FROM (SELECT walk.*, {luck} AS luck,
        {_below('total', "'walk|' || walk_id || '|' || len(path) || '|' || attempt")} AS pick
      FROM walk JOIN (SELECT DISTINCT db, tbl, total FROM nb) USING (db, tbl), most WHERE len(path) < most) w
    JOIN nb ON nb.db = w.db AND nb.tbl = w.tbl AND nb.place = w.pick
    LEFT JOIN firsts g ON g.db = w.db AND g.tbl = w.prev AND g.nxt = nb.nxt)),
walked AS (SELECT walk_id, db, arg_max(path, len(path)) AS path FROM walk GROUP BY walk_id, db)"""


_WALK = _walk()

_LINE_WALK = """
visit AS (SELECT ok AS walk_id, db, tbl, min(col_pos) AS fst FROM cols GROUP BY ok, db, tbl),
vis AS (SELECT walk_id, db, tbl, row_number() OVER (PARTITION BY walk_id ORDER BY fst) - 1 AS pos FROM visit)"""

_COLS = f"""
cno AS (SELECT db, tbl, col, count(*) OVER (PARTITION BY db, tbl) AS n,
  row_number() OVER (PARTITION BY db, tbl ORDER BY substr(md5(col_pos::VARCHAR), 1, 2), col_pos) - 1 AS col_no FROM cols),
need AS (SELECT v.walk_id, v.db, v.pos, v.tbl, n,
    least(n, {_size('column', "'n_columns|' || v.walk_id || '|' || v.tbl")}) AS k
  FROM vis v JOIN (SELECT DISTINCT db, tbl, n FROM cno) USING (db, tbl)),
take AS (
  SELECT walk_id, db, pos, tbl, n, n - k AS j, []::BIGINT[] AS taken FROM need
  UNION ALL
  SELECT walk_id, db, pos, tbl, n, j + 1, list_append(taken, CASE WHEN list_contains(taken, r) THEN j ELSE r END)
  FROM (SELECT *, {_below('(j + 1)', "'column|' || walk_id || '|' || tbl || '|' || j")} AS r FROM take WHERE j < n)),
drawn AS (SELECT walk_id, db, pos, tbl, draw_pos, col FROM (
  SELECT walk_id, db, pos, tbl, unnest(taken) AS col_no, generate_subscripts(taken, 1) AS draw_pos
  FROM take WHERE j = n) JOIN cno USING (db, tbl, col_no))"""

_WITH = f"WITH RECURSIVE {t.CATALOG}, {_HIST}"

ORACLE = {
    "cardinality_histogram": f"WITH {t.LINES}, {_HIST} SELECT what, size::INT AS size, n FROM hist",
    "max_tables": f"""WITH {t.LINES}, {_HIST}
SELECT max(size)::INT AS max_tables, (2 + 2 * max(size))::INT AS walk_len FROM tsz""",
    "random_walks": f"{_WITH}, {_WALK} SELECT walk_id, db, array_to_string(path, ',') AS path FROM walked",
    "weighted_walks": f"{_WITH}, {_walk(RETURN, IN_OUT)} SELECT walk_id, db, array_to_string(path, ',') AS path FROM walked",
    "walk_dedupe": f"""WITH {t.LINES}, {_LINE_WALK}
SELECT walk_id, db, string_agg(tbl, ',' ORDER BY pos) AS tables FROM vis GROUP BY walk_id, db""",
    "draw_table_count": f"""WITH {t.LINES}, {_HIST}, {_LINE_WALK},
n AS (SELECT ok AS walk_id, {_size('table', "'n_tables|' || ok")} AS n FROM tsz)
SELECT walk_id, db, coalesce(string_agg(tbl, ',' ORDER BY pos) FILTER (pos < n), '') AS tables
FROM vis JOIN n USING (walk_id) GROUP BY walk_id, db""",
    "draw_columns": f"""WITH RECURSIVE {t.LINES}, {_HIST}, {_LINE_WALK}, {_COLS}
SELECT walk_id, db, pos::INT AS pos, tbl, draw_pos::INT AS draw_pos, col FROM drawn""",
    "assemble_synthetic": f"""{_WITH}, {_WALK},
visit AS (SELECT walk_id, db, tbl, min(i) AS fst FROM (
  SELECT walk_id, db, unnest(path) AS tbl, generate_subscripts(path, 1) AS i FROM walked) GROUP BY ALL),
n AS (SELECT walk_id, {_size('table', "'n_tables|' || walk_id")} AS n FROM walked),
vis AS (SELECT * EXCLUDE (n) FROM (
  SELECT walk_id, db, tbl, row_number() OVER (PARTITION BY walk_id ORDER BY fst) - 1 AS pos FROM visit)
  JOIN n USING (walk_id) WHERE pos < n), {_COLS},
tbs AS (SELECT v.walk_id, v.pos, v.tbl || '(' || coalesce(string_agg(d.col, ',' ORDER BY draw_pos), '') || ')' AS x
  FROM vis v LEFT JOIN drawn d ON d.walk_id = v.walk_id AND d.pos = v.pos GROUP BY v.walk_id, v.pos, v.tbl)
SELECT walk_id AS qid, '' AS sql, db, coalesce(string_agg(x, ';' ORDER BY pos), '') AS metadata
FROM walked LEFT JOIN tbs USING (walk_id) GROUP BY walk_id, db""",
    "train_validation_split": f"""SELECT doc_id, source,
  CASE WHEN {t.draw("'split|' || doc_id")} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents""",
}
