"""Schema graph queries over the order catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import graph as g
from routewright.operators import parsing
from routewright.plans import tables as t


def graph_tree_edges(spark, d):
    return g.tree_edges(t.plain_columns(spark, d))


def _named_key(df):
    return df.withColumn("key", F.concat_ws(".", "key.fk_tbl", "key.fk_col"))


def fk_clique_members(spark, d):
    return _named_key(t.members(spark, d))


def fk_clique_edges(spark, d):
    """How many edges each clique stands for."""
    return _named_key(g.clique_sizes(t.members(spark, d)))


def fk_linked_pairs(spark, d):
    """Which consecutive tables of an order's catalog are linked."""
    columns = t.keep(t.full_columns(spark, d))
    tables = columns.select("db", "tbl_pos", "tbl").distinct()
    nxt = tables.select("db", (F.col("tbl_pos") - 1).alias("tbl_pos"), F.col("tbl").alias("b"))
    pairs = tables.withColumnRenamed("tbl", "a").join(nxt, ["db", "tbl_pos"]).select("db", "a", "b")
    return g.linked_pairs(pairs, g.clique_members(columns))


def serialize_schema(spark, d):
    columns = t.keep(t.full_columns(spark, d))
    return g.serialise(t.mentioned(columns), g.clique_members(columns), t.SEP)


def deserialize_schema(spark, d):
    text = parsing.strip_special_tokens(F.col("text"), ["<s>", "<pad>", "</s>"])
    schema = g.deserialise(text, t.SEP)
    return t.beams(spark, d).select(
        "qid",
        "beam",
        schema["database"].alias("db"),
        F.array_join(schema["tables"], ",").alias("tables"),
    )


def _part_index(spark, d):
    """Parts are the table names, orders the databases."""
    lines = t.load(spark, d, "lineitem")
    return g.table_index(
        lines.select(
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tbl"),
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("db"),
        )
    )


def table_to_db_index(spark, d):
    return _part_index(spark, d)


def _labels(spark, d):
    return t.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("qid"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_returnflag") == "A", F.lit("unknown"))
        .otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
        .alias("tbl"),
    )


def label_vote_db(spark, d):
    """Each order's parts, and one unknown name, vote for an order."""
    return g.vote_database(_labels(spark, d), _part_index(spark, d))


def label_vote_schema(spark, d):
    """The same with the tables of the list, none where no name is known."""
    voted = g.voted_schema(_labels(spark, d), _part_index(spark, d))
    return voted.select("qid", "db", F.array_join("tables", ",").alias("tables"))


def schema_to_label(spark, d):
    return g.flat_label(t.gold_mentions(spark, d), t.SEP)


def schema_to_label_shuffled(spark, d):
    return g.flat_label(t.gold_mentions(spark, d), t.SEP, seed="label")


def separator_guard(spark, d):
    return g.separator_rejects(t.plain_columns(spark, d), "99")


def _states(spark, d, columns):
    """Per order: nothing chosen, the database chosen, and returned tables chosen."""
    order = t.gold(spark, d)
    none = F.lit(None).cast("string")
    empty = order.select("qid", none.alias("db"), none.alias("tbl"))
    opened = order.select("qid", "db", none.alias("tbl"))
    chosen = t.mentioned(columns).select("qid", "db", "tbl").distinct()
    return empty.unionByName(opened).unionByName(chosen).withColumnRenamed("qid", "sid")


def schema_frontier(spark, d):
    columns = t.keep(t.full_columns(spark, d))
    return g.frontier(_states(spark, d, columns), columns, g.clique_members(columns))


def _chosen(spark, d):
    """The gold tables of each question as a state, and the places of all cliques."""
    columns = t.keep(t.full_columns(spark, d))
    chosen = t.mentioned(columns).select(F.col("qid").alias("sid"), "db", "tbl").distinct()
    return chosen, t.keep(g.clique_members(columns))


def frontier_sizes(spark, d):
    chosen, members = _chosen(spark, d)
    return g.frontier_sizes(g.frontier_spans(chosen, t.keep(g.clique_places(members, least=1))))


def frontier_draws(spark, d):
    chosen, members = _chosen(spark, d)
    places = t.keep(g.clique_places(members, least=1))
    return g.frontier_draws(t.keep(g.frontier_spans(chosen, places)), places)


def frontier_holds(spark, d):
    """Every table of an order is asked about."""
    chosen, members = _chosen(spark, d)
    asked = chosen.select("sid", "db").distinct().join(
        members.select("db", F.col("tbl").alias("nxt")).distinct(), "db"
    )
    return g.frontier_holds(asked, chosen, members)


def valid_route_check(spark, d):
    """A route visits the suppliers of an order in line order."""
    steps = t.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("rid"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("db"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("pos"),
        F.concat(
            F.lit("s"),
            F.when(F.col("l_quantity") < 2, F.lit(-1)).otherwise(F.col("l_suppkey")).cast("string"),
        ).alias("tbl"),
    )
    columns = t.keep(t.full_columns(spark, d))
    return g.check_routes(steps, columns, g.clique_members(columns))


QUERIES = {
    f.__name__: f
    for f in (
        graph_tree_edges,
        fk_clique_members,
        fk_clique_edges,
        fk_linked_pairs,
        serialize_schema,
        deserialize_schema,
        table_to_db_index,
        frontier_sizes,
        frontier_draws,
        frontier_holds,
        label_vote_db,
        label_vote_schema,
        schema_to_label,
        schema_to_label_shuffled,
        separator_guard,
        schema_frontier,
        valid_route_check,
    )
}

_CAT = f"WITH {t.CATALOG}"
_GOLD = f"WITH {t.LINES}, {t.GOLD}"

_VOTES = """WITH idx AS (
  SELECT DISTINCT 'p' || l_partkey AS tbl, 'o' || l_orderkey AS db FROM lineitem),
lab AS (SELECT l_orderkey AS qid, l_linenumber AS pos,
  CASE WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'p' || l_partkey END AS tbl FROM lineitem),
v AS (SELECT qid, db, count(*) AS n, min(pos) AS seen FROM lab JOIN idx USING (tbl) GROUP BY ALL),
b AS (SELECT qid, db FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, seen, db) AS r
  FROM v) WHERE r = 1)"""

# The stack as a list: the last table is taken, its unseen neighbours go on top.
_PREORDER = """
g AS (SELECT DISTINCT qid, db, tbl_pos, tbl FROM gold),
pairs AS (SELECT DISTINCT a.qid, a.tbl, b.tbl AS nxt, b.tbl_pos
  FROM g a JOIN memb x ON x.db = a.db AND x.tbl = a.tbl JOIN memb y ON y.db = x.db AND y.key = x.key
  JOIN g b ON b.qid = a.qid AND b.tbl = y.tbl WHERE a.tbl <> b.tbl),
adj AS (SELECT qid, tbl, list(nxt ORDER BY tbl_pos) AS near FROM pairs GROUP BY qid, tbl),
st AS (
  SELECT qid, db, list(tbl ORDER BY tbl_pos) AS stack, []::VARCHAR[] AS ord, count(*) AS n, 0 AS i
  FROM g GROUP BY qid, db
  UNION ALL
  SELECT s.qid, db,
    CASE WHEN old THEN rest ELSE rest || list_filter(coalesce(near, []), lambda x: NOT list_contains(done, x)) END,
    done, n, i + 1
  FROM (SELECT qid, db, n, i, stack[len(stack)] AS top, stack[1:len(stack) - 1] AS rest,
          list_contains(ord, stack[len(stack)]) AS old,
          CASE WHEN list_contains(ord, stack[len(stack)]) THEN ord ELSE list_append(ord, stack[len(stack)]) END AS done
        FROM st WHERE len(stack) > 0 AND len(ord) < n) s
  LEFT JOIN adj ON adj.qid = s.qid AND adj.tbl = s.top)"""

# Neighbours of each state by first shared key, then by slot.
_REACHED = f"""{_CAT}, {t.GOLD}, {t.slots_sql(1)},
state AS (SELECT DISTINCT qid AS sid, db, tbl FROM gold),
touched AS (SELECT DISTINCT sid, db FROM state JOIN memb USING (db, tbl)),
reach AS (SELECT s.sid, s.db, y.tbl AS nxt, min(y.key) AS key FROM state s
  JOIN memb x ON x.db = s.db AND x.tbl = s.tbl JOIN memb y ON y.db = x.db AND y.key = x.key
  WHERE NOT EXISTS (SELECT 1 FROM state h WHERE h.sid = s.sid AND h.tbl = y.tbl) GROUP BY s.sid, s.db, y.tbl),
nb AS (SELECT r.sid, r.db, r.nxt, row_number() OVER (PARTITION BY r.sid ORDER BY r.key, s.slot) - 1 AS place,
    count(*) OVER (PARTITION BY r.sid) AS total
  FROM reach r JOIN slots s ON s.db = r.db AND s.key = r.key AND s.tbl = r.nxt)"""

ORACLE = {
    "serialize_schema": f"""WITH RECURSIVE {t.CATALOG}, {t.GOLD}, {_PREORDER}
SELECT qid, any_value(db) || '<sep>' || array_to_string(arg_max(ord, i), '<sep>') AS text FROM st GROUP BY qid""",
    "graph_tree_edges": f"""WITH {t.LINES}
SELECT DISTINCT 'source' AS src, '' AS src_in, db AS dst, 'source' AS dst_in FROM cols
UNION SELECT DISTINCT db, 'source', tbl, db FROM cols""",
    "fk_clique_members": f"{_CAT} SELECT db, key, tbl, size FROM memb",
    "fk_clique_edges": f"""{_CAT}
SELECT db, key, count(*) AS n_tables, count(*) * (count(*) - 1) AS n_edges FROM memb GROUP BY db, key""",
    "fk_linked_pairs": f"""{_CAT},
tb AS (SELECT DISTINCT db, tbl_pos, tbl FROM cols)
SELECT DISTINCT a.db, a.tbl AS a, b.tbl AS b FROM tb a JOIN tb b ON a.db = b.db AND b.tbl_pos = a.tbl_pos + 1
JOIN memb x ON x.db = a.db AND x.tbl = a.tbl JOIN memb y ON y.db = a.db AND y.tbl = b.tbl AND y.key = x.key""",
    "deserialize_schema": f"""WITH {t.LINES}
SELECT ok AS qid, (j - 1)::INT AS beam, CASE WHEN rf = 'N' THEN 'o' || ok ELSE 'o' || pk END AS db,
  's' || sk || ',s' || ln AS tables FROM lines""",
    "table_to_db_index": """SELECT DISTINCT 'p' || l_partkey AS tbl, 'o' || l_orderkey AS db FROM lineitem""",
    "label_vote_schema": f"""{_VOTES}
SELECT q.qid, coalesce(db, '') AS db, CASE WHEN db IS NULL THEN '' ELSE tables END AS tables
FROM (SELECT qid, string_agg(tbl, ',' ORDER BY pos, tbl) AS tables FROM lab GROUP BY qid) q
LEFT JOIN b USING (qid)""",
    "label_vote_db": """WITH idx AS (
  SELECT DISTINCT 'p' || l_partkey AS tbl, 'o' || l_orderkey AS db FROM lineitem),
lab AS (SELECT l_orderkey AS qid, l_linenumber AS pos,
  CASE WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'p' || l_partkey END AS tbl FROM lineitem),
v AS (SELECT qid, db, count(*) AS n, min(pos) AS seen FROM lab JOIN idx USING (tbl) GROUP BY ALL),
b AS (SELECT qid, db FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, seen, db) AS r
  FROM v) WHERE r = 1)
SELECT q.qid, coalesce(db, '') AS db FROM (SELECT DISTINCT qid FROM lab) q LEFT JOIN b USING (qid)""",
    "schema_to_label": f"""{_GOLD}
SELECT qid, string_agg(tbl, '<sep>' ORDER BY tbl_pos) AS text
FROM (SELECT DISTINCT qid, tbl_pos, tbl FROM gold) GROUP BY qid""",
    "schema_to_label_shuffled": f"""{_GOLD}
SELECT qid, string_agg(tbl, '<sep>' ORDER BY md5('label|' || qid || '|' || tbl)) AS text
FROM (SELECT DISTINCT qid, tbl_pos, tbl FROM gold) GROUP BY qid""",
    "separator_guard": f"""WITH {t.LINES}
SELECT DISTINCT name FROM (SELECT unnest([db, tbl]) AS name FROM cols) WHERE contains(name, '99')""",
    "schema_frontier": f"""{_CAT}, {t.GOLD}
SELECT NULL::BIGINT AS sid, NULL::VARCHAR AS db, db AS nxt FROM cols GROUP BY db
UNION ALL SELECT DISTINCT NULL::BIGINT, db, tbl FROM cols
UNION ALL SELECT DISTINCT g.qid, g.db, y.tbl FROM gold g
  JOIN memb x ON x.db = g.db AND x.tbl = g.tbl JOIN memb y ON y.db = x.db AND y.key = x.key
  WHERE NOT EXISTS (SELECT 1 FROM gold h WHERE h.qid = g.qid AND h.tbl = y.tbl)""",
    "frontier_sizes": f"""{_REACHED}
SELECT sid, db, coalesce(n, 0)::BIGINT AS n FROM touched LEFT JOIN (SELECT sid, count(*) AS n FROM nb GROUP BY sid) USING (sid)""",
    "frontier_draws": f"""{_REACHED}
SELECT sid, db, nxt FROM nb WHERE place = floor({t.draw("'frontier|' || sid || '|' || db")} * total)::BIGINT""",
    "frontier_holds": f"{_REACHED} SELECT sid, db, nxt FROM nb",
    "valid_route_check": f"""{_CAT},
st AS (SELECT l_orderkey AS rid, 'o' || l_orderkey AS db, l_linenumber::BIGINT * 1000000000 + l_partkey AS pos,
  's' || CASE WHEN l_quantity < 2 THEN -1 ELSE l_suppkey END AS tbl FROM lineitem),
tb AS (SELECT DISTINCT db, tbl FROM cols),
ed AS (SELECT DISTINCT x.db, x.tbl AS a, y.tbl AS b FROM memb x JOIN memb y USING (db, key) WHERE x.tbl <> y.tbl),
lk AS (SELECT DISTINCT s.rid, s.pos, s.tbl FROM st s JOIN st p ON p.rid = s.rid AND p.pos < s.pos
  JOIN ed ON ed.db = s.db AND ed.a = p.tbl AND ed.b = s.tbl),
ok AS (SELECT s.rid, s.pos, tb.tbl IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM st p WHERE p.rid = s.rid AND p.tbl = s.tbl AND p.pos < s.pos)
    AND (NOT EXISTS (SELECT 1 FROM st p WHERE p.rid = s.rid AND p.pos < s.pos) OR lk.rid IS NOT NULL) AS legal
  FROM st s LEFT JOIN tb USING (db, tbl) LEFT JOIN lk ON lk.rid = s.rid AND lk.pos = s.pos AND lk.tbl = s.tbl)
SELECT rid, bool_and(legal) AS valid, count(*) AS n_tables FROM ok GROUP BY rid""",
}
