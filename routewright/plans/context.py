"""Context queries: which schemas a question's prompt shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright.operators import context as c
from routewright.plans import retrieval
from routewright.plans import tables as t

_OUT = ["qid", "schema_pos", "db", "tbl", "col_pos", "col"]


def context_database(spark, d):
    return c.context_database(t.gold(spark, d), t.plain_columns(spark, d)).select(*_OUT)


def context_table(spark, d):
    return c.context_table(
        t.gold(spark, d), t.gold_mentions(spark, d), t.plain_columns(spark, d)
    ).select(*_OUT)


def context_column(spark, d):
    return c.context_column(t.gold(spark, d), t.gold_mentions(spark, d)).select(*_OUT)


def context_random5(spark, d):
    return c.context_random(t.gold(spark, d), t.plain_columns(spark, d)).select(*_OUT)


def context_pred_topk(spark, d):
    pred = retrieval.beam_predictions(spark, d)
    return c.context_predicted(pred, t.plain_columns(spark, d), 3).select(*_OUT)


def gold_rank(spark, d):
    pred = retrieval.beam_predictions(spark, d)
    return pred.join(t.gold(spark, d), "qid").select(
        "qid", "db", c.gold_rank(F.col("pred_schemas"), F.col("db")).alias("label")
    )


def context_gold_hit(spark, d):
    pred = retrieval.beam_predictions(spark, d)
    return c.context_gold_hit(pred, t.gold(spark, d), t.plain_columns(spark, d)).select(*_OUT)


def context_nested(spark, d):
    rows = c.context_random(t.gold(spark, d), t.plain_columns(spark, d))
    return c.nest_context(rows).select(
        "qid",
        F.array_join(
            F.transform(
                "schemas",
                lambda s: F.concat(
                    s["name"],
                    F.lit(":"),
                    F.array_join(
                        F.transform(
                            s["tables"],
                            lambda x: F.concat(x["name"], F.lit("("), F.array_join(x["columns"], ","), F.lit(")")),
                        ),
                        ",",
                    ),
                ),
            ),
            ";",
        ).alias("schemas"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        context_database,
        context_table,
        context_column,
        context_random5,
        context_pred_topk,
        gold_rank,
        context_gold_hit,
        context_nested,
    )
}

_COLS = f"WITH {t.LINES}"
_RANDOM = f"""{_COLS},
ids AS (SELECT db, row_number() OVER (ORDER BY substr(md5(db), 1, 2), db) - 1 AS db_no, count(*) OVER () AS n
  FROM (SELECT DISTINCT db FROM cols)),
qs AS (SELECT DISTINCT ok AS qid, db FROM cols),
pick AS (
  SELECT qid, p AS schema_pos, ids.db FROM (
    SELECT qid, p, floor({t.draw("'context|' || qid || '|' || p")} * (SELECT max(n) FROM ids))::BIGINT AS db_no
    FROM (SELECT qid, unnest([0, 1, 3, 4]) AS p FROM qs)) JOIN ids USING (db_no)
  UNION ALL SELECT qid, 2, db FROM qs)"""

_PRED = f"""{retrieval._beams_sql()},
pred AS (SELECT qid, db, row_number() OVER (PARTITION BY qid ORDER BY seen) - 1 AS pos FROM lst),
ptab AS (SELECT qid, pos, db, tbl FROM pred JOIN cnt USING (qid, db))"""

ORACLE = {
    "context_database": f"{_COLS} SELECT ok AS qid, 0 AS schema_pos, db, tbl, col_pos, col FROM cols",
    "context_table": f"""{_COLS}, {t.GOLD},
g AS (SELECT DISTINCT qid, db, tbl FROM gold)
SELECT q.qid, 0 AS schema_pos, q.db, g.tbl, c.col_pos, c.col
FROM (SELECT DISTINCT ok AS qid, db FROM cols) q LEFT JOIN g USING (qid, db)
LEFT JOIN cols c ON c.db = g.db AND c.tbl = g.tbl""",
    "context_column": f"""{_COLS}, {t.GOLD}
SELECT q.qid, 0 AS schema_pos, q.db, g.tbl, g.col_pos, g.col
FROM (SELECT DISTINCT ok AS qid, db FROM cols) q LEFT JOIN gold g USING (qid, db)""",
    "context_random5": f"""{_RANDOM}
SELECT qid, schema_pos, db, tbl, col_pos, col FROM pick JOIN cols USING (db)""",
    "context_pred_topk": f"""{_PRED}
SELECT qid, pos::INT AS schema_pos, p.db, p.tbl, c.col_pos, c.col
FROM ptab p LEFT JOIN cols c ON c.db = p.db AND c.tbl = p.tbl WHERE pos < 3""",
    "gold_rank": f"""{_PRED}
SELECT qid, 'o' || qid AS db, coalesce(max(pos) FILTER (db = 'o' || qid), -1)::INT AS label FROM pred GROUP BY qid""",
    "context_gold_hit": f"""{_PRED}
SELECT qid, 0 AS schema_pos, p.db, p.tbl, c.col_pos, c.col
FROM ptab p LEFT JOIN cols c ON c.db = p.db AND c.tbl = p.tbl WHERE p.db = 'o' || qid""",
    "context_nested": f"""{_RANDOM},
tb AS (SELECT db, tbl_pos, tbl || '(' || string_agg(col, ',' ORDER BY col_pos) || ')' AS s FROM cols GROUP BY db, tbl_pos, tbl),
dbt AS (SELECT db, db || ':' || string_agg(s, ',' ORDER BY tbl_pos) AS s FROM tb GROUP BY db)
SELECT qid, string_agg(s, ';' ORDER BY schema_pos) AS schemas FROM pick JOIN dbt USING (db) GROUP BY qid""",
}
