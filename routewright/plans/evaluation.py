"""Evaluation queries over two supplier rankings per order, and over BM25 runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from routewright.functions.numbers import rounded
from routewright.operators import metrics as m
from routewright.operators import retrieval as r
from routewright.plans import tables as t

DB_KS = [1, 5]
TABLE_KS = [5, 10, 15, 20]
BY = ["method"]


def qrels_column(spark, d):
    return m.qrels(t.instances(spark, d), "column")


def qrels_table(spark, d):
    return m.qrels(t.instances(spark, d), "table")


def qrels_database(spark, d):
    return m.qrels(t.instances(spark, d), "database")


def text_qrels(spark, d):
    return t.text_qrels(spark, d)


def _db_rel(rel):
    return rel.select("qid", F.col("db").alias("doc_id")).distinct()


def _micro(spark, d, measure):
    run, rel = t.ranked_runs(spark, d), t.returned_gold(spark, d)
    tables = m.micro_metrics(run, rel, TABLE_KS, BY, measure).withColumn("level", F.lit("table"))
    dbs = m.micro_metrics(t.ranked_databases(run), _db_rel(rel), DB_KS, BY, measure)
    return tables.unionByName(dbs.withColumn("level", F.lit("database")))


def micro_precision(spark, d):
    return _micro(spark, d, "precision")


def micro_recall(spark, d):
    return _micro(spark, d, "recall")


def micro_f1(spark, d):
    return _micro(spark, d, "f1")


def macro_recall_at_k(spark, d):
    run, rel = t.ranked_runs(spark, d), t.returned_gold(spark, d)
    tables = m.macro_recall(run, rel, TABLE_KS, BY).withColumn("level", F.lit("table"))
    dbs = m.macro_recall(t.ranked_databases(run), _db_rel(rel), DB_KS, BY)
    return tables.unionByName(dbs.withColumn("level", F.lit("database")))


def _bm25_run(spark, d):
    return r.search(r.stored_index(t.documents(spark, d)), t.questions(spark, d))


def bm25_macro_recall(spark, d):
    return m.macro_recall(_bm25_run(spark, d), t.text_qrels(spark, d), TABLE_KS, [])


def format_percent(spark, d):
    return bm25_macro_recall(spark, d).select("k", m.percent_text(F.col("value")).alias("text"))


def _query_metrics(spark, d):
    run, rel = t.ranked_runs(spark, d), t.returned_gold(spark, d)
    tables = m.query_recall(run, rel, [5, 15], BY).withColumnsRenamed({"r5": "tr5", "r15": "tr15"})
    dbs = m.query_recall(t.ranked_databases(run), _db_rel(rel), DB_KS, BY)
    return tables.join(dbs.withColumnsRenamed({"r1": "dr1", "r5": "dr5"}), ["method", "qid"])


def query_metrics(spark, d):
    scores = _query_metrics(spark, d)
    return scores.select("method", "qid", *[rounded(F.col(c)).alias(c) for c in ("dr1", "dr5", "tr5", "tr15")])


def _asked(spark, d):
    """(method, qid): every method is asked about every order."""
    method = F.explode(F.array(F.lit("price"), F.lit("quantity"))).alias("method")
    return t.gold(spark, d).select(method, "qid")


def precision_recall_curve(spark, d):
    run, rel = t.ranked_runs(spark, d), t.returned_gold(spark, d)
    return m.precision_recall_curve(run, rel, _asked(spark, d), BY)


def average_precision(spark, d):
    run, rel = t.ranked_runs(spark, d), t.returned_gold(spark, d)
    return m.average_precision(run, rel, _asked(spark, d), BY)


def map_by_table_count(spark, d):
    return m.map_by_table_count(
        average_precision(spark, d), t.gold(spark, d), t.plain_columns(spark, d), BY
    )


def _tests(spark, d):
    return m.paired_t(_query_metrics(spark, d), "price", ["dr1", "dr5", "tr5", "tr15"])


def paired_t_test(spark, d):
    return _tests(spark, d)


def paired_t_p_value(spark, d):
    return m.with_p_values(_tests(spark, d)).withColumn("p", rounded(F.col("p")))


def _top_recall(spark, d):
    run = t.compared_runs(spark, d)
    of_db = F.min("rank").over(Window.partitionBy("method", "qid", "db"))
    ranked = run.withColumn("db_first", of_db).withColumn(
        "db_rank", F.dense_rank().over(Window.partitionBy("method", "qid").orderBy("db_first"))
    )
    return m.top_schema_recall(ranked.drop("db_first"), t.returned_gold(spark, d))


def method_compare(spark, d):
    return m.method_compare(_top_recall(spark, d), "price").select(
        "qid",
        rounded(F.col("router_recall")).alias("router_recall"),
        rounded(F.col("best_other")).alias("best_other"),
        "n_perfect",
    )


def method_compare_database(spark, d):
    found = m.compare_for_database(_top_recall(spark, d), t.returned_gold(spark, d), "n5")
    return found.select("method", "qid", rounded(F.col("recall")).alias("recall"))


# Finished orders are the validation, open and partly open ones the test.
STATUSES = {"F": ["F"], "O": ["O", "P"]}


def _order_metrics(spark, d, status):
    """metrics(run, key, value): a customer is a run, its orders of some statuses the results."""
    orders = t.load(spark, d, "orders").where(F.col("o_orderstatus").isin(*STATUSES[status]))
    per = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") > 300000, 1)).alias("big")
    )
    return per.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("run"),
        F.inline(
            F.array(
                F.struct(F.lit("n").alias("key"), F.col("n").cast("string").alias("value")),
                F.struct(
                    F.lit("big/" + status).alias("key"), F.col("big").cast("string").alias("value")
                ),
            )
        ),
    )


def metric_history(spark, d):
    return m.metric_history(_order_metrics(spark, d, "F"), _order_metrics(spark, d, "O"))


def leaderboard(spark, d):
    return m.leaderboard(metric_history(spark, d), ["n", "big/F", "big/O"])


def dataset_stats(spark, d):
    orders = t.load(spark, d, "orders")
    status = F.col("o_orderstatus")
    records = orders.select(
        F.col("o_orderpriority").alias("dataset"),
        F.when(status == "F", "train").when(status == "O", "test").otherwise("test_p").alias("split"),
    )
    lines = t.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    columns = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_custkey").alias("db"),
        F.col("o_orderkey").alias("tbl"),
        F.col("l_linenumber").alias("col"),
    )
    return m.dataset_stats(records, columns)


def melt_sweep(spark, d):
    lines = t.load(spark, d, "lineitem")
    wide = lines.groupBy("l_returnflag").agg(
        *[
            F.count(F.when(F.col("l_linenumber") <= n, 1)).cast("double").alias(str(n))
            for n in range(1, 8)
        ]
    )
    return m.melt_sweep(wide, ["l_returnflag"], "score")


QUERIES = {
    f.__name__: f
    for f in (
        qrels_column,
        qrels_table,
        qrels_database,
        text_qrels,
        micro_precision,
        micro_recall,
        micro_f1,
        macro_recall_at_k,
        bm25_macro_recall,
        format_percent,
        query_metrics,
        precision_recall_curve,
        average_precision,
        map_by_table_count,
        paired_t_test,
        paired_t_p_value,
        method_compare,
        method_compare_database,
        leaderboard,
        metric_history,
        dataset_stats,
        melt_sweep,
    )
}

_HITS = f"""WITH {t.RUNS},
hit AS (SELECT f.method, f.qid, f.rank, r.qid IS NOT NULL AS rel
  FROM first f LEFT JOIN rel r ON r.qid = f.qid AND r.doc_id = f.doc_id),
dbhit AS (SELECT f.method, f.qid, f.rank, r.qid IS NOT NULL AS rel
  FROM dbfirst f LEFT JOIN dbrel r ON r.qid = f.qid AND r.doc_id = f.doc_id)"""


def _micro_sql(value: str) -> str:
    def level(name: str, hits: str, rel: str, ks: str) -> str:
        return f"""SELECT method, k, '{name}' AS level, round(coalesce({value}, 0) + 1e-9, 6) AS value
FROM (SELECT method, k, count(*) FILTER (rel) AS tp, count(*) AS n, (SELECT count(*) FROM {rel}) AS g
  FROM {hits}, (VALUES {ks}) v(k) WHERE rank <= k GROUP BY method, k)"""

    return (
        f"{_HITS} {level('table', 'hit', 'rel', '(5), (10), (15), (20)')} UNION ALL "
        f"{level('database', 'dbhit', 'dbrel', '(1), (5)')}"
    )


def _recall_sql(name: str, hits: str, rel: str, ks: str) -> str:
    """CTE (method, qid, k, r): recall of every question at every k."""
    return f"""{name}g AS (SELECT qid, count(*) AS g FROM {rel} GROUP BY qid),
{name} AS (
  SELECT q.method, q.qid, k, coalesce(tp / g, 0) AS r
  FROM (SELECT method, qid FROM {hits} UNION
        SELECT method, qid FROM {name}g, (SELECT DISTINCT method FROM runs)) q
  CROSS JOIN (VALUES {ks}) v(k)
  LEFT JOIN {name}g USING (qid)
  LEFT JOIN (SELECT method, qid, k, count(*) FILTER (rel AND rank <= k) AS tp
    FROM {hits}, (VALUES {ks}) v(k) GROUP BY ALL) h USING (method, qid, k))"""


_REC = (
    _HITS
    + ", "
    + _recall_sql("tr", "hit", "rel", "(5), (10), (15), (20)")
    + ", "
    + _recall_sql("dr", "dbhit", "dbrel", "(1), (5)")
)
_PER_Q = f"""{_REC},
pq AS (SELECT method, qid,
  max(r) FILTER (lvl = 'd' AND k = 1) AS dr1, max(r) FILTER (lvl = 'd' AND k = 5) AS dr5,
  max(r) FILTER (lvl = 't' AND k = 5) AS tr5, max(r) FILTER (lvl = 't' AND k = 15) AS tr15
  FROM (SELECT 't' AS lvl, * FROM tr UNION ALL SELECT 'd' AS lvl, * FROM dr) GROUP BY method, qid)"""

_POINTS = f"""{_HITS},
g AS (SELECT qid, count(*) AS g FROM rel GROUP BY qid),
pts AS (
  SELECT method, qid, k, coalesce(tp / nullif(n, 0), 0) AS p, coalesce(tp / g, 0) AS r
  FROM (SELECT method, qid, k, count(*) FILTER (rank <= k) AS n,
          count(*) FILTER (rank <= k AND rel) AS tp
        FROM hit, (SELECT unnest(range(1, {{n}} + 1)) AS k) GROUP BY method, qid, k)
  LEFT JOIN g USING (qid))"""

_AP = (
    _POINTS.format(n=15)
    + """,
ends AS (SELECT *, lag(p, 1, 1) OVER w AS p0, lag(r, 1, 0) OVER w AS r0 FROM pts
  WINDOW w AS (PARTITION BY method, qid ORDER BY k)),
ap AS (SELECT method, qid, round(sum((r - r0) * (p + p0) / 2) + 1e-9, 6) AS ap
  FROM ends GROUP BY method, qid)"""
)

_TOP = f"""WITH {t.RUNS},
compared AS (SELECT method, qid, db, doc_id, rank FROM runs
  UNION ALL SELECT 'region', qid, 'r' || n_regionkey, doc_id, rank FROM runs
  JOIN supplier ON doc_id = 's' || s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE method = 'price'),
head AS (SELECT method, qid, db FROM compared WHERE rank = 1),
toprec AS (
  SELECT method, qid, coalesce(hits / g, 0) AS recall
  FROM (SELECT method, qid FROM head UNION SELECT method, qid FROM rel, (VALUES ('price'), ('quantity'), ('region')) m(method))
  LEFT JOIN (SELECT method, qid, count(DISTINCT rel.doc_id) AS hits
    FROM compared JOIN head USING (method, qid, db) JOIN rel USING (qid, doc_id) GROUP BY ALL) USING (method, qid)
  LEFT JOIN (SELECT qid, count(*) AS g FROM rel GROUP BY qid) USING (qid))"""

_TEXT = f"""WITH {t.BM25}, {t.BENCH}, {t.bm25_run('bench', 'qid', 100)}, {t.TEXT_REL},
g AS (SELECT qid, count(*) AS g FROM trel GROUP BY qid),
rec AS (
  SELECT k, round(avg(coalesce(tp / g, 0)) + 1e-9, 6) AS value FROM bench
  CROSS JOIN (VALUES (5), (10), (15), (20)) v(k) LEFT JOIN g USING (qid)
  LEFT JOIN (SELECT qid, k, count(*) AS tp FROM run JOIN trel USING (qid, doc_id),
    (VALUES (5), (10), (15), (20)) v(k) WHERE rank <= k GROUP BY ALL) USING (qid, k)
  GROUP BY k)"""


def _history(status: str) -> str:
    names = ", ".join(f"'{s}'" for s in STATUSES[status])
    return f"""SELECT 'c' || o_custkey AS run, unnest(['n', 'big/{status}']) AS key,
  unnest([count(*), count(*) FILTER (o_totalprice > 300000)])::VARCHAR AS value
FROM orders WHERE o_orderstatus IN ({names}) GROUP BY o_custkey"""


_HISTORY = f"""v AS ({_history('F')}), te AS ({_history('O')}),
hist AS (SELECT run, key, coalesce(te.value, v.value) AS value FROM v FULL JOIN te USING (run, key))"""

_T_TEST = f"""{_PER_Q},
long AS (UNPIVOT pq ON dr1, dr5, tr5, tr15 INTO NAME metric VALUE x),
diff AS (SELECT b.method, metric, a.x - b.x AS d FROM long a JOIN long b USING (qid, metric)
  WHERE a.method = 'price' AND b.method <> 'price'),
tests AS (SELECT method, metric, count(*) AS n, round(avg(d) + 1e-9, 6) AS mean_diff,
  CASE WHEN stddev_samp(d) > 0 THEN round(avg(d) / (stddev_samp(d) / sqrt(count(*))) + 1e-9, 6) END AS t,
  count(*) - 1 AS df FROM diff GROUP BY ALL)"""

ORACLE = {
    "qrels_column": f"WITH {t.LINES}, {t.GOLD} SELECT DISTINCT qid, db, tbl, col FROM gold",
    "qrels_table": f"WITH {t.LINES}, {t.GOLD} SELECT DISTINCT qid, db, tbl FROM gold",
    "qrels_database": "SELECT DISTINCT l_orderkey AS qid, 'o' || l_orderkey AS db FROM lineitem",
    "text_qrels": f"WITH {t.TEXT_REL} SELECT qid, doc_id FROM trel",
    "micro_precision": _micro_sql("100.0::DOUBLE * tp / n"),
    "micro_recall": _micro_sql("100.0::DOUBLE * tp / g"),
    "micro_f1": _micro_sql("100.0::DOUBLE * 2 * tp / (n + g)"),
    "macro_recall_at_k": f"""{_REC}
SELECT method, k, 'table' AS level, round(avg(r) + 1e-9, 6) AS value FROM tr GROUP BY method, k
UNION ALL SELECT method, k, 'database', round(avg(r) + 1e-9, 6) FROM dr GROUP BY method, k""",
    "bm25_macro_recall": f"{_TEXT} SELECT k, value FROM rec",
    "format_percent": f"{_TEXT} SELECT k, round(value * 100, 2)::VARCHAR AS text FROM rec",
    "query_metrics": f"""{_PER_Q}
SELECT method, qid, round(dr1 + 1e-9, 6) AS dr1, round(dr5 + 1e-9, 6) AS dr5,
  round(tr5 + 1e-9, 6) AS tr5, round(tr15 + 1e-9, 6) AS tr15 FROM pq""",
    "precision_recall_curve": f"""{_POINTS.format(n=50)}
SELECT method, k::INT AS k, round(avg(p) + 1e-9, 6) AS precision, round(avg(r) + 1e-9, 6) AS recall
FROM pts GROUP BY method, k""",
    "average_precision": f"{_AP} SELECT method, qid, ap FROM ap",
    "map_by_table_count": f"""{_AP},
size AS (SELECT l_orderkey AS qid, count(DISTINCT l_suppkey) AS n_tables FROM lineitem GROUP BY 1)
SELECT method, n_tables, round(avg(ap) + 1e-9, 6) AS map, count(*) AS n
FROM ap JOIN size USING (qid) WHERE n_tables < 20 GROUP BY ALL""",
    "paired_t_test": f"{_T_TEST} SELECT * FROM tests",
    # Twice the upper tail of the density by Simpson's rule.
    "paired_t_p_value": f"""{_T_TEST},
steps AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
  FROM range(4001) r(i)),
tails AS (SELECT method, metric,
  2 * sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
    * pow(1 + pow(abs(t) + i * 0.005, 2) / df, -(df + 1) / 2)) * 0.005 / 3 AS p
  FROM (SELECT * REPLACE (df::DOUBLE AS df) FROM tests WHERE t IS NOT NULL), steps GROUP BY ALL)
SELECT tests.*, round(p + 1e-9, 6) AS p FROM tests LEFT JOIN tails USING (method, metric)""",
    "method_compare": f"""{_TOP}
SELECT a.qid, round(a.recall + 1e-9, 6) AS router_recall, round(max(b.recall) + 1e-9, 6) AS best_other,
  count(*) FILTER (b.recall = 1) AS n_perfect
FROM toprec a JOIN toprec b ON a.qid = b.qid AND a.method = 'price' AND b.method <> 'price'
WHERE a.recall > 0 AND a.recall < 1 GROUP BY a.qid, a.recall HAVING n_perfect > 0""",
    "method_compare_database": f"""{_TOP}
SELECT method, qid, round(recall + 1e-9, 6) AS recall FROM toprec
WHERE qid IN (SELECT qid FROM rel WHERE db = 'n5')""",
    "leaderboard": f"""WITH {_HISTORY}
SELECT run, coalesce(max(value) FILTER (key = 'n'), 'N/A') AS n,
  coalesce(max(value) FILTER (key = 'big/F'), 'N/A') AS "big/F",
  coalesce(max(value) FILTER (key = 'big/O'), 'N/A') AS "big/O" FROM hist GROUP BY run""",
    "metric_history": f"WITH {_HISTORY} SELECT run, key, value FROM hist",
    "dataset_stats": """WITH r AS (
  SELECT o_orderpriority AS dataset, count(*) FILTER (o_orderstatus = 'F') AS tr,
    count(*) FILTER (o_orderstatus <> 'F') AS te FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority AS dataset, count(DISTINCT o_custkey) AS n_db,
    count(DISTINCT o_orderkey) AS n_tables, count(*) AS n_cols
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT dataset, CASE WHEN tr > 0 THEN tr::VARCHAR ELSE '-' END AS train, '-' AS dev,
  CASE WHEN te > 0 THEN te::VARCHAR ELSE '-' END AS test, n_db, n_tables, n_cols
FROM r JOIN c USING (dataset)""",
    "melt_sweep": """SELECT l_returnflag, s::INT AS size,
  count(*) FILTER (l_linenumber <= s)::DOUBLE AS score
FROM lineitem, (SELECT unnest(range(1, 8)) AS s) GROUP BY ALL""",
}
