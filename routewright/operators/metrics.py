"""Evaluation of ranked predictions against gold tables or databases.

A run is run(…, qid, doc_id, rank) with rank from 1; relevance is
qrels(qid, doc_id). Cutting at k comes before removing repeats, so a document
counts within k exactly when its first rank is at most k. All metrics for all
k come from that one number per document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewright.functions.numbers import rounded


def qrels(instances: DataFrame, resolution: str) -> DataFrame:
    """(qid, db[, tbl[, col]]) that are relevant for each question."""
    base = instances.select(
        "qid", F.col("schema.database").alias("db"), F.col("schema.metadata").alias("m")
    )
    if resolution == "database":
        return base.select("qid", "db").distinct()
    tables = base.select("qid", "db", F.explode("m").alias("t"))
    if resolution == "table":
        return tables.select("qid", "db", F.col("t.name").alias("tbl")).distinct()
    if resolution == "column":
        return tables.select(
            "qid", "db", F.col("t.name").alias("tbl"), F.explode("t.columns").alias("col")
        ).distinct()
    raise ValueError(f"unknown resolution: {resolution}")


def flatten_predictions(pred: DataFrame) -> DataFrame:
    """run(qid, db, tbl, rank): the tables of all predicted schemas, one list per question."""
    flat = F.flatten(
        F.transform(
            "pred_schemas",
            lambda s: F.transform(
                s["tables"], lambda t: F.struct(s["database"].alias("db"), t.alias("tbl"))
            ),
        )
    )
    return pred.select("qid", F.posexplode(flat).alias("pos", "x")).select(
        "qid", F.col("x.db"), F.col("x.tbl"), (F.col("pos") + 1).alias("rank")
    )


def first_ranks(run: DataFrame, rel: DataFrame, by: list[str]) -> DataFrame:
    """(by…, qid, doc_id, rank, rel): distinct documents with their first rank."""
    first = run.groupBy(*by, "qid", "doc_id").agg(F.min("rank").alias("rank"))
    gold = rel.select("qid", "doc_id").distinct().withColumn("_hit", F.lit(1))
    return first.join(gold, ["qid", "doc_id"], "left").select(
        *by, "qid", "doc_id", "rank", F.coalesce("_hit", F.lit(0)).alias("rel")
    )


def _gold_sizes(rel: DataFrame) -> DataFrame:
    return rel.select("qid", "doc_id").distinct().groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_gold")
    )


def micro_metrics(
    run: DataFrame, rel: DataFrame, ks: list[int], by: list[str], measure: str
) -> DataFrame:
    """(by…, k, value): pooled precision, recall or f1 in percent; 0 for an empty ratio."""
    ranked = first_ranks(run, rel, by)
    hit = F.col("rel") == 1
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.col(f"tp{k}").alias("tp"),
                F.col(f"n{k}").alias("n"),
            )
            for k in ks
        ]
    )
    sums = []
    for k in ks:
        within = F.col("rank") <= k
        sums.append(F.count(F.when(within & hit, 1)).alias(f"tp{k}"))
        sums.append(F.count(F.when(within, 1)).alias(f"n{k}"))
    pooled = ranked.groupBy(*by).agg(*sums).select(*by, F.inline(cells))
    n_gold = rel.select("qid", "doc_id").distinct().agg(F.count(F.lit(1)).alias("g")).scalar()
    top, bottom = {
        "precision": (F.col("tp"), F.col("n")),
        "recall": (F.col("tp"), n_gold),
        "f1": (2 * F.col("tp"), F.col("n") + n_gold),
    }[measure]
    value = F.when(bottom == 0, 0.0).otherwise(top * 100.0 / bottom)
    return pooled.select(*by, "k", rounded(value).alias("value"))


def query_recall(run: DataFrame, rel: DataFrame, ks: list[int], by: list[str]) -> DataFrame:
    """(by…, qid, r@k for each k): recall per question.

    A question that a method answered with nothing counts with 0, and so does
    one without a gold set. Documents below all ks are one row per question and
    task, before anything is shuffled.
    """
    listed = run.withColumn("doc_id", F.when(F.col("rank") <= max(ks), F.col("doc_id")))
    found = first_ranks(listed, rel, by).groupBy(*by, "qid").agg(
        *[
            F.count(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1)).alias(f"tp{k}")
            for k in ks
        ]
    )
    gold = _gold_sizes(rel)
    if by:
        methods = run.select(*by).distinct().agg(F.collect_list(F.struct(*by)).alias("m")).scalar()
        gold = gold.select("qid", "n_gold", F.inline(methods))
    return gold.join(found, [*by, "qid"], "full").select(
        *by,
        "qid",
        *[F.coalesce(F.col(f"tp{k}") / F.col("n_gold"), F.lit(0.0)).alias(f"r{k}") for k in ks],
    )


def macro_recall(run: DataFrame, rel: DataFrame, ks: list[int], by: list[str]) -> DataFrame:
    """(by…, k, value): mean of the per-question recall."""
    per_query = query_recall(run, rel, ks, by)
    means = per_query.groupBy(*by).agg(*[F.avg(f"r{k}").alias(f"r{k}") for k in ks])
    cells = F.array(
        *[F.struct(F.lit(k).alias("k"), rounded(F.col(f"r{k}")).alias("value")) for k in ks]
    )
    return means.select(*by, F.inline(cells))


def _points(run: DataFrame, rel: DataFrame, n: int, by: list[str]) -> DataFrame:
    """(by…, qid, rank, p, r, p0, r0): precision and recall from a document's rank on, and before.

    Both change only where the list has a document, so a question has a row per
    document within n and none for the other ranks. Before the first p0 and r0 are 0.
    """
    first = run.groupBy(*by, "qid", "doc_id").agg(F.min("rank").alias("rank"))
    within = first.where((F.col("rank") >= 1) & (F.col("rank") <= n))
    gold = rel.select("qid", "doc_id").distinct().groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_gold"), F.collect_list("doc_id").alias("gold")
    )
    hit = F.coalesce(F.array_contains("gold", F.col("doc_id")), F.lit(False))
    ranked = within.join(gold, "qid", "left").select(*by, "qid", "rank", hit.cast("int").alias("rel"), "n_gold")
    upto = Window.partitionBy(*by, "qid").orderBy("rank")
    return (
        ranked.withColumn("p", F.sum("rel").over(upto) / F.count(F.lit(1)).over(upto))
        .withColumn("r", F.coalesce(F.sum("rel").over(upto) / F.col("n_gold"), F.lit(0.0)))
        .withColumn("p0", F.lag("p", 1, 0.0).over(upto))
        .withColumn("r0", F.lag("r", 1, 0.0).over(upto))
        .select(*by, "qid", "rank", "p", "r", "p0", "r0")
    )


def precision_recall_curve(
    run: DataFrame, rel: DataFrame, questions: DataFrame, by: list[str], n: int = 50
) -> DataFrame:
    """(by…, k, precision, recall): means over the questions for k = 1..n.

    questions(by…, qid) names every question that was asked; one without any
    prediction counts with zeros. The changes at each k are summed, then added up
    over the n values of k.
    """
    changes = (
        _points(run.where(F.col("rank") <= n), rel, n, by)
        .join(questions.select(*by, "qid"), [*by, "qid"])
        .groupBy(*by, F.col("rank").cast("int").alias("k"))
        .agg(F.sum(F.col("p") - F.col("p0")).alias("dp"), F.sum(F.col("r") - F.col("r0")).alias("dr"))
    )
    asked = questions.groupBy(*by).agg(F.count(F.lit(1)).alias("asked")).where("asked > 0")
    every = asked.select(*by, "asked", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    cells = every.unionByName(changes, allowMissingColumns=True).groupBy(*by, "k").agg(
        F.max("asked").alias("asked"), F.sum("dp").alias("dp"), F.sum("dr").alias("dr")
    )
    upto = Window.partitionBy(*by).orderBy("k")

    def mean(change: str) -> Column:
        return rounded(F.coalesce(F.sum(change).over(upto), F.lit(0.0)) / F.col("asked"))

    return cells.select(*by, "k", mean("dp").alias("precision"), mean("dr").alias("recall"))


def average_precision(
    run: DataFrame, rel: DataFrame, questions: DataFrame, by: list[str], n: int = 15
) -> DataFrame:
    """(by…, qid, ap): trapezoidal area under (recall, precision), from (0, 1) to k = n."""
    before = F.when(F.col("rank") == 1, 1.0).otherwise(F.col("p0"))
    area = F.sum((F.col("r") - F.col("r0")) * (F.col("p") + before) / 2)
    points = _points(run.where(F.col("rank") <= n), rel, n, by)
    areas = points.groupBy(*by, "qid").agg(rounded(area).alias("ap"))
    return (
        questions.select(*by, "qid")
        .join(areas, [*by, "qid"], "left")
        .select(*by, "qid", F.coalesce("ap", rounded(F.lit(0.0))).alias("ap"))
    )


def map_by_table_count(
    ap: DataFrame, gold: DataFrame, columns: DataFrame, by: list[str], below: int = 20
) -> DataFrame:
    """(by…, n_tables, map, n): mean area by the number of tables of the gold database."""
    sizes = columns.groupBy("db").agg(F.countDistinct("tbl").alias("n_tables"))
    return (
        ap.join(gold.select("qid", "db"), "qid")
        .join(sizes.where(F.col("n_tables") < below), "db")
        .groupBy(*by, "n_tables")
        .agg(rounded(F.avg("ap")).alias("map"), F.count(F.lit(1)).alias("n"))
    )


def paired_t(scores: DataFrame, base: str, metrics: list[str]) -> DataFrame:
    """(method, metric, n, mean_diff, t, df): paired test of each method against ``base``.

    scores(method, qid, metric columns…), one row per method and question. A
    question's methods meet in one row, so neither side is joined; a constant
    difference has no t.
    """
    met = scores.groupBy("qid").agg(F.collect_list(F.struct("method", *metrics)).alias("all"))
    ours = F.get(F.filter("all", lambda x: x["method"] == base), F.lit(0))
    others = (
        met.withColumn("ours", ours)
        .where("ours is not null")
        .select("ours", F.explode(F.filter("all", lambda x: x["method"] != base)).alias("x"))
    )
    names = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), (F.col(f"ours.{m}") - F.col(f"x.{m}")).alias("d"))
            for m in metrics
        ]
    )
    diff = others.select(F.col("x.method").alias("method"), F.inline(names))
    stats = diff.groupBy("method", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")
    )
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    return stats.select(
        "method",
        "metric",
        "n",
        rounded(F.col("mean_diff")).alias("mean_diff"),
        rounded(t).alias("t"),
        (F.col("n") - 1).alias("df"),
    )


# From so many degrees of freedom on, t is normal to more digits than are left.
NORMAL_FROM = 10_000_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for num in (even, odd):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-14:
            return h
    raise ArithmeticError(f"no convergence at a={a}, b={b}, x={x}")


def t_p_value(t: float | None, df: int) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df < 1:
        return None
    if df > NORMAL_FROM:
        return math.erfc(abs(t) / math.sqrt(2))
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def _p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    known = [None if pd.isna(x) else float(x) for x in t]
    return pd.Series(
        [t_p_value(x, int(n)) for x, n in zip(known, df, strict=True)], dtype="float64"
    )


def with_p_values(tests: DataFrame) -> DataFrame:
    """Add ``p``, the two-sided p-value of each test."""
    return tests.withColumn("p", _p_values("t", "df"))


def top_schema_recall(run: DataFrame, rel: DataFrame) -> DataFrame:
    """(method, qid, recall) of each method's first schema; run(method, qid, db_rank, doc_id, rank)."""
    first = run.where("db_rank = 1").drop("db_rank")
    n = 2**31 - 1
    return query_recall(first, rel, [n], ["method"]).select(
        "method", "qid", F.col(f"r{n}").alias("recall")
    )


def method_compare(recall: DataFrame, router: str) -> DataFrame:
    """(qid, router_recall, best_other, n_perfect): the router is partly right and
    another method is perfect."""
    is_router = F.col("method") == router
    per_q = recall.groupBy("qid").agg(
        F.max(F.when(is_router, F.col("recall"))).alias("router_recall"),
        F.max(F.when(~is_router, F.col("recall"))).alias("best_other"),
        F.count(F.when(~is_router & (F.col("recall") == 1), 1)).alias("n_perfect"),
    )
    return per_q.where("router_recall > 0 and router_recall < 1 and n_perfect > 0")


def compare_for_database(recall: DataFrame, gold: DataFrame, db: str) -> DataFrame:
    """(method, qid, recall) of the questions of one database."""
    return recall.join(gold.where(F.col("db") == db).select("qid"), "qid", "left_semi")


def leaderboard(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """run × chosen keys of metrics(run, key, value text); ``N/A`` where a run has none."""
    cells = [
        F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("N/A")).alias(k)
        for k in keys
    ]
    return metrics.groupBy("run").agg(*cells).orderBy("run")


def dataset_stats(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts per dataset as text, ``-`` for an empty split.

    records(dataset, split), columns(dataset, db, tbl, col). A split counts all
    files whose name starts with it. A dataset that only one side knows has
    empty splits or 0 databases.
    """

    def cell(split: str) -> Column:
        n = F.count(F.when(F.col("split").startswith(split), 1))
        return F.when(n > 0, n.cast("string")).otherwise("-").alias(split)

    splits = records.groupBy("dataset").agg(cell("train"), cell("dev"), cell("test"))
    tables = columns.groupBy("dataset", "db", "tbl").agg(F.count(F.lit(1)).alias("cols"))
    dbs = tables.groupBy("dataset", "db").agg(
        F.count(F.lit(1)).alias("tbls"), F.sum("cols").alias("cols")
    )
    sizes = dbs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_db"),
        F.sum("tbls").alias("n_tables"),
        F.sum("cols").alias("n_cols"),
    )
    return splits.join(sizes, "dataset", "full").fillna("-").fillna(0)


def melt_sweep(wide: DataFrame, ids: list[str], value: str) -> DataFrame:
    """Wide to long; the former column names become the integer ``size``."""
    values = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, values, "size", value).withColumn("size", F.col("size").cast("int"))


def percent_text(value: Column) -> Column:
    """A score in percent with at most two decimals, as text."""
    return F.round(value * 100, 2).cast("string")


def metric_history(validation: DataFrame, test: DataFrame) -> DataFrame:
    """(run, key, value): metrics of both stages in one record; the test value wins."""
    both = validation.withColumn("_o", F.lit(0)).unionByName(test.withColumn("_o", F.lit(1)))
    return both.groupBy("run", "key").agg(F.max_by("value", "_o").alias("value"))
