import random

import pytest
from pyspark.sql import functions as F

from routewright.operators import context, cost, metrics as m

# two recorded questions with the routed tables of six methods
CASES = {
    1: (
        ["world_1.country", "world_1.countrylanguage"],
        {
            "router": ["world_1.countrylanguage", "world_1.country", "world_1.city"],
            "tuned": ["world_1.countrylanguage"],
            "cover_dense": ["match_season.country"],
            "cover_sparse": ["car_1.continents", "car_1.countries"],
            "dense": ["roller_coaster.country"],
            "sparse": ["car_1.continents", "car_1.countries"],
        },
    ),
    2: (
        ["flight_2.airports", "flight_2.flights"],
        {
            "router": ["flight_2.flights", "flight_2.airlines"],
            "tuned": ["flight_2.flights", "flight_2.airports", "flight_2.airlines"],
            "cover_dense": ["flight_2.flights", "flight_2.airports", "flight_2.airlines"],
            "cover_sparse": ["flight_2.flights", "flight_2.airports", "flight_2.airlines"],
            "dense": ["flight_2.airports", "flight_2.flights", "flight_2.airlines"],
            "sparse": ["flight_1.flight", "flight_1.certificate", "flight_1.employee", "flight_1.aircraft"],
        },
    ),
}


def recorded(spark):
    run = [
        (meth, q, 1, d, i + 1)
        for q, (_, preds) in CASES.items()
        for meth, docs in preds.items()
        for i, d in enumerate(docs)
    ]
    rel = [(q, d) for q, (gold, _) in CASES.items() for d in gold]
    return (
        spark.createDataFrame(run, "method string, qid bigint, db_rank int, doc_id string, rank int"),
        spark.createDataFrame(rel, "qid bigint, doc_id string"),
    )


def test_recorded_recalls(spark):
    run, rel = recorded(spark)
    got = {(r["method"], r["qid"]): r["recall"] for r in m.top_schema_recall(run, rel).collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == 1} == {
        "router": 1.0, "tuned": 0.5, "cover_dense": 0, "cover_sparse": 0, "dense": 0, "sparse": 0,
    }
    assert {k[0]: v for k, v in got.items() if k[1] == 2} == {
        "router": 0.5, "tuned": 1.0, "cover_dense": 1.0, "cover_sparse": 1.0, "dense": 1.0, "sparse": 0,
    }
    hits = m.method_compare(m.top_schema_recall(run, rel), "router").collect()
    assert [(r["qid"], r["router_recall"], r["n_perfect"]) for r in hits] == [(2, 0.5, 4)]


def random_run(spark, seed=1, n=25):
    rng = random.Random(seed)
    lists = {q: [rng.randrange(12) for _ in range(rng.randrange(0, 30))] for q in range(n)}
    gold = {q: set(rng.sample(range(12), rng.randrange(0, 5))) for q in range(n)}
    run = [("m", q, d, i + 1) for q, ds in lists.items() for i, d in enumerate(ds)]
    rel = [(q, d) for q, g in gold.items() for d in g]
    return (
        lists,
        gold,
        spark.createDataFrame(run, "method string, qid bigint, doc_id bigint, rank int"),
        spark.createDataFrame(rel, "qid bigint, doc_id bigint"),
    )


def at(lists, gold, q, k):
    cut = set(lists[q][:k])
    tp = len(cut & gold[q])
    return tp, len(cut), (tp / len(cut) if cut else 0), (tp / len(gold[q]) if gold[q] else 0)


def test_micro_metrics(spark):
    lists, gold, run, rel = random_run(spark)
    for k in (1, 5, 20):
        tp = sum(at(lists, gold, q, k)[0] for q in lists)
        n = sum(at(lists, gold, q, k)[1] for q in lists)
        g = sum(map(len, gold.values()))
        want = {"precision": 100 * tp / n, "recall": 100 * tp / g, "f1": 200 * tp / (n + g)}
        for name, value in want.items():
            got = m.micro_metrics(run, rel, [k], ["method"], name).first()["value"]
            assert got == pytest.approx(value, abs=1e-5)


def test_macro_recall_counts_unanswered(spark):
    lists, gold, run, rel = random_run(spark)
    asked = [q for q in lists if lists[q] or gold[q]]
    got = {r["k"]: r["value"] for r in m.macro_recall(run, rel, [1, 5, 20], ["method"]).collect()}
    for k, value in got.items():
        assert value == pytest.approx(sum(at(lists, gold, q, k)[3] for q in asked) / len(asked), abs=1e-5)
    assert got[1] <= got[5] <= got[20] <= 1


def test_curve_and_average_precision(spark):
    lists, gold, run, rel = random_run(spark)
    questions = spark.createDataFrame([("m", q) for q in lists], "method string, qid bigint")
    curve = m.precision_recall_curve(run, rel, questions, ["method"], 50).collect()
    assert len(curve) == 50
    for r in curve:
        rows = [at(lists, gold, q, r["k"]) for q in lists]
        assert r["precision"] == pytest.approx(sum(x[2] for x in rows) / len(rows), abs=1e-5)
        assert r["recall"] == pytest.approx(sum(x[3] for x in rows) / len(rows), abs=1e-5)
    for r in m.average_precision(run, rel, questions, ["method"], 15).collect():
        pts = [(1.0, 0.0)] + [at(lists, gold, r["qid"], k)[2:] for k in range(1, 16)]
        area = sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(pts, pts[1:]))
        assert r["ap"] == pytest.approx(area, abs=1e-5)


def test_p_values():
    # published two-sided quantiles of Student's t
    for t, df, p in [(12.7062, 1, 0.05), (2.2281, 10, 0.05), (2.5758, 10**6, 0.01), (0.0, 5, 1.0), (-2.2281, 10, 0.05)]:
        assert m.t_p_value(t, df) == pytest.approx(p, abs=1e-4)
    assert m.t_p_value(None, 5) is None


def test_paired_t(spark):
    rows = [("a", q, x) for q, x in enumerate([1.0, 0.5, 1.0, 0.0])] + [("b", q, x) for q, x in enumerate([0.5, 0.5, 0.0, 0.0])]
    df = spark.createDataFrame(rows + [("c", q, r[2] - 1) for q, r in enumerate(rows[:4])], "method string, qid int, s double")
    got = {r["method"]: r for r in m.with_p_values(m.paired_t(df, "a", ["s"])).collect()}
    # differences .5 0 1 0: mean .375, sd .478714
    assert got["b"]["t"] == pytest.approx(0.375 / (0.4787136 / 2), abs=1e-5)
    assert got["b"]["df"] == 3 and 0.2 < got["b"]["p"] < 0.25
    assert got["c"]["t"] is None and got["c"]["p"] is None


def test_tables_of_results(spark):
    metrics = spark.createDataFrame([("r2", "a", "0.5"), ("r1", "a", "1"), ("r1", "b", "x")], "run string, key string, value string")
    assert [tuple(r) for r in m.leaderboard(metrics, ["a", "b"]).collect()] == [("r1", "1", "x"), ("r2", "0.5", "N/A")]
    wide = spark.createDataFrame([("Spider", 50.68, 72.15)], "Dataset string, `5000` double, `10000` double")
    assert sorted(tuple(r) for r in m.melt_sweep(wide, ["Dataset"], "recall").collect()) == [("Spider", 5000, 50.68), ("Spider", 10000, 72.15)]
    pct = spark.createDataFrame([(0.8529,), (1.0,)], "x double").select(m.percent_text(F.col("x")))
    assert [r[0] for r in pct.collect()] == ["85.29", "100.0"]
    v = spark.createDataFrame([("r", "loss", 1.0), ("r", "val/x", 2.0)], "run string, key string, value double")
    t = spark.createDataFrame([("r", "loss", 3.0)], "run string, key string, value double")
    assert {r["key"]: r["value"] for r in m.metric_history(v, t).collect()} == {"loss": 3.0, "val/x": 2.0}


def test_flat_predictions_keep_list_order(spark):
    pred = spark.createDataFrame(
        [(1, [("b", ["x", "y"]), ("a", []), ("c", ["z"])])],
        "qid bigint, pred_schemas array<struct<database:string,tables:array<string>>>",
    )
    rows = m.flatten_predictions(pred).orderBy("rank").collect()
    assert [(r["db"], r["tbl"], r["rank"]) for r in rows] == [("b", "x", 1), ("b", "y", 2), ("c", "z", 3)]


PRED = "qid bigint, pred_schemas array<struct<database:string,tables:array<string>>>"


def test_contexts(spark):
    cols = spark.createDataFrame(
        [("a", 0, "t", 0, "x"), ("a", 1, "u", 1, "y"), ("b", 0, "v", 0, "z")],
        "db string, tbl_pos int, tbl string, col_pos int, col string",
    )
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "qid bigint, db string")
    pred = spark.createDataFrame(
        [(1, [("b", ["v", "v"]), ("a", ["u", "nope"])]), (2, [("a", ["nope"])]), (3, [])], PRED
    )
    rank = pred.join(gold, "qid").select("qid", context.gold_rank(F.col("pred_schemas"), F.col("db")).alias("r"))
    assert {r["qid"]: r["r"] for r in rank.collect()} == {1: 1, 2: -1, 3: -1}
    nested = {r["qid"]: r["schemas"] for r in context.nest_context(context.context_predicted(pred, cols, 5)).collect()}
    plain = lambda s: [(x["name"], [(t["name"], t["columns"]) for t in x["tables"]]) for x in s]
    assert plain(nested[1]) == [("b", [("v", ["z"])]), ("a", [("u", ["y"])])]
    assert plain(nested[2]) == [("a", [])]
    hit = context.nest_context(context.context_gold_hit(pred, gold, cols)).collect()
    assert [(r["qid"], plain(r["schemas"])) for r in hit] == [(1, [("a", [("u", ["y"])])])]
    random5 = context.random_schemas(gold, cols).collect()
    assert len(random5) == 15
    assert {(r["qid"], r["db"]) for r in random5 if r["schema_pos"] == 2} == {(1, "a"), (2, "b"), (3, "b")}


def test_costs(spark):
    ddl = "call_id bigint, model string, prompt_tokens bigint, completion_tokens bigint"
    calls = spark.createDataFrame([(1, "gpt-4", 10**6, 10**6), (2, "gpt-3.5-turbo", 1000, 10)], ddl)
    assert {r["call_id"]: r["cost"] for r in cost.call_cost(calls).collect()} == {1: 90.0, 2: 0.000515}
    assert {r["call_id"]: r["cost"] for r in cost.usage_cost(calls).collect()} == {1: 90.0, 2: 0.00202}
    total = {r["model"]: r["cost"] for r in cost.total_cost(calls).collect()}
    assert total[None] == pytest.approx(90.000515)
    unknown = spark.createDataFrame([(1, "who", 1, 1)], ddl)
    assert cost.unknown_models(unknown).count() == 1
    with pytest.raises(Exception, match="Unknown model name: who"):
        cost.call_cost(unknown).collect()


def test_pending(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "req_id bigint, request string")
    done = spark.createDataFrame([("b",)], "request string")
    assert [tuple(r) for r in cost.pending_requests(req, done).collect()] == [("a", 2, 1)]


def test_running_cost_of_a_stream(spark, tmp_path):
    from routewright.streaming.running_cost import running_cost

    ddl = "call_id bigint, model string, prompt_tokens bigint, completion_tokens bigint"
    path = str(tmp_path / "calls")
    spark.createDataFrame([(1, "gpt-4", 10**6, 0)], ddl).write.json(path)
    totals = str(tmp_path / "totals")
    query = running_cost(spark.readStream.schema(ddl).json(path), totals)
    try:
        query.processAllAvailable()
        spark.createDataFrame([(2, "gpt-4", 0, 10**6)], ddl).write.mode("append").json(path)
        query.processAllAvailable()
    finally:
        query.stop()
    states = spark.read.parquet(totals)
    last = states.agg({"batch": "max"}).first()[0]
    rows = {r["model"]: r["cost"] for r in states.where(f"batch = {last}").collect()}
    assert rows == {"gpt-4": 90.0, None: 90.0}


def test_curves_list_a_question_once_per_document(spark):
    """Ranks without a document make no rows; questions without a list count with zeros."""
    run = spark.createDataFrame(
        [("m", 1, "a", 2), ("m", 1, "b", 3), ("m", 1, "a", 7), ("m", 2, "c", 1), ("m", 9, "c", 1), ("m", 2, "z", 60)],
        "method string, qid int, doc_id string, rank int",
    )
    rel = spark.createDataFrame([(1, "a"), (1, "x"), (2, "c")], "qid int, doc_id string")
    asked = spark.createDataFrame([("m", q) for q in (1, 2, 3, 3)], "method string, qid int")
    points = m._points(run, rel, 50, ["method"]).where("qid < 9")
    assert points.count() == 3
    got = m.precision_recall_curve(run, rel, asked, ["method"], 50).collect()
    curve = {r["k"]: (r["precision"], r["recall"]) for r in got}
    assert len(curve) == len(got) == 50
    assert curve[1] == (0.25, 0.25) and curve[2] == (0.5, 0.375) and curve[3] == curve[50] == (0.375, 0.375)
    ap = m.average_precision(run, rel, asked, ["method"], 15).collect()
    assert sorted((r["qid"], r["ap"]) for r in ap) == [(1, 0.25), (2, 1.0), (3, 0.0), (3, 0.0)]


def test_recall_shuffles_no_documents_below_its_cutoffs(spark, monkeypatch):
    """Ranks below all ks are one row a question; a question with such rows only still counts."""
    rows = [(q, f"d{i % 40}", i + 1) for q in (1, 2) for i in range(100)] + [(3, "d0", 50), (None, "d1", 1)]
    run = spark.createDataFrame(rows, "qid bigint, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "d1"), (1, "d30"), (2, "d4"), (4, "d9")], "qid bigint, doc_id string")
    seen, ranks = [], m.first_ranks
    monkeypatch.setattr(m, "first_ranks", lambda run, *a: seen.append(run) or ranks(run, *a))
    got = {x["qid"]: (x["r2"], x["r5"]) for x in m.query_recall(run, rel, [2, 5], []).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0), None: (0.0, 0.0)}
    assert all(x["n"] <= 6 for x in seen[0].distinct().groupBy("qid").agg(F.countDistinct("doc_id").alias("n")).collect())
    assert seen[0].where("qid = 1").select("qid", "doc_id").distinct().count() == 6
