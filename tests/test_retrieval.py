import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from routewright import session
from routewright.operators import block_scan, cover, dense, retrieval as r

WORDS = [f"w{i}" for i in range(30)]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    docs = [(i, f"d{i % 7}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 25)))) for i in range(n)]
    docs += [(n, "d0", ""), (n + 1, "d1", "only here")]
    queries = [(q, " ".join(rng.choices(WORDS, k=4)) + " w1 w1") for q in range(5)] + [(9, "nothing")]
    return docs, queries


def brute(docs, queries, k1=1.2, b=0.75):
    toks = {d: t.split() for d, _, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = collections.Counter(w for t in toks.values() for w in set(t))
    out = {}
    for q, text in queries:
        scores = {}
        for d, t in toks.items():
            tf = collections.Counter(t)
            hit = [w for w in text.split() if w in tf]
            if hit:
                scores[d] = sum(
                    math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg))
                    for w in hit
                )
        out[q] = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))
    return out


def frames(spark, parts=None):
    docs, queries = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, db string, text string")
    q = spark.createDataFrame(queries, "qid bigint, text string")
    return docs, queries, df.repartition(parts) if parts else df, q


def as_lists(run):
    out = collections.defaultdict(list)
    for x in run.orderBy("qid", "rank").collect():
        out[x["qid"]].append((x["score"], x["doc_id"]))
    return out


def test_search_is_exact(spark):
    docs, queries, df, q = frames(spark)
    got = as_lists(r.search(r.build_index(df), q, 10))
    want = brute(docs, queries)
    for qid, _ in queries:
        assert [d for _, d in got[qid]] == [d for _, d in want[qid][:10]]
        assert np.allclose([s for s, _ in got[qid]], [s for s, _ in want[qid][:10]])


def test_search_does_not_depend_on_partitioning(spark):
    runs = [as_lists(r.search(r.build_index(frames(spark, p)[2]), frames(spark)[3], 10)) for p in (1, 17)]
    assert runs[0] == runs[1]


def test_parts_of_a_document_count_together(spark):
    docs, _, df, q = frames(spark)
    halves = [
        (d, db, half) for d, db, t in docs
        for half in (" ".join(t.split()[:3]), " ".join(t.split()[3:]))
    ]
    cut = spark.createDataFrame(halves, df.schema)
    assert as_lists(r.search(r.build_index(df), q, 10)) == as_lists(r.search(r.build_index(cut), q, 10))


def test_index_written_and_read(spark, tmp_path):
    _, _, df, q = frames(spark)
    index = r.build_index(df)
    index.write(str(tmp_path / "index"))
    again = r.Bm25Index.read(spark, str(tmp_path / "index"))
    assert as_lists(r.search(again, q, 5)) == as_lists(r.search(index, q, 5))


def test_predicted_schemas(spark):
    docs, queries, df, q = frames(spark)
    run = r.search(r.build_index(df), q, 20)
    db_of = {d: db for d, db, _ in docs}
    pred = {x["qid"]: x["pred_schemas"] for x in r.predicted_schemas(run, q).collect()}
    assert pred[9] == []
    for qid, ranked in brute(docs, queries).items():
        if not ranked:
            continue
        by_db = collections.defaultdict(list)
        for s, d in ranked[:20]:
            by_db[db_of[d]].append((s, d))
        mean = {db: round(sum(s for s, _ in v) / len(v) + 1e-9, 6) for db, v in by_db.items()}
        best = sorted(mean, key=lambda db: (-mean[db], db))[:5]
        assert [s["database"] for s in pred[qid]] == best
        assert [s["tables"] for s in pred[qid]] == [[str(d) for _, d in by_db[db]] for db in best]


def test_beams(spark):
    beams = spark.createDataFrame(
        [(1, 0, "b", ["x", "y"]), (1, 1, "a", []), (1, 2, "b", ["z", "y"]), (1, 3, "a", ["q"])],
        "qid bigint, beam int, database string, tables array<string>",
    )
    pred = r.beam_aggregate(beams).first()["pred_schemas"]
    assert [(s["database"], s["tables"]) for s in pred] == [("b", ["y", "x", "z"]), ("a", ["q"])]


def test_autotune_matches_single_searches(spark):
    docs, queries, df, q = frames(spark)
    rng = random.Random(1)
    rel = [(qid, rng.randrange(60)) for qid in range(5) for _ in range(3)]
    qrels = spark.createDataFrame(rel, "qid bigint, doc_id bigint").distinct()
    grid = [(0.5, 0.2), (1.2, 0.75), (2.0, 1.0)]
    tuned = {(x["k1"], x["b"]): x["recall"] for x in r.autotune(r.build_index(df), q, qrels, grid).collect()}
    gold = collections.defaultdict(set)
    for qid, d in rel:
        gold[qid].add(d)
    for k1, b in grid:
        want = brute(docs, queries, k1, b)
        recalls = [len({d for _, d in want[x][:10]} & g) / len(g) for x, g in gold.items()]
        assert abs(tuned[k1, b] - sum(recalls) / len(recalls)) < 1e-6
    best = r.best_parameters(r.autotune(r.build_index(df), q, qrels, grid)).first()
    assert tuned[best["k1"], best["b"]] == max(tuned.values())


def vectors(spark, n, ddl, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8)).astype("float32")
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], ddl)


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "SLICE", 50)
    monkeypatch.setattr(dense, "TILE", 2)
    q, qdf = vectors(spark, 7, "qid bigint, vec array<float>", 1)
    d, ddf = vectors(spark, 300, "doc_id bigint, vec array<float>", 2)
    q64, d64 = q.astype(float), d.astype(float)
    cos = (q64 / np.linalg.norm(q64, axis=1, keepdims=True)) @ (d64 / np.linalg.norm(d64, axis=1, keepdims=True)).T
    for block in (100, 3):
        monkeypatch.setattr(dense, "BLOCK", block)
        run = dense.dense_search(qdf, ddf.repartition(5), 12).collect()
        for i in range(7):
            mine = sorted((x for x in run if x["qid"] == i), key=lambda x: x["rank"])
            assert [x["doc_id"] for x in mine] == list(np.lexsort((np.arange(300), -np.round(cos[i], 6)))[:12])


def test_pooling(spark):
    rows = [(1, 1, [1.0, 3.0], 1), (1, 2, [3.0, 5.0], 1), (1, 3, [9.0, 9.0], 0), (2, 5, [4.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "text_id bigint, pos bigint, vec array<float>, mask int")
    assert {x["text_id"]: x["vec"] for x in dense.masked_mean_pool(df).collect()} == {1: [2.0, 4.0], 2: [4.0, 4.0]}
    assert {x["text_id"]: x["vec"] for x in dense.cls_pool(df).collect()} == {1: [1.0, 3.0], 2: [4.0, 4.0]}


def greedy(cells, n_segments, budget):
    """Plain loops over the full matrix; cells[segment][document] = score."""
    docs = list(dict.fromkeys(d for s in range(n_segments) for d in cells[s]))
    half = [[(cells[s].get(d, 0) + 1) / 2 for d in docs] for s in range(n_segments)]
    entropy = []
    for row in half:
        p = [x / sum(row) for x in row]
        entropy.append(-sum(x * math.log(x) for x in p))
    mean = sum(entropy) / n_segments
    weight = [1 / (1 + math.exp(-(mean - e))) for e in entropy]
    covered, chosen = set(), {}
    while len(chosen) < min(budget, len(docs)):
        if len(covered) == n_segments:
            covered = set()
        best = None
        for s in range(n_segments):
            if s in covered:
                continue
            for i, d in enumerate(docs):
                value = 0 if d in chosen else weight[s] * half[s][i]
                if best is None or value > best[0]:
                    best = (value, s, d)
        covered.add(best[1])
        chosen[best[2]] = best[0]
    return weight, list(chosen.items())


def test_segment_cover(spark):
    rng = random.Random(4)
    cells, rows, asked = {}, [], []
    for q, n in enumerate((3, 1, 4)):
        cells[q] = []
        for s in range(n):
            # the last segment of the last question retrieves nothing
            picked = [] if (q, s) == (2, 3) else rng.sample(range(40), rng.randrange(2, 12))
            scored = sorted(((rng.random() * 5, d) for d in picked), reverse=True)
            cells[q].append({d: x for x, d in scored})
            asked.append((q, s))
            rows += [(q, s, d, f"db{d % 3}", x, i + 1) for i, (x, d) in enumerate(scored)]
    run = spark.createDataFrame(rows, "qid bigint, sid int, doc_id bigint, db string, score double, rank int")
    queries = spark.createDataFrame(asked, "qid bigint, sid int")
    matrix = cover.score_matrix(run)
    weights = cover.segment_weights(matrix, queries)
    got_w = {(x["qid"], x["sid"]): x["weight"] for x in weights.collect()}
    got = cover.greedy_cover(matrix, weights, budget=6).orderBy("qid", "rank").collect()
    for q, segs in cells.items():
        want_w, want = greedy(segs, len(segs), 6)
        assert np.allclose([got_w[q, s] for s in range(len(segs))], want_w)
        mine = [x for x in got if x["qid"] == q]
        assert [x["doc_id"] for x in mine] == [d for d, _ in want]
        assert np.allclose([x["score"] for x in mine], [s for _, s in want])
        assert all(x["db"] == f"db{x['doc_id'] % 3}" for x in mine)


def test_cover_shuffles_the_run_once_by_question(spark):
    schema = "qid bigint, sid int, doc_id bigint, db string, score double, rank int"
    run = spark.createDataFrame([(1, 0, 5, "a", 2.0, 1)], schema)
    weights = spark.createDataFrame([(1, 0, 0.5)], "qid bigint, sid int, weight double")

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert exchanges(cover.score_matrix(run)) == 1
    # one for the run, one for the weights
    assert exchanges(cover.greedy_cover(run, weights)) == 2


def test_cover_leaves_out_what_has_no_weight_or_key(spark):
    schema = "qid bigint, sid int, doc_id bigint, db string, score double, rank int"
    rows = [
        (1, 0, 5, "a", 2.0, 1), (1, 7, 6, "a", 9.0, 1), (2, 0, 8, "a", 1.0, 1),
        (None, 0, 5, "a", 2.0, 1), (3, None, 5, "a", 2.0, 1),
    ]
    asked = [(1, 0, 0.5), (1, 1, 0.4), (None, 0, 0.5), (3, None, 0.5), (4, 0, 0.5)]
    weights = spark.createDataFrame(asked, "qid bigint, sid int, weight double")
    got = cover.greedy_cover(spark.createDataFrame(rows, schema), weights).collect()
    assert [tuple(x) for x in got] == [(1, 5, "a", 0.75, 1)]


@pytest.mark.parametrize("dense", [0, 8, 1 << 40])
@pytest.mark.parametrize("hits", [3, 1 << 20])
def test_block_sums_are_the_matrix_product(monkeypatch, dense, hits):
    """Whether a term goes as an array or hit by hit, for any size of a step."""
    monkeypatch.setattr(block_scan, "DENSE", dense)
    monkeypatch.setattr(block_scan, "HITS", hits)
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(30)]
    term, of = np.nonzero(rng.random((30, 7)) < np.linspace(0.1, 1, 30)[:, None])
    ws = rng.normal(size=len(term))
    asked = block_scan._Asked(pa.array([names[i] for i in term]), of, ws, 7)
    number = {x: i for i, x in enumerate(asked.known.to_pylist())}
    doc, own = np.nonzero(rng.random((11, 30)) < 0.4)
    held = np.array([names[i] in number for i in own])
    doc, own = doc[held], own[held]
    value, at = rng.random(len(doc)), np.array([number[names[i]] for i in own])
    full, w = np.zeros((11, 30)), np.zeros((30, 7))
    full[doc, own], w[term, of] = value, ws
    assert np.allclose(asked.sums(11, doc, at, value), full @ w)
    met = asked.sums(11, doc, at, np.ones(len(at)), met=True) > 0
    assert (met == ((full > 0).astype(float) @ (w != 0) > 0)).all()


def test_segment_queries_drop_repeats(spark):
    q = spark.createDataFrame([(1, "how many")], "qid bigint, question string")
    s = spark.createDataFrame([(1, ["a.b", "a.b", "c.d"])], "qid bigint, segments array<string>")
    rows = cover.segment_queries(q, s).orderBy("sid").collect()
    assert [(x["sid"], x["text"]) for x in rows] == [(0, "how many a.b"), (1, "how many c.d")]


def test_few_shot(spark):
    train = spark.createDataFrame(
        [(1, "a", "blue car", "SELECT 1"), (2, "b", "red car", "SELECT 2"), (3, "a", "house", "SELECT 3")],
        "qid bigint, db string, question string, sql string",
    )
    cols = spark.createDataFrame(
        [("a", 0, "t", 0, "x"), ("a", 0, "t", 1, "y"), ("b", 0, "u", 0, "z")],
        "db string, tbl_pos int, tbl string, col_pos int, col string",
    )
    q = spark.createDataFrame([(7, "a red car")], "qid bigint, text string")
    index = r.build_index(r.few_shot_documents(train))
    rows = r.few_shot_examples(index, q, train, cols, 2).orderBy("rank", "col_pos").collect()
    assert [(x["rank"], x["sql"], x["col"]) for x in rows] == [(1, "SELECT 2", "z"), (2, "SELECT 1", "x"), (2, "SELECT 1", "y")]


def test_search_leaves_out_what_cannot_be_among_the_best(spark, monkeypatch):
    """Common words alone bring no document in once k documents share the rare ones."""
    monkeypatch.setattr(r, "BLOCK_DOCS", 40)
    monkeypatch.setattr(r, "PROBED", 4)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(6)]
    docs = [(i, "d0", " ".join(rng.choices(common, k=12))) for i in range(1500)]
    docs += [
        (2000 + 20 * q + j, "d1", f"r{q} s{q} " + " ".join(rng.choices(common, k=6)))
        for q in range(8) for j in range(20)
    ]
    queries = [(q, f"r{q} s{q} " + " ".join(common)) for q in range(8)]
    queries += [(20, "c0 c1"), (21, "r1"), (22, "c0 r1 r2 c0 c3")]
    df = spark.createDataFrame(docs, "doc_id bigint, db string, text string")
    index, q = r.stored_index(df), spark.createDataFrame(queries, "qid bigint, text string")
    for k1, b in ((1.2, 0.75), (2.0, 0.0)):
        got, want = as_lists(r.search(index, q, 10, k1, b)), brute(docs, queries, k1, b)
        for qid, _ in queries:
            assert got[qid] == [(s, d) for s, d in want[qid][:10]]
    steps = r.prune(index, q, 10)
    pairs = sum(len(x) for x in brute(docs, queries).values())
    rare = [x for x in range(8)]
    assert steps.candidates.where(F.col("qid").isin(rare)).count() <= 8 * 20
    assert steps.probed.count() <= 11 * r.PROBED * 10 + 1700
    n_blocks = index.bounds.select("block").distinct().count()
    assert steps.blocks.where(F.col("qid").isin(rare)).count() < 8 * 2 * n_blocks
    assert steps.candidates.count() < pairs / 3


def test_lazy_cover_picks_what_the_full_matrix_gives():
    rng = random.Random(9)
    for _ in range(300):
        n_docs, n = rng.randrange(1, 9), rng.randrange(1, 6)
        cells = {
            s: [(rng.choice([0.0, 0.5, 1.0, 2.0]), d) for d in rng.sample(range(n_docs), rng.randrange(n_docs + 1))]
            for s in range(n)
        }
        weights = [rng.choice([0.3, 0.5, 0.6]) for _ in range(n)]
        gain = np.full((n, n_docs), 0.5)
        for s, row in cells.items():
            for x, d in row:
                gain[s, d] = (x + 1) / 2
        gain *= np.array(weights)[:, None]
        open_, free, want = np.ones(n, bool), np.ones(n_docs, bool), []
        while len(want) < min(6, n_docs):
            if not open_.any():
                open_[:] = True
            s, d = np.unravel_index(np.argmax(np.where(open_[:, None] & free, gain, -1)), gain.shape)
            want.append((int(d), gain[s, d]))
            open_[s], free[d] = False, False
        assert cover.lazy_cover(cells, weights, n_docs, 6) == want


def test_lazy_cover_of_many_segments():
    """The full matrix of this question would have 2.5 billion cells."""
    rng = random.Random(10)
    cells = {s: [(rng.random(), s * 100 + i) for i in range(100)] for s in range(5000)}
    picks = cover.lazy_cover(cells, [0.5] * 5000, 500_000, 20)
    best = sorted((max(x) for x in cells.values()), reverse=True)[:20]
    assert [d for d, _ in picks] == [d for _, d in best]


def test_dense_search_leaves_out_far_cells(spark, monkeypatch):
    """Tight groups of vectors: a query reads its own group's cells and few others."""
    monkeypatch.setattr(dense, "CELL_DOCS", 20)
    monkeypatch.setattr(dense, "FIRST_CELLS", 1)
    monkeypatch.setattr(dense, "GROWTH", 2)
    rng = np.random.default_rng(6)
    heads = rng.normal(size=(12, 16))
    rows = np.concatenate([h + rng.normal(size=(40, 16)) * 0.05 for h in heads]).astype("float32")
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "doc_id bigint, vec array<float>")
    asked = [(q, [float(x) for x in rows[q * 40]]) for q in range(12)] + [(50, [0.0] * 16)]
    queries = spark.createDataFrame(asked, "qid bigint, vec array<float>")
    index = dense.CellIndex(docs)
    best, looked = dense._search_block(index, queries, 10)
    assert looked < 13 * len(index.cells) / 2
    plan = index.read([0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for qid, vec in asked:
        cos = np.round(unit @ (np.array(vec) / (np.linalg.norm(vec) or 1)), 6)
        want = np.lexsort((np.arange(len(cos)), -cos))[:10]
        got = [r.doc_id for r in best.where(f"qid = {qid}").orderBy("rank").collect()]
        assert got == want.tolist()


def test_vectors_meet_the_centres_a_few_at_a_time(spark, monkeypatch):
    """The scores of a task's vectors with all centres are never held together."""
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(2_000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tracemalloc.start()
    own = dense.nearest(unit, unit[:1_000])
    assert tracemalloc.get_traced_memory()[1] < 2_000 * 1_000 * 8 / 4
    tracemalloc.stop()
    assert (own == (unit @ unit[:1_000].T).argmax(axis=1)).all()
    assert len(dense.nearest(unit[:0], unit)) == 0
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit[:300])], "doc_id bigint, vec array<double>")
    asked = vectors.where("doc_id < 40").withColumnRenamed("doc_id", "qid")
    monkeypatch.setattr(dense, "CELL_DOCS", 16)
    found = []
    for meet in (3, 256):
        monkeypatch.setattr(dense, "MEET", meet)
        found.append(sorted(tuple(x) for x in dense.dense_search(asked, vectors, 7).collect()))
    assert len(found[0]) == 40 * 7 and found[0] == found[1]


def test_common_words_are_scored_without_listing_pairs(spark, monkeypatch):
    """Only the best of a query leave a task of the block scan, for several parameters at once."""
    monkeypatch.setattr(r, "PROBED", 0)
    monkeypatch.setattr(block_scan, "PACK_DOCS", 50)
    monkeypatch.setattr(block_scan, "QUERY_BLOCK", 3)
    monkeypatch.setattr(block_scan, "BLOCKS_A_TASK", 1)
    rng = random.Random(12)
    docs = [(i, f"d{i % 3}" if i % 9 else None, " ".join(rng.choices(WORDS[:6], k=rng.randrange(3, 9)))) for i in range(600)]
    docs += [(1000 + i, "d5", docs[0][2]) for i in range(30)]
    queries = [(q, " ".join(rng.choices(WORDS[:6], k=3))) for q in range(8)] + [(20, "nothing")]
    left, scan = [], r.best_of_blocks
    monkeypatch.setattr(r, "best_of_blocks", lambda *a: left.append(scan(*a)) or left[-1])
    df = spark.createDataFrame([(f"n{d:04}", db, t) for d, db, t in docs], "doc_id string, db string, text string")
    q, grid = spark.createDataFrame(queries, "qid bigint, text string"), [(1.2, 0.75), (2.0, 0.0)]
    run = r.grid_runs(r.stored_index(df.repartition(3)), q, grid, 10).cache()
    db_of = {f"n{d:04}": db for d, db, _ in docs}
    for i, (k1, b) in enumerate(grid):
        got, want = as_lists(run.where(f"pair = {i}")), brute(docs, queries, k1, b)
        for qid, _ in queries:
            assert got[qid] == [(s, f"n{d:04}") for s, d in want[qid][:10]]
    assert all(x["db"] == db_of[x["doc_id"]] for x in run.collect())
    tasks = left[0].rdd.getNumPartitions()
    assert left[0].count() <= tasks * 2 * 8 * 10


def test_wide_rows_are_written_in_small_row_groups(spark, monkeypatch):
    rows = spark.range(0, 40, 1, 1).select("id", F.expr("transform(sequence(1, 125000), i -> xxhash64(i, id))").alias("x"))
    kept = session.cut_lineage(rows, wide=True)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40
    assert max(g.total_byte_size for g in groups) < 20 << 20
    # Documents and queries of the block scan are such rows.
    wide = []
    for module in (r, block_scan):
        real = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, real=real, **k: wide.append((df.columns[0], k)) or real(df, **k))
    monkeypatch.setattr(r, "PROBED", 0)
    monkeypatch.setattr(r, "WIDE", 1 << 40)
    _, _, df, q = frames(spark)
    r.search(r.build_index(df), q, 5).collect()
    assert ("ids", {"wide": True}) in wide and ("block", {"wide": True}) in wide


def test_the_first_documents_set_a_floor():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 40, (300, 6)) / 8, rng.permutation(300)
    scores[:, 5], dbs = np.where(np.arange(300) < 7, 1.0, 0.0), np.full(300, "d", dtype=object)
    best = block_scan._Best(6, 10)
    best.add(scores, scores > 0, ids, dbs)
    # Only ties of the tenth and better ones are held; a query with fewer documents keeps them all.
    assert best.held == sum(int((c >= max(np.sort(c)[-10], 1 / 8)).sum()) for c in scores.T)
    best.cut()
    q, shown, _, got, _ = best.rows[0]
    for i, column in enumerate(scores.T):
        want = sorted((-s, d) for s, d in zip(column, ids, strict=True) if s > 0)[:10]
        assert sorted(zip(-shown[q == i], got[q == i], strict=True)) == want


def test_queries_reach_a_scan_task_once(spark, monkeypatch):
    monkeypatch.setattr(r, "PROBED", 0)
    monkeypatch.setattr(r, "WIDE", 1 << 40)
    monkeypatch.setattr(block_scan, "PACK_DOCS", 5)
    _, _, df, q = frames(spark, 2)
    scans = []
    real = r.best_of_blocks
    monkeypatch.setattr(r, "best_of_blocks", lambda *a: scans.append(real(*a)) or scans[-1])
    r.search(r.stored_index(df), q, 5).collect()
    sent = scans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"AS {c}#" in sent for c in ("keys", "qs", "asked", "ws")) and "(nth" in sent


@pytest.mark.parametrize("most", [0, 60, 1 << 20])
def test_hits_stay_at_the_home_of_a_query(spark, monkeypatch, most):
    """Each query has one home, a term of its own unless that has too many hits; no roll-up moves its rows."""
    monkeypatch.setattr(r, "HOME_HITS", most)
    docs, queries, df, q = frames(spark)
    wanted = brute(docs, queries)
    run = r.search(r.stored_index(df), q, 10, homes=True)

    def exchanges(df):
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count(" Exchange ")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(r.roll_up(run)) == exchanges(run)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = run.collect()
    home = {x["qid"]: x["home"] for x in rows}
    assert len({(x["qid"], x["home"]) for x in rows}) == len(home)
    words = {x: t.split() for x, t in queries}
    assert any(home[x] in words[x] for x in home) == (most > 0)
    assert all(home[x] in words[x] or home[x][0] == "\0" for x in home)
    got = as_lists(run)
    assert all(got[x] == wanted[x][:10] for x, _ in queries)
    plain = run.drop("home")
    assert sorted(r.roll_up(run).collect()) == sorted(r.roll_up(plain).collect())
    pred = [sorted(r.predicted_schemas(x, q, 3).collect()) for x in (run, plain)]
    assert pred[0] == pred[1]
    # A query of one term moves no hit at all.
    one = r.search(r.stored_index(df), q.where("qid < 2").select("qid", F.substring_index("text", " ", 1).alias("text")), 10, homes=True)
    found = [x for x in one.collect() if most > 100 and x["home"][0] == "\0"]
    assert not found


def test_lengths_of_a_stored_index(spark):
    parts = [(1, "a", "x y"), (1, "b", "z"), (2, "a", ""), (None, "a", "u v"), (None, None, "w"), (3, None, None)]
    df = spark.createDataFrame(parts, "doc_id bigint, db string, text string")
    index = r.stored_index(df)
    assert dict(index.lengths.collect()) == dict(r.build_index(df).lengths.collect()) == {1: 3, 2: 0, None: 3, 3: 0}
    assert " Exchange " not in index.lengths._jdf.queryExecution().executedPlan().toString()
    assert tuple(index.stats.first()) == tuple(r.build_index(df).stats.first())
