import zlib

import numpy as np
import pyarrow as pa
import rows as R

from routewright.llm import quality as Q
from routewright.llm.common import load

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_documents_are_told_apart(spark):
    got = Q.quality(load(spark, SF, "documents"), load(spark, SF, "labels"))
    kind = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    rows = got.collect()
    assert len(rows) == load(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [r for r in rows if r.held_out and r.doc_id in kind]
    assert np.mean([r.predicted == kind[r.doc_id] for r in tested]) > 0.95


def test_pairs_are_ranked_by_their_features():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, Q.FEATURES)), rng.normal(-1, 1, (60, Q.FEATURES))
    ranking = Q.fit(good, bad, 1 / 6)
    scores = np.concatenate([ranking.score(good), ranking.score(bad)])
    assert ranking.score(good).mean() > 0.9 > 0.1 > ranking.score(bad).mean()
    assert abs((scores < Q.THRESHOLD).mean() - 1 / 6) < 0.02


def test_features_see_whole_texts():
    long = "plain words. " * 5000
    x = Q.features(pa.array([long, long + "!? " * 5000, "", None, "\n\n", "a"]))
    assert x.shape == (6, Q.FEATURES) and np.isfinite(x).all()
    assert (x[0] != x[1]).any() and (x[2] == x[3]).all()


def test_hard_rows_and_missing_labels(spark):
    docs = R.clashing(spark.createDataFrame(R.documents(), R.SCHEMA))
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, 0), (9999, 0, 0), (1, 0, 1)], LABELS
    )
    got = Q.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.quality(spark.createDataFrame([], R.SCHEMA), labels).count() == 0


def test_all_labels_are_fitted(spark, monkeypatch):
    """Any number of labels: a kind that only a tenth of the blocks would see, and every row counts."""
    monkeypatch.setattr(Q, "BLOCK", 100)
    monkeypatch.setattr(Q, "BINS", 16)
    rng = np.random.default_rng(1)
    kinds = [(i, int(i % 40 != 0), 0) for i in range(5000)]
    found = [(i, [float(v) for v in rng.normal(1 if q else -1, 1, Q.FEATURES)]) for i, q, _ in kinds]
    rows = spark.createDataFrame(found, "doc_id bigint, found array<double>")
    labels = spark.createDataFrame(kinds, LABELS)
    seen, used = [], Q._fit_blocks
    monkeypatch.setattr(Q, "_fit_blocks", lambda r, c, s: seen.append((c, s)) or used(r, c, s))
    ranking = Q.learn(rows, labels)
    learnt = [q for i, q, _ in kinds if zlib.crc32(str(i).encode()) % 5]
    assert seen[0][0] == {1: sum(learnt), 0: len(learnt) - sum(learnt)} and sum(learnt) > 3800
    raw = ranking.raw(np.array([x for _, x in found]))
    good, bad = raw[[q == 1 for _, q, _ in kinds]], raw[[q == 0 for _, q, _ in kinds]]
    assert good.mean() > bad.mean() and (good > ranking.threshold).mean() > 0.95 and (bad < ranking.threshold).mean() > 0.95
    own = [i for i, _, _ in kinds if zlib.crc32(str(i).encode()) % 5]
    # The labelled share of bad documents lies below the threshold.
    assert abs((raw[own] < ranking.threshold).mean() - seen[0][1]) < 0.01
