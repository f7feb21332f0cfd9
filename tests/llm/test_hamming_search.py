import numpy as np
import pytest

from routewright.llm import hamming_search as H

SCHEMA = "vec_id bigint, embedding array<float>"


def _vectors(seed=1, n=260):
    """Random and clustered codes, a very common one, repeated and odd rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 64))
    rows = []
    for i in range(n):
        kind = i % 3
        v = rng.normal(size=64) if kind == 0 else centres[i % 4] + rng.normal(size=64) * (0.3 if kind == 1 else 0)
        rows.append((i, [float(x) for x in v]))
    rows += [(5, rows[5][1]), (1000, None), (1050, []), (1100, [1.0] * 63), (None, rows[2][1])]
    rows += [(1150, [None] * 10 + [float("nan")] * 10 + [1.0] * 44)]
    return rows


def _plain(rows, k):
    def code(v):
        return [bool(x is not None and x > 0) for x in v]

    known = [(i, code(v)) for i, v in rows if v is not None and len(v) == 64]
    out = []
    for q, c in known:
        if q is None or q % 50:
            continue
        near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), i is None, i or 0) for i, d in known)
        out += [(q, None if none else i, d, r + 1) for r, (d, none, i) in enumerate(near[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 10, 400])
def test_nearest_equal_brute_force(spark, k):
    rows = _vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' as code", "1 as rank")
    got = H.search(df, df.where("vec_id % 50 = 0"), k).collect()
    assert sorted(map(tuple, got), key=str) == _plain(rows, k)


def test_blocks_do_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(H, "ENTRIES", 20)
    monkeypatch.setattr(H, "QUERIES", 2)
    rows = _vectors(seed=2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.search(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got), key=str) == _plain(rows, 10)


def test_radius_grows_until_covered():
    rng = np.random.default_rng(3)
    code = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    index, copies = H.SegmentIndex(code), np.ones(3000, dtype=np.int64)
    for query in [int(code[7]), 0, -1]:
        place, distance = index.search(query, 10, copies)
        true = np.bitwise_count(code.view(np.uint64) ^ np.uint64(query & ((1 << 64) - 1)))
        kth = np.sort(true)[9]
        assert sorted(place) == np.flatnonzero(true <= kth).tolist()
        assert (distance == true[place]).all()


def test_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.search(empty, empty).count() == 0
