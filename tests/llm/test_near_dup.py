from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import rows as R

from routewright.llm import components, near_dup as N


def _set(text):
    w = R.words(text)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def _linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def _plain(docs):
    sets = [_set(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if _linked(sets[i], sets[j]):
            parent[find(i)] = find(j)
    out, groups = [], []
    for i, d in enumerate(docs):
        same = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        least = min(same) if same else None
        groups.append(find(i))
        out.append((d[0], len(sets[i]), least if sets[i] else d[0], d[0] == (least if sets[i] else d[0])))
    return Counter(out), groups


def test_groups_equal_brute_force(spark):
    docs = R.documents(n=120)
    df = R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(4))
    assert Counter(tuple(r) for r in N.near_dup(df).collect()) == _plain(docs)[0]


def test_large_group_is_joined_across_blocks(spark, monkeypatch):
    """Members that are often not similar to the hub of their key, in blocks of a few."""
    import random

    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(4)
    base = R.text_of(rng, 150).split()
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = R.text_of(rng, 1)
        docs.append((i, " ".join(w), "en", "s", 1))
    got = Counter(tuple(r) for r in N.near_dup(spark.createDataFrame(docs, R.SCHEMA)).collect())
    assert got == _plain(docs)[0]


def test_one_of_each_group_stays(spark):
    docs = R.documents(n=90)
    df = R.clashing(spark.createDataFrame(docs, R.SCHEMA))
    got = N.drop_near_copies(df)
    assert got.columns == df.columns
    _, groups = _plain(docs)
    blank = [g for g, d in zip(groups, docs, strict=True) if not _set(d[1])]
    # Blank documents are groups of their own; equal rows stay once.
    wanted = len({g for g in groups if g not in blank}) + len(
        {d[:2] for d in docs if not _set(d[1])}
    )
    rows = got.collect()
    assert len(rows) == wanted and len({r.doc_id for r in rows if r.doc_id is not None}) >= wanted - 1


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.75, 0.9):
        errors = []
        for _ in range(20):
            n = 1000
            both = int(2 * n * share / (1 + share))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - both :])
            low = np.array([N.minima(a), N.minima(b)])
            guess = N._estimates(*(N.packed(low).view(np.uint64)[i : i + 1] for i in (0, 1)))[0, 0]
            errors.append(guess - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_column_estimate_equals_array_estimate(spark):
    low = np.array([N.minima(np.arange(s, s + 400, dtype=np.uint64) * np.uint64(1 << 33)) for s in (1, 60)])
    packed = N.packed(low)
    df = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "x array<bigint>, y array<bigint>")
    got = df.select(N.estimate("x", "y")).first()[0]
    x = packed.view(np.uint64)
    assert abs(got - N._estimates(x[:1], x[1:])[0, 0]) < 1e-9


def test_short_texts_are_one_shingle():
    sets = N.shingle_sets(pa.array(["a b", "A  b", "b a", "", None, "a b c d e", "a b c d e f"]))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 1, 2]
    assert (sets[0] == sets[1]).all() and sets[0][0] != sets[2][0]


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"x{i}") for i in range(50)]
    edges += [("a", "a"), ("a", "b"), ("b", "a")]
    rng.shuffle(edges)
    got = components.components(spark.createDataFrame([tuple(map(str, e)) for e in edges], "a string, b string"))
    roots = {}
    for r in got.collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [2, 51, 61]


def test_without_rows(spark):
    empty = spark.createDataFrame([], R.SCHEMA)
    assert N.near_dup(empty).count() == 0 and N.drop_near_copies(empty).count() == 0
