import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import rows as R
from hypothesis import given, settings
from hypothesis import strategies as st

from routewright.llm import ball_search as B

ITEMS = "item_id bigint, text string, extra string"


def _terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _plain(docs, items):
    """Every item against every document."""
    own = [(d[0], Counter(_terms(d[1]))) for d in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    total = sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    w = {t: math.floor(1000 * math.log((2.0 * len(own) + 2) / (2.0 * x + 1))) for t, x in df.items()}
    out = []
    for item, text, *_ in items:
        found = []
        for i, c, n in own:
            m = 10 + 90 * n * len(own) // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:10], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    more = [(4000 + i, R.text_of(rng, 20), "en", "s0", 1) for i in range(150)]
    return R.documents() + more + [(5000, "A-b_c9 É\x7fx 　y", "en", "s", 1)]


@pytest.fixture(scope="module")
def items(docs):
    rng = random.Random(4)
    some = [(i, " ".join(rng.sample((docs[i * 7 % len(docs)][1] or "a b").split() or ["x"], 1) * 2) + " "
             + (docs[i][1] or ""), "x") for i in range(25)]
    odd = [(90, None), (91, ""), (92, "?!"), (None, "ab cd"), (None, "ab cd"), (93, "nowhereatall"), (94, docs[-1][1])]
    return some + [(*x, "y") for x in odd]


@pytest.mark.parametrize(("entries", "terms", "leaf"), [(1 << 17, 1 << 17, 32), (60, 1 << 17, 2), (500, 100, 4)])
def test_ranks_are_those_of_all_pairs(spark, docs, items, monkeypatch, entries, terms, leaf):
    monkeypatch.setattr(B, "SUBTREE_ENTRIES", entries)
    monkeypatch.setattr(B, "BLOCK_TERMS", terms)
    monkeypatch.setattr(B, "LEAF", leaf)
    d = R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(3))
    got = B.search(d, spark.createDataFrame(items, ITEMS).repartition(2)).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == _plain(docs, items)


def _tree_of(rng, n, n_terms):
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.3:
            rows.append(rows[-1])
            continue
        t = np.sort(rng.choice(n_terms, rng.integers(1, 12), replace=False))
        rows.append((t, rng.integers(1, 10**10, len(t))))
    at = np.cumsum([0, *(len(r[0]) for r in rows)])
    return rows, at, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300))
def test_balls_hold_their_documents_and_bounds_their_scores(seed, n):
    rng = np.random.default_rng(seed)
    rows, at, term, value = _tree_of(rng, n, 40)
    tree = B.build(at, term, value, 40)
    wanted = np.sort(rng.choice(40, 6, replace=False))
    under = list(tree["leaves"])
    for node in range(len(under) - 1, -1, -1):
        if tree["children"][node][0] >= 0:
            under[node] = np.concatenate([under[c] for c in tree["children"][node]])
    assert sorted(under[0].tolist()) == list(range(n))
    for node, (terms, mean) in enumerate(tree["centroids"]):
        centre = np.zeros(40)
        centre[terms] = mean
        for j in under[node]:
            v = np.zeros(40)
            v[rows[j][0]] = rows[j][1]
            assert np.linalg.norm(v - centre) <= tree["radius"][node]
            bound = (centre[wanted].sum() + math.sqrt(len(wanted)) * tree["radius"][node]) * (1 + B.SLACK) + 1
            assert sum(int(x) for t, x in zip(*rows[j], strict=True) if t in set(wanted.tolist())) <= bound


def test_far_subtrees_are_pruned(spark):
    """Documents that hold an item whole set a mark that others' balls do not reach."""
    rng = random.Random(5)
    said = [R.text_of(rng, 12) for _ in range(12)]
    docs = [(i, f"{said[i % 12]} the end", "en", "s", 1) for i in range(240)]
    docs += [(1000 + i, " ".join(rng.choices(["the", "end", "of", "a"], k=30)), "en", "s", 1) for i in range(3000)]
    block = B.block_of(
        B.item_terms(spark.createDataFrame([(i, t + " the of", "x") for i, t in enumerate(said)], ITEMS)).collect()
    )
    counted = B.count_terms(spark.createDataFrame(docs, R.SCHEMA), block.terms)
    weights, n_docs, total = B.weigh(counted, len(block.terms))
    index = B.trees(B.deal(B.vectors(counted, weights, n_docs, total), len(block.terms)), len(block.terms))
    first = {r.item: r.subtree for r in B.root_bounds(index, block).collect()}
    near = B.search_trees(index, block, first, None, 10).collect()
    scored = {(r.item, r.scored) for r in near}
    assert sum(s for _, s in scored) < 12 * 3240 / 4


def test_without_rows(spark):
    none, items = spark.createDataFrame([], R.SCHEMA), spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert B.search(none, items).count() == 0
    assert B.search(spark.createDataFrame(R.documents(n=9), R.SCHEMA), items.limit(0)).count() == 0


def test_terms_are_cut_by_bytes():
    at, terms = B.terms_of(pa.array(["A-b_c9", None, "", "É\x7fx 　y", " . "]).slice(0))
    assert at.tolist() == [0, 3, 3, 3, 6, 6]
    assert terms.to_pylist() == ["a", "b", "c9", "É", "x", "　y"]
