import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import rows as R
from hypothesis import given, settings
from hypothesis import strategies as st

from routewright.llm import line_rules as L

SF = "/root/testdata/sf0.01"
NAMES = [c.split()[0] for c in L._COUNTS.split(", ")]


def _plain(text):
    words = R.words(text, lower=False)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = Counter(x for x in (text or "").encode().split(b"\n") if R.words(x.decode(), lower=False))
    return [
        len(words),
        sum(len(w.decode()) for w in words),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(n - 1 for n in lines.values()),
        len(hit),
    ]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é#|\n \t\x0b\r　."), max_size=40), max_size=5))
def test_counts_are_those_of_the_rules(texts):
    m = L.measure(pa.array(texts, pa.string()))
    assert m.counts.tolist() == [_plain(t) for t in texts]
    wanted = [(i, k) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if R.words(x)]
    assert list(zip(m.text.tolist(), m.number.tolist(), strict=True)) == wanted


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    for _ in range(50):
        chain = L.Chain(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        emit = rng.normal(size=(rng.integers(1, 8), 2))

        def score(ls, chain=chain, emit=emit):
            return (
                chain.first[ls[0]]
                + sum(emit[t, x] for t, x in enumerate(ls))
                + sum(chain.moves[x, y] for x, y in zip(ls, ls[1:], strict=False))
            )

        assert L.viterbi(chain, emit) == list(max(product((0, 1), repeat=len(emit)), key=score))


def test_gradient_agrees_with_finite_differences():
    rng = np.random.default_rng(2)
    chain = L.Chain(*(rng.normal(size=s) for s in ((L.N_FEATURES * 10, 2), (2, 2), 2)))
    features = rng.integers(0, 10, (5, 6, L.N_FEATURES)) + 10 * np.arange(L.N_FEATURES)
    labels = rng.integers(0, 2, (5, 6))
    valid = np.arange(6) < np.array([6, 3, 1, 5, 2])[:, None]
    _, *grads = L.gradient(chain, features, labels, valid)
    for part, grad in zip((chain.weights, chain.moves, chain.first), grads, strict=True):
        for at in list(np.ndindex(part.shape))[:40]:
            part[at] += 1e-5
            up = L.gradient(chain, features, labels, valid)[0]
            part[at] -= 2e-5
            down = L.gradient(chain, features, labels, valid)[0]
            part[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def test_rows_of_hard_documents(spark):
    docs = R.documents()
    labels = spark.createDataFrame([(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = L.judge(R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(3)), labels).collect()
    said = sorted(([r.doc_id, *(r[n] for n in NAMES), r.base_failed, r.kept] for r in got), key=repr)
    wanted = []
    for d in docs:
        c = _plain(d[1])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        wanted.append([d[0], *c, failed, not failed])
    assert said == sorted(wanted, key=repr)
    assert all(r.content_share == (r.n_words > 0) and r.boilerplate == [] for r in got)


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return L.judge(docs, labels).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id").collect()


def test_good_documents_stay_and_bad_ones_go(judged):
    held = [r for r in judged if not r.base_failed]
    good = [r.kept for r in held if r.quality == 1]
    bad = [r.kept for r in held if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3


def test_marked_lines_are_not_prose(judged):
    marked = [r.text.split("\n")[i] for r in judged for i in r.boilerplate]
    prose = [x for r in judged if r.quality == 1 for i, x in enumerate(r.text.split("\n")) if i not in r.boilerplate]
    odd = re.compile(r"[#*$%&|]|!!|(\b\w+\b) \1")
    assert np.mean([bool(odd.search(x)) for x in marked]) > 0.6
    assert np.mean([bool(odd.search(x)) for x in prose]) < 0.1


def test_learned_from_one_row_of_a_document(spark):
    docs = [(i, ("good line here.\n" if i % 2 else "| | x | y\n") * 4, "en", "s", 1) for i in range(40)]
    docs += [(1, "good line here.\n" * 4, "en", "s", 1)] * 300
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2, "doc_id bigint, quality int, toxic int")
    assert L.training_runs(spark.createDataFrame(docs, R.SCHEMA), labels).count() <= 40


def test_without_rows(spark):
    empty = spark.createDataFrame([], R.SCHEMA)
    assert L.judge(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0
