import numpy as np
import pyarrow as pa
import rows as R

from routewright.llm import language_id as L
from routewright.llm.common import coded, load, words_of

SF = "/root/testdata/sf0.01"


def _chain(k=3, seed=0):
    rng = np.random.default_rng(seed)
    return L.Chain(
        list("xyz")[:k], rng.normal(size=(L.BUCKETS, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64),
        rng.normal(size=(k, k)), rng.normal(size=k),
    )


def test_shares_equal_sums_over_all_labelings():
    from itertools import product

    chain, rng = _chain(), np.random.default_rng(1)
    emit = rng.normal(size=(5, 3))
    total, mass = np.zeros(3), 0.0
    for path in product(range(3), repeat=5):
        w = chain.first[path[0]] + sum(emit[t, y] for t, y in enumerate(path))
        w = np.exp(w + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w * np.bincount(path, minlength=3) / 5
        mass += w
    got = L.shares(chain, np.array([0, 0, 5, 5]), emit)
    assert np.allclose(got[1], total / mass) and not got[0].any() and not got[2].any()


def test_spans_do_not_change_the_shares():
    chain, rng = _chain(), np.random.default_rng(2)
    sizes = [1, 31, 32, 33, 64, 500]
    at = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(size=(at[-1], 3)) * 2
    got = L.shares(chain, at, emit)
    for i in range(len(sizes)):
        e = emit[None, at[i] : at[i + 1]]
        a, b, _, _ = L._forward_backward(chain, e, np.ones(e.shape[:2], dtype=bool))
        assert np.allclose(got[i], L._scaled(a * b)[0].mean(axis=0))


def test_features_of_a_word():
    own, _ = L.features(["ab", "é", "abcd"])
    # Bytes, pairs and triples with breaks, and four-byte affixes.
    assert np.bincount(own).tolist() == [2 + 3 + 2 + 1, 2 + 3 + 2 + 1, 4 + 5 + 4 + 2]


def test_steps_follow_the_gradient_of_the_likelihood():
    """One step with large past gradients is a known multiple of the gradient."""
    distinct = ["ab", "cd", "abc", "é"]
    rng = np.random.default_rng(3)
    chain = _chain(seed=4)
    chain.weights *= 0.3
    own, place = L.features(distinct)
    order = np.argsort(own, kind="stable")
    place, ends = place[order], np.searchsorted(own[order], np.arange(len(distinct) + 1))
    tokens = [rng.integers(0, 4, n) for n in (5, 1, 3)]
    truth = [rng.integers(0, 3, len(t)) for t in tokens]

    def told():
        total = 0.0
        for t, y in zip(tokens, truth, strict=True):
            emit = L.emissions(chain, distinct)[t]
            path = chain.first[y[0]] + emit[np.arange(len(y)), y].sum() + chain.moves[y[:-1], y[1:]].sum()
            alpha = chain.first + emit[0]
            for e in emit[1:]:
                alpha = np.logaddexp.reduce(alpha[:, None] + chain.moves, axis=0) + e
            total += path - np.logaddexp.reduce(alpha)
        return total

    parts = (chain.weights, chain.moves, chain.first)
    before = [p.copy() for p in parts]
    spots = [(0, (int(place[3]), 1)), (0, (int(place[0]), 2)), (1, (0, 1)), (1, (2, 2)), (2, (1,))]
    slopes = []
    for i, at in spots:
        parts[i][at] += 1e-4
        up = told()
        parts[i][at] -= 2e-4
        slopes.append((up - told()) / 2e-4 - L.DECAY * before[i][at])
        parts[i][at] = before[i][at]
    L._step(chain, [np.full(p.shape, 1e12) for p in parts], tokens, truth, place, ends)
    for (i, at), slope in zip(spots, slopes, strict=True):
        assert abs((parts[i][at] - before[i][at]) * 1e6 / L.RATE - slope) < 1e-3


def test_learned_languages_are_told_apart():
    runs, langs = ["aa ab aa", "zz zy zz", "aa aa"], ["x", "y", "x"]
    chain = L.fit(runs * 20, langs * 20)
    at, words = words_of(pa.array(["aa ab", "zy zz zz"]))
    code, distinct = coded(words)
    got = L.shares(chain, at, L.emissions(chain, distinct)[code])
    assert chain.languages == ["x", "y"] and got[0, 0] > 0.9 and got[1, 1] > 0.9


def test_unlearned_scripts_go_and_short_clean_texts_stay(spark):
    docs = load(spark, SF, "documents")
    rng = np.random.default_rng(5)

    def words(alphabet):
        return " ".join("".join(rng.choice(list(alphabet), rng.integers(3, 9))) for _ in range(40))

    other = [words("абвгдежзиклмнопрстуфхцчш"), words("αβγδεζηθικλμνξοπρστυ"), words("漢字仮名交文章語"), words("مرحباكيفل")]
    rows = [(90_000 + i, t, "en", "s", 1) for i, t in enumerate(other)]
    fine = ["Of the and.", "That with the.", "Les de la.", "Und der die."]
    rows += [(91_000 + i, t, None, "s", 1) for i, t in enumerate(fine)]
    mixed = docs.unionByName(spark.createDataFrame([r[:2] + (None,) + r[3:] for r in rows], docs.schema))
    kept = {r.doc_id for r in L.keep_identified(mixed).select("doc_id").collect()}
    assert not kept & {r[0] for r in rows[:4]}
    assert {r[0] for r in rows[4:]} <= kept and len(kept) == docs.count() + 4


def test_held_out_languages_are_found(spark):
    docs = load(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.label(docs).collect()
    assert len(rows) == len(lang)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_hard_rows(spark):
    odd = [(3000, "12 34 --", "en", "s", 1), (3001, "x " * 40000, "en", "s", 1)]
    df = R.clashing(spark.createDataFrame(R.documents() + odd, R.SCHEMA).repartition(3))
    rows = L.label(df).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (2000, 2001, 2002, 3000):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[3001].lang_pred in ("en", "fr") and by_id[2004].lang_pred in ("en", "fr")
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    assert not {2000, 2001, 2002, 3000} & {r.doc_id for r in kept.collect()}


def test_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], R.SCHEMA)
    assert L.label(empty).count() == 0 and L.keep_identified(empty).count() == 0
    got = L.label(spark.createDataFrame([(1, "some text", None, "s", 1)], R.SCHEMA)).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)
