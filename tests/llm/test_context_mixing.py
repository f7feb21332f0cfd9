import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import rows as R

from routewright.llm import context_mixing as M
from routewright.llm.common import load, words_of

SF = "/root/testdata/sf0.001"


def _plain(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base) by counting."""
    held = [zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 5 == 1 for d in docs]
    count, ends = Counter(), 0
    for d, h in zip(docs, held, strict=True):
        if not h:
            ends += 1
            count.update(R.words(d[1]))
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    size = n + 0.5 * (v + 1)
    out = []
    for d, h in zip(docs, held, strict=True):
        c = [count[w] for w in R.words(d[1])] + [ends]
        base = sum(math.log10((x + 0.5) / size) for x in c)
        out.append((str(d[0]), h, len(c), sum(x > 0 for x in c), n, round(base, 5)))
    return Counter(out)


def _got(df):
    rows = M.score(df).collect()
    assert all(r.score < 0 for r in rows)
    return Counter(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
        for r in rows
    )


def test_base_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "KNOWN_WORDS", 20)
    docs = R.documents()
    assert _got(R.clashing(spark.createDataFrame(docs, R.SCHEMA).repartition(4))) == _plain(docs)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = [(held, "a b", "en", "s", 1)]
    assert _got(spark.createDataFrame(docs, R.SCHEMA)) == _plain(docs)
    assert M.score(spark.createDataFrame([], R.SCHEMA)).count() == 0


def test_held_out_texts_are_predicted(spark):
    rows = M.score(load(spark, SF, "documents")).collect()
    held = [r for r in rows if r.held_out]
    rate = sum(r.bits_per_byte * r.n_bytes for r in held) / sum(r.n_bytes for r in held)
    assert rate < 3.2, rate
    for r in rows:
        assert abs(r.score + r.bits_per_byte * r.n_bytes * math.log10(2)) < 1e-6 * -r.score


def _mixer():
    rng = np.random.default_rng(1)
    mixer = M.Mixer(
        rng.integers(0, 9, M._FIRST[-1]).astype(np.uint16), rng.integers(0, 9, M._FIRST[-1]).astype(np.uint16)
    )
    mixer.weights = rng.normal(0.2, 0.2, mixer.weights.shape)
    mixer.mapped = rng.normal(size=(1 << M.MAP_BITS) * M.CELLS)
    return mixer


def test_bytes_after_a_context_sum_to_one():
    mixer = _mixer()
    for context in (0, 0x6162636465, 0x20FF00AB01):
        code = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
        assert abs((2.0 ** -mixer.costs(code)).sum() - 1) < 1e-9


def test_remembered_costs_are_the_costs():
    mixer = _mixer()
    costs = M.GramCosts(mixer, bits=6)
    code = np.random.default_rng(2).integers(0, 1 << 48, 500).astype(np.uint64)
    for _ in range(3):
        assert np.allclose(costs.of(code), mixer.costs(code))


def test_grams_of_each_text_follow_its_bytes():
    texts = pa.array(["Ab  c", "", None, "  ", "z"])
    code, ends = M.stream(*words_of(texts))
    wanted = [b"ab c \0", b"\0", b"\0", b"\0", b"z \0"]
    for i, w in enumerate(wanted):
        own = code[ends[i] : ends[i + 1]]
        assert bytes((own & np.uint64(255)).astype(np.uint8)) == w
        padded = bytes(5) + w
        assert [int(c) for c in own] == [int.from_bytes(padded[j : j + 6], "big") for j in range(len(w))]


def test_tally_loses_no_key():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 300, 5000).astype(np.uint64)
    tally, found = M.Tally(bits=5), Counter()
    for part in np.array_split(keys, 7):
        for k, n in zip(*tally.add(part), strict=True):
            found[int(k)] += int(n)
    for k, n in zip(*tally.rest(), strict=True):
        found[int(k)] += int(n)
    assert found == Counter(keys.tolist())


def test_learning_lowers_the_cost(spark):
    text = pa.array(["the cat sat on the mat and the dog sat on the log " * 20])
    code, counts = np.unique(M.stream(*words_of(text))[0], return_counts=True)
    zeros, ones = np.zeros(M._FIRST[-1], np.uint16), np.zeros(M._FIRST[-1], np.uint16)
    for bit in range(8):
        is_one = (code >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        for at in M.places(code, bit):
            np.add.at(ones, at[is_one], counts[is_one].astype(np.uint16))
            np.add.at(zeros, at[~is_one], counts[~is_one].astype(np.uint16))
    mixer = M.Mixer(zeros, ones)
    before = (mixer.costs(code) * counts).sum()
    for _ in range(5):
        mixer.learn(code, counts)
    assert (mixer.costs(code) * counts).sum() < before


def test_large_counts_keep_their_odds(spark):
    text = pa.array(["the cat sat on the mat and the dog sat on the log " * 200])
    code, counts = np.unique(M.stream(*words_of(text))[0], return_counts=True)

    def looked_up(times):
        rows = [(int(k), int(n) * times) for k, n in zip(code, counts, strict=True)]
        tables = M._tables(spark.createDataFrame(rows, "key bigint, n bigint"))
        mixer = M.Mixer(*tables)
        odds = [mixer.look_up(code, bit, own=False)[0][: M.ORDERS] for bit in range(8)]
        least = [np.minimum(*(t[M.places(code, bit)] for t in tables)) for bit in range(8)]
        return np.stack(odds), np.stack(least)

    odds, least = looked_up(1)
    many, _ = looked_up(10_000)
    frequent = least >= 100
    assert frequent.sum() > 100 and np.abs(odds[frequent]).max() > 1
    assert np.allclose(many[frequent], odds[frequent], atol=0.005)


def test_few_contexts_share_a_place():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"]
    grams = np.unique(M.stream(*words_of(texts.combine_chunks()))[0])
    for k, most in ((2, 0.02), (3, 0.05), (4, 0.1), (5, 0.3)):
        seen, used = 0, []
        for bit in range(8):
            key = (grams & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8 - bit)
            _, first = np.unique(key, return_index=True)
            seen += len(first)
            used.append(M.places(grams[first], bit)[k])
        assert 1 - len(np.unique(np.concatenate(used))) / seen < most, k
