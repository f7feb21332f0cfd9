"""Quality rules: counts of a text, and a label for every line by a linear-chain CRF.

A line with a word is described by its surface: words and their lengths,
capitals, digits, symbols, ends, repeated words, place in the text. A
conditional random field over a text's lines labels each as content or
boilerplate by Viterbi decoding; a text stays if enough of its words stand in
content lines and the counts do not rule it out.

The chain is fitted on a bounded sample of labelled documents: DOCS_PER_SLICE
documents in each of SLICES hash slices of a label, cut into runs of lines, at
most RUNS of a label. Lines of good documents are content. Lines of bad
documents are boilerplate at first; after a first fit those that read as content
are taken as such, if the run keeps another one.

Defined results: null and empty texts have counts of 0 and fail for their
length; without labels of both kinds every line is content; rows that repeat are
judged each; null labels and labels without a document are not learned; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.common import coded, fold, slices, words_of

HELD_OUT = 0
LEAST_WORDS, MOST_REPEATED = 50, 50
# A text stays if its content lines hold this share of its words.
LEAST_CONTENT = 0.5
# Bounds of the sample: documents per label and slice, slices, lines of a run, runs of a label.
DOCS_PER_SLICE, SLICES, RUN_LINES, RUNS = 24, 64, 32, 2000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.3, 1e-3
# Bytes of text that are measured at once.
AT_ONCE = 2 << 20

CONTENT, BOILERPLATE = 0, 1
SYMBOLS = b"#*$%&|<>"
_SHARES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_LOGS = np.array([1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5, 128.5, 256.5])
_LENGTHS = np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8.5, 10.5, 14.5])
# Every description of a line has places for ten values.
_PLACES = 10
_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


_IS_SYMBOL, _IS_CALL, _IS_STOP, _IS_PAUSE = map(_table, (SYMBOLS, b"!?", b".!?", b",;:-"))
_IS_UPPER, _IS_LOWER, _IS_DIGIT = map(
    _table, (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)))
)
_IS_MARK = _table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


@dataclass
class Measured:
    """Counts of each text (columns of _COUNTS) and its lines with a word."""

    counts: np.ndarray
    # Text, number within the text, words and description of each line.
    text: np.ndarray
    number: np.ndarray
    words: np.ndarray
    features: np.ndarray


def repeated_words(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word stands in a 3-word window found twice or more in its text."""
    out = np.zeros(len(code), dtype=bool)
    if len(code) < 3:
        return out
    k = int(code.max()) + 1
    pair = _ranks(code[:-1] * k + code[1:])
    window = _ranks(pair[:-1] * k + code[2:])
    whole = np.flatnonzero(text[:-2] == text[2:])
    key = text[whole] * (int(window.max()) + 1) + window[whole]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    at = whole[times[inverse] > 1]
    for j in range(3):
        out[at + j] = True
    return out


def measure(texts: pa.Array) -> Measured:
    """Counts and lines of the texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: n + 1]
    data = texts.buffers()[2]
    s = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    full = np.diff(at) > 0
    in_word = ~((s == 32) | ((s >= 9) & (s <= 13)))
    first = np.zeros(len(s), dtype=bool)
    first[at[:-1][full]] = True
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1] | first[1:]

    def total(flag: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(flag)])
        return before[high] - before[low]

    chars = in_word & ((s & 0xC0) != 0x80)
    code, distinct = coded(words_of(texts.cast(pa.string()), lower=False)[1])
    where = np.flatnonzero(starts)
    word_text = np.searchsorted(at, where, side="right") - 1
    twice = repeated_words(code, word_text)

    newline = s == 10
    begins = first.copy()
    begins[1:] |= newline[:-1]
    low = np.flatnonzero(begins)
    high = np.append(low[1:], len(s))[: len(low)]
    high = high - newline[high - 1]
    text = np.searchsorted(at, low, side="right") - 1
    number = np.arange(len(low)) - np.searchsorted(low, at[:-1])[text]
    cuts = np.append(np.stack([low, high], axis=1).ravel(), len(s)).astype(np.int64)
    segments = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(s))]
    )
    words = total(starts, low, high)
    said = np.flatnonzero(words)
    low, high, text, number, words = (x[said] for x in (low, high, text, number, words))
    same = segments.take(pa.array(2 * said)).dictionary_encode().indices.to_numpy().astype(np.int64)
    key = text * (int(same.max(initial=0)) + 1) + same
    again = np.ones(len(said), dtype=bool)
    again[np.unique(key, return_index=True)[1]] = False

    by_text = [total(x, at[:-1], at[1:]) for x in (starts, chars, _IS_SYMBOL[s])]
    by_text.append(np.bincount(text[again], minlength=n))
    by_text.append(np.bincount(word_text[twice], minlength=n))
    counts = np.stack(by_text, axis=1).astype(np.int64)
    features = _features(
        s, chars, low, high, text, words, again, code, where, total, max(1, len(distinct))
    )
    return Measured(counts, text, number, words, features)


def _features(s, chars, low, high, text, words, again, code, where, total, n_distinct):
    """(line, description) places of the weights."""
    n = np.maximum(1, words)
    size = np.maximum(1, total(chars, low, high))
    capital, small = (total(x[s], low, high) for x in (_IS_UPPER, _IS_LOWER))
    # Edges of a line without its white space.
    line = np.searchsorted(low, where, side="right") - 1
    head = where[np.searchsorted(where, low)]
    tail = np.maximum.reduceat(np.where(chars, np.arange(len(s)), 0), low) if len(low) else low
    tail = np.minimum(np.maximum(tail, head), high - 1)
    key, uses = np.unique(line * n_distinct + code, return_counts=True)
    distinct = np.bincount(key // n_distinct, minlength=len(low))
    most = np.zeros(len(low), dtype=np.int64)
    np.maximum.at(most, key // n_distinct, uses)
    doubled = np.zeros(len(code), dtype=bool)
    doubled[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    opens = np.append(True, text[1:] != text[:-1])[: len(low)]
    closes = np.append(text[1:] != text[:-1], True)[: len(low)]
    edge = [_IS_STOP, _IS_PAUSE, _IS_UPPER, _IS_LOWER, _IS_DIGIT, _IS_SYMBOL, _IS_MARK]

    def kind(at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), len(edge))
        for i in range(len(edge) - 1, -1, -1):
            out[edge[i][s[at]]] = i
        return out

    described = [
        np.searchsorted(_LOGS, words),
        np.searchsorted(_LENGTHS, size / n),
        np.searchsorted(_SHARES, capital / np.maximum(1, capital + small)),
        np.searchsorted(_SHARES, total(_IS_SYMBOL[s], low, high) / n),
        np.searchsorted(_SHARES, total(_IS_CALL[s], low, high) / n),
        np.searchsorted(_SHARES, total(_IS_DIGIT[s], low, high) / size),
        np.searchsorted(_SHARES, total(_IS_MARK[s], low, high) / size),
        np.searchsorted(_SHARES, 1 - distinct / n),
        np.searchsorted(_SHARES, most / n),
        np.searchsorted(_SHARES, np.bincount(line[doubled], minlength=len(low)) / n),
        kind(head),
        kind(tail),
        again.astype(np.int64),
        opens * 2 + closes,
    ]
    return np.stack([d + _PLACES * i for i, d in enumerate(described)], axis=1).astype(np.int16)


N_FEATURES = 14


@dataclass
class Chain:
    """Weights of (place, label), of moves between labels and of the first label."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    @classmethod
    def new(cls) -> Chain:
        return cls(np.zeros((N_FEATURES * _PLACES, 2)), np.zeros((2, 2)), np.zeros(2))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)


def viterbi(chain: Chain, emit: np.ndarray) -> list[int]:
    """The likeliest labels of one text's lines; ties go to content."""
    (stay, go), (leave, remain) = chain.moves.tolist()
    pairs = emit.tolist()
    a, b = (x + y for x, y in zip(chain.first.tolist(), pairs[0], strict=True))
    back = []
    for x, y in pairs[1:]:
        to_a, to_b = b + leave > a + stay, b + remain > a + go
        a, b = (b + leave if to_a else a + stay) + x, (b + remain if to_b else a + go) + y
        back.append((to_a, to_b))
    out = [int(b > a)]
    for choice in reversed(back):
        out.append(int(choice[out[-1]]))
    return out[::-1]


def gradient(chain: Chain, features: np.ndarray, labels: np.ndarray, valid: np.ndarray):
    """Log chance of the labels of (run, line) arrays, and its gradients."""
    emit = np.where(valid[..., None], chain.weights[features].sum(axis=2), 0.0)
    runs, longest = valid.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = chain.first + emit[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + chain.moves, axis=1) + emit[:, t]
        alpha[:, t] = np.where(valid[:, t, None], step, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = chain.moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(valid[:, t + 1, None], np.logaddexp.reduce(step, axis=2), 0.0)
    log_all = np.logaddexp.reduce(alpha[:, -1], axis=1)
    gold = np.eye(2)[labels] * valid[..., None]
    error = gold - np.exp(alpha + beta - log_all[:, None, None]) * valid[..., None]
    weights = np.zeros_like(chain.weights)
    np.add.at(weights, features[valid], error[valid][:, None, :])
    moves = np.zeros((2, 2))
    told = float((emit * gold).sum() + chain.first[labels[:, 0]].sum())
    for t in range(1, longest):
        go = valid[:, t]
        both = (
            alpha[go, t - 1, :, None] + chain.moves + (emit[go, t] + beta[go, t])[:, None, :]
        ) - log_all[go, None, None]
        np.add.at(moves, (labels[go, t - 1], labels[go, t]), 1.0)
        moves -= np.exp(both).sum(axis=0)
        told += float(chain.moves[labels[go, t - 1], labels[go, t]].sum())
    return told - float(log_all.sum()), weights, moves, error[:, 0].sum(axis=0)


def fit(runs: list[np.ndarray], bad: np.ndarray) -> Chain | None:
    """Learn from runs of line descriptions and whether their documents are bad."""
    if not len(runs) or bad.all() or not bad.any():
        return None
    labels = [np.full(len(r), BOILERPLATE if b else CONTENT) for r, b in zip(runs, bad, strict=True)]
    chain = _climb(runs, labels)
    for i in np.flatnonzero(bad):
        found = np.array(viterbi(chain, chain.emissions(runs[i])))
        if found.any():
            labels[i] = found
    return _climb(runs, labels)


def _climb(runs: list[np.ndarray], labels: list[np.ndarray]) -> Chain:
    chain = Chain.new()
    longest = max(map(len, runs))
    size = np.array([len(r) for r in runs])
    valid = np.arange(longest) < size[:, None]
    features = np.zeros((len(runs), longest, N_FEATURES), dtype=np.int64)
    gold = np.zeros((len(runs), longest), dtype=np.int64)
    features[valid], gold[valid] = np.concatenate(runs), np.concatenate(labels)
    rng = np.random.default_rng(13)
    parts = (chain.weights, chain.moves, chain.first)
    seen = [np.full(p.shape, 1e-6) for p in parts]
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            _, *grads = gradient(chain, features[own], gold[own], valid[own])
            for p, g, s in zip(parts, grads, seen, strict=True):
                g = g - DECAY * len(own) * p
                s += g**2
                p += RATE * g / np.sqrt(s)
    return chain


def training_runs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, run): descriptions of the lines of the bounded sample."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        (fold() != HELD_OUT) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    order = F.xxhash64(F.lit(13), "doc_id")
    slot = Window.partitionBy("quality", F.pmod("order", F.lit(SLICES))).orderBy("order", "doc_id")
    drawn = (
        marks.distinct()
        .withColumn("order", order)
        .withColumn("nth", F.row_number().over(slot))
        .where(F.col("nth") <= DOCS_PER_SLICE)
        .select("doc_id", "quality", "order")
    )
    # A document with several rows is learned from once.
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "quality", "order")
        .agg(F.min("text").alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                m = measure(part.column("text"))
                at = np.searchsorted(m.text, np.arange(part.num_rows + 1))
                who, nth, blobs = [], [], []
                for i in range(part.num_rows):
                    for a in range(at[i], at[i + 1], RUN_LINES):
                        who.append(i)
                        nth.append(a - at[i])
                        blobs.append(m.features[a : min(a + RUN_LINES, at[i + 1])].tobytes())
                rows = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "quality": part.column("quality").take(rows),
                        "order": part.column("order").take(rows),
                        "nth": pa.array(nth, pa.int64()),
                        "run": pa.array(blobs, pa.binary()),
                    }
                )

    runs = texts.mapInArrow(run, "quality int, order bigint, nth bigint, run binary")
    mixed = Window.partitionBy("quality").orderBy(F.xxhash64("order", "nth"), "run")
    return runs.withColumn("place", F.row_number().over(mixed)).where(F.col("place") <= RUNS)


def learn(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """Fit the chain; what is collected is bounded by 2 x RUNS x RUN_LINES descriptions."""
    rows = training_runs(docs, labels).select("quality", "place", "run").collect()
    rows.sort(key=lambda r: (r.quality, r.place))
    runs = [np.frombuffer(r.run, dtype=np.int16).reshape(-1, N_FEATURES) for r in rows]
    return fit(runs, np.array([r.quality == 0 for r in rows], dtype=bool))


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST_CONTENT) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, content_share, boilerplate.

    ``boilerplate`` lists the numbers, from 0, of the lines so labelled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shipped.value
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                yield _judged(chain, part)

    counts = [c.split()[0] for c in _COUNTS.split(", ")]
    judged = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, f"doc_id bigint, {_COUNTS}, content_share double, boilerplate array<bigint>")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )
    return judged.select(
        "doc_id",
        *counts,
        failed.alias("base_failed"),
        (~failed & (F.col("content_share") >= least)).alias("kept"),
        "content_share",
        "boilerplate",
    )


def _judged(chain: Chain | None, part: pa.RecordBatch) -> pa.RecordBatch:
    m = measure(part.column("text"))
    n = part.num_rows
    mark = np.zeros(len(m.text), dtype=np.int64)
    at = np.searchsorted(m.text, np.arange(n + 1))
    if chain is not None and len(mark):
        emit = chain.emissions(m.features)
        for i in np.flatnonzero(np.diff(at)):
            mark[at[i] : at[i + 1]] = viterbi(chain, emit[at[i] : at[i + 1]])
    words = m.counts[:, 0]
    content = np.bincount(m.text, weights=m.words * (mark == CONTENT), minlength=n)
    marked = np.flatnonzero(mark == BOILERPLATE)
    lists = pa.array(np.searchsorted(m.text[marked], np.arange(n + 1)), pa.int32())
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    return pa.RecordBatch.from_pydict(
        {"doc_id": part.column("doc_id")}
        | {k: pa.array(x) for k, x in zip(names, m.counts.T.copy(), strict=True)}
        | {
            "content_share": pa.array(content / np.maximum(1, words)),
            "boilerplate": pa.ListArray.from_arrays(lists, pa.array(m.number[marked].astype(np.int64))),
        }
    )
