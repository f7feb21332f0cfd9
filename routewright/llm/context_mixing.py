"""Text log-probabilities by logistic context mixing over bits.

The model reads a document's lower-cased words, each followed by a blank, and an
end byte. For each bit, one predictor per context length looks up how often the
bit was 0 or 1 after the same bytes, in tables addressed by a hash. The
predictors' log-odds are combined by a weight set that a gate selects, and the
result is refined by an adaptive map from (last byte, bits so far, log-odds) to
the rate that was observed. Weights are learned online: each task goes through
its part of the corpus statistics in small steps, every event predicted from
the counts without itself, and the tasks' weights are averaged. A text is
scored by the finished model, so its score depends on nothing but its words.

Contexts reach five bytes back, so a byte's bits depend on six bytes only. The
corpus is counted as these grams, in full; tables are built from the counted
grams, and a scoring task works out each gram once.

The unigram base score needs the count of every word. The most frequent
KNOWN_WORDS words are broadcast; rarer ones are joined by hash.

Defined results: null, empty and blank texts have the end token alone; a null
doc_id counts as empty text for the fold; rows that repeat are learned and
scored each; with nothing to learn from, all counts are 0; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.common import coded, fold, hash_words, seeded, slices, words_of
from routewright.session import cut_lineage

HELD_OUT = 1
ORDERS = 6  # contexts of 0 to 5 bytes
# Places of each order's table, as powers of two.
TABLE_BITS = (8, 16, 19, 20, 21, 21)
# Words whose counts are broadcast, at 16 bytes each.
KNOWN_WORDS = 500_000
# Text that is scored at a time: its grams' arrays stand beside the tables in each worker.
SCORED_BYTES = 1 << 20
ROUNDS, STEP, RATE = 2, 4096, 0.3
# The adaptive map: places of its contexts, and cells of log-odds from -SPAN to SPAN.
MAP_BITS, CELLS, SPAN = 12, 33, 8.0

_FIRST = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
_ODD = seeded(31, ORDERS + 3) | np.uint64(1)
_EMPTY = np.uint64((1 << 64) - 1)
_GATES = ORDERS * 8
_WORD, _GRAM, _DOC = 0, 1, 2
_U8 = np.uint64(8)


def stream(at: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in order, and where each text's grams begin (one more than texts)."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ")
    length = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    source = np.frombuffer(joined.buffers()[2] or b"", dtype=np.uint8)[: int(length.sum())]
    full = (length > 0).astype(np.int64)
    # Per text: five bytes that are context only, its bytes, a blank, the end byte 0.
    size = length + full + ORDERS
    start = np.concatenate([[0], np.cumsum(size)])
    begin = np.concatenate([[0], np.cumsum(length)])
    s = np.zeros(start[-1], dtype=np.uint8)
    s[np.repeat(start[:-1] + ORDERS - 1 - begin[:-1], length) + np.arange(len(source))] = source
    s[(start[1:] - 2)[full > 0]] = 32
    code = np.zeros(max(0, len(s) - ORDERS + 1), dtype=np.uint64)
    for j in range(ORDERS):
        code = code << _U8 | s[j : j + len(code)]
    count = size - ORDERS + 1
    ends = np.concatenate([[0], np.cumsum(count)])
    return code[np.repeat(start[:-1] - ends[:-1], count) + np.arange(ends[-1])], ends


class Tally:
    """Counts of 64-bit keys in bounded memory; what finds no room is handed out at once."""

    def __init__(self, bits: int = 21):
        self._shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, _EMPTY)
        self.counts = np.zeros(1 << bits, dtype=np.int64)

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (keys * _ODD[ORDERS] >> self._shift).astype(np.int64)
        free = self.keys[place] == _EMPTY
        self.keys[place[free]] = keys[free]
        hit = self.keys[place] == keys
        np.add.at(self.counts, place[hit], 1)
        return np.unique(keys[~hit], return_counts=True)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        full = self.keys != _EMPTY
        return self.keys[full], self.counts[full]


def places(code: np.ndarray, bit: int) -> np.ndarray:
    """(order, gram): where each order's table holds the counts for the gram's bit."""
    symbol = code & np.uint64(255)
    node = np.uint64(1 << bit) | symbol >> np.uint64(8 - bit)
    out = np.empty((ORDERS, len(code)), dtype=np.int64)
    for k in range(ORDERS):
        context = code >> _U8 & np.uint64((1 << 8 * k) - 1)
        key = context << _U8 | node
        if k < 2:  # small enough to have a place each
            out[k] = key
        else:
            out[k] = (key * _ODD[k] >> np.uint64(64 - TABLE_BITS[k])) + np.uint64(_FIRST[k])
    out[1] += _FIRST[1]
    return out


@dataclass
class Mixer:
    """Bit counts, gated weights and the adaptive map."""

    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((_GATES, ORDERS + 1), 0.3))
    mapped: np.ndarray | None = None

    def look_up(self, code: np.ndarray, bit: int, own: bool):
        """(inputs, gate) of a bit; ``own`` leaves the event itself out of the counts."""
        at = places(code, bit)
        n0, n1 = self.zeros[at].astype(np.float64), self.ones[at].astype(np.float64)
        if own:
            is_one = (code >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            n1 -= is_one
            n0 -= ~is_one
            np.maximum(n0, 0, out=n0)
            np.maximum(n1, 0, out=n1)
        inputs = np.empty((ORDERS + 1, len(code)))
        inputs[:ORDERS] = np.log((n1 + 0.2) / (n0 + 0.2))
        inputs[ORDERS] = 0.3
        seen = n0 + n1 > 0
        longest = np.where(seen[1:].any(axis=0), ORDERS - 1 - seen[:0:-1].argmax(axis=0), 0)
        return inputs, longest * 8 + bit

    def mix(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("kn,nk->n", inputs, self.weights[gate]), -SPAN, SPAN)

    def cell(self, code: np.ndarray, bit: int, odds: np.ndarray):
        """Cells below and above the log-odds, and the share of the upper one."""
        node = np.uint64(1 << bit) | (code & np.uint64(255)) >> np.uint64(8 - bit)
        last = code >> _U8 & np.uint64(255)
        context = ((last << _U8 | node) * _ODD[ORDERS + 1] >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        x = (odds + SPAN) * ((CELLS - 1) / (2 * SPAN))
        low = np.minimum(x.astype(np.int64), CELLS - 2)
        return context * CELLS + low, x - low

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each gram takes after the bytes before it."""
        total = np.zeros(len(code))
        for bit in range(8):
            odds = self.mix(*self.look_up(code, bit, own=False))
            if self.mapped is not None:
                low, share = self.cell(code, bit, odds)
                fine = self.mapped[low] * (1 - share) + self.mapped[low + 1] * share
                odds = (odds + fine) / 2
            sign = 1.0 - 2.0 * (code >> np.uint64(7 - bit) & np.uint64(1)).astype(np.float64)
            total += np.logaddexp(0, sign * odds)
        return total / np.log(2)

    def learn(self, code: np.ndarray, count: np.ndarray) -> None:
        """One way through the grams in small steps, each event predicted without itself."""
        for a in range(0, len(code), STEP):
            some, weight = code[a : a + STEP], count[a : a + STEP].astype(np.float64)
            for bit in range(8):
                inputs, gate = self.look_up(some, bit, own=True)
                odds = self.mix(inputs, gate)
                error = (some >> np.uint64(7 - bit) & np.uint64(1)) - 1 / (1 + np.exp(-odds))
                mass = np.bincount(gate, weights=weight, minlength=_GATES)
                push = [
                    np.bincount(gate, weights=weight * error * x, minlength=_GATES) for x in inputs
                ]
                scale = [np.bincount(gate, weights=weight * x * x, minlength=_GATES) for x in inputs]
                mean = np.stack(push, axis=1) / np.maximum(mass, 1)[:, None]
                size = 1 + np.stack(scale, axis=1).sum(axis=1) / np.maximum(mass, 1)
                self.weights += RATE * mean / size[:, None] * np.minimum(1, mass / 64)[:, None]

    def observe(self, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Events and ones in each cell of the adaptive map."""
        n = (1 << MAP_BITS) * CELLS
        events, ones = np.zeros(n), np.zeros(n)
        for a in range(0, len(code), 1 << 16):
            some, weight = code[a : a + (1 << 16)], count[a : a + (1 << 16)].astype(np.float64)
            for bit in range(8):
                low, share = self.cell(some, bit, self.mix(*self.look_up(some, bit, own=True)))
                is_one = (some >> np.uint64(7 - bit) & np.uint64(1)).astype(np.float64)
                for at, part in ((low, 1 - share), (low + 1, share)):
                    events += np.bincount(at, weights=weight * part, minlength=n)
                    ones += np.bincount(at, weights=weight * part * is_one, minlength=n)
        return events, ones


class GramCosts:
    """Costs of grams, each worked out once while its place in a fixed table lasts."""

    def __init__(self, mixer: Mixer, bits: int = 21):
        self._mixer = mixer
        self._shift = np.uint64(64 - bits)
        self._keys = np.full(1 << bits, _EMPTY)
        self._costs = np.zeros(1 << bits)

    def of(self, code: np.ndarray) -> np.ndarray:
        place = (code * _ODD[ORDERS] >> self._shift).astype(np.int64)
        out = self._costs[place]
        miss = np.flatnonzero(self._keys[place] != code)
        if len(miss):
            new, back = np.unique(code[miss], return_inverse=True)
            cost = np.concatenate(
                [self._mixer.costs(new[a : a + 8192]) for a in range(0, len(new), 8192)]
            )
            out[miss] = cost[back]
            at = (new * _ODD[ORDERS] >> self._shift).astype(np.int64)
            self._keys[at], self._costs[at] = new, cost
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(keys), kind, dtype=np.int8)),
                pa.array(keys.view(np.int64)),
                pa.array(counts.astype(np.int64)),
            ],
            names=["kind", "key", "n"],
        )

    for batch in batches:
        for part in slices(batch):
            at, words = words_of(part.column("text"))
            code, distinct = coded(words)
            yield rows(_WORD, hash_words(distinct), np.bincount(code, minlength=len(distinct)))
            yield rows(_DOC, np.zeros(1, dtype=np.uint64), np.array([part.num_rows]))
            yield rows(_GRAM, *tally.add(stream(at, words)[0]))
    keys, counts = tally.rest()
    for a in range(0, len(keys), 100_000):
        yield rows(_GRAM, keys[a : a + 100_000], counts[a : a + 100_000])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): words by hash, six-byte grams, and documents of all training rows."""
    rows = docs.where(fold() != HELD_OUT).select("text")
    counted = rows.mapInArrow(_count, "kind tinyint, key bigint, n bigint")
    return cut_lineage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _grams(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        counts.append(batch.column("n").to_numpy())
    code, count = np.concatenate(keys).view(np.uint64), np.concatenate(counts)
    order = np.argsort(code * _ODD[ORDERS + 2])
    return code[order], count[order]


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each table place with its zeros and ones, of a task's grams."""
    both = np.zeros((2, _FIRST[-1]), dtype=np.int64)
    for batch in batches:
        code, n = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        for bit in range(8):
            is_one = (code >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
            for at in places(code, bit):
                np.add.at(both, (is_one, at), n)
    full = np.flatnonzero(both.any(axis=0))
    for a in range(0, len(full), 100_000):
        at = full[a : a + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(both[0, at]), pa.array(both[1, at])], names=["at", "n0", "n1"]
        )


def _tables(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of every table place.

    They are summed in 64 bits and kept as 32-bit floats: no count is too large,
    and odds are right to seven digits.
    """
    counted = (
        grams.mapInArrow(_bit_counts, "at bigint, n0 bigint, n1 bigint")
        .groupBy("at")
        .agg(F.sum("n0").cast("float").alias("n0"), F.sum("n1").cast("float").alias("n1"))
        .select(F.col("at").cast("int"), "n0", "n1")
    )
    zeros, ones = np.zeros(_FIRST[-1], dtype=np.float32), np.zeros(_FIRST[-1], dtype=np.float32)
    for batch in counted.toArrow().to_batches():
        at = batch.column("at").to_numpy()
        zeros[at], ones[at] = batch.column("n0").to_numpy(), batch.column("n1").to_numpy()
    return zeros, ones


def build(counts: DataFrame) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """The tables, which tasks get once, and the weights and the map, which go with each job.

    What reaches the driver is bounded by their sizes.
    """
    # Grams of one context meet in one task, so long contexts have their places once.
    grams = cut_lineage(
        counts.where(F.col("kind") == _GRAM)
        .select("key", "n", F.shiftright("key", 8).alias("context"))
        .repartition("context")
        .select("key", "n")
    )
    tables = counts.sparkSession.sparkContext.broadcast(_tables(grams))
    weights = Mixer(None, None).weights
    for _ in range(ROUNDS):
        learned = grams.mapInArrow(_learning(tables, weights), "i int, total double, mass double")
        sums = learned.groupBy("i").agg(F.sum("total").alias("total"), F.sum("mass").alias("mass")).toArrow()
        if sums.num_rows:
            weights = weights.copy()
            mean = sums["total"].to_numpy() / sums["mass"].to_numpy()
            weights.ravel()[sums["i"].to_numpy()] = mean
    observed = grams.mapInArrow(_observing(tables, weights), "i int, events double, ones double")
    cells = observed.groupBy("i").agg(F.sum("events").alias("events"), F.sum("ones").alias("ones")).toArrow()
    centre = np.tile(np.linspace(-SPAN, SPAN, CELLS), 1 << MAP_BITS)
    events, ones = np.zeros(len(centre)), np.zeros(len(centre))
    at = cells["i"].to_numpy()
    events[at], ones[at] = cells["events"].to_numpy(), cells["ones"].to_numpy()
    # A cell begins at its own log-odds, with the weight of a few events.
    rate = (ones + 8 / (1 + np.exp(-centre))) / (events + 8)
    return tables, weights, np.clip(np.log(rate / (1 - rate)), -SPAN, SPAN).astype(np.float32)


def _learning(tables: Broadcast, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count = _grams(batches)
        if not len(code):
            return
        mixer = Mixer(*tables.value, weights.copy())
        mixer.learn(code, count)
        mass = np.full(mixer.weights.size, float(count.sum()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(mixer.weights.size, dtype=np.int32)),
                pa.array(mixer.weights.ravel() * mass),
                pa.array(mass),
            ],
            names=["i", "total", "mass"],
        )

    return run


def _observing(tables: Broadcast, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count = _grams(batches)
        events, ones = Mixer(*tables.value, weights).observe(code, count)
        full = np.flatnonzero(events)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(events[full]), pa.array(ones[full])],
            names=["i", "events", "ones"],
        )

    return run


def frequent_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of at most KNOWN_WORDS words, the most frequent.

    The histogram of counts tells from which count on the words fit.
    """
    histogram = sorted(
        ((r.n, r.words) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()),
        reverse=True,
    )
    total, least = 0, None
    for n, words_here in histogram:
        total += words_here
        if total > KNOWN_WORDS:
            break
        least = n
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    known = words.where(F.col("n") >= least).select("key", "n").toArrow()
    key, n = known["key"].to_numpy().view(np.uint64), known["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, "
    "bits double, n_bytes bigint, rare array<bigint>, times array<int>"
)


def _scoring(tables: Broadcast, weights: np.ndarray, mapped: np.ndarray, words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = words.value
        log = np.log10(n + 0.5)
        costs = GramCosts(Mixer(*tables.value, weights, mapped))
        for batch in batches:
            for part in slices(batch, size=SCORED_BYTES):
                yield _score_slice(part, costs, key, log)

    return run


def _score_slice(part: pa.RecordBatch, costs: GramCosts, key, log) -> pa.RecordBatch:
    at, words = words_of(part.column("text"))
    code, distinct = coded(words)
    hashes = hash_words(distinct)
    place = np.minimum(np.searchsorted(key, hashes), max(0, len(key) - 1))
    known = key[place] == hashes if len(key) else np.zeros(len(hashes), dtype=bool)
    value = np.where(known, log[place] if len(key) else 0.0, 0.0)
    rows = part.num_rows
    text = np.repeat(np.arange(rows), np.diff(at))
    n_known = np.bincount(text, weights=known[code], minlength=rows).astype(np.int64)
    logs = np.bincount(text, weights=value[code], minlength=rows)
    rare = ~known[code]
    pair, times = np.unique(text[rare] * max(1, len(distinct)) + code[rare], return_counts=True)
    owner, word = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    ends = pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32())
    grams, begins = stream(at, words)
    bits = np.add.reduceat(costs.of(grams), begins[:-1])
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            part.column("held_out"),
            pa.array(np.diff(at) + 1),
            pa.array(n_known),
            pa.array(logs),
            pa.array(bits),
            pa.array(np.diff(begins)),
            pa.ListArray.from_arrays(ends, pa.array(hashes[word].view(np.int64))),
            pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
        ],
        names=[c.split()[0] for c in _SCORED.split(", ")],
    )


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes, bits_per_byte."""
    counts = corpus_counts(docs)
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    totals = counts.where(F.col("kind") != _GRAM).agg(
        F.sum("n").alias("tokens"),
        F.count_if(F.col("kind") == _WORD).alias("words"),
        F.sum(F.when(F.col("kind") == _DOC, F.col("n"))).alias("docs"),
    ).first()
    n, docs_seen = totals.tokens or 0, totals.docs or 0
    distinct = totals.words + (docs_seen > 0)
    known = docs.sparkSession.sparkContext.broadcast(frequent_words(words))
    scoring = _scoring(*build(counts), known)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), "text"
    )
    scored = cut_lineage(
        rows.mapInArrow(scoring, _SCORED).withColumn("row", F.monotonically_increasing_id())
    )
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
        .join(words, "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_logs"),
        )
    )
    per_token = float(np.log10(n + 0.5 * (distinct + 1)))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + float(np.log10(docs_seen + 0.5))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(docs_seen > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2)))).alias("score"),
        "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
