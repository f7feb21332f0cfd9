"""Document quality by Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one. The chance of a
preference is the logistic function of the difference of two scores, a score is
linear in features of the whole text, and the weights maximise the likelihood
of the drawn pairs. The ranking has no zero of its own: its threshold is the
quantile of the labelled scores below which the labelled share of bad documents
lies, and scores are shifted so that this threshold is THRESHOLD.

Fitting uses all labelled documents of the learning folds, with PARTNERS pairs
for each document of the more frequent kind. The features of every document are
taken once and stored. Labelled documents are dealt to blocks, in which they are
paired; the sums of a Newton step are added up per task, and the threshold is
found by counting scores in ever narrower ranges, so what reaches the driver does
not grow with the labels.

Defined results: null text is empty text; labels that are null or have no
document are ignored; a document that is labelled both ways counts as both; without
labels of both kinds every score is 0.5; rows that repeat are scored each; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewright.llm.common import coded, fold, slices, words_of
from routewright.session import cut_lineage

HELD_OUT = 0
THRESHOLD = 0.3
# Pairs drawn for each labelled document of the more frequent kind.
PARTNERS = 16
# Labelled documents of a block, fewest documents of a kind in it, and bins of a range of scores.
BLOCK, RARE, BINS = 4096, 64, 4096
NEWTON_STEPS, PENALTY = 12, 1e-3

# Bytes that are counted as one kind each; bytes above 127 are letters of words.
_KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!?",
    b"|<>{}[]=\\/", b"*%&#$@^~_+", b"\n", bytes(range(128, 256)),
)
_KIND_OF = np.zeros(256, dtype=np.uint8)
for _i, _bytes in enumerate(_KINDS, start=1):
    _KIND_OF[list(_bytes)] = _i
FEATURES = len(_KINDS) + 12


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text, all over the whole text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    s = np.frombuffer("".join(texts.to_pylist()).encode(), dtype=np.uint8)
    owner = np.repeat(np.arange(n), length)
    kinds = np.bincount(
        owner * (len(_KINDS) + 1) + _KIND_OF[s], minlength=n * (len(_KINDS) + 1)
    ).reshape(n, -1)[:, 1:]
    at, words = words_of(texts)
    code, distinct = coded(words)
    size = np.diff(at)
    text = np.repeat(np.arange(n), size)
    width = np.fromiter(map(len, distinct), dtype=np.float64, count=len(distinct))
    mean_width = _mean(width[code], text, size)
    spread = np.sqrt(np.maximum(0, _mean(width[code] ** 2, text, size) - mean_width**2))
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
    pairs, uses = np.unique(text * max(1, len(distinct)) + code, return_counts=True)
    of = pairs // max(1, len(distinct))
    n_distinct = np.bincount(of, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, of, uses)
    last = np.fromiter((w[-1:].isalnum() for w in distinct), dtype=np.float64, count=len(distinct))
    plain = np.fromiter((w.isalpha() for w in distinct), dtype=np.float64, count=len(distinct))
    lines = pc.split_pattern(texts, "\n")
    line_at, line = lines.offsets.to_numpy(), lines.flatten()
    line_code, line_distinct = coded(line)
    line_of = np.repeat(np.arange(n), np.diff(line_at))
    line_pairs = np.unique(line_of * max(1, len(line_distinct)) + line_code)
    n_lines = np.diff(line_at)
    distinct_lines = np.bincount(line_pairs // max(1, len(line_distinct)), minlength=n)
    per_byte = kinds / np.maximum(1, length)[:, None]
    words_each = np.maximum(1, size)
    return np.column_stack(
        [
            np.log(per_byte + 1e-3),
            np.log1p(length),
            np.log1p(size),
            mean_width,
            spread,
            n_distinct / words_each,
            n_distinct / np.sqrt(words_each),
            top / words_each,
            np.bincount(text, weights=again, minlength=n) / words_each,
            _mean(last[code], text, size),
            _mean(plain[code], text, size),
            distinct_lines / np.maximum(1, n_lines),
            np.log1p(size / np.maximum(1, n_lines)),
        ]
    )


def _mean(value: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=value, minlength=len(size)) / np.maximum(1, size)


@dataclass
class Ranking:
    """Scaling of the features, weights of the scaled ones, and the raw threshold."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _expanded((x - self.centre) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shifted = self.raw(x) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -500, 500)))


def _expanded(z: np.ndarray) -> np.ndarray:
    """Scaled features and their squares, so that a feature may be best in the middle."""
    z = np.clip(z, -5, 5)
    return np.hstack([z, z**2])


def _differences(g: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Drawn pairs of a good and a bad document, PARTNERS for each of the more frequent kind."""
    rng = np.random.default_rng(seed)
    n = PARTNERS * max(len(g), len(b))
    return g[rng.integers(0, len(g), n)] - b[rng.integers(0, len(b), n)]


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the likelihood, without the penalty."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (1 - p), (d * (p * (1 - p))[:, None]).T @ d


def _newton(w: np.ndarray, slope: np.ndarray, curve: np.ndarray, n: int) -> np.ndarray:
    ridge = PENALTY * n * np.eye(len(w))
    return w + np.linalg.solve(curve + ridge, slope - ridge @ w)


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float) -> Ranking | None:
    """Bradley-Terry weights by Newton's method on the differences of drawn pairs."""
    if not len(good) or not len(bad):
        return None
    both = np.vstack([good, bad])
    ranking = Ranking(both.mean(axis=0), both.std(axis=0) + 1e-9, np.zeros(2 * both.shape[1]), 0.0)
    g = _expanded((good - ranking.centre) / ranking.scale)
    b = _expanded((bad - ranking.centre) / ranking.scale)
    n = PARTNERS * max(len(g), len(b))
    d = _differences(g, b, 3)
    w = ranking.weights
    for _ in range(NEWTON_STEPS):
        w = _newton(w, *_sums(d, w), n)
    ranking.weights = w
    raw = np.concatenate([ranking.raw(good), ranking.raw(bad)])
    mass = np.concatenate(
        [np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))]
    )
    order = np.argsort(raw)
    at = int(np.searchsorted(np.cumsum(mass[order]), bad_share))
    at = min(at, len(raw) - 1)
    ranking.threshold = float((raw[order][max(0, at - 1)] + raw[order][at]) / 2)
    return ranking


_FOUND = "array<double>"


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the features of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = pa.array(list(features(part.column("text"))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], names=["doc_id", "found"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, found {_FOUND}")


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, found) of all labelled documents to learn from; rows that share an id count once."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)
    )
    return (
        found.join(usable.distinct(), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("found").alias("found"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def learn(found: DataFrame, labels: DataFrame) -> Ranking | None:
    """The ranking from found(doc_id, found) and all its labels."""
    share = (
        labels.where(fold() != HELD_OUT)
        .agg(F.avg(F.when(F.col("quality") == 0, 1.0).when(F.col("quality") == 1, 0.0)).alias("bad"))
        .first()
        .bad
    )
    rows = cut_lineage(labelled(found, labels))
    counts = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    if sum(counts.values()) <= BLOCK:
        own = sorted((r.quality, r.found) for r in rows.collect())
        kinds = [np.array([x for kind, x in own if kind == q]) for q in (1, 0)]
        return fit(kinds[0], kinds[1], share or 0.0)
    if len(counts) < 2:
        return None
    return _fit_blocks(rows, counts, share or 0.0)


def _fit_blocks(rows: DataFrame, counts: dict[int, int], share: float) -> Ranking:
    """``fit`` over any number of rows(doc_id, quality, found)."""
    n = sum(counts.values())
    each = rows.select(F.posexplode("found").alias("i", "x"))
    moments = each.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    centre, scale = np.zeros(FEATURES), np.zeros(FEATURES)
    for r in moments:
        centre[r.i], scale[r.i] = r.m, r.s + 1e-9
    ranking = Ranking(centre, scale, np.zeros(2 * FEATURES), 0.0)

    # A rare kind is copied to further blocks, so that each has partners.
    n_blocks = -(-n // BLOCK)
    copies = {q: min(n_blocks, -(-RARE * n_blocks // c)) for q, c in counts.items()}
    again = F.when(F.col("quality") == 1, copies[1]).otherwise(copies[0])
    first = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(n_blocks))
    dealt = rows.select(
        "doc_id", "quality", "found", F.explode(F.sequence(F.lit(0), again - 1)).alias("copy"), first.alias("first")
    ).withColumn("block", F.pmod(F.col("first") + F.col("copy"), F.lit(n_blocks)))
    blocks = cut_lineage(
        dealt.groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("doc_id", "quality", "found"))).alias("rows")
        ).select("block", F.transform("rows", lambda r: r["quality"]).alias("kinds"),
                 F.flatten(F.transform("rows", lambda r: r["found"])).alias("found"))
    )
    width = 2 * FEATURES

    def step(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve, pairs = np.zeros(width), np.zeros((width, width)), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    kinds = batch.column("kinds")[i].values.to_numpy(zero_copy_only=False)
                    x = batch.column("found")[i].values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                    z = _expanded((x - centre) / scale)
                    if kinds.min() == kinds.max():
                        continue
                    d = _differences(z[kinds == 1], z[kinds == 0], batch.column("block")[i].as_py())
                    own = _sums(d, w)
                    slope, curve, pairs = slope + own[0], curve + own[1], pairs + len(d)
            row = [pa.array([slope.tolist()]), pa.array([curve.ravel().tolist()]), pa.array([pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, names=["slope", "curve", "n"])

        return run

    w = ranking.weights
    for _ in range(NEWTON_STEPS):
        sums = blocks.mapInArrow(step(w), f"slope {_FOUND}, curve {_FOUND}, n bigint").collect()
        slope = np.sum([r.slope for r in sums], axis=0)
        curve = np.sum([r.curve for r in sums], axis=0).reshape(width, width)
        w = _newton(w, slope, curve, sum(r.n for r in sums))
    ranking.weights = w
    mass = {1: (1 - share) / counts[1], 0: share / counts[0]}
    ranking.threshold = _quantile(cut_lineage(_raw(rows, ranking)), mass, share)
    return ranking


def _raw(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """(quality, raw) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array(ranking.raw(_matrix(batch.column("found"))))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), raw], names=["quality", "raw"])

    return rows.select("quality", "found").mapInArrow(run, "quality int, raw double")


def _quantile(raw: DataFrame, mass: dict[int, float], share: float) -> float:
    """Halfway between the first score at which the mass reaches ``share`` and the one below it.

    Each round counts the scores of BINS parts of a range and goes on in one of
    them, until its distinct scores are few.
    """
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    below = 0.0
    weight = F.when(F.col("quality") == 1, mass[1]).otherwise(mass[0])
    while True:
        inside = raw.where((F.col("raw") >= lo) & (F.col("raw") <= hi))
        values = inside.groupBy("raw").agg(F.sum(weight).alias("mass")).orderBy("raw").limit(BINS + 1).collect()
        if len(values) <= BINS:
            break
        part = F.least(F.lit(BINS - 1), F.floor((F.col("raw") - lo) / (hi - lo) * BINS))
        bins = inside.groupBy(part.alias("i")).agg(
            F.sum(weight).alias("mass"), F.min("raw").alias("lo"), F.max("raw").alias("hi")
        )
        for r in sorted(bins.collect(), key=lambda r: r.i):
            lo, hi = r.lo, r.hi
            if below + r.mass >= share - 1e-12:
                break
            below += r.mass
    at = values[-1].raw
    for r in values:
        below += r.mass
        if below >= share - 1e-12:
            at = r.raw
            break
    less = raw.where(F.col("raw") < at).agg(F.max("raw")).first()[0]
    return float(at if less is None else (less + at) / 2)


def ranked(found: DataFrame, ranking: Ranking | None) -> DataFrame:
    """(doc_id, score) of every row of found(doc_id, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("found"))
            score = np.full(len(x), 0.5) if ranking is None else ranking.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = cut_lineage(featured(docs))
    scored = ranked(found, learn(found, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", predicted)
