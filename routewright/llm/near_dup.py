"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct shingles of five words. Documents with equal
sets are one node. Each node keeps MinHash minima: bands of them are the keys
under which candidates meet, and their low bits, packed, estimate similarity by
bit counts, corrected for the matches that few bits make by chance. Links are
confirmed on the full sets.

No key's members are paired with each other:

1. Each member is paired with the smallest member of its key only. The best of
   these pairs by estimate are confirmed and joined to components.
2. Where a key still spans several components, their members are compared by
   bit counts inside blocks of bounded size. Each component puts forward its
   best pairs with others, as long as this joins any.
3. Where that ends, the blocks are gone through once more with the members'
   texts, and every pair of different components that the estimate does not
   rule out is compared in full, inside the block. Only links leave it, one for
   a member and a component. No pair that shares a key and could join two
   components stays untested.

A link is missed if no band agrees, or if the estimate is five standard
deviations low: at similarity 0.75 about 2 in 100,000 links, at 0.8 one in ten
million; a group loses a member only if all its links are missed.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; a null doc_id is larger than any; rows that repeat are all in the
group, and of rows that share its smallest doc_id ``drop_near_copies`` keeps
one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.common import coded, hash_words, mix, seeded, slices, words_of
from routewright.llm.components import components
from routewright.session import cut_lineage

SHINGLE = 5
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 5
MINIMA = BANDS * ROWS
# Low bits kept of each minimum; sixteen fill a long.
BITS = 4
LONGS = -(-MINIMA // 16)
# Pairs of a document that the first round confirms: the best by estimate.
FIRST_PAIRS = 3
# Pairs that a component of a block puts forward in each further round.
BEST_PAIRS = 2
# A block's size: a member counts one, and one more for each UNIT of its shingles.
BLOCK, UNIT = 4096, 128

_CHANCE = 1 / (1 << BITS)
_AT_LIMIT = PERCENT / 100 * (1 - _CHANCE) + _CHANCE
_SPREAD = (_AT_LIMIT * (1 - _AT_LIMIT) / MINIMA) ** 0.5 / (1 - _CHANCE)
LEAST_ESTIMATE = PERCENT / 100 - 5 * _SPREAD

_A = seeded(11, MINIMA).astype(np.uint32) | np.uint32(1)
_B = seeded(12, MINIMA).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NIBBLES = np.uint64(0x1111111111111111)

_NODES = (
    "doc_id bigint, f1 bigint, f2 int, node binary, n_shingles bigint, "
    "sketch array<bigint>, bands array<bigint>"
)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    at, words = words_of(texts)
    code, distinct = coded(words)
    h = hash_words(distinct)[code]
    full = np.zeros(max(0, len(h) - SHINGLE + 1), dtype=np.uint64)
    for j in range(SHINGLE):
        full = full * _BASE + h[j : len(full) + j]
    full = mix(full)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for x in h[a:b]:
                short = short * _BASE + x
            out.append(mix(short))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(found: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each of MINIMA fixed permutations."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(low, (x[a : a + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band of a (n, MINIMA) array."""
    parts = low.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for j in range(ROWS):
        key = mix(key * _BASE + parts[:, :, j])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, sixteen to a long."""
    bits = np.zeros((len(low), LONGS * 16), dtype=np.uint64)
    bits[:, :MINIMA] = mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits.reshape(-1, LONGS, 16) << shift, axis=2).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = shingle_sets(part.column("text"))
            n = np.array([len(s) for s in found], dtype=np.int64)
            full = n > 0
            low = np.array([minima(s) for s in found if len(s)], dtype=np.uint32).reshape(-1, MINIMA)
            node = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in found]
            columns = [part.column(c) for c in ("doc_id", "f1", "f2")]
            columns += [pa.array(node, pa.binary()), pa.array(n)]
            for values in (packed(low), band_keys(low)):
                ends = np.concatenate([[0], np.cumsum(full)]) * values.shape[1]
                flat = pa.array(values.ravel(), pa.int64())
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(
                columns,
                names=["doc_id", "f1", "f2", "node", "n_shingles", "sketch", "bands"],
            )


def _fingerprint(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and two hashes of the text: enough to find a row again."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("f1"),
        F.hash("text").alias("f2"),
        *more,
    )


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, node, n_shingles, sketch, bands): one row per document."""
    return _fingerprint(docs, F.col("text")).mapInArrow(_sketch, _NODES)


def estimate(x: str, y: str) -> Column:
    """Similarity from two packed sketches, corrected for chance matches."""
    unequal = F.lit(0)
    for j in range(LONGS):
        d = F.col(x)[j].bitwiseXOR(F.col(y)[j])
        for k in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        unequal = unequal + F.bit_count(d.bitwiseAND(F.lit(int(_NIBBLES))))
    return 1 - unequal / F.lit(MINIMA * (1 - _CHANCE))


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for all rows of x against all rows of y."""
    d = x[:, None, :] ^ y[None, :, :]
    for k in (1, 2):
        d |= d >> np.uint64(k)
    unequal = np.bitwise_count(d & _NIBBLES).sum(axis=2, dtype=np.int64)
    return 1 - unequal / (MINIMA * (1 - _CHANCE))


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, node, hub): members of the keys that several nodes share."""
    group = Window.partitionBy("key")
    return (
        nodes.select("node", F.explode("bands").alias("key"))
        .withColumns({"hub": F.min("node").over(group), "most": F.max("node").over(group)})
        .where("hub <> most")
        .drop("most")
    )


def hub_pairs(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each member with the smallest of its keys, the best few by estimate."""
    sketch = nodes.select("node", "sketch")
    pairs = met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    guessed = (
        pairs.distinct()
        .join(sketch.toDF("a", "x"), "a")
        .join(sketch.toDF("b", "y"), "b")
        .select("a", "b", estimate("x", "y").alias("guess"))
        .where(F.col("guess") >= LEAST_ESTIMATE)
    )
    best = Window.partitionBy("a").orderBy(F.desc("guess"), "b")
    placed = guessed.withColumn("place", F.row_number().over(best))
    return placed.where(F.col("place") <= FIRST_PAIRS).select("a", "b")


def _open_blocks(met: DataFrame, roots: DataFrame, carried: DataFrame) -> DataFrame:
    """(members): blocks that hold all pairs of a key's members in different components.

    ``carried`` is what a member brings along, by node.

    Members in the component of the key's hub are dealt to blocks once; only the
    others, which are few, are copied to each block.
    """
    root = roots.toDF("node", "root")
    hub_root = roots.toDF("hub", "hub_root")
    group = Window.partitionBy("key")
    named = (
        met.join(root, "node", "left")
        .join(hub_root, "hub", "left")
        .select(
            "key",
            "node",
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("root", "node") != F.coalesce("hub_root", "hub")).alias("other"),
            "weight",
        )
        .withColumns(
            {
                "others": F.sum(F.when(F.col("other"), F.col("weight"))).over(group),
                "mains": F.sum(F.when(~F.col("other"), F.col("weight"))).over(group),
            }
        )
        .where("others > 0")
    )
    main_slices, other_slices = F.ceil(F.col("mains") / BLOCK), F.ceil(F.col("others") / BLOCK)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("other"), other_slices).otherwise(main_slices))

    def place(kind: int, i, j) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    to_mains = F.transform(F.sequence(F.lit(0), main_slices - 1), lambda i: place(0, i, F.col("own")))
    to_others = F.transform(
        F.sequence(F.lit(0), other_slices - 1),
        lambda k: place(1, F.least("own", k), F.greatest("own", k)),
    )
    from_main = F.transform(F.sequence(F.lit(0), other_slices - 1), lambda j: place(0, F.col("own"), j))
    dealt = (
        named.withColumn("own", own)
        .withColumn(
            "block", F.explode(F.when(F.col("other"), F.concat(to_mains, to_others)).otherwise(from_main))
        )
        .select("key", "block", "node", "root")
        .join(carried, "node")
    )
    member = F.struct("node", "root", *[c for c in carried.columns if c != "node"])
    return dealt.groupBy("key", "block").agg(F.collect_list(member).alias("members")).select("members")


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(members, nodes, component codes, sketches) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            flat = batch.column("members").slice(i, 1).flatten()
            node = np.array(flat.field("node").to_pylist(), dtype=object)
            code, _ = coded(flat.field("root"))
            sketch = flat.field("sketch").flatten().to_numpy().reshape(-1, LONGS).view(np.uint64)
            yield flat, node, code, sketch


def _guesses(sketch: np.ndarray, code: np.ndarray):
    """(rows, estimates) of some rows at a time against all, -1 inside a component."""
    for i in range(0, len(sketch), 64):
        rows = np.arange(i, min(i + 64, len(sketch)))
        guess = _estimates(sketch[rows], sketch)
        guess[code[rows][:, None] == code[None]] = -1
        yield rows, guess


def _pairs(a, b) -> pa.RecordBatch:
    low = [min(p) for p in zip(a, b, strict=True)]
    high = [max(p) for p in zip(a, b, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["a", "b"]
    )


def _best_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most similar pairs that each component of a block has with others."""
    for _, node, code, sketch in _blocks(batches):
        best = [(guess.argmax(axis=1), guess.max(axis=1)) for _, guess in _guesses(sketch, code)]
        y, guess = (np.concatenate(c) for c in zip(*best, strict=True))
        order = np.lexsort((-guess, code))
        place = np.arange(len(order)) - np.searchsorted(code[order], code[order])
        x = order[(place < BEST_PAIRS) & (guess[order] >= LEAST_ESTIMATE)]
        yield _pairs(node[x], node[y[x]])


class _Shared:
    """Intersections of a block's sets, by bits of the shingles that several have."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        _, code, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.where(uses > 1, np.cumsum(uses > 1) - 1, -1)[code]
        row = np.repeat(np.arange(len(sets)), self.size)
        self._bits = np.zeros((len(sets), int((uses > 1).sum()) // 64 + 1), dtype=np.uint64)
        full = column >= 0
        bit = np.uint64(1) << (column[full] % 64).astype(np.uint64)
        np.bitwise_or.at(self._bits, (row[full], column[full] // 64), bit)

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of places are links."""
        both = np.empty(len(x), dtype=np.int64)
        step = max(1, (1 << 21) // self._bits.shape[1])
        for a in range(0, len(x), step):
            some = slice(a, a + step)
            both[some] = np.bitwise_count(self._bits[x[some]] & self._bits[y[some]]).sum(
                axis=1, dtype=np.int64
            )
        return 100 * both >= PERCENT * (self.size[x] + self.size[y] - both)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, one for a member and a component."""
    for flat, node, code, sketch in _blocks(batches):
        shared, a, b = None, [], []
        for rows, guess in _guesses(sketch, code):
            x, y = np.nonzero(guess >= LEAST_ESTIMATE)
            x = rows[x]
            x, y = x[x < y], y[x < y]
            if len(x):
                shared = shared or _Shared(shingle_sets(flat.field("text")))
                link = shared.linked(x, y)
                _, first = np.unique(x[link] * len(node) + code[y[link]], return_index=True)
                a.extend(node[x[link][first]])
                b.extend(node[y[link][first]])
        yield _pairs(a, b)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        for part in slices(batch, "x"):
            seen: dict[bytes, int] = {}
            b = part.column("b").to_pylist()
            place = [seen.setdefault(v, len(seen)) for v in b]
            first = {p: i for i, p in reversed(list(enumerate(place)))}
            ys = shingle_sets(part.column("y").take(pa.array([first[p] for p in range(len(seen))])))
            xs = shingle_sets(part.column("x"))
            keep = []
            for x, p in zip(xs, place, strict=True):
                y = ys[p]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) that are links, by the full sets of (node, text)."""
    both = (
        pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    )
    return cut_lineage(both.mapInArrow(_linked, "a binary, b binary"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, node, n_shingles, root, component_id): one row per document."""
    rows = cut_lineage(sketches(docs))
    nodes = cut_lineage(rows.where("node is not null").dropDuplicates(["node"]))
    weight = (1 + F.col("n_shingles") / UNIT).alias("weight")
    met = cut_lineage(meetings(nodes).join(nodes.select("node", weight), "node"))
    wanted = nodes.select("node", "doc_id", "f1", "f2").join(met.select("node").distinct(), "node")
    texts = cut_lineage(_texts(docs, wanted))

    links = confirmed(hub_pairs(met, nodes), texts)
    roots = components(links)
    sketch = nodes.select("node", "sketch")
    while True:
        best = _open_blocks(met, roots, sketch).mapInArrow(_best_pairs, "a binary, b binary")
        more = confirmed(cut_lineage(best.distinct()), texts)
        if more.isEmpty():
            break
        links = links.union(more)
        roots = components(links)
    blocks = _open_blocks(met, roots, sketch.join(texts, "node"))
    late = blocks.mapInArrow(_block_links, "a binary, b binary")
    roots = components(links.union(late))
    least = cut_lineage(
        rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id"))
    )
    by_root = cut_lineage(
        roots.join(least, "node").groupBy("root").agg(F.min("own_id").alias("component_id"))
    )
    joined = cut_lineage(roots.join(by_root, "root").select("node", "root", "component_id"))
    named = cut_lineage(
        least.join(joined, "node", "left").select(
            "node",
            F.coalesce("root", "node").alias("root"),
            F.when(F.col("root").isNull(), F.col("own_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
    )
    found = rows.select("doc_id", "f1", "f2", "node", "n_shingles").join(named, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.withColumn("component_id", alone)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of one document for each wanted node."""
    rows = _fingerprint(docs, F.col("text"))
    same = [rows[c].eqNullSafe(wanted[c]) for c in ("doc_id", "f1", "f2")]
    return rows.join(wanted, same).select("node", "text").dropDuplicates(["node"])


def near_dup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return groups(docs).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    found = groups(docs)
    # Documents with an empty set are groups of their own.
    group = Window.partitionBy("root", F.when(F.col("root").isNull(), F.struct("doc_id", "f1", "f2")))
    stay = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "f1", "f2", "root")
        .distinct()
        .withColumn("place", F.row_number().over(group.orderBy("f1", "f2")))
        .where("place = 1")
        .select("doc_id", "f1", "f2")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _fingerprint(docs, row)
    same = [rows[c].eqNullSafe(stay[c]) for c in ("doc_id", "f1", "f2")]
    again = Window.partitionBy("doc_id", "f1", "f2").orderBy("f1")
    return (
        rows.join(stay, same, "left_semi")
        .withColumn("nth", F.row_number().over(again))
        .where("nth = 1")
        .select("row.*")
    )
