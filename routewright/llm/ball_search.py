"""Exact ranked lexical search by inner products over sparse ball trees.

A document is a sparse vector of integer term scores: weight of the term times
its damped uses. An item's score for it is the inner product with the item's
terms, each counted once. Only terms of the items have a coordinate.

Documents go to the nearest of PIVOTS drawn vectors; those of a pivot are dealt
to subtrees of about SUBTREE_ENTRIES coordinates. A subtree is built in one task
by splitting at two far members until LEAF documents are left; every node keeps
the centroid and the radius of its documents. By Cauchy and Schwarz no document
of a node scores above q.c + |q| r for an item q with |q| = sqrt(number of terms).
Bounds are doubles that are rounded up by more than their error; scores are
64-bit integers. A node is left out only if its bound is below a score that ten
documents are known to reach, so the result is exact.

Each item is first searched in the subtree of its best bound. The tenth score
found there is where the search of all other subtrees starts; in each, nodes are
taken best bound first. Items are worked on in blocks with about BLOCK_TERMS
terms, which bounds what is broadcast; a single item may have more.

Defined results: null texts and texts without a term have no coordinate and are
never returned; items without a term have no row; rows of documents that repeat
are ranked each, null ids last among ties; rows of items that repeat are answered
each; null ids of items are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.common import coded, slices
from routewright.session import cut_lineage

K = 10
PIVOTS, LEAF = 32, 32
# Coordinates of a subtree on average; bounds what a task builds and holds at once.
SUBTREE_ENTRIES = 1 << 17
# (item, term) pairs of a block on average.
BLOCK_TERMS = 1 << 17
# Coordinates whose pivot is looked for at once.
DEALT_AT_ONCE = 1 << 15
# Bytes of text that are cut into terms at once.
AT_ONCE = 4 << 20
# Relative slack of a bound; sums of doubles here are off by less than 1e-10.
SLACK = 1e-9

_TREE = (
    "subtree long, children array<int>, radius array<double>, "
    "node_at array<int>, node_term array<int>, node_value array<double>, "
    "leaf_at array<int>, doc_at array<int>, term array<int>, value array<long>, doc_id array<long>"
)


def _term_bytes() -> bytes:
    """What each byte of a text becomes: itself, a-z for A-Z, a blank outside terms."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return bytes(out)


_AS_TERM = _term_bytes()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Term boundaries per text (one more than texts) and all terms in order."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: len(texts) + 1]
    data = texts.buffers()[2]
    raw = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(_AS_TERM) if data else b""
    plain = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(raw)
    )
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    at = lists.offsets.to_numpy()
    return before[at - at[0]].astype(np.int64), flat.filter(full).cast(pa.string())


def item_terms(items: DataFrame) -> DataFrame:
    """(item row, item_id, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                at, terms = terms_of(part.column("text"))
                code, distinct = coded(terms)
                who = np.repeat(np.arange(part.num_rows), np.diff(at))
                row, which = np.divmod(np.unique(who * max(1, len(distinct)) + code), max(1, len(distinct)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": part.column("item").take(rows),
                        "item_id": part.column("item_id").take(rows),
                        "term": pa.array(distinct, pa.string()).take(pa.array(which)),
                    }
                )

    rows = items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")
    )
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item long, item_id {kind}, term string")


@dataclass
class Block:
    """Items of a block: terms in order, and each item's term numbers."""

    terms: list[str]
    items: list[int]
    wanted: list[np.ndarray]


def block_of(rows: list) -> Block:
    terms = sorted({r.term for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    own: dict[int, list[int]] = {}
    for r in rows:
        own.setdefault(r.item, []).append(number[r.term])
    items = sorted(own)
    return Block(terms, items, [np.array(sorted(own[i]), dtype=np.int64) for i in items])


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, term, tf): a text's number of terms, and its uses of the given ones."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shipped.value, pa.string())
        for batch in batches:
            for part in slices(batch, size=AT_ONCE):
                at, found = terms_of(part.column("text"))
                d = found.dictionary_encode()
                place = pc.fill_null(pc.index_in(d.dictionary, value_set=known), -1)
                place = place.to_numpy(zero_copy_only=False).astype(np.int64)
                term = place[d.indices.to_numpy(zero_copy_only=False)]
                who = np.repeat(np.arange(part.num_rows), np.diff(at))
                own = term >= 0
                key, tf = np.unique(who[own] * len(known) + term[own], return_counts=True)
                row, which = np.divmod(key, max(1, len(known)))
                lists = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n": pa.array(np.diff(at)),
                        "term": pa.ListArray.from_arrays(lists, pa.array(which.astype(np.int32))),
                        "tf": pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64))),
                    }
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def weigh(counted: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each of a block's terms, number of documents with a term, sum of their terms."""
    whole = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, total = whole.docs, whole.terms or 0
    held = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = (F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)
    rows = held.select("term", F.floor(F.lit(1000) * F.log(ratio)).alias("weight")).collect()
    weights = np.zeros(n_terms, dtype=np.int64)
    for r in rows:
        weights[r.term] = r.weight
    return weights, n_docs, total


def vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, total: int) -> DataFrame:
    """(doc_id, term, value): documents with a coordinate above 0."""
    shipped = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            lists = batch.column("term")
            at = lists.offsets.to_numpy().astype(np.int64)
            term = lists.flatten().to_numpy()
            tf = batch.column("tf").flatten().to_numpy()
            size = np.diff(at)
            n = batch.column("n").to_numpy()
            m = 10 + (90 * n * n_docs) // max(1, total)
            value = own[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
            keep = value > 0
            row = np.repeat(np.arange(batch.num_rows), size)[keep]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "term": pa.ListArray.from_arrays(ends, pa.array(term[keep])),
                    "value": pa.ListArray.from_arrays(ends, pa.array(value[keep])),
                }
            ).filter(pa.array(np.bincount(row, minlength=batch.num_rows) > 0))

    return counted.where("n > 0").mapInArrow(run, "doc_id long, term array<int>, value array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries, terms and values of a batch's vectors."""
    lists = batch.column("term")
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0], lists.flatten().to_numpy(), batch.column("value").flatten().to_numpy()


def deal(found: DataFrame, n_terms: int) -> DataFrame:
    """The vectors with their subtree: the nearest pivot, and a share of its documents."""
    order = F.xxhash64("doc_id", "term", "value")
    drawn = found.select("term", "value").orderBy(order).limit(PIVOTS).collect()
    distinct = sorted({(tuple(r.term), tuple(r.value)) for r in drawn})
    points = np.zeros((n_terms, max(1, len(distinct))))
    for j, (term, value) in enumerate(distinct):
        points[list(term), j] = value
    shipped = found.sparkSession.sparkContext.broadcast((points, (points**2).sum(axis=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, norms = shipped.value
        for batch in batches:
            at, term, value = _flat(batch)
            near = np.empty(batch.num_rows, dtype=np.int64)
            lots = np.unique(np.searchsorted(at, np.arange(0, at[-1], DEALT_AT_ONCE), side="left"))
            for a, b in zip(lots, [*lots[1:], batch.num_rows], strict=True):
                part = slice(at[a], at[b])
                dots = np.add.reduceat(points[term[part]] * value[part, None], at[a:b] - at[a], axis=0)
                near[a:b] = (norms - 2 * dots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near)], names=[*batch.schema.names, "pivot"]
            )

    with_pivot = cut_lineage(
        found.mapInArrow(run, "doc_id long, term array<int>, value array<long>, pivot long")
    )
    sizes = with_pivot.groupBy("pivot").agg(F.sum(F.size("term")).alias("entries"))
    shares = F.ceil(F.col("entries") / SUBTREE_ENTRIES).cast("long")
    # Equal and like vectors are spread evenly over a pivot's subtrees.
    place = F.pmod(F.xxhash64("doc_id", "term", "value", F.monotonically_increasing_id()), F.col("shares"))
    return with_pivot.join(F.broadcast(sizes.select("pivot", shares.alias("shares"))), "pivot").select(
        "doc_id", "term", "value", (F.col("pivot") * (1 << 40) + place).alias("subtree")
    )


class Dense:
    """A lookup row over all terms that is cleared after use."""

    def __init__(self, n_terms: int):
        self._row = np.zeros(n_terms)

    def dots(self, term: np.ndarray, value: np.ndarray, at: np.ndarray, terms, values) -> np.ndarray:
        self._row[terms] = values
        out = np.add.reduceat(self._row[term] * value, at[:-1])
        self._row[terms] = 0
        return out


def _pick(at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the chosen rows, and their boundaries."""
    size = at[some + 1] - at[some]
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(at[some] - ends[:-1], size) + np.arange(ends[-1]), ends


def build(at: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> dict:
    """A ball tree over sparse vectors: nodes with centroid, radius, and children or documents."""
    real = value.astype(np.float64)
    squares = np.add.reduceat(real**2, at[:-1])
    dense = Dense(n_terms)
    children, radius, centroids, leaves = [], [], [], []
    stack = [(np.arange(len(at) - 1), -1, 0)]
    while stack:
        some, parent, side = stack.pop()
        node = len(radius)
        if parent >= 0:
            children[parent][side] = node
        take, ends = _pick(at, some)
        t, x = term[take], real[take]
        terms, local = np.unique(t, return_inverse=True)
        mean = np.bincount(local, weights=x) / len(some)
        # Distances in double: squares grow to 1e21 and more, and the slack covers the rounding.
        apart = squares[some] - 2 * dense.dots(t, x, ends, terms, mean) + (mean**2).sum()
        largest = squares[some].max() + (mean**2).sum()
        radius.append(math.sqrt(max(0.0, apart.max()) + largest * SLACK) * (1 + SLACK))
        centroids.append((terms, mean))
        children.append([-1, -1])
        parts = _split(at, term, real, squares, some, dense) if len(some) > LEAF else None
        leaves.append(some if parts is None else np.zeros(0, dtype=np.int64))
        if parts is not None:
            stack += [(parts[1], node, 1), (parts[0], node, 0)]
    return {"children": children, "radius": radius, "centroids": centroids, "leaves": leaves}


def _split(at, term, real, squares, some, dense):
    """Members nearer to one or the other of two far ones; halves where all are alike."""
    take, ends = _pick(at, some)
    t, x = term[take], real[take]

    def apart(j: int) -> np.ndarray:
        a, b = at[some[j]], at[some[j] + 1]
        return squares[some] - 2 * dense.dots(t, x, ends, term[a:b], real[a:b]) + squares[some[j]]

    left = int(apart(0).argmax())
    from_left = apart(left)
    from_right = apart(int(from_left.argmax()))
    order = np.argsort(from_left - from_right, kind="stable")
    near = int((from_left < from_right).sum())
    least = max(1, len(some) // 16)
    cut = near if least <= near <= len(some) - least else len(some) // 2
    return some[np.sort(order[:cut])], some[np.sort(order[cut:])]


def trees(dealt: DataFrame, n_terms: int) -> DataFrame:
    """One row per subtree, with the nodes and vectors in flat arrays."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        at, term, value = _flat(batch)
        tree = build(at, term, value, n_terms)
        order = np.concatenate(tree["leaves"])
        take, ends = _pick(at, order)
        sizes = [len(c[0]) for c in tree["centroids"]]
        row = {
            "subtree": [batch.column("subtree")[0].as_py()],
            "children": [np.array(tree["children"], dtype=np.int32).ravel()],
            "radius": [np.array(tree["radius"])],
            "node_at": [np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)],
            "node_term": [np.concatenate([c[0] for c in tree["centroids"]]).astype(np.int32)],
            "node_value": [np.concatenate([c[1] for c in tree["centroids"]])],
            "leaf_at": [np.concatenate([[0], np.cumsum([len(x) for x in tree["leaves"]])]).astype(np.int32)],
            "doc_at": [ends.astype(np.int32)],
            "term": [term[take]],
            "value": [value[take]],
            "doc_id": [batch.column("doc_id").take(pa.array(order)).to_pylist()],
        }
        return pa.table({k: pa.array(v, type=_ARROW[k]) for k, v in row.items()})

    return dealt.groupBy("subtree").applyInArrow(run, _TREE)


_ARROW = {
    k: {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]
    if "<" not in kind
    else pa.list_({"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}[kind[6:-1]])
    for k, kind in (part.split() for part in _TREE.split(", "))
}


class Tree:
    """A subtree read back, with the lookups that a search needs."""

    def __init__(self, row: pa.RecordBatch, i: int):
        def flat(name: str) -> np.ndarray:
            return row.column(name)[i].values.to_numpy(zero_copy_only=False)

        self.children, self.radius = flat("children").reshape(-1, 2), flat("radius")
        self.node_at, self.node_term, self.node_value = map(flat, ("node_at", "node_term", "node_value"))
        self.leaf_at, self.doc_at, self.term, self.value = map(
            flat, ("leaf_at", "doc_at", "term", "value")
        )
        self.doc_id = row.column("doc_id")[i].values

    def bounds(self, lookup: np.ndarray, n_wanted: int, nodes: int | None = None) -> np.ndarray:
        """Highest score that any document of each node can have, rounded up."""
        n = nodes or len(self.radius)
        high = self.node_at[n]
        dots = np.add.reduceat(lookup[self.node_term[:high]] * self.node_value[:high], self.node_at[:n])
        return (dots + math.sqrt(n_wanted) * self.radius[:n]) * (1 + SLACK) + 1

    def search(self, wanted: np.ndarray, lookup: np.ndarray, least: int, k: int):
        """(score, document place) of the k best from ``least`` on, and how many were scored."""
        lookup[wanted] = 1
        if self.bounds(lookup, len(wanted), 1)[0] < least:
            lookup[wanted] = 0
            return [], 0
        bounds = self.bounds(lookup, len(wanted))
        heap = [(-bounds[0], 0)]
        best: list[int] = []
        found, scored = [], 0
        whole = lookup.astype(bool)
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if self.children[node, 0] >= 0:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], int(child)))
                continue
            a, b = self.leaf_at[node], self.leaf_at[node + 1]
            low, high = self.doc_at[a], self.doc_at[b]
            own = np.where(whole[self.term[low:high]], self.value[low:high], 0)
            scores = np.add.reduceat(own, self.doc_at[a:b] - low)
            scored += len(scores)
            for j in np.flatnonzero(scores >= max(1, least)):
                found.append((int(scores[j]), int(a + j)))
                heapq.heappush(best, int(scores[j]))
                if len(best) > k:
                    heapq.heappop(best)
            if len(best) == k:
                least = max(least, best[0])
        lookup[wanted] = 0
        # Of equal scores the smallest ids may be ranked.
        found = [x for x in found if x[0] >= least]
        ids = self.doc_id.take(pa.array([x[1] for x in found], pa.int64())).to_pylist()
        order = sorted(
            range(len(found)), key=lambda j: (-found[j][0], ids[j] is None, ids[j] or 0)
        )
        return [found[j] for j in order[:k]], scored


def root_bounds(index: DataFrame, block: Block) -> DataFrame:
    """(item, subtree): for each item the subtree with the best bound."""
    shipped = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        best = np.full(len(own.items), -1.0)
        where = np.zeros(len(own.items), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = np.zeros(len(own.terms))
                at = batch.column("node_at")[i].values.to_numpy()
                terms = batch.column("node_term")[i].values.to_numpy()[: at[1]]
                row[terms] = batch.column("node_value")[i].values.to_numpy()[: at[1]]
                r = batch.column("radius")[i].values.to_numpy()[0]
                bound = np.array([row[w].sum() + math.sqrt(len(w)) * r for w in own.wanted])
                better = bound > best
                best[better], where[better] = bound[better], batch.column("subtree")[i].as_py()
        seen = best >= 0
        yield pa.RecordBatch.from_pydict(
            {
                "item": pa.array(np.array(own.items, dtype=np.int64)[seen]),
                "subtree": pa.array(where[seen]),
                "bound": pa.array(best[seen]),
            }
        )

    roots = index.select("subtree", "node_at", "node_term", "node_value", "radius").mapInArrow(
        run, "item long, subtree long, bound double"
    )
    return roots.groupBy("item").agg(F.max_by("subtree", F.struct("bound", "subtree")).alias("subtree"))


def search_trees(
    index: DataFrame, block: Block, first: dict[int, int], least: dict[int, int] | None, k: int
) -> DataFrame:
    """(item, doc_id, score, scored) found in each item's first subtree, or in all others.

    ``least`` holds scores that k documents of the first subtrees reach.
    """
    shipped = index.sparkSession.sparkContext.broadcast((block, first, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, least = shipped.value
        lookup = np.zeros(len(own.terms))
        by_tree: dict[int, list[int]] = {}
        for q, item in enumerate(own.items):
            by_tree.setdefault(first[item], []).append(q)
        for batch in batches:
            for i in range(batch.num_rows):
                subtree = batch.column("subtree")[i].as_py()
                here = by_tree.get(subtree, [])
                if least is None:
                    asked = here
                else:
                    asked = sorted(set(range(len(own.items))) - set(here))
                if not asked:
                    continue
                tree = Tree(batch, i)
                items, places, scores, work = [], [], [], []
                for q in asked:
                    item = own.items[q]
                    start = 0 if least is None else least.get(item, 0)
                    found, scored = tree.search(own.wanted[q], lookup, start, k)
                    items += [item] * len(found)
                    places += [x[1] for x in found]
                    scores += [x[0] for x in found]
                    work += [scored] * len(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": pa.array(items, pa.int64()),
                        "doc_id": tree.doc_id.take(pa.array(places, pa.int64())),
                        "score": pa.array(scores, pa.int64()),
                        "scored": pa.array(work, pa.int64()),
                    }
                )

    return index.mapInArrow(run, "item long, doc_id long, score long, scored long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = cut_lineage(item_terms(items))
    n_blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    ids = asked.select("item", "item_id").distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    done = spark.createDataFrame([], f"item long, doc_id long, score long, rank int, item_id {kind}")
    for b in range(n_blocks):
        mine = F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b
        block = block_of(asked.where(mine).select("item", "term").collect())
        done = done.unionByName(search_block(docs, block, k).join(ids, "item"))
    return done.select("item_id", "rank", "doc_id", "score")


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    n = len(block.terms)
    counted = cut_lineage(count_terms(docs, block.terms))
    weights, n_docs, total = weigh(counted, n)
    index = cut_lineage(trees(deal(vectors(counted, weights, n_docs, total), n), n))
    first = {r.item: r.subtree for r in root_bounds(index, block).collect()}
    block = Block(block.terms, [i for i in block.items if i in first], [
        w for i, w in zip(block.items, block.wanted, strict=True) if i in first
    ])
    near = cut_lineage(best(search_trees(index, block, first, None, k), k))
    least = {r.item: r.score for r in near.where(F.col("rank") == k).select("item", "score").collect()}
    far = search_trees(index, block, first, least, k)
    names = ("item", "doc_id", "score")
    return best(near.select(*names).unionByName(far.select(*names)), k)
