"""Best documents of queries that share words with most of them: block by block, nothing listed.

Documents are packed in blocks, queries in blocks, and every pair of blocks meets
in one task, where the scores are a product of two matrices: of the terms with many
hits there as dense arrays, of the others hit by hit. A task holds the k best of a
query so far, so what leaves it is k rows a query and not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.session import cut_lineage

# Documents and postings of a block at most (a larger document stands alone), and queries of a block.
PACK_DOCS, PACK_TERMS = 1024, 1 << 18
QUERY_BLOCK = 1024
# Query blocks that a task takes along, and rows a query keeps, times k, before they are cut.
BLOCKS_A_TASK, SLACK_ROWS = 1, 3
# A term is dense in a pair of blocks if so many times its hits exceed the pairs of documents and
# queries; hits of other terms are added up so many at once.
DENSE, HITS = 64, 1 << 20
# Scores are rounded to six digits; a score that is further below the floor cannot reach it.
ROUNDING = 1e-6


def packed(vectors: DataFrame) -> DataFrame:
    """One row per block of vectors(doc_id, db, len, terms): flat arrays of its documents."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    ddl = (
        f"ids array<{kind['doc_id']}>, dbs array<{kind['db']}>, lens array<bigint>, "
        "sizes array<int>, terms array<string>, tfs array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
            upto, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                most = (upto[at - 1] if at else 0) + PACK_TERMS
                end = min(max(int(np.searchsorted(upto, most, "right")), at + 1), at + PACK_DOCS)
                part = batch.slice(at, end - at)
                flat = part.column("terms").flatten()
                values = [
                    part.column("doc_id"), part.column("db"), part.column("len").cast(pa.int64()),
                    pa.array(sizes[at:end], pa.int32()), flat.field("term"), flat.field("tf").cast(pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values],
                    names=["ids", "dbs", "lens", "sizes", "terms", "tfs"],
                )
                at = end

    return vectors.mapInArrow(run, ddl)


def asked_blocks(terms: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block of queries terms(keys…, term, w): (block, keys[], qs[], terms[], ws[])."""
    each = terms.groupBy(*keys).agg(F.collect_list(F.struct("term", "w")).alias("t"))
    # About QUERY_BLOCK of them; a hash, so that no window runs over all queries.
    n_blocks = F.greatest(F.lit(1), F.ceil(each.agg(F.count(F.lit(1)).alias("n")).scalar() / QUERY_BLOCK))
    dealt = each.select(
        F.pmod(F.xxhash64(*keys), n_blocks).alias("block"), F.struct(F.struct(*keys).alias("key"), "t").alias("x")
    )
    rows = dealt.groupBy("block").agg(F.collect_list("x").alias("xs"))
    flat = F.flatten(
        F.transform("xs", lambda x, i: F.transform(x["t"], lambda t: F.struct(i.alias("q"), t["term"].alias("term"), t["w"].alias("w"))))
    )
    return rows.select("block", F.transform("xs", lambda x: x["key"]).alias("keys"), flat.alias("t")).select(
        "block", "keys", F.col("t.q").alias("qs"), F.col("t.term").alias("asked"), F.col("t.w").alias("ws")
    )


class _Best:
    """The k best documents of each query of a block so far, for each parameter pair."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.held = n, k, 0
        self.floor = np.full(n, -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, met: np.ndarray, ids: np.ndarray, dbs: np.ndarray) -> None:
        """scores and met are (documents, queries)."""
        if not self.rows and len(ids) > self.k:
            # The k-th of the first documents is a floor already; fewer than k give none.
            at = len(ids) - self.k
            first = np.partition(np.where(met, scores, -np.inf), at, axis=0)[at]
            self.floor = np.maximum(self.floor, np.round(first, 6))
        doc, q = np.nonzero(met & (scores >= self.floor - ROUNDING))
        score = scores[doc, q]
        shown = np.round(score, 6)
        if len(doc):
            near = shown >= self.floor[q]
            doc, q, score, shown = doc[near], q[near], score[near], shown[near]
            self.rows.append((q, shown, score, ids[doc], dbs[doc]))
            self.held += len(doc)
        if self.held > SLACK_ROWS * self.k * self.n:
            self.cut()

    def cut(self) -> None:
        if not self.rows:
            return
        q, shown, score, ids, dbs = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        by_id = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((by_id, -shown, q))
        begins = np.searchsorted(q[order], np.arange(self.n))
        nth = np.arange(len(order)) - begins[q[order]]
        last = order[nth == self.k - 1]
        self.floor[q[last]] = shown[last]
        left = order[nth < self.k]
        self.rows, self.held = [(q[left], shown[left], score[left], ids[left], dbs[left])], len(left)


class _Asked:
    """The terms of a block of n queries, each with the queries that ask for it."""

    def __init__(self, said: pa.Array, of: np.ndarray, ws: np.ndarray, n: int):
        self.known, self.n = said.unique(), n
        term = pc.index_in(said, self.known).to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.qs, self.ws = of[order], ws[order]
        self.uses = np.bincount(term, minlength=len(self.known))
        self.begins = np.cumsum(self.uses) - self.uses

    def hits(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hit): for each place in ``terms`` the numbers of its queries in qs and ws."""
        uses = self.uses[terms]
        place = np.repeat(np.arange(len(terms)), uses)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(uses) - uses, uses) + self.begins[terms[place]]

    def sums(self, n_docs: int, doc: np.ndarray, at: np.ndarray, value: np.ndarray, met: bool = False) -> np.ndarray:
        """(documents, queries): sums of value times weight over the postings (doc, term number), or
        if ``met`` of value alone."""
        wide = np.bincount(at, minlength=len(self.known)) * self.uses * DENSE > n_docs * self.n
        column, dense = np.cumsum(wide) - 1, wide[at]
        cells = np.zeros((n_docs, int(wide.sum())))
        cells[doc[dense], column[at[dense]]] = value[dense]
        row, hit = self.hits(np.flatnonzero(wide))
        w = np.zeros((cells.shape[1], self.n))
        w[row, self.qs[hit]] = self.ws[hit] != 0 if met else self.ws[hit]
        out = (cells @ w).ravel()
        doc, at, value = doc[~dense], at[~dense], value[~dense]
        upto, a = np.cumsum(self.uses[at]), 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            row, hit = self.hits(at[a:z])
            row += a
            part = value[row] * (self.ws[hit] != 0 if met else self.ws[hit])
            out += np.bincount(doc[row] * self.n + self.qs[hit], part, minlength=len(out))
            a = z
        return out.reshape(n_docs, self.n)


def _values(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def best_of_blocks(
    packs: DataFrame, terms: DataFrame, keys: list[str], avg_len: float, grid: list[tuple[float, float]], k: int
) -> DataFrame:
    """(keys…, pair, doc_id, db, s): documents that hold a query's term, each task's k best for
    each parameter pair, by number; terms(keys…, term, w) are the weighted query terms."""
    blocks = cut_lineage(asked_blocks(terms, keys), wide=True)
    n_blocks = blocks.count()
    cores = packs.sparkSession.sparkContext.defaultParallelism
    apart = max(1, -(-n_blocks // BLOCKS_A_TASK))
    kind = dict(packs.dtypes)
    key_kind = dict(blocks.dtypes)["keys"][len("array<") : -1]
    ddl = f"key {key_kind}, pair int, doc_id {kind['ids'][6:-1]}, db {kind['dbs'][6:-1]}, s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block = row["block"].as_py()
                if row["keys"].is_valid:
                    n = len(row["keys"])
                    of, ws = (row[c].values.to_numpy(zero_copy_only=False) for c in ("qs", "ws"))
                    asked[block] = (row["keys"].values, _Asked(row["asked"].values, of, ws, n), [_Best(n, k) for _ in grid])
                _, said, best = asked[block]
                sizes = row["sizes"].values.to_numpy(zero_copy_only=False)
                lens = row["lens"].values.to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(row["terms"].values, said.known), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
                tf = row["tfs"].values.to_numpy(zero_copy_only=False)[at >= 0].astype(np.float64)
                at = at[at >= 0]
                ids, dbs = _values(row["ids"].values), _values(row["dbs"].values)
                met = None
                if (said.ws < 0).any():
                    met = said.sums(len(sizes), doc, at, np.ones(len(at)), met=True) > 0
                for (k1, b), found in zip(grid, best, strict=True):
                    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[doc] / avg_len))
                    scores = said.sums(len(sizes), doc, at, part)
                    found.add(scores, scores > 0 if met is None else met, ids, dbs)
        for names, _, best in asked.values():
            for pair, found in enumerate(best):
                found.cut()
                for q, _, score, ids, dbs in found.rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            names.take(pa.array(q)), pa.array(np.full(len(q), pair), pa.int32()),
                            pa.array(ids), pa.array(dbs.tolist(), pa.string()), pa.array(score),
                        ],
                        names=["key", "pair", "doc_id", "db", "s"],
                    )

    few = max(1, -(-2 * cores // apart))
    left = packs.coalesce(few) if packs.rdd.getNumPartitions() > few else packs
    # A task meets its first pack with all its queries; later ones come with their block's number only.
    left = left.withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    met = left.hint("shuffle_replicate_nl").crossJoin(blocks.repartitionByRange(apart, "block"))
    said = [F.when(F.col("nth") == 0, F.col(c)).alias(c) for c in blocks.columns if c != "block"]
    sent = met.select(*packs.columns, "block", *said)
    return sent.mapInArrow(run, ddl).select("key.*", "pair", "doc_id", "db", "s")
