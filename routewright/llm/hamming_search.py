"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per component: whether it is above 0. Codes are cut
into segments, each with an index of its own. A code within distance r of a
query differs from it by at most r / SEGMENTS bits in some segment, so all
codes below SEGMENTS * (s + 1) are found once every segment was searched up to
radius s. The radius grows until the k-th best verified distance is below that.

Equal codes are one entry with its smallest k ids. Entries are dealt to blocks,
query codes to others; each pair of blocks is searched by one task, which keeps
k ids for a query, and the best of these are merged. No pair of a query and an
entry becomes a row.

Defined results: ties go to the smaller id, null ids come last; a null vector
and one of another length than BITS are neither found nor searched for, nor
does a row with a null id search; missing and not-a-number components are bits
0; rows that repeat are found each; with fewer than k rows all are found; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.session import cut_lineage

BITS, SEGMENTS = 64, 4
K = 10
# Entries and query codes of a block at most.
ENTRIES, QUERIES = 1 << 18, 1 << 14

_WIDTH = BITS // SEGMENTS


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = batch.column("vec")
        fits = pc.fill_null(pc.equal(pc.list_value_length(vec), BITS), False)
        kept = batch.filter(fits)
        flat = pc.fill_null(kept.column("vec").flatten(), 0.0)
        above = flat.to_numpy(zero_copy_only=False).reshape(-1, BITS) > 0
        code = np.packbits(above, axis=1, bitorder="little").view("<i8").ravel()
        yield pa.RecordBatch.from_arrays(
            [kept.column("vec_id"), pa.array(code, pa.int64())], names=["vec_id", "code"]
        )


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code) of (vec_id, embedding): the signs of the components."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    return rows.mapInArrow(_encode, "vec_id bigint, code bigint")


@lru_cache(maxsize=None)
def _masks(weight: int) -> np.ndarray:
    """All segment values with so many bits."""
    return np.array(
        [sum(1 << b for b in bits) for bits in combinations(range(_WIDTH), weight)], dtype=np.int64
    )


class SegmentIndex:
    """Entries by the value of each segment."""

    def __init__(self, code: np.ndarray):
        self.code = code.view(np.uint64)
        self._order, self._ends = [], []
        for j in range(SEGMENTS):
            value = self.segment(self.code, j)
            self._order.append(np.argsort(value, kind="stable"))
            self._ends.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << _WIDTH))]))

    @staticmethod
    def segment(code: np.ndarray, j: int) -> np.ndarray:
        return (code >> np.uint64(j * _WIDTH) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)

    def at_radius(self, query: np.uint64, radius: int) -> np.ndarray:
        """Entries that differ from the query by just so many bits in a segment."""
        found = []
        for j in range(SEGMENTS):
            value = self.segment(query, j) ^ _masks(radius)
            first, last = self._ends[j][value], self._ends[j][value + 1]
            full = last > first
            first, n = first[full], (last - first)[full]
            ends = np.cumsum(n)
            take = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            found.append(self._order[j][take])
        return np.concatenate(found)

    def search(self, query: int, k: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all entries up to the k-th nearest id.

        ``copies`` holds how many ids an entry brings, k at most.
        """
        q = np.uint64(query & ((1 << BITS) - 1))
        seen = np.zeros(len(self.code), dtype=bool)
        place, distance = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for radius in range(_WIDTH + 1):
            new = self.at_radius(q, radius)
            new = np.unique(new[~seen[new]])
            seen[new] = True
            place = np.concatenate([place, new])
            distance = np.concatenate([distance, np.bitwise_count(self.code[new] ^ q).astype(np.int64)])
            # Every entry nearer than this has been met.
            covered = SEGMENTS * (radius + 1)
            near = distance < covered
            if copies[place[near]].sum() >= k or len(place) == len(self.code):
                break
        order = np.argsort(distance, kind="stable")
        before = np.cumsum(copies[place[order]]) - copies[place[order]]
        reached = distance[order][before < k]
        keep = distance <= (reached[-1] if len(reached) else -1)
        return place[keep], distance[keep]


def _searching(k: int):
    def run(keys, entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(entries) and len(queries):
            index = SegmentIndex(entries["code"].to_numpy())
            ids = entries["ids"].to_pylist()
            copies = np.array([len(x) for x in ids])
            for query in queries["code"].to_pylist():
                place, distance = index.search(query, k, copies)
                best = sorted(
                    (d, i is None, i or 0) for p, d in zip(place, distance, strict=True) for i in ids[p]
                )[:k]
                out.extend((query, None if none else i, d) for d, none, i in best)
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table(
            {
                "code": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "distance": pa.array([int(d) for d in columns[2]], pa.int32()),
            }
        )

    return run


def search(base: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest rows of ``base`` for each query row.

    Both have (vec_id, embedding).
    """
    spark = base.sparkSession
    rows = codes(base)
    smallest = Window.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last())
    entries = cut_lineage(
        rows.withColumn("nth", F.row_number().over(smallest))
        .where(F.col("nth") <= k)
        .groupBy("code")
        .agg(F.collect_list(F.struct("nth", "vec_id")).alias("ids"))
        .select("code", F.transform(F.sort_array("ids"), lambda x: x["vec_id"]).alias("ids"))
    )
    asked = cut_lineage(codes(queries).where("vec_id is not null"))
    distinct = asked.select("code").distinct()
    blocks = max(-(-entries.count() // ENTRIES), spark.sparkContext.defaultParallelism)
    lots = max(1, -(-distinct.count() // QUERIES))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int):
        return F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")

    left = entries.withColumn("block", own(blocks)).withColumn("lot", every(lots))
    right = distinct.withColumn("lot", own(lots)).withColumn("block", every(blocks))
    met = (
        left.groupBy("block", "lot")
        .cogroup(right.groupBy("block", "lot"))
        .applyInArrow(_searching(k), "code bigint, vec_id bigint, distance int")
    )
    order = Window.partitionBy("code").orderBy("distance", F.col("vec_id").asc_nulls_last())
    best = cut_lineage(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return asked.withColumnRenamed("vec_id", "query_id").join(best, "code").select(
        "query_id", "vec_id", "distance", "rank"
    )
