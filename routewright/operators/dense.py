"""Dense retrieval: pooling of token vectors and exact cosine top-k with pruning.

Vectors are dealt to the cells of a bounded number of centres, and a cell keeps
the largest distance of a member from its centre. For unit vectors the triangle
inequality then bounds every cosine of a query with a cell. A query reads its
cells by falling bound, a few in the first round and more in each later one, and
stops where the bound falls below the k-th score it has; cells that no query
needs are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.session import cut_lineage, scratch_path

# Query vectors of a block, documents of a slice, and query vectors of a matrix product.
BLOCK = 4096
SLICE = 20_000
TILE = 64
# Vectors that meet all centres at once.
MEET = 256
# Documents of a cell on average, the most cells, and vectors drawn per cell to place the centres.
CELL_DOCS, MOST_CELLS, DRAWN, ROUNDS = 256, 4096, 8, 3
# Cells that a query reads in the first round, and how many times as many in each later one.
FIRST_CELLS, GROWTH = 4, 8
# Scores are rounded to six digits; a bound must miss the k-th score by more than that.
SLACK = 2e-6


def masked_mean_pool(tokens: DataFrame) -> DataFrame:
    """(text_id, vec): mean of the unmasked token vectors.

    tokens(text_id, pos, vec, mask). The mean is taken per dimension with partial
    sums, so a text of any length is reduced where its tokens are.
    """
    flat = tokens.where("mask = 1").select("text_id", F.posexplode("vec").alias("dim", "x"))
    means = flat.groupBy("text_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("text_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("vec")
    )


def cls_pool(tokens: DataFrame) -> DataFrame:
    """(text_id, vec): the first token's vector."""
    return tokens.groupBy("text_id").agg(F.min_by("vec", "pos").alias("vec"))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0.0, 1.0, norm)


def _best(
    qids: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int
) -> pd.DataFrame:
    """The k best (score, id) of each query among one slice, TILE queries at a time.

    Only documents that reach the k-th best score are sorted.
    """
    take = min(k, len(ids))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(qids), TILE):
        scores = np.round(q[a : a + TILE] @ d.T, 6)
        least = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
        for qid, row, low in zip(qids[a : a + TILE], scores, least, strict=True):
            near = np.flatnonzero(row >= low)
            near = near[np.lexsort((ids[near], -row[near]))[:take]]
            found.append((np.full(take, qid), ids[near], row[near]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pd.DataFrame(dict(zip(("qid", "doc_id", "score"), columns, strict=True)))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each unit vector, MEET vectors at a time."""
    parts = [(rows[a : a + MEET] @ centres.T).argmax(axis=1) for a in range(0, len(rows), MEET)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def place_centres(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit centres of n cells, by a few rounds of means over a bounded sample."""
    drawn = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n * DRAWN).select("vec").toPandas()
    if drawn.empty:
        return np.zeros((0, 1))
    rows = _unit(drawn["vec"])
    centres = rows[:n]
    for _ in range(ROUNDS):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), centres)
    return centres


def deal_to_cells(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, vec, cell, apart): nearest centre of each vector, and its distance."""
    shipped = docs.sparkSession.sparkContext.broadcast(centres)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                rows, near = _unit(part["vec"]), shipped.value
                cell = nearest(rows, near)
                apart = np.sqrt(((rows - near[cell]) ** 2).sum(axis=1))
                yield part.assign(cell=cell, apart=apart)

    kind = docs.schema["vec"].dataType.simpleString()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "vec").mapInPandas(
        run, f"doc_id bigint, vec {kind}, cell int, apart double"
    )


def cell_bounds(units: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Highest cosine that each unit vector can have with a member of each cell."""
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (units @ centres.T)) + 1e-12)
    gap = np.maximum(0.0, apart - radius[None, :] - 1e-6)
    # A zero vector has no direction: its cosines are 0.
    return np.where((units != 0).any(axis=1)[:, None], 1 - gap**2 / 2, 1.0)


class CellIndex:
    """Vectors by cell, in one folder each, and the centres and radii of the cells."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        n = min(MOST_CELLS, max(1, math.ceil(docs.count() / CELL_DOCS)))
        self.centres = place_centres(docs, n)
        self._path, self._spark = scratch_path(spark, "cells"), spark
        dealt = cut_lineage(deal_to_cells(docs, self.centres))
        rows = dealt.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n"))
        self.cells = {r.cell: r for r in rows.collect()}
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-self.largest() // SLICE)))).cast("int")
        self._kind = dealt.select("doc_id", "vec", salt.alias("salt"), "cell").schema
        dealt.select("doc_id", "vec", salt.alias("salt"), "cell").repartition("cell", "salt").write.partitionBy(
            "cell"
        ).parquet(self._path)
        self.radius = np.full(len(self.centres), -1.0)
        for cell, r in self.cells.items():
            self.radius[cell] = r.radius

    def largest(self) -> int:
        return max((r.n for r in self.cells.values()), default=0)

    def read(self, cells: list[int]) -> DataFrame:
        """Members of the cells; other folders are not opened."""
        rows = self._spark.read.schema(self._kind).parquet(self._path)
        return rows.where(F.col("cell").isin(cells))

    def next_cells(self, state: DataFrame, most: int) -> DataFrame:
        """(qid, vec, cell): the next cells of state(qid, vec, seen, floor) by bound, if they reach it."""
        shipped = state.sparkSession.sparkContext.broadcast((self.centres, self.radius))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, radius = shipped.value
            held = np.flatnonzero(radius >= 0)
            for part in parts:
                if not len(part) or not len(held):
                    continue
                for a in range(0, len(part), MEET):
                    few = part.iloc[a : a + MEET]
                    bounds = cell_bounds(_unit(few["vec"]), centres[held], radius[held])
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    rows, cells = [], []
                    for i, (seen, floor) in enumerate(zip(few["seen"], few["floor"], strict=True)):
                        own = order[i, seen : seen + most]
                        own = own[bounds[i, own] >= floor - SLACK]
                        rows += [i] * len(own)
                        cells += held[own].tolist()
                    picked = few[["qid", "vec"]].iloc[rows]
                    yield picked.assign(cell=np.array(cells, dtype=np.int32))

        kind = state.schema["vec"].dataType.simpleString()
        return state.select("qid", "vec", "seen", "floor").mapInPandas(
            run, f"qid bigint, vec {kind}, cell int"
        )


def _pair(k: int):
    def pair(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"qid": [], "doc_id": [], "score": []})
        qids, ids = q["qid"].to_numpy(dtype=np.int64), d["doc_id"].to_numpy(dtype=np.int64)
        return _best(qids, _unit(q["vec"]), ids, _unit(d["vec"]), k)

    return pair


def _search_block(index: CellIndex, asked: DataFrame, k: int) -> tuple[DataFrame | None, int]:
    """The k best (qid, doc_id, score) of a block of queries, and the (query, cell) pairs looked at."""
    spark = asked.sparkSession
    n = spark.sparkContext.defaultParallelism
    n_salts = max(1, -(-index.largest() // SLICE))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    best: DataFrame | None = None
    seen, most, looked = 0, FIRST_CELLS, 0
    while seen < len(index.cells):
        state = asked.withColumns({"seen": F.lit(seen), "floor": F.lit(-2.0)})
        if best is not None:
            floors = best.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
            state = asked.join(floors, "qid", "left").withColumns(
                {"seen": F.lit(seen), "floor": F.coalesce("least", F.lit(-2.0))}
            )
        pairs = cut_lineage(index.next_cells(state, most))
        cells = [r.cell for r in pairs.groupBy("cell").count().collect()]
        if not cells:
            break
        looked += pairs.count()
        # A number, so that adaptive execution leaves the partitions of costly products apart.
        left = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
        found = (
            left.repartition(n, "cell", "salt")
            .groupBy("cell", "salt")
            .cogroup(index.read(cells).repartition(n, "cell", "salt").groupBy("cell", "salt"))
            .applyInPandas(_pair(k), "qid bigint, doc_id bigint, score double")
        )
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = cut_lineage(
            found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        )
        seen, most = seen + most, most * GROWTH
    return best, looked


def dense_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """run(qid, doc_id, score, rank): exact cosine top-k of docs(doc_id, vec) per queries(qid, vec).

    Queries go in blocks, one after another, so vectors are not copied per block;
    what is collected are centres, cells and their counts, at most MOST_CELLS.
    """
    asked = cut_lineage(queries.select(F.col("qid").cast("bigint").alias("qid"), "vec"))
    index = CellIndex(docs)
    n_blocks = max(1, -(-asked.count() // BLOCK))
    run = docs.sparkSession.createDataFrame([], "qid bigint, doc_id bigint, score double, rank int")
    for b in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b)
        best, _ = _search_block(index, own, k)
        if best is not None:
            run = run.unionByName(best)
    return run
