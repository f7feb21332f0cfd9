"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary names the few digests that may be frequent. Their counts
and winners are verified, and a broadcast of at most ``HEAVY`` rows decides all
their copies where they are read. Only the remaining digests are shuffled, and
their groups are small: a digest that the summary misses has less than about
1 / TRACKED of the rows.

Defined results: null text is empty text; the largest doc_id of a group stays
and null is smaller than any; of rows that share that doc_id one stays; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.common import text_or_empty
from routewright.session import cut_lineage

# Digests a summary tracks, digests decided by broadcast, summaries merged first.
TRACKED = 1024
HEAVY = 256
FAN_IN = 64


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest): one narrow row per document, written once."""
    return cut_lineage(
        docs.select(F.col(doc_id).alias("doc_id"), F.sha2(text_or_empty(text), 256).alias("digest"))
    )


def frequent(ids: DataFrame) -> DataFrame:
    """(digest): at most HEAVY digests by merged Misra-Gries summaries.

    Tasks summarise their rows in bounded memory; summaries are merged by group
    and then in one small step, so no task reads more than its share of them.
    """
    partial = ids.groupBy((F.spark_partition_id() % FAN_IN).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {TRACKED})").alias("summary")
    )
    # One group, and not none: a task without rows then makes no empty summary.
    merged = partial.groupBy((F.col("part") * 0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(summary, {TRACKED})").alias("summary")
    )
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {HEAVY})")).alias("t"))
    return top.select(F.col("t.item").alias("digest"))


def winners(ids: DataFrame) -> DataFrame:
    """(digest, keep_id, n, n_last): exact figures of the frequent digests.

    ``n_last`` counts the rows that hold keep_id. Digests that occur once are
    left to the ordinary way.
    """
    verified = (
        ids.join(F.broadcast(frequent(ids)), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    verified = cut_lineage(verified)
    last = (
        ids.join(F.broadcast(verified), "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n_last"))
    )
    return cut_lineage(verified.join(last, "digest"))


def decide(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """(row, doc_id, digest, keep_id, group_size, kept) of (row, doc_id, digest).

    ``row`` is carried along untouched. Copies of a frequent digest are decided
    in place; only rows tied for the last doc_id of one go the ordinary way.
    """
    met = rows.join(F.broadcast(heavy), "digest", "left")
    is_last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    in_place = F.col("n").isNotNull() & (~is_last | (F.col("n_last") == 1))
    placed = met.where(in_place).select(
        "row", "doc_id", "digest", "keep_id", F.col("n").alias("group_size"), is_last.alias("kept")
    )
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("doc_id").desc_nulls_last())
    dealt = met.where(~in_place).select(
        "row",
        "doc_id",
        "digest",
        F.coalesce("keep_id", F.max("doc_id").over(group)).alias("keep_id"),
        F.coalesce("n", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
    )
    return placed.union(dealt)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = digests(docs, doc_id, text)
    narrow = ids.select(F.lit(None).cast("int").alias("row"), "doc_id", "digest")
    return decide(narrow, winners(ids)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    heavy = winners(digests(docs, doc_id, text))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.sha2(text_or_empty(text), 256).alias("digest"),
    )
    return decide(rows, heavy).where("kept").select("row.*")
