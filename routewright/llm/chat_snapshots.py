"""Chat formatting with cumulative-snapshot collapse.

A chat is often logged again after every turn, so that a log holds the whole
conversation and many beginnings of it. The rolling hash of a conversation up
to each turn names that beginning; a conversation whose own hash is among the
beginnings of longer ones is dropped by an anti-join, and the others, the
maximal ones, are rendered. Of equal conversations the one with the smallest
id is rendered.

A conversation's turns are numbered and hashed in runs, and the runs' totals
are carried on, so that no task needs a whole conversation. A rendered
conversation continues in further parts after PART turns.

Defined results: turns are in the order of their number, null first, and of
their role and text where numbers tie; rows that repeat count once; null role
and text are empty; rows without a conv_id belong to no conversation and are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.session import cut_lineage

# Turns of a run, and of a rendered part.
RUN, PART = 1024, 1024
# What stands around a turn.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): distinct turns, numbered from 1 in each conversation."""
    rows = (
        conversations.where("conv_id is not null")
        .select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .distinct()
        .withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))))
    )
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    numbered = rows.withColumn("nth", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = _carried(sizes, "run", F.sum("n"))
    return numbered.join(before, ["conv_id", "run"]).select(
        "conv_id", (F.col("before") + F.col("nth")).alias("pos"), "role", "text"
    )


def _carried(totals: DataFrame, run: str, total: Column) -> DataFrame:
    """(conv_id, run, before): what the runs before have together, 0 for the first."""
    earlier = Window.partitionBy("conv_id").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv_id", run, F.coalesce(total.over(earlier), F.lit(0)).alias("before"))


def prefixes(numbered: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2): a 128-bit hash of each conversation up to each turn.

    It is the xor of the hashes of all turns with their numbers.
    """
    hashed = numbered.select(
        "conv_id",
        "pos",
        F.floor((F.col("pos") - 1) / RUN).alias("run"),
        F.xxhash64(F.lit(1), "pos", "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "text", "role", "pos").alias("h2"),
    )
    inside = (
        Window.partitionBy("conv_id", "run")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rolling = hashed.withColumns({h: F.bit_xor(h).over(inside) for h in ("h1", "h2")})
    totals = hashed.groupBy("conv_id", "run").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    first = _carried(totals, "run", F.bit_xor("h1")).withColumnRenamed("before", "b1")
    second = _carried(totals, "run", F.bit_xor("h2")).withColumnRenamed("before", "b2")
    before = first.join(second, ["conv_id", "run"])
    return rolling.join(before, ["conv_id", "run"]).select(
        "conv_id",
        "pos",
        F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"),
    )


def maximal(numbered: DataFrame) -> DataFrame:
    """(conv_id, n_turns): conversations that no longer one begins with.

    Ends and beginnings are made distinct first, so that neither a common first
    turn nor a conversation that is logged very often is a hot key.
    """
    ends = numbered.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    rolled = cut_lineage(prefixes(numbered).join(ends, "conv_id"))
    whole = (
        rolled.where("pos = n_turns")
        .groupBy("pos", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"))
    )
    begun = rolled.where("pos < n_turns").select("pos", "h1", "h2").distinct()
    return whole.join(begun, ["pos", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("pos").alias("n_turns")
    )


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations as chat text."""
    numbered = cut_lineage(turns(conversations))
    kept = cut_lineage(maximal(numbered))
    turn = F.concat(F.lit(OPEN), "role", F.lit(BREAK), "text", F.lit(CLOSE)).alias("turn")
    part = F.floor((F.col("pos") - 1) / PART).alias("part")
    texts = F.sort_array(F.collect_list(F.struct("pos", "turn")))
    return (
        numbered.join(kept, "conv_id")
        .select("conv_id", "n_turns", part, "pos", turn)
        .groupBy("conv_id", "part", "n_turns")
        .agg(F.array_join(F.transform(texts, lambda x: x["turn"]), "").alias("text"))
    )
