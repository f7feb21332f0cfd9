"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same number of copies, target words over
source words. The whole part is taken; the fractions are rounded so that the
words taken add up: two fractions are paired, mass moves between them at random
until one is 0 or 1, and the words that one gains are those that the other loses. Blocks of a
source are rounded apart and each leaves one fraction at most; those meet in a
tree of blocks until one per source is left, which is rounded by its chance.

Defined results: null text has no words; a source that is null is a source,
the last one; draws depend on doc_id, size and block only, so reruns agree;
rows that repeat are rounded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.common import MASK, WORD, text_or_empty
from routewright.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
# Rows that one block rounds, and blocks whose remainders meet.
BLOCK = 1024
# Times the middle size of a block from which a document is settled against several.
LARGER = 8

_EPS = 1e-9
_STATE = (
    "source string, doc_id bigint, size bigint, tie bigint, source_size bigint, target double, "
    "copies double, block bigint, frac double"
)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): words of each document."""
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words.alias("size"),
        F.xxhash64("doc_id", words).alias("tie"),
    )


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """(source, rows, source_size, target): one row per source.

    Targets share all words by weight and stop at ``most`` times the source's
    words. Sources reach that stop in the order of stop over weight, so running
    sums over this order tell which do and what share is left for the rest.
    The two windows see one row per source, however many documents it has.
    """
    totals = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)
    stop = F.col("source_size") * F.lit(float(most))
    every = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    return (
        totals.withColumns({"place": place, "weight": weight, "stop": stop})
        .withColumn("reach", F.col("stop") / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(every), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(every), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        # The first source that does not stop has the level of all later ones.
        .withColumn("free", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(whole))
        .withColumn(
            "target",
            F.when(F.col("free").isNull(), F.col("stop")).otherwise(
                F.least("stop", F.col("weight") * F.col("free.level"))
            ),
        )
        .select("source", "rows", "source_size", "target")
    )


def _between(x: float) -> bool:
    return _EPS < x < 1 - _EPS


def _whole_if_near(x: float) -> float:
    return x if _between(x) else float(round(x))


def _settle_large(frac: list[float], size: list[float], draws: np.ndarray, larger: float) -> None:
    """Make documents above ``larger`` words whole, each against several smaller ones.

    A document that dwarfs its partners would stay the last fraction and miss
    the target by its own size. Its direction is drawn once, and every partner
    gives or takes mass in the proportion that keeps both chances.
    """
    for a in range(len(frac)):
        p, need = frac[a], size[a]
        if need <= larger:
            return
        if not _between(p):
            continue
        up = draws[a] < p
        for b in range(a + 1, len(frac)):
            q = frac[b]
            if not _between(q):
                continue
            moved = min(q * size[b] / (1 - p), (1 - q) * size[b] / p, need)
            frac[b] = _whole_if_near(q + moved * (p - 1 if up else p) / size[b])
            need -= moved
            if need <= _EPS * size[a]:
                break
        frac[a] = _whole_if_near(p + (1 - need / size[a]) * (1 - p if up else -p))


def _settle_pairs(frac: list[float], size: list[float], draws: np.ndarray) -> int:
    """Pair fractions until one at most is left; its place, or -1.

    Neighbours have like sizes, so the one that is left belongs to a small document.
    """
    held = -1
    for i in range(len(frac)):
        if not _between(frac[i]):
            continue
        if held < 0:
            held = i
            continue
        # Words that can move to the held one, and from it, before one is whole.
        up = min((1 - frac[held]) * size[held], frac[i] * size[i])
        down = min(frac[held] * size[held], (1 - frac[i]) * size[i])
        moved = up if draws[i] * (up + down) < down else -down
        frac[held] = _whole_if_near(frac[held] + moved / size[held])
        frac[i] = _whole_if_near(frac[i] - moved / size[i])
        held = next((j for j in (held, i) if _between(frac[j])), -1)
    return held


def _round_block(rows: pa.Table, last: bool) -> pa.Table:
    """Round a block's fractions but one, largest documents first; ``last`` rounds that too."""
    size, tie = rows["size"].to_numpy(), rows["tie"].to_numpy()
    order = np.lexsort((tie, -size))
    own = size[order].astype(float).tolist()
    frac = [_whole_if_near(f) if s else 0.0 for f, s in zip(rows["frac"].to_numpy()[order], own)]
    seed = [int(tie.min()) & MASK, len(own), int(rows["block"][0].as_py())]
    draws = np.random.default_rng(seed).random((2, len(own) + 1))
    _settle_large(frac, own, draws[0], LARGER * own[len(own) // 2])
    held = _settle_pairs(frac, own, draws[1])
    if last and held >= 0:
        frac[held] = float(draws[0][-1] < frac[held])
    out = np.empty(len(own))
    out[order] = frac
    return rows.set_column(rows.schema.get_field_index("frac"), "frac", pa.array(out))


def _rounding(last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _round_block(rows, last)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): one row per document."""
    sized = cut_lineage(sizes(docs))
    targets = cut_lineage(source_targets(sized, weights, most))
    blocks = F.ceil(F.col("rows") / BLOCK)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .select(
            sized["source"], "doc_id", "size", "tie", "source_size", "target",
            F.floor(share + _EPS).cast("double").alias("copies"),
            F.pmod(F.xxhash64("tie"), blocks).alias("block"),
            F.greatest(F.lit(0.0), share - F.floor(share + _EPS)).alias("frac"),
        )
    )
    n_blocks = targets.agg(F.max(blocks)).first()[0] or 1
    done: DataFrame | None = None
    while True:
        last = n_blocks == 1
        rounded = cut_lineage(
            state.groupBy("source", "block").applyInArrow(_rounding(last), _STATE)
        )
        whole = rounded.where("frac <= 0 or frac >= 1")
        done = whole if done is None else done.union(whole)
        if last:
            break
        state = rounded.where("frac > 0 and frac < 1").withColumn(
            "block", F.floor(F.col("block") / BLOCK)
        )
        n_blocks = -(-n_blocks // BLOCK)
    return done.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("copies") + F.col("frac")).cast("bigint").alias("copies"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns.

    Rows with equal doc_id, source and size are numbered on both sides, so each
    gets the copies of one of them.
    """
    key = ["doc_id", "source", "size"]
    nth = F.row_number().over(Window.partitionBy(*[f"_k.{k}" for k in key]).orderBy("_o"))
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.struct(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            words.alias("size"),
        ).alias("_k"),
        F.xxhash64("text").alias("_o"),
    ).withColumn("_n", nth)
    taken = mix_sources(docs, **options).select(
        F.struct(*key).alias("_k"), F.col("copies").alias("_o"), F.col("copies").alias("_c")
    ).withColumn("_n", nth)
    same = [rows["_n"] == taken["_n"]] + [rows[f"_k.{k}"].eqNullSafe(taken[f"_k.{k}"]) for k in key]
    both = rows.join(taken, same)
    return both.where("_c > 0").select(
        "_row", F.explode(F.array_repeat(F.lit(0), F.col("_c").cast("int"))).alias("_again")
    ).select("_row.*")
