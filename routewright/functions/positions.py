"""Numbering rows without putting a whole group into one task, and naming values in a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group is cut by the first two hex digits of a hash: 256 slices, each
# sorted by its own task; only the slice sizes are summed per group.
_SLICE_CHARS = 2


def number_rows(df: DataFrame, group: list[str], item: str, out: str, kind: str | None = None) -> DataFrame:
    """Number the distinct ``item`` values of each group from 0.

    Order is (md5 prefix, item): arbitrary but fixed. ``df`` must hold one row
    per (group, item). An empty ``group`` numbers the whole table. With ``kind``
    items of one kind stand side by side, kinds in order: [lo, lo + n) are their numbers.
    """
    own = [*group, kind] if kind else group
    sliced = df.withColumn(
        "_slice", F.substring(F.md5(F.col(item).cast("string")), 1, _SLICE_CHARS)
    )
    sizes = sliced.groupBy(*own, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*own[len(group) :], "_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if kind:
        alike = Window.partitionBy(*own)
        offsets = offsets.withColumns({"lo": F.min("_base").over(alike), "n": F.sum("_n").over(alike)})
    in_slice = Window.partitionBy(*own, "_slice").orderBy(item)
    return (
        sliced.withColumn("_rn", F.row_number().over(in_slice))
        .join(offsets.drop("_n"), [*own, "_slice"])
        .withColumn(out, (F.col("_base") + F.col("_rn") - 1).cast("bigint"))
        .drop("_slice", "_rn", "_base")
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often a lambda asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
