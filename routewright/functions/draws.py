"""Seeded draws that depend on the row's key only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def unit_draw(*parts: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the key's md5.

    A string part names a column, as everywhere in Spark.
    """
    key = F.concat_ws("|", *parts)
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return bits / F.lit(_TWO_32)


def draw_below(n: Column, *parts: Column | str) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(unit_draw(*parts) * n).cast("bigint")


def shuffle_key(*parts: Column | str) -> Column:
    """Sort key that puts rows in a seeded random order."""
    return F.md5(F.concat_ws("|", *parts))
