"""Rounding that does not depend on the order of a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
_NUDGE = 1e-9


def rounded(x: Column, digits: int = DIGITS) -> Column:
    """Round with exact halves going up.

    Means of rounded scores often lie exactly half-way, where the last bit of a
    floating-point sum would decide; the nudge is far below the distance of any
    other such mean from the half.
    """
    return F.round(x + F.lit(_NUDGE), digits)
