"""Parsing of model completions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routewright.functions.text import lines, strip

# The form of a schema item line and of a database choice.
_ITEM = r"(?U)^(\w+)\(([\w\s,]+)\)"
_CHOICE = r"\[(\d+)\]"


def parse_segments(text: Column) -> Column:
    """``n:table(c1, c2)`` lines to ``table.c1``, ``table.c2``.

    One malformed line makes the whole completion a single segment, its text.
    """
    rows = lines(text)
    items = F.transform(
        rows,
        lambda row: F.translate(strip(F.coalesce(F.get(F.split(row, ":"), F.lit(1)), F.lit(""))), "/-", "  "),
    )
    malformed = F.exists(items, lambda i: ~i.rlike(_ITEM))
    parsed = F.flatten(
        F.transform(
            items,
            lambda i: F.transform(
                F.split(F.regexp_extract(i, _ITEM, 2), ", "),
                lambda c: F.concat(
                    F.regexp_extract(i, _ITEM, 1), F.lit("."), F.replace(c, F.lit(" "), F.lit("_"))
                ),
            ),
        )
    )
    return F.when(malformed, F.array(text)).otherwise(parsed)


def segments_or_question(text: Column, question: Column) -> Column:
    """Distinct segments; an empty completion leaves the question alone."""
    parsed = F.array_distinct(parse_segments(text))
    return F.when(F.size(parsed) > 0, parsed).otherwise(F.array(question))


def assemble_sql(text: Column) -> Column:
    """Response lines trimmed and joined behind ``SELECT``."""
    joined = F.array_join(F.transform(F.split(text, "\n"), strip), " ")
    return F.concat(F.lit("SELECT "), joined)


def pick_database(reply: Column, n_schemas: Column) -> Column:
    """Index in the first ``[n]``, kept inside the list; 0 when there is none.

    Digits beyond the integer range mean the last schema; an empty list has index 0.
    """
    digits = F.regexp_extract(reply, _CHOICE, 1)
    index = F.coalesce(digits.try_cast("int"), F.when(digits != "", F.lit(2147483647)), F.lit(0))
    return F.greatest(F.least(index, n_schemas - 1), F.lit(0))


def picked_schema(schemas: Column, reply: Column) -> Column:
    """The list with only the chosen schema; an empty list stays empty."""
    return F.slice(schemas, pick_database(reply, F.size(schemas)) + 1, F.lit(1))


def strip_special_tokens(text: Column, special: list[str]) -> Column:
    """Remove begin, padding and end marks, then trim."""
    for mark in special:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return strip(text)
