"""Tokens, names and trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundaries of the tokeniser and of identifiers.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
CAMEL_EDGE = r"([\p{Ll}\p{N}])(\p{Lu})"
NAME_BREAK = r"[_\-./\s]+"
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"


def tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs, in text order."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def normalise_name(name: Column) -> Column:
    """``orderLine_id`` becomes ``order line id``."""
    spaced = F.regexp_replace(name, CAMEL_EDGE, "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, NAME_BREAK, " ")))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Non-empty lines."""
    return F.filter(F.split(text, LINE_BREAK), lambda s: s != "")
