"""Words, lines and let-bindings as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and deep the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.size(words(text)).cast("long")
