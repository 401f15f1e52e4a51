"""Word and line expressions that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a regular expression, one or more.
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row.

    The optimizer may put an expression in place of its name, also inside a lambda, where it
    would run for every element; a lambda's own variable is never replaced.
    """
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN, -1), "")


def lines(text: Column) -> Column:
    """The ``\\n``-split lines; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def dropped_chars(text: Column, chars: str) -> Column:
    """The text without any of ``chars``."""
    return F.translate(text, chars, "")
