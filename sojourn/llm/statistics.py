"""Statistics of a text as Spark columns. A null text counts as an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What parts words, and which signs count as symbols.
WORD_GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(filled(text), WORD_GAPS, -1), "")


def lines_with_words(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(filled(text), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def left_of(text: Column, without: str) -> Column:
    """Characters that stay when all matches of a pattern go."""
    return F.length(F.regexp_replace(filled(text), without, "")).cast("long")


def word_chars(text: Column) -> Column:
    return left_of(text, WORD_GAPS)


def symbols(text: Column) -> Column:
    return left_of(text, SYMBOLS)
