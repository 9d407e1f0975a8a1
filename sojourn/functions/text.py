"""String expressions: slugs, image keys, booking numbers, search tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prefix of every booking number.
NUMBER_PREFIX = "CT-"


def slugify(column: str) -> Column:
    """Lower case, letters, digits and single hyphens only."""
    kept = F.regexp_replace(F.lower(F.col(column)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")


def image_key(column: str, host: str) -> Column:
    """Last three path pieces without extension for URLs of the image host, else null."""
    pieces = F.split(F.col(column), "/")
    name = F.element_at(F.split(F.element_at(pieces, -1), r"\."), 1)
    key = F.concat_ws("/", F.try_element_at(pieces, F.lit(-3)), F.try_element_at(pieces, F.lit(-2)), name)
    return F.when(F.col(column).contains(host), key)


def contains_any(text: str, *columns: str) -> Column:
    """Case-blind substring test over several columns; % and _ stay wildcards."""
    tests = [F.col(c).ilike(f"%{text}%") for c in columns]
    return reduce(lambda a, b: a | b, tests)


def number_stem(day: Column) -> Column:
    """Booking number up to and including the second hyphen."""
    return F.concat(F.lit(NUMBER_PREFIX), F.date_format(day, "yyMMdd"), F.lit("-"))


def number_sequence(column: str) -> Column:
    """Running part of a booking number; null when it is not a five-digit number."""
    tail = F.substring(F.col(column), len(NUMBER_PREFIX) + 8, 100)
    return F.when(tail.rlike("^[0-9]{5,}$"), tail.try_cast("long"))


def random_number(day: Column, *seeds: Column) -> Column:
    """Booking number with a six-digit hexadecimal tail derived from the seeds."""
    digest = F.sha2(F.concat_ws("|", *[s.cast("string") for s in seeds]), 256)
    return F.concat(number_stem(day), F.upper(F.substring(digest, 1, 6)))


def as_list(column: str) -> Column:
    """A form field that is a JSON list or a bare value, as a list."""
    text = F.trim(F.col(column))
    parsed = F.from_json(text, "array<string>")
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(text.startswith("["), parsed)
        .otherwise(F.array(text))
    )
