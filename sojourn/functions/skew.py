"""Joins whose left side may have a very frequent key.

The adaptive skew join splits a hot key only when both sides come straight from a shuffle. It cannot when the
other side was aggregated or ranked on the key just before. ``join_hot`` is for those joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split into shares of about this size.
HOT_ROWS = 1_000_000
# The broadcast list names the keys with the most rows, this many at most. A key beyond it has less than one row in
# HOT_KEYS of the whole table, which one task can take.
HOT_KEYS = 10_000
# Rows with a null key match nothing; they only need to be spread.
NULL_SHARES = 1024


def join_hot(
    rows: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join rows (left) to a frame with few rows per key.

    The rows of a hot key are spread over shares, as many as its count asks for, and what the other side has
    for it is repeated once per share; every other key has one share. ``how`` is inner, left, left_semi
    or left_anti. Keys are compared by equality. The counts are taken on ``counted`` when the rows are
    costly to compute twice: a plain table that has at least as many rows of each key.
    """
    keys = list(keys)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    counts = (rows if counted is None else counted).dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    shares = F.ceil(F.col("_n") / F.lit(limit)).alias("_shares")
    hottest = counts.filter(F.col("_n") > limit).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS)
    hot = F.broadcast(hottest.select(*keys, shares))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    width = F.when(no_key, F.lit(NULL_SHARES)).otherwise(F.coalesce("_shares", F.lit(1)))
    # A hash of the row itself: a task that runs again spreads its rows the same way.
    share = F.pmod(F.xxhash64(*rows.columns), width)
    left = rows.join(hot, keys, "left").withColumn("_share", share)
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)) - 1)
    right = other.join(hot, keys, "left").withColumn("_share", F.explode(every))
    return left.drop("_shares").join(right.drop("_shares"), [*keys, "_share"], how).drop("_share")
