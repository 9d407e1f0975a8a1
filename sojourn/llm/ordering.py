"""Positions in a sorted table, however many rows a key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.scratch import written

_ROW_BITS = 33


def marked(df: DataFrame, names: list[str]) -> DataFrame:
    """These columns under names of their own, for a join with another table that has them."""
    return df.withColumnsRenamed({c: f"{c}__" for c in names})


def same(names: list[str]) -> Column:
    """Equality with the ``marked`` columns, in which nulls equal each other."""
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in names])


def placed(df: DataFrame, keys: list[str], order: list[str], name: str, total: str) -> DataFrame:
    """Adds the position (from 0) of each row within its key, in ascending order with nulls first, and the key's row count.

    One range sort over the keys and the order deals the rows out, so the rows of a hot key lie in many tasks. Each task numbers its
    rows; only one count per key and task is shuffled to find where each begins. The sorted rows are written, so that the
    counts and the rows tell of the same ranges. Rows that tie in keys and order get their places in any order.
    """
    columns = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    held = written(dealt.select("*", F.spark_partition_id().alias("_task"), row.alias("_row")), "sorted")
    counts = held.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    window = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_task", *keys, (before - F.col("_first")).alias("_start"), F.sum("_rows").over(window).alias(total))
    found = held.join(marked(starts, ["_task", *keys]), same(["_task", *keys]))
    return found.select(*df.columns, (F.col("_row") + F.col("_start")).alias(name), total)
