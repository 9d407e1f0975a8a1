"""Running numbers and exact medians that never put one hot key into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.shared import written
from sojourn.functions.skew import join_hot

# Rows that follow each other in a sorted task and are handled as one run.
RUN_ROWS = 100_000
_ROW_BITS = 33


def dealt_by_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows sorted by the columns (ascending, nulls first) over all tasks, with the number of their task (``_task``) and their place in it
    (``_row``). Tasks follow each other in the order, so the rows of a hot key lie in many. The result is written once: whoever reads
    it, also twice, reads the same ranges."""
    order = [F.col(c).asc_nulls_first() for c in columns]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("*", F.spark_partition_id().alias("_task"), row.alias("_row")), "by-range")


def running_number(df: DataFrame, keys: list[str], order: str | list[str], name: str) -> DataFrame:
    """``row_number`` per key (of the whole table without keys) in order of one or more columns of any type that are unique within a key.

    One range sort numbers the rows of each task; where a key begins in a task comes from one count per key and task.
    """
    held = dealt_by_range(df, [*keys, *([order] if isinstance(order, str) else order)])
    counts = held.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # A key (or the whole table) has one row for each task here.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = counts.select(F.col("_task").alias("_of"), *[F.col(k).alias(f"_{k}") for k in keys], start.alias("_start"))
    same = F.col("_task") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return held.join(starts, same).select(*df.columns, (F.col("_row") + F.col("_start") + 1).alias(name))


# Leading bits of a value that name its bin.
BITS = 18


def exact_median(
    df: DataFrame, keys: list[str], value: str, name: str, few_keys: bool = False, bits: int = BITS
) -> DataFrame:
    """Median per key (mean of the two middle values when the count is even).

    The value must be decimal with two places, not null. Equal values are counted first. Then values that share
    their leading bits are counted together, the bin that holds each middle rank is found, and
    only the distinct values of that bin are ranked. A key has at most 2^(bits-1) bins per power of two
    that its values span, and a bin around v cents at most v / 2^(bits-1) distinct values, so no
    step sorts or collects a whole group. ``few_keys`` says that the number of keys is fixed by the
    query, so that the bins found (at most two per key) may be broadcast.
    """
    counts = df.groupBy(*keys, (F.col(value) * 100).cast("long").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    size = F.abs("_v")
    span = F.expr(f"shiftleft(1L, greatest(0, length(bin(abs(_v))) - {bits}))")
    floor = size - size % F.col("_span")
    low = F.when(F.col("_v") >= 0, floor).otherwise(1 - floor - F.col("_span"))
    bins = (
        counts.withColumn("_span", span)
        .groupBy(*keys, low.alias("_low"), "_span")
        .agg(F.sum("_n").alias("_in"))
    )
    everything = Window.partitionBy(*keys)
    seen = F.sum("_in").over(everything.orderBy("_low"))
    placed = bins.withColumn("_total", F.sum("_in").over(everything)).withColumn("_before", seen - F.col("_in"))
    # The two middle ranks are equal when the count is odd.
    ranks = F.array(
        F.struct(F.lit(0).alias("side"), F.floor((F.col("_total") + 1) / 2).alias("rank")),
        F.struct(F.lit(1).alias("side"), (F.floor(F.col("_total") / 2) + 1).alias("rank")),
    )
    inside = F.col("_rank") - F.col("_before")
    found = (
        placed.select(*keys, "_low", "_span", "_in", "_before", F.inline(ranks).alias("_side", "_rank"))
        .filter((inside >= 1) & (inside <= F.col("_in")))
        .select(*keys, "_side", "_low", "_span", inside.alias("_rank"))
    )
    joined = counts.join(F.broadcast(found), keys) if few_keys else join_hot(counts, found, keys)
    past_low = F.col("_v") - F.col("_low")
    hits = joined.filter((past_low >= 0) & (past_low < F.col("_span")))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_side").orderBy("_v"))
    reached = hits.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rank"))
    middle = reached.groupBy(*keys, "_side").agg(F.min("_v").alias("_v"))
    return middle.groupBy(*keys).agg((F.avg("_v") / 100).alias(name))


# Largest k for which the optimizer limits each group before the shuffle by itself.
GROUP_LIMIT = 1000
# Rows of a key that are ranked in one share when k is larger, and the keys that are split, those with the most rows: any other
# has less than one row in ``SPLIT_KEYS`` of the table.
SHARE_ROWS = 1_000_000
SPLIT_KEYS = 10_000


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key. The order must be unique within a key.

    The rank test lets Spark keep only k rows per key and input partition before the shuffle, so a hot key
    stays small. It does so for small k only; for a larger k the rows of a hot key are first ranked in shares, as many as its
    count asks for, each of which keeps its first k.
    """
    if k > GROUP_LIMIT:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SHARE_ROWS)
        hottest = counts.orderBy(F.desc("_n"), *keys).limit(SPLIT_KEYS)
        hot = hottest.select(*[F.col(c).alias(f"_{c}") for c in keys], F.ceil(F.col("_n") / SHARE_ROWS).alias("_shares"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
        share = F.pmod(F.xxhash64(*df.columns), F.coalesce("_shares", F.lit(1)))
        shares = df.join(F.broadcast(hot), same, "left").withColumn("_share", share)
        inside = F.row_number().over(Window.partitionBy(*keys, "_share").orderBy(*order))
        df = shares.withColumn("_at", inside).filter(F.col("_at") <= k).select(*df.columns)
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)
