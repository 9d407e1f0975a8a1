"""Shares of a total, and totals that several one-row queries put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.money import percent
from sojourn.operators.revenue import confirmed
from sojourn.tables import Tables


def global_share(t: Tables) -> DataFrame:
    """Confirmed revenue per tour and its share of all confirmed revenue. The divisor is an uncorrelated scalar
    subquery over the same fold."""
    facts = confirmed(t).groupBy("tour_id").agg(F.sum("total_price").alias("revenue"))
    total = facts.agg(F.sum("revenue")).scalar()
    return facts.withColumn("share", percent(F.col("revenue"), total, 6))


def status_share(t: Tables) -> DataFrame:
    """Bookings per state and their percentage, in business order."""
    counts = t.bookings.groupBy("status").agg(F.count(F.lit(1)).alias("bookings"))
    total = counts.agg(F.sum("bookings")).scalar()
    # Business order of the states.
    rank = F.array_position(F.array(*[F.lit(s) for s in ("pending", "confirmed", "cancelled", "completed")]), F.col("status"))
    return (
        counts.select("status", "bookings", percent(F.col("bookings"), total).alias("percentage"), rank.alias("position"))
        .orderBy("position")
    )
