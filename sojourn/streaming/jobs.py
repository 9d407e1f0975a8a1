"""Live numbers with Spark's own windows: the batch and the streaming form are one expression. ``live`` has the forms that lose no late row.

Event times are zone-less; a watermark wants a zoned time, so they are read as UTC.
State is bounded by the watermark: hours and days behind it are dropped from memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates


def _timed(bookings: DataFrame, late: str) -> DataFrame:
    return bookings.withColumn("at", dates.as_instant("booked_at")).withWatermark("at", late)


def stream_hourly_sales(bookings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Confirmed count and revenue per hour. In append mode an hour comes out once, after the
    watermark has passed it; rows later than ``late`` are in no hour (``live.hour_events`` sets them aside)."""
    hourly = (
        _timed(bookings.filter(F.col("status") == "confirmed"), late)
        .groupBy(F.window("at", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("bookings"), F.sum("total_price").alias("revenue"))
    )
    return hourly.select(dates.as_clock("w.start").alias("hour"), "bookings", "revenue")


def stream_user_days(bookings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Running count and revenue per day and customer, for update mode. ``day_counters`` folds the last row of each to the
    day's exact numbers at any time."""
    daily = (
        _timed(bookings.filter(F.col("status") == "confirmed"), late)
        .groupBy(F.window("at", "1 day").alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("bookings"), F.sum("total_price").alias("revenue"))
    )
    return daily.select(F.to_date(dates.as_clock("w.start")).alias("day"), "user_id", "bookings", "revenue")


def day_counters(user_days: DataFrame) -> DataFrame:
    """Counters per day from one row per day and customer."""
    return user_days.groupBy("day").agg(
        F.sum("bookings").alias("bookings_today"),
        F.sum("revenue").cast("decimal(28,2)").alias("revenue_today"),
        F.count("user_id").alias("customers_today"),
    )


def stream_today_counters(bookings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counters per day, exact distinct customers among them. In append mode a day comes out once, after the watermark has
    passed it: the rows of a day and customer are folded first, and these are counted."""
    per_user = (
        _timed(bookings.filter(F.col("status") == "confirmed"), late)
        .groupBy(F.window("at", "1 day").alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s"))
    )
    daily = per_user.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.sum("n").alias("bookings_today"),
        F.sum("s").cast("decimal(28,2)").alias("revenue_today"),
        F.count("user_id").alias("customers_today"),
    )
    return daily.select(
        F.to_date(dates.as_clock("d.start")).alias("day"), "bookings_today", "revenue_today", "customers_today"
    )
