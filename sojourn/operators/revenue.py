"""Revenue over time, by tour and by payment method.

Bookings are always aggregated on their key before any join, so a tour or customer with a
large share of the rows is folded into one row per input partition before the shuffle.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.money import mean, percent, ratio
from sojourn.schemas import BOOKABLE
from sojourn.tables import Tables

When = date | datetime


def confirmed(t: Tables) -> DataFrame:
    return t.bookings.filter(F.col("status") == "confirmed")


def zero_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def whole_buckets(column: str, start: When, end: When, grain: str) -> Column:
    """Rows of every bucket the window touches, from first day to last."""
    return (F.col(column) >= dates.ts(dates.floor_day(start, grain))) & (
        F.col(column) < dates.ts(dates.ceil_day(end, grain))
    )


def fill_calendar(t: Tables, facts: DataFrame, start: When, end: When, grain: str, key: str) -> DataFrame:
    """Left join a calendar to facts that hold at most one row per bucket of the window, which
    bounds the broadcast side."""
    return dates.calendar(t.spark, start, end, grain, key).join(F.broadcast(facts), key, "left")


def revenue_trend(t: Tables, *, start: When, end: When) -> DataFrame:
    """Zero-filled monthly confirmed revenue. The window only sets first and last month."""
    facts = (
        confirmed(t)
        .transform(dates.booked_buckets(start, end, "month"))
        .groupBy(dates.bucket("booked_at", "month").alias("month"))
        .agg(F.sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("bookings"))
    )
    filled = fill_calendar(t, facts, start, end, "month", "month")
    return filled.select(
        F.date_format("month", "yyyy-MM-dd").alias("period"), zero_if_null("revenue"), zero_if_null("bookings")
    ).orderBy("period")


def revenue_trend_grain(t: Tables, *, start: When, end: When, grain: str) -> DataFrame:
    """Zero-filled trend by day, week, month, quarter or year with distinct customers."""
    per_user = (
        confirmed(t)
        .transform(dates.booked_buckets(start, end, grain))
        .groupBy(dates.bucket("booked_at", grain).alias("period"), "user_id")
        .agg(F.sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("bookings"))
    )
    facts = per_user.groupBy("period").agg(
        F.sum("bookings").alias("bookings"),
        F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
        F.count("user_id").alias("customers"),
    )
    filled = fill_calendar(t, facts, start, end, grain, "period")
    return filled.select(
        "period",
        zero_if_null("bookings"),
        zero_if_null("revenue"),
        zero_if_null("customers"),
        F.coalesce(ratio(F.col("revenue"), F.col("bookings")), F.lit(0.0)).alias("avg_booking_value"),
    ).orderBy("period")


def revenue_by_time(t: Tables, *, start: When, end: When, grain: str, limit: int = 24) -> DataFrame:
    """Confirmed bookings, customers, tours and order value per bucket; latest buckets first."""
    return (
        confirmed(t)
        .transform(dates.booked_within(start, end))
        .groupBy(dates.bucket("booked_at", grain).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.countDistinct("user_id").alias("unique_customers"),
            F.sum("total_price").alias("revenue"),
            mean(F.col("total_price")).alias("avg_order_value"),
            F.countDistinct("tour_id").alias("unique_tours"),
        )
        .orderBy(F.desc("period"))
        .limit(limit)
    )


def revenue_by_period_lookback(
    t: Tables,
    *,
    as_of: date,
    periods: tuple[str, ...] = ("day", "week", "month", "year"),
    start: When | None = None,
    end: When | None = None,
) -> DataFrame:
    """Revenue, count and average per bucket over the lookback of each period, or from ``start`` instead,
    and up to ``end`` if given. One scan is folded to days, then the days are rolled up to every
    requested period."""
    # How far each period looks back.
    first_day = {
        "day": date.fromordinal(as_of.toordinal() - 30),
        "week": date.fromordinal(as_of.toordinal() - 84),
        "month": dates.months_before(as_of, 12),
        "year": dates.months_before(as_of, 60),
    }
    if start is not None:
        first_day = dict.fromkeys(periods, dates.stamp(start).date())
    earliest = start if start is not None else min(first_day[p] for p in periods)
    wanted = dates.booked_within(earliest, end) if end is not None else dates.booked_since(earliest, None if start is not None else as_of)
    daily = (
        confirmed(t)
        .transform(wanted)
        .groupBy(F.to_date("booked_at").alias("day"))
        .agg(F.sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("bookings"))
    )
    buckets = F.array(
        *[
            F.struct(
                F.lit(p).alias("grain"),
                F.when(F.col("day") >= dates.day(first_day[p]), dates.bucket("day", p)).alias("period"),
            )
            for p in periods
        ]
    )
    return (
        daily.select("revenue", "bookings", F.inline(buckets))
        .filter(F.col("period").isNotNull())
        .groupBy("grain", "period")
        .agg(
            F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
            F.sum("bookings").alias("bookings"),
        )
        .withColumn("avg_booking_value", ratio(F.col("revenue"), F.col("bookings")))
        .orderBy("grain", "period")
    )


def revenue_by_period_text(t: Tables, *, as_of: date, period: str) -> DataFrame:
    """The last 12 units with a text bucket: yyyy-MM-dd, year and week of year, or yyyy-MM."""
    back = {
        "day": date.fromordinal(as_of.toordinal() - 12),
        "week": date.fromordinal(as_of.toordinal() - 84),
        "month": dates.months_before(as_of, 12),
    }[period]
    label = {
        "day": F.date_format("bucket", "yyyy-MM-dd"),
        "week": F.concat(F.date_format("bucket", "yyyy-"), dates.week_of_year(F.col("bucket"))),
        "month": F.date_format("bucket", "yyyy-MM"),
    }[period]
    return (
        confirmed(t)
        .transform(dates.booked_since(back, as_of))
        .groupBy(dates.bucket("booked_at", period).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("bookings_count"), F.sum("total_price").alias("revenue"))
        .select(label.alias("period"), "bookings_count", "revenue")
        .orderBy("period")
    )


def revenue_comparison(
    t: Tables, *, start: When, end: When, prev_start: When, prev_end: When
) -> DataFrame:
    """Monthly confirmed revenue of two windows, stacked. One scan labels each booking with
    the windows it lies in (a booking of overlapping windows counts in both)."""
    now, before = dates.within("booked_at", start, end), dates.within("booked_at", prev_start, prev_end)
    windows = F.array_compact(
        F.array(F.when(now, F.lit("current")), F.when(before, F.lit("previous")))
    )
    return (
        confirmed(t)
        .transform(dates.booked_any([(start, end), (prev_start, prev_end)]))
        .select(F.explode(windows).alias("period"), dates.bucket("booked_at", "month").alias("month"), "total_price")
        .groupBy("period", "month")
        .agg(F.sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("bookings"))
        .orderBy("period", "month")
    )


def _by_tour(bookings: DataFrame, distinct_users: bool = False) -> DataFrame:
    """One row per tour; distinct customers through a (tour, user) fold."""
    if not distinct_users:
        return bookings.groupBy("tour_id").agg(
            F.count(F.lit(1)).alias("bookings"), F.sum("total_price").alias("revenue")
        )
    pairs = bookings.groupBy("tour_id", "user_id").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("total_price").alias("revenue")
    )
    return pairs.groupBy("tour_id").agg(
        F.sum("bookings").alias("bookings"),
        F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
        F.count("user_id").alias("unique_customers"),
    )


def revenue_by_tour(t: Tables, *, start: When, end: When, limit: int = 20) -> DataFrame:
    facts = _by_tour(confirmed(t).transform(dates.booked_within(start, end)), distinct_users=True)
    return (
        facts.join(t.tours.select("id", "title", "slug", "location"), F.col("id") == F.col("tour_id"))
        .orderBy(F.desc("revenue"), "id")
        .limit(limit)
        .select(
            "id", "title", "slug", "location", "bookings", "revenue",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_price"), "unique_customers",
        )
    )


def top_tours(t: Tables, *, start: When, end: When, limit: int = 10) -> DataFrame:
    facts = _by_tour(confirmed(t).transform(dates.booked_within(start, end)))
    return (
        facts.join(t.tours.select("id", "title", "location"), F.col("id") == F.col("tour_id"))
        .orderBy(F.desc("revenue"), "id")
        .limit(limit)
        .select(
            "id", "title", "location", "bookings", "revenue",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_booking_value"),
        )
    )


def top_tours_share(t: Tables, *, start: When, end: When, limit: int = 10) -> DataFrame:
    """Top tours with their share of the window's confirmed revenue. The total is a scalar subquery
    over the same fold, so the window is read once."""
    window = confirmed(t).transform(dates.booked_within(start, end))
    facts = _by_tour(window, distinct_users=True)
    total = facts.agg(F.sum("revenue")).scalar()
    return (
        facts.join(t.tours.select("id", "title", "location"), F.col("id") == F.col("tour_id"))
        .orderBy(F.desc("revenue"), "id")
        .limit(limit)
        .select(
            "id", "title", "location", "bookings", "revenue",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_booking_value"),
            "unique_customers",
            percent(F.col("revenue"), total).alias("revenue_share"),
        )
    )


def top_revenue_tours(t: Tables, *, limit: int = 10) -> DataFrame:
    """All-time; a tour without bookings has null revenue and sorts last."""
    return (
        t.tours.select("id", "title")
        .join(_by_tour(confirmed(t)), F.col("id") == F.col("tour_id"), "left")
        .select("id", "title", "revenue", zero_if_null("bookings"))
        .orderBy(F.desc_nulls_last("revenue"), "id")
        .limit(limit)
    )


def popular_tours(
    t: Tables,
    *,
    start: When | None = None,
    end: When | None = None,
    bookable_only: bool = False,
    limit: int | None = 5,
) -> DataFrame:
    """Tours by confirmed bookings. With a date bound only tours booked inside it remain;
    without one, tours nobody booked count 0. ``limit=None`` ranks every tour."""
    bookings = confirmed(t)
    if start is not None:
        bookings = bookings.filter(F.col("booked_at") >= dates.ts(start))
    if end is not None:
        bookings = bookings.filter(F.col("booked_at") <= dates.ts(end))
    facts = bookings.groupBy("tour_id").agg(
        F.count(F.lit(1)).alias("bookings_count"),
        F.sum("total_price").alias("revenue"),
        mean(F.col("people_count")).alias("avg_people"),
    )
    tours = t.tours.select("id", "title", "slug", "price", "status")
    if bookable_only:
        tours = tours.filter(F.col("status").isin(*BOOKABLE))
    how = "left" if start is None and end is None else "inner"
    ranked = (
        tours.join(facts, F.col("id") == F.col("tour_id"), how)
        .select("id", "title", "slug", "price", zero_if_null("bookings_count"), "revenue", "avg_people")
        .orderBy(F.desc("bookings_count"), "id")
    )
    return ranked if limit is None else ranked.limit(limit)


def payment_methods(t: Tables, *, start: When, end: When) -> DataFrame:
    per_user = (
        confirmed(t)
        .transform(dates.booked_within(start, end))
        .groupBy(F.coalesce("payment_method", F.lit("unknown")).alias("payment_method"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s"))
    )
    return (
        per_user.groupBy("payment_method")
        .agg(
            F.sum("n").alias("bookings"),
            F.sum("s").cast("decimal(28,2)").alias("revenue"),
            F.count("user_id").alias("unique_customers"),
        )
        .withColumn("avg_amount", ratio(F.col("revenue"), F.col("bookings")))
        .orderBy(F.desc("revenue"), "payment_method")
    )


def seasonality(t: Tables, *, start: When, end: When) -> DataFrame:
    return (
        confirmed(t)
        .transform(dates.booked_within(start, end))
        .groupBy(F.year("booked_at").alias("year"), F.month("booked_at").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.sum("total_price").alias("revenue"),
            mean(F.col("total_price")).alias("avg_amount"),
        )
        .orderBy("year", "month")
    )


def seasonal_by_tour(t: Tables, *, as_of: date, months: int = 24) -> DataFrame:
    facts = (
        confirmed(t)
        .transform(dates.booked_since(dates.months_before(as_of, months), as_of))
        .groupBy("tour_id", F.month("booked_at").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.sum("total_price").alias("revenue"),
            mean(F.col("total_price")).alias("avg_value"),
        )
    )
    return facts.join(t.tours.select("id", "title"), F.col("id") == F.col("tour_id")).select(
        "id", "title", "month", "bookings", "revenue", "avg_value"
    ).orderBy("title", "month", "id")


def sales_by_hour(t: Tables, *, now: datetime, hours: int = 24) -> DataFrame:
    """Confirmed count and revenue per hour of the last day; hours without sales are absent."""
    return (
        confirmed(t)
        .transform(dates.booked_since(now - timedelta(hours=hours), now))
        .groupBy(dates.hour_of("booked_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("bookings"), F.sum("total_price").alias("revenue"))
    )


def velocity(hourly: DataFrame) -> DataFrame:
    """Moving average over the current and the three existing hours before it, for one row per hour (also those
    a stream has written). The window has no key; its input is as long as the report."""
    last4 = Window.orderBy("hour").rowsBetween(-3, 0)
    seen = F.count(F.lit(1)).over(last4)
    return hourly.select(
        "hour",
        "bookings",
        "revenue",
        ratio(F.sum("bookings").over(last4), seen).alias("moving_avg_bookings"),
        ratio(F.sum("revenue").over(last4), seen).alias("moving_avg_revenue"),
    ).orderBy(F.desc("hour"))


def sales_velocity(t: Tables, *, now: datetime) -> DataFrame:
    """Hourly sales of the last day with their moving averages."""
    return velocity(sales_by_hour(t, now=now))
