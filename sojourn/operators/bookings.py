"""Lists of bookings with their tour and customer, and lists per user.

Newest-k lists cut the bookings first and join names afterwards; every booking has its tour and
user (``quality.dq_foreign_keys`` checks that). Whole-table joins leave the strategy to the optimizer:
a small side is broadcast by its measured size, and a hot tour or customer is split by the
adaptive skew join.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.numbering import first_rows
from sojourn.functions.skew import join_hot
from sojourn.functions.text import contains_any
from sojourn.operators import customers
from sojourn.operators.catalog import bookable, main_images, paginate, with_totals
from sojourn.operators.revenue import When, confirmed, fill_calendar, zero_if_null
from sojourn.tables import Tables

SHOWN = ("id", "booking_number", "user_id", "tour_id", "people_count", "total_price", "status", "booked_at")


def latest_first():
    return [F.desc("booked_at"), F.desc("id")]


def with_names(t: Tables, bookings: DataFrame, *more: Column) -> DataFrame:
    """Add tour title and slug (and more tour columns), customer name and email; bookings without tour or
    customer are dropped."""
    tours = t.tours.select(
        F.col("id").alias("_tour"), F.col("title").alias("tour_title"), F.col("slug").alias("tour_slug"), *more
    )
    users = t.users.select(
        F.col("id").alias("_user"), F.col("name").alias("customer_name"), F.col("email").alias("customer_email")
    )
    return (
        bookings.join(tours, F.col("_tour") == F.col("tour_id"))
        .join(users, F.col("_user") == F.col("user_id"))
        .drop("_tour", "_user")
    )


def booking_enriched(t: Tables) -> DataFrame:
    """Every booking with the columns of all detail views. A lookup by id is a filter on it."""
    return with_names(
        t,
        t.bookings.select(*SHOWN, "payment_method", "confirmed_at", "cancelled_at"),
        F.col("location").alias("tour_location"),
        *[F.col(c) for c in ("start_date", "end_date", "duration_days")],
    )


def bookings_by_filter(
    t: Tables,
    *,
    status: str | None = None,
    tour_id: int | None = None,
    user_id: int | None = None,
    start: date | None = None,
    end: date | None = None,
    search: str | None = None,
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    """A page of bookings, newest first. The day range is inclusive on both ends; the search looks
    at customer name, email and booking number."""
    rows = t.bookings.transform(dates.booked_days(start, end)).select(*SHOWN)
    for column, value in (("status", status), ("tour_id", tour_id), ("user_id", user_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    matched = rows
    if search:
        people = t.users.select(F.col("id").alias("_u"), "name", "email")
        matched = (
            rows.join(people, F.col("_u") == F.col("user_id"))
            .filter(contains_any(search, "name", "email", "booking_number"))
            .select(*SHOWN)
        )
    shown = paginate(matched, latest_first(), page, size)
    return with_totals(with_names(t, shown), matched, size).orderBy(*latest_first())


def calendar_bookings(t: Tables, *, year: int, month: int) -> DataFrame:
    """All bookings of a month, oldest first."""
    first = date(year, month, 1)
    last = dates.shift_months(first, 1) - timedelta(days=1)
    rows = t.bookings.transform(dates.booked_days(first, last)).select(*SHOWN)
    return with_names(t, rows).orderBy("booked_at", "id")


def recent_bookings(t: Tables, *, limit: int = 10) -> DataFrame:
    newest = t.bookings.select(*SHOWN).orderBy(*latest_first()).limit(limit)
    return with_names(t, newest).orderBy(*latest_first())


def live_bookings(t: Tables, *, now: datetime, hours: int = 24, limit: int = 20) -> DataFrame:
    newest = (
        t.bookings.transform(dates.booked_since(now - timedelta(hours=hours), now))
        .select("id", "user_id", "tour_id", "people_count", "total_price", "status", "booked_at")
        .orderBy(*latest_first())
        .limit(limit)
    )
    return with_names(t, newest).orderBy(*latest_first())


def user_bookings(
    t: Tables, *, user_id: int | None = None, status: str | None = None, page: int = 1, size: int = 10
) -> DataFrame:
    """A page of bookings per user, newest first, with the user's total. All users unless one is given."""
    rows = t.bookings.select(*SHOWN)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if user_id is None:
        shown = first_rows(rows, ["user_id"], latest_first(), page * size)
        shown = shown.filter(F.col("rank") > (page - 1) * size)
    else:
        # One page of at most ``size`` rows, so the window over it is small.
        at = F.row_number().over(Window.partitionBy("user_id").orderBy(*latest_first()))
        shown = paginate(rows, latest_first(), page, size).withColumn("rank", at + (page - 1) * size)
    totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    tours = t.tours.select(F.col("id").alias("tour_id"), "title").join(main_images(t), "tour_id", "left")
    return join_hot(shown.join(totals, "user_id"), tours, ["tour_id"], counted=shown)


def user_recent(t: Tables, *, k: int = 5) -> DataFrame:
    """The k latest bookings of every user."""
    newest = first_rows(t.bookings.select(*SHOWN), ["user_id"], latest_first(), k)
    tours = t.tours.select(F.col("id").alias("_tour"), "title")
    return newest.join(tours, F.col("_tour") == F.col("tour_id")).select(
        "user_id", "rank", "id", "status", "booked_at", "total_price", "title"
    )


def user_upcoming(t: Tables, *, as_of: date, k: int = 3) -> DataFrame:
    """Confirmed bookings of tours that have not started, the k soonest of every user."""
    ahead = t.tours.filter(F.col("start_date") >= dates.day(as_of)).select(
        F.col("id").alias("_tour"), "title", "start_date", "location"
    )
    rows = confirmed(t).select(*SHOWN).join(ahead, F.col("_tour") == F.col("tour_id")).drop("_tour")
    soonest = first_rows(rows, ["user_id"], [F.asc("start_date"), F.asc("id")], k)
    images = main_images(t).withColumnRenamed("main_image", "image")
    return join_hot(soonest, images, ["tour_id"], "left").select(
        "user_id", "rank", "id", "people_count", "total_price", "booked_at", "title", "start_date", "location", "image"
    )


def user_favorites(t: Tables, *, k: int = 12) -> DataFrame:
    """The latest favourite bookable tours of every user."""
    offered = t.tours.filter(bookable()).select(
        F.col("id").alias("_tour"), "title", "slug", "price", "discount_price"
    )
    liked = t.favorites.withColumnRenamed("created_at", "favorited_at").join(
        offered, F.col("_tour") == F.col("tour_id")
    )
    newest = first_rows(liked.drop("_tour"), ["user_id"], [F.desc("favorited_at"), F.asc("tour_id")], k)
    images = main_images(t).withColumnRenamed("main_image", "image")
    return join_hot(newest, images, ["tour_id"], "left")


def user_favorites_counts(t: Tables) -> DataFrame:
    """Favourites of every user: all of them, and those that can be booked."""
    offered = t.tours.filter(bookable()).select(F.col("id").alias("_tour"), F.lit(1).alias("one"))
    facts = (
        t.favorites.join(offered, F.col("_tour") == F.col("tour_id"), "left")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total"), F.count("one").alias("bookable"))
    )
    return customers.for_every_user(t, facts)


def user_notifications(t: Tables, *, k: int = 20) -> DataFrame:
    """The k latest notifications of every user."""
    rows = t.notifications.select("id", "user_id", "type", "message", "is_read", "created_at")
    return first_rows(rows, ["user_id"], [F.desc("created_at"), F.desc("id")], k)


def export_revenue(t: Tables, *, start: When, end: When) -> DataFrame:
    """Booking extract of a range, newest first."""
    rows = t.bookings.transform(dates.booked_within(start, end)).select(
        *SHOWN, "payment_method", "confirmed_at"
    )
    return with_names(t, rows).select(
        "id", "booking_number", "customer_name", F.col("customer_email").alias("email"),
        F.col("tour_title").alias("tour_name"), "total_price", "status", "payment_method", "booked_at", "confirmed_at",
    ).orderBy(*latest_first())


def report_bookings(t: Tables, *, start: date | None = None, end: date | None = None) -> DataFrame:
    """The six report columns, newest first. Days are inclusive, an absent bound is open."""
    rows = t.bookings.transform(dates.booked_days(start, end)).select(*SHOWN)
    return with_names(t, rows).orderBy(*latest_first()).select(
        "booking_number", "customer_name", F.col("tour_title").alias("tour"), "total_price", "status",
        dates.second_text("booked_at").alias("booked_at"),
    )


def conditional_left_join(t: Tables, *, start: When, end: When) -> DataFrame:
    """Every user with the confirmed bookings of a window. The conditions sit on the right side before
    the join, so users without such bookings stay with zero."""
    facts = (
        confirmed(t)
        .transform(dates.booked_within(start, end))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("bookings"))
    )
    return (
        t.users.select("id", "name")
        .join(facts, F.col("id") == F.col("user_id"), "left")
        .select("id", "name", zero_if_null("bookings"))
    )


def left_join_null_rejected(t: Tables, *, start: When, end: When) -> DataFrame:
    """A left join whose WHERE tests the right side keeps matches only, so it is an inner join."""
    facts = (
        confirmed(t)
        .transform(dates.booked_within(start, end))
        .groupBy("tour_id")
        .agg(F.count(F.lit(1)).alias("bookings"))
    )
    return t.tours.select("id", "title").join(facts, F.col("id") == F.col("tour_id")).drop("tour_id")


def calendar_left_join(t: Tables, *, start: date, end: date) -> DataFrame:
    """Every day of the range with its bookings, days without any included."""
    facts = (
        t.bookings.transform(dates.booked_days(start, end))
        .groupBy(F.to_date("booked_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("bookings"))
    )
    filled = fill_calendar(t, facts, start, end, "day", "day")
    return filled.select("day", zero_if_null("bookings")).orderBy("day")
