"""Customer analytics: acquisition, value, churn, cohorts, segments, lists.

Bookings are folded to one row per customer (or customer and month) before they meet the users.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.money import mean, percent, ratio, rounded, sum_if
from sojourn.functions.numbering import exact_median
from sojourn.functions.text import contains_any
from sojourn.operators.revenue import When, whole_buckets, zero_if_null, confirmed, fill_calendar
from sojourn.tables import Tables


def _per_user(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_bookings"), F.sum("total_price").alias("total_spent")
    )


def customer_acquisition(t: Tables, *, start: When, end: When) -> DataFrame:
    """Zero-filled monthly count of new users with the plain role."""
    facts = (
        t.users.filter((F.col("role") == "user") & whole_buckets("created_at", start, end, "month"))
        .groupBy(dates.bucket("created_at", "month").alias("m"))
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )
    filled = fill_calendar(t, facts, start, end, "month", "m")
    return filled.select(
        F.date_format("m", "yyyy-MM-dd").alias("month"), zero_if_null("new_customers")
    ).orderBy("month")


def first_bookings(bookings: DataFrame) -> DataFrame:
    """Earliest booking of each user: the smallest (time, id), found by partial aggregation."""
    first = F.min(F.struct("booked_at", "id", "total_price")).alias("first")
    return bookings.groupBy("user_id").agg(first).select(
        "user_id",
        F.col("first.id").alias("booking_id"),
        F.col("first.booked_at").alias("booked_at"),
        F.col("first.total_price").alias("total_price"),
    )


def lateral_first_booking(t: Tables, *, start: When, end: When) -> DataFrame:
    """Every user with the first confirmed booking of the window, null when there is none."""
    first = first_bookings(confirmed(t).transform(dates.booked_within(start, end)))
    return (
        t.users.select("id", "name")
        .join(first, F.col("id") == F.col("user_id"), "left")
        .select("id", "name", "booking_id", "booked_at", "total_price")
    )


def acquisition_first_value(
    t: Tables, *, start: When, end: When, first_in_window: bool = False
) -> DataFrame:
    """Zero-filled months: new users of any role, how many of them have a confirmed first booking,
    and its value. ``first_in_window`` looks for the first booking inside the window only."""
    bookings = confirmed(t)
    if first_in_window:
        bookings = bookings.transform(dates.booked_within(start, end))
    users = t.users.filter(whole_buckets("created_at", start, end, "month")).select("id", "created_at")
    facts = (
        users.join(first_bookings(bookings), F.col("id") == F.col("user_id"), "left")
        .groupBy(dates.bucket("created_at", "month").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("new_customers"),
            F.count("booking_id").alias("first_bookings"),
            F.sum("total_price").alias("initial_revenue"),
        )
    )
    filled = fill_calendar(t, facts, start, end, "month", "month")
    return filled.select(
        "month", zero_if_null("new_customers"), zero_if_null("first_bookings"), zero_if_null("initial_revenue")
    ).orderBy("month")


def top_customers(
    t: Tables, *, start: When, end: When, role: str | None = "user", limit: int = 10
) -> DataFrame:
    facts = _per_user(confirmed(t).transform(dates.booked_within(start, end)))
    users = t.users.select("id", "name", "email", "role")
    if role is not None:
        users = users.filter(F.col("role") == role)
    return (
        facts.join(users, F.col("id") == F.col("user_id"))
        .orderBy(F.desc("total_spent"), "id")
        .limit(limit)
        .select(
            "id", "name", "email", "total_bookings", "total_spent",
            ratio(F.col("total_spent"), F.col("total_bookings")).alias("avg_booking_value"),
        )
    )


def top_customers_detail(t: Tables, *, start: When, end: When, limit: int = 10) -> DataFrame:
    per_year = (
        confirmed(t)
        .transform(dates.booked_within(start, end))
        .groupBy("user_id", F.year("booked_at").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("total_price").alias("s"),
            F.min("booked_at").alias("first"),
            F.max("booked_at").alias("last"),
        )
    )
    facts = per_year.groupBy("user_id").agg(
        F.sum("n").alias("total_bookings"),
        F.sum("s").cast("decimal(28,2)").alias("total_spent"),
        F.min("first").alias("first_booking"),
        F.max("last").alias("last_booking"),
        F.count("year").alias("active_years"),
    )
    users = t.users.select("id", "name", "email", F.col("created_at").alias("joined_date"))
    return (
        facts.join(users, F.col("id") == F.col("user_id"))
        .orderBy(F.desc("total_spent"), "id")
        .limit(limit)
        .select(
            "id", "name", "email", "joined_date", "total_bookings", "total_spent", "first_booking",
            "last_booking", ratio(F.col("total_spent"), F.col("total_bookings")).alias("avg_booking_value"),
            "active_years",
        )
    )


def segment(count: Column, none: str) -> Column:
    """Segment by number of confirmed bookings."""
    return (
        F.when(count >= 5, "VIP").when(count >= 3, "Regular").when(count >= 1, "New").otherwise(none)
    )


def customer_segments(t: Tables) -> DataFrame:
    """Confirmed customers with positive value per segment, in business order."""
    rank = (
        F.when(F.col("segment") == "VIP", 1)
        .when(F.col("segment") == "Regular", 2)
        .when(F.col("segment") == "New", 3)
        .otherwise(4)
    )
    facts = _per_user(confirmed(t)).join(
        t.users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    )
    return (
        facts.filter(F.col("total_spent") > 0)
        .groupBy(segment(F.col("total_bookings"), "Prospect").alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("total_spent").cast("decimal(28,2)").alias("total_revenue"),
            mean(F.col("total_spent")).alias("avg_value"),
        )
        .orderBy(rank)
    )


def clv(t: Tables) -> DataFrame:
    """Lifetime value per customer type and segment, with the exact median. Users without a confirmed
    booking are left out, so only users with bookings are read."""
    facts = _per_user(confirmed(t)).join(
        t.users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    )
    kind = F.when(F.col("total_bookings") == 1, "One-time").otherwise("Repeat")
    labelled = facts.select(
        kind.alias("customer_type"),
        segment(F.col("total_bookings"), "Inactive").alias("segment"),
        "total_bookings",
        F.col("total_spent").alias("value"),
    )
    keys = ["customer_type", "segment"]
    sums = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("customer_count"),
        mean(F.col("value")).alias("avg_lifetime_value"),
        mean(F.col("total_bookings")).alias("avg_bookings"),
        F.sum("value").cast("decimal(28,2)").alias("total_revenue"),
    )
    medians = exact_median(labelled, keys, "value", "m", few_keys=True)
    return (
        sums.join(F.broadcast(medians), keys, "left")
        .withColumn("median_value", rounded(F.col("m"), 2))
        .drop("m")
        .orderBy(F.desc("total_revenue"))
    )


def churn(t: Tables, *, as_of: date) -> DataFrame:
    """Customers by the age of their last confirmed booking. Exactly 90 (or 30) days ago is not yet
    churned (at risk). The share is taken over the three result rows."""
    last = F.col("last_activity")
    # Labels and bounds in days.
    status = (
        F.when(last < dates.ts(as_of - timedelta(days=90)), "Churned")
        .when(last < dates.ts(as_of - timedelta(days=30)), "At Risk")
        .otherwise("Active")
    )
    customers = (
        confirmed(t)
        .transform(dates.booked_days(None, as_of))
        .filter(F.col("booked_at").isNotNull())
        .groupBy("user_id")
        .agg(F.max("booked_at").alias("last_activity"))
        .join(t.users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    )
    counts = customers.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("customer_count"))
    total = counts.agg(F.sum("customer_count")).scalar()
    order = F.when(F.col("status") == "Active", 1).when(F.col("status") == "At Risk", 2).otherwise(3)
    return counts.withColumn("percentage", percent(F.col("customer_count"), total)).orderBy(order)


def referral_sources(t: Tables) -> DataFrame:
    facts = _per_user(confirmed(t))
    return (
        t.users.select("id", "utm_source")
        .join(facts, F.col("id") == F.col("user_id"), "left")
        .groupBy(F.coalesce("utm_source", F.lit("direct")).alias("source"))
        .agg(
            F.count(F.lit(1)).alias("signups"),
            F.coalesce(F.sum("total_bookings"), F.lit(0)).alias("bookings"),
            F.coalesce(F.sum("total_spent"), F.lit(0)).cast("decimal(28,2)").alias("revenue"),
        )
        .orderBy(F.desc("signups"), "source")
    )


def cohorts(t: Tables, *, as_of: date, months: int = 12) -> DataFrame:
    """Signup-month cohorts by activity month. ``month_number`` is the true month difference."""
    since = dates.months_before(as_of, months)
    members = t.users.filter(F.col("created_at") >= dates.ts(since)).select(
        F.col("id").alias("member"), dates.bucket("created_at", "month").alias("cohort_month")
    )
    # A member's activity cannot precede the first cohort month.
    activity = (
        confirmed(t)
        .transform(dates.booked_since(dates.floor_day(since, "month"), as_of))
        .groupBy("user_id", dates.bucket("booked_at", "month").alias("activity_month"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s"))
    )
    same = (F.col("member") == F.col("user_id")) & (F.col("activity_month") >= F.col("cohort_month"))
    return (
        members.join(activity, same)
        .groupBy("cohort_month", "activity_month")
        .agg(
            F.count(F.lit(1)).alias("active_users"),
            F.sum("n").alias("bookings"),
            F.sum("s").cast("decimal(28,2)").alias("revenue"),
        )
        .select(
            F.date_format("cohort_month", "yyyy-MM").alias("cohort"),
            F.date_format("activity_month", "yyyy-MM").alias("month"),
            dates.month_difference(F.col("activity_month"), F.col("cohort_month")).alias("month_number"),
            "active_users", "bookings", "revenue",
        )
        .orderBy("cohort", "month")
    )


def export_customers(t: Tables) -> DataFrame:
    """Every user with all-status booking count and confirmed lifetime value."""
    facts = t.bookings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_bookings"),
        sum_if(F.col("status") == "confirmed", F.col("total_price")).alias("lifetime_value"),
        F.min("booked_at").alias("first_booking"),
        F.max("booked_at").alias("last_booking"),
    )
    return (
        t.users.select("id", "name", "email", "phone", "created_at")
        .join(facts, F.col("id") == F.col("user_id"), "left")
        .select(
            "id", "name", "email", "phone", "created_at", zero_if_null("total_bookings"),
            zero_if_null("lifetime_value"), "first_booking", "last_booking",
        )
        .orderBy(F.desc("lifetime_value"), "id")
    )


def user_list_stats(
    t: Tables, *, role: str | None = None, search: str | None = None, page: int = 1, size: int = 20
) -> DataFrame:
    """Active users, newest first, with all-status count and confirmed spend. The page is cut before
    the bookings are joined, so only its users' bookings are summed."""
    users = t.users.filter("is_active")
    if role is not None:
        users = users.filter(F.col("role") == role)
    if search:
        users = users.filter(contains_any(search, "name", "email"))
    shown = (
        users.select("id", "name", "email", "role", "created_at")
        .orderBy(F.desc("created_at"), "id")
        .offset((page - 1) * size)
        .limit(size)
    )
    # The page holds at most ``size`` rows, which bounds the broadcast.
    facts = (
        t.bookings.join(F.broadcast(shown.select(F.col("id").alias("user_id"))), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            sum_if(F.col("status") == "confirmed", F.col("total_price")).alias("total_spent"),
        )
    )
    return (
        shown.join(F.broadcast(facts), F.col("id") == F.col("user_id"), "left")
        .select("id", "name", "email", "role", "created_at", zero_if_null("total_bookings"), zero_if_null("total_spent"))
        .orderBy(F.desc("created_at"), "id")
    )


def user_count(t: Tables, *, role: str | None = None, search: str | None = None) -> DataFrame:
    users = t.users.filter("is_active")
    if role is not None:
        users = users.filter(F.col("role") == role)
    if search:
        users = users.filter(contains_any(search, "name", "email"))
    return users.agg(F.count(F.lit(1)).alias("total"))


def user_stats(t: Tables) -> DataFrame:
    """Trips by state and confirmed spend of every user, zeros without bookings."""
    state = F.col("status")
    facts = t.bookings.groupBy("user_id").agg(
        F.count_if(state == "confirmed").alias("total_trips"),
        F.count_if(state == "pending").alias("pending_trips"),
        F.count_if(state == "cancelled").alias("cancelled_trips"),
        sum_if(state == "confirmed", F.col("total_price")).alias("total_spent"),
    )
    return for_every_user(t, facts)


def for_every_user(t: Tables, facts: DataFrame) -> DataFrame:
    """Facts of one row per ``user_id`` for all users, zero where there are none."""
    known = t.users.select(F.col("id").alias("user_id")).join(facts, "user_id", "left")
    return known.select("user_id", *[zero_if_null(c) for c in facts.columns if c != "user_id"])


def live_users(t: Tables, *, now: datetime, limit: int = 10) -> DataFrame:
    """Users seen within the last hour with what they booked in it."""
    since = now - timedelta(hours=1)
    facts = t.bookings.transform(dates.booked_since(since, now)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("session_bookings"), F.sum("total_price").alias("session_spend")
    )
    return (
        t.users.filter(F.col("last_login_at").between(dates.ts(since), dates.ts(now)))
        .select("id", "name", "email", "last_login_at")
        .join(facts, F.col("id") == F.col("user_id"), "left")
        .select("id", "name", "email", "last_login_at", zero_if_null("session_bookings"), "session_spend")
        .orderBy(F.desc("last_login_at"), "id")
        .limit(limit)
    )
