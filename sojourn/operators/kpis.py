"""Headline numbers: windows, growth, dashboards, funnel.

Distinct customers come from one fold per customer, so each metric set is one scan and
one shuffle of at most one row per customer and input partition. One-row results are put together as
scalar subqueries.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.money import growth, percent, ratio, sum_if
from sojourn.operators import customers
from sojourn.operators.revenue import When, confirmed
from sojourn.schemas import BOOKABLE, BOOKING_STATUSES
from sojourn.tables import Tables

def is_confirmed() -> Column:
    return F.col("status") == "confirmed"


def side_by_side(t: Tables, *rows: DataFrame) -> DataFrame:
    """One row from several one-row frames; each becomes one scalar subquery."""
    packed = [
        r.select(F.struct(*r.columns).alias("row")).scalar().alias(f"r{i}") for i, r in enumerate(rows)
    ]
    return t.spark.range(1).select(*packed).select(*[f"r{i}.*" for i in range(len(rows))])


def _per_user(t: Tables, windows: dict[str, tuple[When, When]]) -> DataFrame:
    """One row per customer: bookings, confirmed bookings and revenue in each window."""
    aggs = []
    for name, span in windows.items():
        inside = dates.within("booked_at", *span)
        aggs += [
            F.count_if(inside).alias(f"{name}_n"),
            F.count_if(inside & is_confirmed()).alias(f"{name}_c"),
            sum_if(inside & is_confirmed(), F.col("total_price")).alias(f"{name}_s"),
        ]
    return t.bookings.transform(dates.booked_any(list(windows.values()))).groupBy("user_id").agg(*aggs)


def _totals(t: Tables, windows: dict[str, tuple[When, When]]) -> DataFrame:
    """One row of totals per window; all zero when the window is empty."""
    aggs = []
    for w in windows:
        n, c, s = (F.col(f"{w}_{x}") for x in "ncs")
        aggs += [
            F.coalesce(F.sum(n), F.lit(0)).alias(f"{w}_bookings"),
            F.coalesce(F.sum(c), F.lit(0)).alias(f"{w}_confirmed"),
            F.coalesce(F.sum(s), F.lit(0)).cast("decimal(28,2)").alias(f"{w}_revenue"),
            F.count(F.when(n > 0, F.col("user_id"))).alias(f"{w}_customers"),
            F.count(F.when(n > 1, F.col("user_id"))).alias(f"{w}_returning"),
        ]
    return _per_user(t, windows).agg(*aggs)


def kpi_window(t: Tables, *, start: When, end: When) -> DataFrame:
    """Bookings of any state, confirmed revenue and distinct customers of any state."""
    totals = _totals(t, {"now": (start, end)})
    return totals.selectExpr(
        "now_bookings total_bookings", "now_revenue total_revenue", "now_customers total_customers"
    )


def _two(t: Tables, start: When, end: When, prev_start: When, prev_end: When) -> DataFrame:
    return _totals(
        t,
        {
            "now": (start, end),
            "prev": (prev_start, prev_end),
        },
    )


def _growths() -> list[Column]:
    return [
        growth(F.col(f"now_{m}"), F.col(f"prev_{m}")).alias(f"{name}_growth")
        for m, name in (("bookings", "booking"), ("revenue", "revenue"), ("customers", "customer"))
    ]


def kpi_growth(t: Tables, *, start: When, end: When, prev_start: When, prev_end: When) -> DataFrame:
    """Percent change of bookings, revenue and customers against the previous window."""
    return _two(t, start, end, prev_start, prev_end).select(*_growths())


def kpi_avg_booking(t: Tables, *, start: When, end: When) -> DataFrame:
    """Confirmed revenue per booking of any state, and per confirmed booking."""
    totals = _totals(t, {"now": (start, end)})
    return totals.select(
        F.coalesce(ratio(F.col("now_revenue"), F.col("now_bookings")), F.lit(0.0)).alias("avg_over_all"),
        F.coalesce(ratio(F.col("now_revenue"), F.col("now_confirmed")), F.lit(0.0)).alias("avg_over_confirmed"),
    )


def kpi_capacity(t: Tables) -> DataFrame:
    totals = t.tours.filter(F.col("status").isin(*BOOKABLE)).agg(
        F.coalesce(F.sum("capacity"), F.lit(0)).alias("total_capacity"),
        F.coalesce(F.sum("booked_count"), F.lit(0)).alias("total_booked"),
    )
    rate = percent(F.col("total_booked"), F.col("total_capacity"))
    return totals.withColumn("occupancy_rate", F.coalesce(rate, F.lit(0.0)))


def kpi_full(t: Tables, *, start: When, end: When, prev_start: When, prev_end: When) -> DataFrame:
    """The complete KPI row; every number is zero, never null, for an empty window."""
    active = (
        t.bookings.transform(dates.booked_within(start, end))
        .select("tour_id")
        .distinct()
        .agg(F.count("tour_id").alias("active_tours"))
    )
    row = side_by_side(t, _two(t, start, end, prev_start, prev_end), active, kpi_capacity(t))
    return row.select(
        F.col("now_bookings").alias("total_bookings"),
        F.col("now_revenue").alias("total_revenue"),
        F.col("now_customers").alias("total_customers"),
        F.col("now_returning").alias("returning_customers"),
        "active_tours",
        F.coalesce(ratio(F.col("now_revenue"), F.col("now_confirmed")), F.lit(0.0)).alias("avg_booking_value"),
        "total_capacity",
        F.col("total_booked").alias("total_booked_capacity"),
        "occupancy_rate",
        *_growths(),
        _retention().alias("customer_retention"),
    )


def _retention() -> Column:
    return F.coalesce(percent(F.col("now_returning"), F.col("now_customers")), F.lit(0.0))


def retention_rate(t: Tables, *, start: When, end: When) -> DataFrame:
    """Customers with at least two bookings among all customers of the window."""
    totals = _totals(t, {"now": (start, end)})
    return totals.select(
        F.col("now_returning").alias("returning_customers"),
        F.col("now_customers").alias("total_customers"),
        _retention().alias("retention_rate"),
    )


def exists_other_row(t: Tables, *, start: When, end: When) -> DataFrame:
    """Customers with another booking in the window, with their count."""
    per_user = _per_user(t, {"now": (start, end)})
    return per_user.filter((F.col("now_n") > 1) & F.col("user_id").isNotNull()).selectExpr(
        "user_id", "now_n bookings"
    )


def interested_users(t: Tables, *, start: When, end: When) -> DataFrame:
    """Users with a favourite or a booking in the window, once each."""
    liked = t.favorites.filter(dates.within("created_at", start, end)).select("user_id")
    booked = t.bookings.transform(dates.booked_within(start, end)).select("user_id")
    return liked.union(booked).distinct()


def funnel(t: Tables, *, start: When, end: When) -> DataFrame:
    """Visitors, interested users, booked users, confirmed bookings and conversion."""
    visitors = t.users.filter(dates.within("created_at", start, end)).agg(
        F.count(F.lit(1)).alias("visitors")
    )
    interested = interested_users(t, start=start, end=end).agg(
        F.count("user_id").alias("interested_users")
    )
    booked = _totals(t, {"now": (start, end)}).selectExpr(
        "now_customers booked_users", "now_confirmed confirmed_count"
    )
    row = side_by_side(t, visitors, interested, booked)
    return row.withColumn("conversion_rate", percent(F.col("booked_users"), F.col("visitors")))


def funnel_step_rates(t: Tables, *, start: When, end: When) -> DataFrame:
    """Interested and booked users per visitor in percent, one decimal, zero without visitors."""
    f = funnel(t, start=start, end=end)
    return f.select(
        *[
            F.coalesce(percent(F.col(c), F.col("visitors"), 1), F.lit(0.0)).alias(f"{c}_rate")
            for c in ("interested_users", "booked_users")
        ]
    )


def funnel_simplified(t: Tables, *, start: When, end: When) -> DataFrame:
    """The short form of the overview page: no visitor numbers, and all bookings in the last step."""
    k = kpi_window(t, start=start, end=end)
    return k.select(
        F.lit(0).alias("visitors"),
        F.lit(0).alias("interested_users"),
        F.col("total_customers").alias("booked_users"),
        F.col("total_bookings").alias("confirmed_count"),
        F.lit(0).alias("conversion_rate"),
    )


def _since(as_of: date, days: int) -> Column:
    return F.col("booked_at") >= dates.ts(as_of - timedelta(days=days))


def dashboard_revenue(t: Tables, *, as_of: date) -> DataFrame:
    """Confirmed revenue of the last 30 days and of days 31 to 60, with the trend."""
    totals = (
        confirmed(t)
        .transform(dates.booked_since(as_of - timedelta(days=60), as_of))
        .agg(
            sum_if(_since(as_of, 30), F.col("total_price")).alias("current_period"),
            sum_if(~_since(as_of, 30), F.col("total_price")).alias("previous_period"),
        )
    )
    return totals.withColumn("trend", growth(F.col("current_period"), F.col("previous_period"), 1))


def dashboard_bookings(t: Tables, *, as_of: date) -> DataFrame:
    return t.bookings.transform(dates.booked_since(as_of - timedelta(days=30), as_of)).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "confirmed", "cancelled")],
    )


def dashboard_tours(t: Tables) -> DataFrame:
    return t.tours.filter(F.col("status").isin(*BOOKABLE)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "available").alias("available"),
        F.count_if(F.col("status") == "upcoming").alias("upcoming"),
        F.count_if(F.col("featured")).alias("featured"),
    )


def dashboard_users(t: Tables, *, as_of: date) -> DataFrame:
    """Active users except admins (whose count is therefore always zero)."""
    return t.users.filter(F.col("is_active") & (F.col("role") != "admin")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("created_at") >= dates.ts(as_of - timedelta(days=30))).alias("new_this_month"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(F.col("role") == "manager").alias("managers"),
        F.count_if(F.col("role") == "user").alias("users"),
    )


def public_stats(t: Tables, *, as_of: date) -> DataFrame:
    tours = t.tours.agg(
        F.count(F.lit(1)).alias("total_tours"),
        F.count_if(F.col("status") == "available").alias("available_tours"),
        F.count_if(F.col("status") == "upcoming").alias("upcoming_tours"),
        F.count_if(F.col("featured")).alias("featured_tours"),
    )
    bookings = t.bookings.transform(dates.booked_since(as_of - timedelta(days=30), as_of)).agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.count_if(is_confirmed()).alias("confirmed_bookings"),
        F.count_if(F.col("status") == "pending").alias("pending_bookings"),
        sum_if(is_confirmed(), F.col("total_price")).alias("revenue_30_days"),
        sum_if(is_confirmed() & _since(as_of, 7), F.col("total_price")).alias("revenue_7_days"),
    )
    return side_by_side(t, tours, bookings)


def home_stats(t: Tables) -> DataFrame:
    travelers = confirmed(t).agg(F.count(F.lit(1)).alias("happy_travelers"))
    tours = t.tours.filter(F.col("status") == "available").agg(F.count(F.lit(1)).alias("active_tours"))
    return side_by_side(t, travelers, tours)


def tour_status_counts(t: Tables) -> DataFrame:
    return t.tours.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def role_counts(t: Tables) -> DataFrame:
    return t.users.filter("is_active").groupBy("role").agg(F.count(F.lit(1)).alias("count"))


def booking_status_counts(t: Tables, *, start: When | None = None, end: When | None = None) -> DataFrame:
    b = t.bookings
    if start is not None:
        b = b.transform(dates.booked_since(start, None))
    if end is not None:
        b = b.filter(F.col("booked_at") <= dates.ts(end))
    return b.groupBy("status").agg(
        F.count(F.lit(1)).alias("count"), F.sum("total_price").alias("total_amount")
    )


def booking_status_summary(t: Tables, *, start: When | None = None, end: When | None = None) -> DataFrame:
    """One row: a column per state, the grand total and confirmed revenue."""
    counts = booking_status_counts(t, start=start, end=end)
    return counts.agg(
        *[
            sum_if(F.col("status") == s, F.col("count")).cast("long").alias(s)
            for s in ("pending", "confirmed", "cancelled")
        ],
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        sum_if(is_confirmed(), F.col("total_amount")).cast("decimal(28,2)").alias("revenue"),
    )


def user_status_counts(t: Tables) -> DataFrame:
    """Bookings of every user by state, one column per state."""
    facts = t.bookings.groupBy("user_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in BOOKING_STATUSES]
    )
    return customers.for_every_user(t, facts)


def _sales_between(t: Tables, first: datetime, now: datetime, suffix: str) -> DataFrame:
    per_user = (
        confirmed(t)
        .transform(dates.booked_since(first, now))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s"))
    )
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(f"bookings_{suffix}"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("decimal(28,2)").alias(f"revenue_{suffix}"),
        F.count("user_id").alias(f"customers_{suffix}"),
    )


def today_stats(t: Tables, *, now: datetime) -> DataFrame:
    row = _sales_between(t, dates.stamp(now.date()), now, "today")
    return row.withColumn(
        "avg_booking_today", ratio(F.col("revenue_today"), F.col("bookings_today"))
    )


def month_stats(t: Tables, *, now: datetime) -> DataFrame:
    return _sales_between(t, dates.stamp(now.date().replace(day=1)), now, "month")


def period_windows(t: Tables, *, as_of: date) -> DataFrame:
    """Bookings and confirmed revenue of the current and previous window of each period, in one scan."""
    labels, spans = [], []
    for period in ("day", "week", "month", "quarter", "year"):
        w = dates.period_window(period, as_of)
        for side, start, end in (("current", w.start, w.end), ("previous", w.prev_start, w.prev_end)):
            inside = dates.within("booked_at", start, end)
            spans.append((start, end))
            labels.append(
                F.when(inside, F.struct(F.lit(period).alias("period"), F.lit(side).alias("side")))
            )
    return (
        t.bookings.transform(dates.booked_any(spans))
        .select("status", "total_price", F.inline(F.array_compact(F.array(*labels))))
        .groupBy("period", "side")
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            sum_if(is_confirmed(), F.col("total_price")).alias("revenue"),
        )
    )


