"""Tour, category and amenity analytics, live seats.

Bookings and reviews are folded apart and joined afterwards, so a tour with many reviews never
multiplies its bookings. A tour counts in each of its categories on purpose.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.functions.money import percent, ratio, sum_if
from sojourn.functions.numbering import first_rows
from sojourn.operators.revenue import When, confirmed, zero_if_null
from sojourn.schemas import BOOKABLE
from sojourn.tables import Tables


def _per_tour(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("tour_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s")
    )


def _fold_links(links: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """Per category or amenity: tours, bookings and revenue; links without bookings kept."""
    return (
        links.join(facts, "tour_id", "left")
        .groupBy(F.col(key).alias("link_id"))
        .agg(
            F.count("tour_id").alias("tour_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("bookings"),
            F.sum("s").cast("decimal(28,2)").alias("revenue"),
        )
    )


def _per_tour_and_user(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("tour_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s")
    )


def _fold_links_by_customer(links: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The same with distinct customers, links without bookings dropped. Bookings come folded to
    (tour, user) and are folded to (link, user) after the join, so a customer of several tours of a
    category counts once. Tours are counted on the links alone."""
    per_user = (
        pairs.join(links, "tour_id")
        .groupBy(F.col(key).alias("link_id"), "user_id")
        .agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(28,2)").alias("s"))
    )
    folded = per_user.groupBy("link_id").agg(
        F.sum("n").alias("bookings"),
        F.sum("s").cast("decimal(28,2)").alias("revenue"),
        F.count("user_id").alias("customers"),
    )
    tours = links.groupBy(F.col(key).alias("link_id")).agg(F.count("tour_id").alias("tour_count"))
    return folded.join(tours, "link_id")


def _ratings(t: Tables) -> DataFrame:
    """Approved reviews folded to one row per tour."""
    return t.reviews.filter("is_approved").groupBy("tour_id").agg(
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_count")
    )


def _ratings_per_link(t: Tables, links: DataFrame, key: str) -> DataFrame:
    return (
        links.join(_ratings(t), "tour_id")
        .groupBy(F.col(key).alias("link_id"))
        .agg(ratio(F.sum("rating_sum"), F.sum("rating_count")).alias("avg_rating"))
    )


def category_revenue(t: Tables, *, start: When, end: When) -> DataFrame:
    """Confirmed revenue and count per category, zero categories kept."""
    facts = _per_tour(confirmed(t).transform(dates.booked_within(start, end)))
    folded = _fold_links(t.tour_categories, "category_id", facts)
    return (
        t.categories.select("id", F.col("name").alias("category"))
        .join(folded, F.col("id") == F.col("link_id"), "left")
        .select("id", "category", zero_if_null("revenue"), zero_if_null("bookings"))
        .orderBy(F.desc("revenue"), "id")
    )


def category_revenue_nonzero(t: Tables, *, start: When, end: When) -> DataFrame:
    """The same, only categories with revenue."""
    return category_revenue(t, start=start, end=end).filter(F.col("revenue") > 0)


def category_share(t: Tables, *, start: When, end: When) -> DataFrame:
    """Per category bookings, customers, tours and the share of the window's confirmed revenue. The
    denominator counts each booking once, so shares of overlapping categories exceed 100."""
    pairs = _per_tour_and_user(confirmed(t).transform(dates.booked_within(start, end)))
    # Over the same fold, so the window is read once.
    total = pairs.agg(F.sum("s")).scalar()
    folded = _fold_links_by_customer(t.tour_categories, "category_id", pairs).filter(F.col("revenue") > 0)
    return (
        t.categories.select("id", "name", "color", "icon")
        .join(folded, F.col("id") == F.col("link_id"))
        .select(
            "id", "name", "color", "icon", "bookings", "revenue", "customers",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_booking_value"),
            "tour_count",
            percent(F.col("revenue"), total).alias("market_share"),
        )
        .orderBy(F.desc("revenue"), "id")
    )


def category_share_chart(t: Tables, *, start: When, end: When) -> DataFrame:
    """Share of the summed category revenue in percent, one decimal. The denominator includes what
    overlapping categories count twice."""
    rows = category_revenue_nonzero(t, start=start, end=end)
    total = rows.agg(F.sum("revenue")).scalar()
    return rows.select("id", "category", "revenue", percent(F.col("revenue"), total, 1).alias("share"))


def category_popularity(t: Tables) -> DataFrame:
    """All-time; categories without revenue last."""
    folded = _fold_links(t.tour_categories, "category_id", _per_tour(confirmed(t)))
    return (
        t.categories.select("id", F.col("name").alias("category"))
        .join(folded, F.col("id") == F.col("link_id"), "left")
        .select(
            "id", "category", zero_if_null("tour_count"),
            F.coalesce("bookings", F.lit(0)).alias("bookings_count"), "revenue",
        )
        .orderBy(F.desc_nulls_last("revenue"), "id")
    )


def category_tour_counts(t: Tables) -> DataFrame:
    """Bookable tours per category, zeros kept."""
    bookable = t.tours.filter(F.col("status").isin(*BOOKABLE)).select(F.col("id").alias("tour_id"))
    counts = (
        t.tour_categories.join(bookable, "tour_id", "left_semi")
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("tour_count"))
    )
    return (
        t.categories.join(counts, F.col("id") == F.col("category_id"), "left")
        .select("id", "name", "description", "icon", "color", zero_if_null("tour_count"))
        .orderBy("name", "id")
    )


def category_performance(t: Tables, *, as_of: date, months: int = 12) -> DataFrame:
    recent = confirmed(t).transform(dates.booked_since(dates.months_before(as_of, months), as_of))
    links = t.tour_categories
    joined = (
        _fold_links_by_customer(links, "category_id", _per_tour_and_user(recent))
        .withColumnRenamed("customers", "unique_customers")
        .join(_ratings_per_link(t, links, "category_id"), "link_id", "left")
    )
    return (
        t.categories.select("id", "name", "color")
        .join(joined, F.col("id") == F.col("link_id"))
        .select(
            "id", "name", "color", "tour_count", "bookings", "revenue",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_booking_value"),
            "unique_customers", "avg_rating",
        )
        .orderBy(F.desc("revenue"), "id")
    )


def amenity_impact(t: Tables) -> DataFrame:
    links = t.tour_amenities
    folded = _fold_links(links, "amenity_id", _per_tour(confirmed(t))).filter(F.col("bookings") > 0)
    joined = folded.join(_ratings_per_link(t, links, "amenity_id"), "link_id", "left")
    return (
        t.amenities.select("id", "name", "icon")
        .join(joined, F.col("id") == F.col("link_id"))
        .select(
            "id", "name", "icon", "tour_count", "bookings", "revenue",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_price"), "avg_rating",
        )
        .orderBy(F.desc("revenue"), "id")
    )


def _performance(t: Tables, start: When, end: When) -> DataFrame:
    """One row per tour booked in the window. Customers and booking days are two kinds of keys in one
    fold, so the bookings are read once."""
    window = t.bookings.transform(dates.booked_within(start, end))
    is_confirmed, is_cancelled = F.col("status") == "confirmed", F.col("status") == "cancelled"
    kinds = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("key")),
        F.struct(F.lit("day").alias("kind"), F.unix_date(F.to_date("booked_at")).cast("long").alias("key")),
    )
    per_key = (
        window.select("tour_id", "status", "total_price", "people_count", F.inline(kinds))
        .groupBy("tour_id", "kind", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_confirmed).alias("c"),
            F.count_if(is_cancelled).alias("x"),
            sum_if(is_confirmed, F.col("total_price")).alias("s"),
            sum_if(is_cancelled, F.col("total_price")).alias("lost"),
            sum_if(is_confirmed, F.col("people_count")).alias("people"),
        )
    )
    by_user = F.col("kind") == "user"
    facts = per_key.groupBy("tour_id").agg(
        sum_if(by_user, F.col("n")).alias("bookings"),
        sum_if(by_user, F.col("c")).alias("confirmed_bookings"),
        sum_if(by_user, F.col("x")).alias("cancelled_bookings"),
        sum_if(by_user, F.col("s")).cast("decimal(28,2)").alias("revenue"),
        sum_if(by_user, F.col("lost")).cast("decimal(28,2)").alias("lost_revenue"),
        sum_if(by_user, F.col("people")).alias("total_participants"),
        F.count(F.when(by_user, F.col("key"))).alias("unique_customers"),
        F.count(F.when(by_user & (F.col("n") > 1), F.col("key"))).alias("repeat_customers"),
        F.count(F.when(~by_user, F.col("key"))).alias("days"),
    )
    tours = t.tours.select("id", "title", "slug", "location", "price", "capacity", "status")
    seats = F.col("capacity").cast("double") * F.col("days")
    worth = F.col("price").cast("double") * F.col("capacity")
    return (
        tours.join(facts.join(_ratings(t), "tour_id", "left"), F.col("id") == F.col("tour_id"))
        .select(
            *tours.columns, "bookings", "confirmed_bookings", "cancelled_bookings", "revenue", "lost_revenue",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_value_incl_zero"),
            "unique_customers", "repeat_customers", "total_participants",
            percent(F.col("total_participants"), seats).alias("occupancy_rate"),
            ratio(F.col("rating_sum"), F.col("rating_count")).alias("avg_rating"),
            F.coalesce("rating_count", F.lit(0)).alias("review_count"),
            F.when(F.col("price") > 0, ratio(F.col("revenue"), worth, 4)).otherwise(0.0).alias("profitability"),
        )
    )


# Sort modes of the performance report. Only ratings put nulls last.
SORT_KEYS = {
    "revenue": ("revenue", False),
    "bookings": ("bookings", False),
    "occupancy": ("occupancy_rate", False),
    "rating": ("avg_rating", True),
    "profitability": ("profitability", False),
}


def sort_order(sort_by: str) -> Column:
    column, nulls_last = SORT_KEYS.get(sort_by, SORT_KEYS["revenue"])
    return F.desc_nulls_last(column) if nulls_last else F.desc_nulls_first(column)


def tour_performance(
    t: Tables, *, start: When, end: When, sort_by: str = "revenue", limit: int = 20
) -> DataFrame:
    return _performance(t, start, end).orderBy(sort_order(sort_by), "id").limit(limit)


def sort_modes(t: Tables, *, start: When, end: When, limit: int = 20) -> DataFrame:
    """The top tours of all sort modes at once. Each tour becomes one row per mode, and the
    rank test keeps ``limit`` rows per mode and input partition before the shuffle."""
    modes = [
        F.struct(
            F.lit(mode).alias("sort_by"),
            # Nulls first for every mode but rating.
            (F.lit(not last) & F.col(c).isNull()).alias("null_first"),
            F.col(c).cast("double").alias("sort_value"),
        )
        for mode, (c, last) in SORT_KEYS.items()
    ]
    rows = _performance(t, start, end).select("id", "title", F.inline(F.array(*modes)))
    order = [F.desc("null_first"), F.desc_nulls_last("sort_value"), F.asc("id")]
    return first_rows(rows, ["sort_by"], order, limit).drop("null_first").orderBy("sort_by", "rank")


def cancellation_analysis(t: Tables, *, as_of: date, months: int = 12, limit: int = 10) -> DataFrame:
    """Tours with the worst cancellation rate and the mean whole days until cancellation."""
    is_cancelled = F.col("status") == "cancelled"
    whole_days = F.expr("extract(DAY FROM cancelled_at - booked_at)")
    facts = (
        t.bookings.transform(dates.booked_since(dates.months_before(as_of, months), as_of))
        .groupBy("tour_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_cancelled).alias("cancelled_bookings"),
            F.count_if(F.col("status") == "confirmed").alias("confirmed_bookings"),
            F.sum(F.when(is_cancelled, whole_days)).alias("days"),
            F.count(F.when(is_cancelled, whole_days)).alias("days_n"),
        )
        .filter(F.col("cancelled_bookings") > 0)
    )
    return (
        facts.join(t.tours.select("id", "title"), F.col("id") == F.col("tour_id"))
        .select(
            "id", "title", "cancelled_bookings", "confirmed_bookings",
            percent(F.col("cancelled_bookings"), F.col("n")).alias("cancellation_rate"),
            ratio(F.col("days"), F.col("days_n")).alias("avg_days_before_cancellation"),
        )
        .orderBy(F.desc("cancellation_rate"), "id")
        .limit(limit)
    )


def export_tours(t: Tables) -> DataFrame:
    """Every tour; the average counts unconfirmed bookings as zero."""
    per_user = t.bookings.groupBy("tour_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"),
        sum_if(F.col("status") == "confirmed", F.col("total_price")).alias("s"),
    )
    facts = per_user.groupBy("tour_id").agg(
        F.sum("n").alias("total_bookings"),
        F.sum("s").cast("decimal(28,2)").alias("revenue"),
        F.count("user_id").alias("unique_customers"),
    )
    return (
        t.tours.select("id", "title", "location", "price", "capacity", "status")
        .join(facts, F.col("id") == F.col("tour_id"), "left")
        .select(
            "id", "title", "location", "price", "capacity", "status",
            zero_if_null("total_bookings"), zero_if_null("revenue"),
            # A tour nobody booked averages zero.
            F.coalesce(ratio(F.col("revenue"), F.col("total_bookings")), F.lit(0.0)).alias("avg_value_incl_zero"),
            zero_if_null("unique_customers"),
        )
        .orderBy(F.desc("revenue"), "id")
    )


def slots_left_counter(t: Tables) -> DataFrame:
    """Seats left by the running counter."""
    return t.tours.select(
        "id", "title", "capacity", "booked_count",
        (F.col("capacity") - F.col("booked_count")).alias("available_slots"),
    )


def tour_availability_live(t: Tables, *, now: datetime, limit: int = 10) -> DataFrame:
    """Bookable tours with seats left: pending bookings of the last day, bookings of the last hour."""
    hour = F.col("booked_at") >= dates.ts(now - timedelta(hours=1))
    facts = t.bookings.transform(dates.booked_since(now - timedelta(hours=24), now)).groupBy("tour_id").agg(
        F.count_if(F.col("status") == "pending").alias("pending_bookings"),
        F.count_if(hour).alias("recent_bookings"),
    )
    bookable = F.col("status").isin(*BOOKABLE)
    tours = slots_left_counter(t.replace(tours=t.tours.filter(bookable)))
    return (
        tours.filter(F.col("available_slots") > 0)
        .join(facts, F.col("id") == F.col("tour_id"), "left")
        .select(
            "id", "title", "capacity", "booked_count", "available_slots",
            zero_if_null("pending_bookings"), zero_if_null("recent_bookings"),
        )
        .orderBy(F.desc("recent_bookings"), F.desc("pending_bookings"), "id")
        .limit(limit)
    )
