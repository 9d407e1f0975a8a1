"""Registered source checks and the batch form of the streaming jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.shared import fresh_folder
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY
from sojourn.schemas import KEY_COLUMNS
from sojourn.sources.keys import KeyDictionary, with_whole_numbers
from sojourn.streaming import jobs
from sojourn.tables import Tables

NAMES = (
    "users", "tours", "bookings", "categories", "amenities", "tour_categories", "tour_amenities", "tour_images",
    "favorites", "reviews", "notifications", "bot_knowledge",
)


def _row_counts(t: Tables) -> DataFrame:
    counts = [
        getattr(t, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in NAMES
    ]
    return reduce(DataFrame.unionByName, counts)


register(
    "load_tables",
    _row_counts,
    "\nunion all\n".join(f"select '{name}' table_name, count(*) row_count from {name}" for name in NAMES),
)


def as_uuids(t: Tables) -> Tables:
    """The same tables with UUIDs for their whole-number keys."""
    digest = lambda entity, column: F.md5(F.concat_ws("/", F.lit(entity), F.col(column).cast("string")))
    uuid = lambda h: F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    def build(name: str):
        keys = KEY_COLUMNS[name]
        return lambda: getattr(t, name).withColumns({c: F.when(F.col(c).isNotNull(), uuid(digest(e, c))) for c, e in keys.items()})

    return Tables(t.spark, {name: build(name) for name in NAMES if name != "bot_knowledge"})


def _uuid_bookings(t: Tables) -> DataFrame:
    """Bookings by customer and tour, of tables that came with UUIDs: the dictionary learns the users and tours first and the rest in a second load."""
    source = as_uuids(t)
    dictionary = KeyDictionary(t.spark, fresh_folder(t.spark, "keys"))
    dictionary.learn(Tables.of(t.spark, users=source.users, tours=source.tours))
    dictionary.learn(source)
    loaded = with_whole_numbers(source, dictionary)
    users = loaded.users.select(F.col("id").alias("user_id"), "email")
    tours = loaded.tours.select(F.col("id").alias("tour_id"), "title")
    return (
        loaded.bookings.join(users, "user_id", "left").join(tours, "tour_id", "left").groupBy("email", "title")
        .agg(F.count(F.lit(1)).alias("bookings"), F.countDistinct("id").alias("ids"), F.sum("total_price").cast("decimal(28,2)").alias("revenue"))
    )


register(
    "load_uuid_tables",
    _uuid_bookings,
    f"""select u.email, t.title, count(*) bookings, count(distinct b.id) ids, {MONEY} revenue
from bookings b left join users u on u.id=b.user_id left join tours t on t.id=b.tour_id group by 1, 2""",
)
register(
    "stream_hourly_sales",
    lambda t: jobs.stream_hourly_sales(t.live_bookings_src),
    f"""select date_trunc('hour', booked_at) as hour, count(*) bookings, {MONEY} revenue
from live_bookings_src where status='confirmed' group by 1""",
)
register(
    "stream_today_counters",
    lambda t: jobs.stream_today_counters(t.live_bookings_src),
    f"""select cast(booked_at as date) as day, count(*) bookings_today, cast({MONEY} as decimal(28,2)) revenue_today,
  count(distinct user_id) customers_today from live_bookings_src where status='confirmed' group by 1""",
)
