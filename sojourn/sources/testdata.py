"""Booking tables derived from the driver's TPC-H-like Parquet files.

Every raw file is read with an explicit schema, so no footer job runs before the
query, and only the columns a query needs reach the scan.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.tables import Tables

RAW_SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def load_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """All booking tables over one scale-factor directory."""

    @cache
    def raw(name: str) -> DataFrame:
        return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    def events(kind: str) -> DataFrame:
        return (
            raw("events")
            .filter(F.col("event_type") == kind)
            .withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        )

    def users() -> DataFrame:
        logins = raw("events").groupBy(F.col("user_id").alias("login_id")).agg(
            F.max("ts").alias("last_login_at")
        )
        joined = raw("customer").join(logins, F.col("login_id") == F.col("c_custkey"), "left")
        return joined.selectExpr(
            "c_custkey id",
            "c_name name",
            "concat(lower(replace(c_name, '#', '.')), '@example.com') email",
            "cast(null as string) phone",
            "case when c_custkey % 50 = 0 then 'admin' when c_custkey % 25 = 0 then 'manager' "
            "else 'user' end role",
            "c_custkey % 20 <> 0 is_active",
            "timestamp_ntz'1995-01-01 00:00:00' + (c_custkey * 37 % 2300) * interval '1' day created_at",
            "cast(null as timestamp_ntz) updated_at",
            "case when c_mktsegment <> 'HOUSEHOLD' then lower(c_mktsegment) end utm_source",
            "last_login_at",
        )

    def bookings() -> DataFrame:
        lines = raw("lineitem").groupBy("l_orderkey").agg(
            F.min("l_partkey").alias("tour_id"), F.min("l_quantity").cast("int").alias("q")
        )
        joined = raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        return joined.selectExpr(
            "o_orderkey id",
            "cast(null as string) booking_number",
            "o_custkey user_id",
            "tour_id",
            "(q % 20) + 1 people_count",
            "cast(o_totalprice as decimal(18,2)) total_price",
            "case o_orderstatus when 'F' then 'confirmed' when 'O' then 'pending' else 'cancelled' end status",
            "cast(null as string) payment_status",
            "case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end payment_method",
            "o_orderdate booked_at",
            "case when o_orderstatus = 'F' then o_orderdate + (o_orderkey % 5) * interval '1' day end confirmed_at",
            "case when o_orderstatus = 'P' then o_orderdate + (o_orderkey % 60) * interval '1' day end cancelled_at",
            "cast(null as string) cancellation_reason",
        )

    def tours() -> DataFrame:
        booked = (
            tables.bookings.filter("status <> 'cancelled'")
            .groupBy("tour_id")
            .agg(F.sum("people_count").alias("n"))
        )
        joined = raw("part").join(booked, F.col("tour_id") == F.col("p_partkey"), "left")
        first = "timestamp_ntz'2001-06-01 00:00:00'"
        return joined.selectExpr(
            "p_partkey id",
            "concat(p_name, ' ', p_partkey) title",
            "concat(replace(p_name, ' ', '-'), '-', p_partkey) slug",
            "concat(p_type, ' tour by ', p_brand) short_description",
            "cast(null as string) full_description",
            "p_brand location",
            "cast(p_retailprice as decimal(10,2)) price",
            "case when p_partkey % 3 = 0 then cast(p_retailprice * 0.9 as decimal(10,2)) end discount_price",
            f"cast({first} + (p_partkey % 120) * interval '1' day as date) start_date",
            f"cast({first} + (p_partkey % 120 + 1 + p_size % 10) * interval '1' day as date) end_date",
            "1 + p_size % 10 duration_days",
            "40 + 2 * p_size capacity",
            "cast(coalesce(n, 0) as bigint) booked_count",
            "case when p_partkey % 10 < 4 then 'available' when p_partkey % 10 < 7 then 'upcoming' "
            "when p_partkey % 10 = 7 then 'fully_booked' when p_partkey % 10 = 8 then 'cancelled' "
            "else 'completed' end status",
            "p_partkey % 8 = 0 featured",
            "p_partkey % 50 created_by",
            "timestamp_ntz'1995-01-01 00:00:00' + p_partkey * interval '1' day created_at",
            "cast(null as timestamp_ntz) updated_at",
        )

    def tour_categories() -> DataFrame:
        return raw("part").select(
            F.col("p_partkey").alias("tour_id"),
            F.explode(F.array_distinct(F.split("p_name", " "))).alias("category_id"),
        )

    def tour_amenities() -> DataFrame:
        return raw("part").select(
            F.col("p_partkey").alias("tour_id"),
            F.explode(F.array("p_type", "p_brand")).alias("amenity_id"),
        )

    def categories() -> DataFrame:
        words = tables.tour_categories.select("category_id").distinct()
        return words.selectExpr(
            "category_id id", "category_id name", "cast(null as string) description",
            "concat('icon-', category_id) icon", "concat('#', substr(md5(category_id), 1, 6)) color",
        )

    def amenities() -> DataFrame:
        names = tables.tour_amenities.select("amenity_id").distinct()
        return names.selectExpr(
            "amenity_id id", "amenity_id name", "cast(null as string) description",
            "concat('icon-', lower(amenity_id)) icon",
        )

    def tour_images() -> DataFrame:
        # Spread over all tours, several to a tour, with equal display orders among them.
        last = raw("part").agg((F.max("p_partkey") / 8).cast("long")).scalar()
        return raw("pages").withColumn("n", last).selectExpr(
            "page_id id", "page_id * 7919 % (n + 1) tour_id", "url image_url", "page_id % 3 = 0 is_main",
            "cast(null as string) alt_text", "cast(page_id % 4 as int) display_order",
        )

    def favorites() -> DataFrame:
        return (
            events("click")
            .groupBy("user_id", F.col("k").alias("tour_id"))
            .agg(F.min("ts").alias("ts"))
            .selectExpr("user_id", "tour_id", "ts - interval '8400' day created_at")
        )

    def reviews() -> DataFrame:
        return events("view").selectExpr(
            "event_id id", "user_id", "k tour_id", "cast(null as bigint) booking_id",
            "cast(1 + event_id % 5 as int) rating", "cast(null as string) comment",
            "event_id % 3 <> 0 is_approved", "ts - interval '8400' day created_at",
        )

    def live_bookings_src() -> DataFrame:
        return events("purchase").selectExpr(
            "event_id id", "user_id", "k tour_id", "cast(1 + event_id % 4 as int) people_count",
            "cast(value as decimal(18,2)) total_price",
            "case when event_id % 10 < 7 then 'confirmed' when event_id % 10 < 9 then 'pending' "
            "else 'cancelled' end status",
            "ts booked_at",
        )

    def notifications() -> DataFrame:
        return events("error").selectExpr(
            "event_id id", "user_id", "event_type type", "props message",
            "event_id % 2 = 0 is_read", "ts created_at",
        )

    def bot_knowledge() -> DataFrame:
        q = raw("conversations").filter("role = 'user'").selectExpr("conv_id", "turn", "text question")
        a = raw("conversations").filter("role <> 'user'").selectExpr(
            "conv_id", "turn - 1 turn", "text answer"
        )
        return q.join(a, ["conv_id", "turn"])

    def requests() -> DataFrame:
        """Booking requests: three days per tour. A third asks for a hundred tours, whose days are overfull, the others for any tour."""
        tours = raw("part").agg(F.max("p_partkey") + 1).scalar()
        return events("click").withColumn("n", tours).selectExpr(
            "event_id request_id", "user_id", "case when event_id % 3 = 0 then k else event_id * 7919 % n end tour_id",
            "cast(timestamp_ntz'2001-06-01 00:00:00' + (event_id % 3 * 30) * interval '1' day as date) tour_date",
            "cast(event_id % 23 as int) people", "ts arrived_at",
        )

    def contact_messages() -> DataFrame:
        return raw("conversations").filter("role = 'user'").selectExpr(
            "case when conv_id % 5 = 0 then ' ' else concat('Guest ', conv_id) end name",
            "case when conv_id % 7 = 0 then 'nobody' else concat('guest', conv_id, '@example.com') end email",
            "cast(null as string) subject", "text message",
        )

    builders = {
        f.__name__: f
        for f in (
            users, bookings, tours, categories, amenities, tour_categories, tour_amenities,
            tour_images, favorites, reviews, live_bookings_src, notifications, bot_knowledge,
            requests, contact_messages,
        )
    }
    builders["raw_events"] = lambda: raw("events")
    builders["raw_orders"] = lambda: raw("orders")
    builders["raw_part"] = lambda: raw("part")
    tables = Tables(spark, builders)
    return tables


def live(t: Tables) -> Tables:
    """The same tables with the live purchase stream as the bookings."""
    return t.replace(bookings=t.live_bookings_src)
