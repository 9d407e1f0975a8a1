"""One projection per family of scalar expressions the reports use."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates, text
from sojourn.functions.money import percent, rounded
from sojourn.schemas import BOOKABLE
from sojourn.tables import Tables


def null_handling(t: Tables) -> DataFrame:
    return t.bookings.select(
        "id",
        F.coalesce("payment_method", F.lit("unknown")).alias("method"),
        F.nullif(F.col("status"), F.lit("cancelled")).alias("kept_status"),
        F.col("payment_method").isNull().alias("no_method"),
        F.col("cancelled_at").isNotNull().alias("was_cancelled"),
    )


def conditional(t: Tables) -> DataFrame:
    people, status = F.col("people_count"), F.col("status")
    return t.bookings.select(
        "id",
        F.when(people >= 15, "group").when(people >= 5, "party").otherwise("few").alias("party"),
        F.when(status == "confirmed", 1).when(status == "pending", 2).alias("position"),
    )


def date_truncation(t: Tables) -> DataFrame:
    return t.bookings.select(
        "id",
        dates.hour_of("booked_at").alias("hour"),
        *[dates.bucket("booked_at", g).alias(g) for g in dates.STEPS],
        dates.sunday_of("booked_at").alias("sunday_week"),
    )


def date_parts(t: Tables) -> DataFrame:
    return t.bookings.select(
        "id",
        F.month("booked_at").alias("month"),
        F.year("booked_at").alias("year"),
        F.expr("cast(extract(DAY FROM cancelled_at - booked_at) as long)").alias("days_to_cancel"),
        F.expr(
            "datediff(to_date(booked_at), date'1970-01-01') * 86400L + hour(booked_at) * 3600 "
            "+ minute(booked_at) * 60 + second(booked_at)"
        ).alias("epoch"),
    )


def age(t: Tables, *, as_of: date) -> DataFrame:
    """Whole months since sign-up month, and the month component only (0 to 11)."""
    months = dates.month_difference(dates.day(as_of.replace(day=1)), dates.bucket("created_at", "month"))
    return t.users.select("id", months.alias("age_months"), (months % 12).alias("month_component"))


def date_arithmetic(t: Tables) -> DataFrame:
    return t.bookings.select(
        "id",
        F.date_sub("booked_at", 30).alias("a_month_of_days_before"),
        F.add_months("booked_at", 1).alias("a_month_later"),
        F.expr("booked_at - interval '1' hour").alias("an_hour_before"),
        F.expr("booked_at + interval '90' day").alias("ninety_days_later"),
    )


def date_casts(t: Tables, *, start: date | None = None, end: date | None = None) -> DataFrame:
    """Day, its midnight, and a day range with open bounds."""
    day = F.to_date("booked_at")
    return t.bookings.transform(dates.booked_days(start, end)).select(
        "id", day.alias("day"), day.cast("timestamp_ntz").alias("midnight"), (day == F.col("booked_at").cast("date")).alias("same")
    )


def generator(t: Tables, *, as_of: date) -> DataFrame:
    """Number of users that had signed up by each month: one row per user and month since sign-up."""
    months = F.sequence(
        dates.bucket("created_at", "month"), dates.day(as_of.replace(day=1)), F.expr(dates.STEPS["month"])
    )
    return (
        t.users.filter(F.col("created_at") <= dates.ts(as_of))
        .select(F.explode(months).alias("month"))
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("members"))
    )


def day_loop(t: Tables) -> DataFrame:
    """Every day of every tour's schedule."""
    return t.tours.select("id", F.explode(F.sequence("start_date", "end_date")).alias("day"))


def formatting(t: Tables) -> DataFrame:
    at = F.col("booked_at")
    return t.bookings.select(
        "id",
        F.date_format(at, "yyyy-MM-dd").alias("day_text"),
        F.date_format(at, "yyyy-MM").alias("month_text"),
        F.concat(F.date_format(at, "yyyy-"), dates.week_of_year(at)).alias("week_text"),
        F.date_format(at, "yyMMdd").alias("short_text"),
        dates.second_text("booked_at").alias("time_text"),
    )


def string_match(t: Tables) -> DataFrame:
    return t.tours.select(
        "id",
        text.contains_any("RING", "title", "short_description").alias("has_ring"),
        F.col("slug").like("red-%").alias("starts_red"),
        F.col("title").ilike("%l_%g%").alias("wildcards"),
    )


def string_build(t: Tables) -> DataFrame:
    code = F.concat(F.lit("B-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    return t.bookings.select(
        "id",
        code.alias("code"),
        F.substring(code, 3, 12).try_cast("long").alias("number"),
        F.concat_ws("|", F.col("status"), F.col("payment_method")).alias("labels"),
    )


def string_clean(t: Tables) -> DataFrame:
    return t.bot_knowledge.select("conv_id", "turn", text.slugify("question").alias("slug"))


def url_part(t: Tables, *, host: str) -> DataFrame:
    return t.tour_images.select("id", text.image_key("image_url", host).alias("image_key"))


def math(t: Tables) -> DataFrame:
    price, seats = F.col("price").cast("double"), F.col("capacity")
    return t.tours.select(
        "id",
        rounded(price * seats + 1, 2).alias("worth"),
        percent(F.col("booked_count"), seats, 1).alias("booked_percent"),
        F.ceil(seats / F.lit(12)).alias("pages"),
        F.abs(seats - F.col("booked_count")).alias("distance"),
    )


def membership(t: Tables) -> DataFrame:
    """IN list, BETWEEN with both ends, IN subquery."""
    liked = t.favorites.select(F.col("tour_id").alias("id")).distinct()
    return (
        t.tours.filter(F.col("status").isin(*BOOKABLE) & F.col("capacity").between(60, 100))
        .join(liked, "id", "left_semi")
        .select("id", "status", "capacity")
    )


def json_array(t: Tables) -> DataFrame:
    """A form field given as nothing, a bare value or a JSON list becomes a list and JSON text."""
    method = F.coalesce("payment_method", F.lit("none"))
    field = F.when(F.col("id") % 3 == 1, method).when(
        F.col("id") % 3 == 2, F.to_json(F.array(method, F.lit("x,y")))
    )
    rows = t.bookings.select("id", field.alias("field")).select("id", text.as_list("field").alias("items"))
    return rows.select(
        "id",
        F.size("items").alias("item_count"),
        F.try_element_at("items", F.lit(1)).alias("first_item"),
        F.to_json("items").alias("json"),
    )


def hash_id(t: Tables) -> DataFrame:
    return t.bookings.select(
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("digest"),
        text.random_number(F.to_date("booked_at"), F.col("id"), F.col("user_id")).alias("number"),
    )


def js_coercion(t: Tables) -> DataFrame:
    """Leading integer of a text, zero when there is none."""
    digits = F.regexp_extract("payment_method", r"^\s*([+-]?\d+)", 1)
    return t.bookings.select("id", F.coalesce(digits.try_cast("long"), F.lit(0)).alias("number"))


def period_labels(t: Tables) -> DataFrame:
    """Bookings per chart label of every period; the days are folded first."""
    daily = t.bookings.groupBy(F.to_date("booked_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    labels = [
        F.struct(F.lit(p).alias("period"), dates.period_label("day", p).alias("label")) for p in dates.STEPS
    ]
    return (
        daily.select("n", F.inline(F.array(*labels)))
        .groupBy("period", "label")
        .agg(F.sum("n").alias("bookings"))
    )
