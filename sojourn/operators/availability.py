"""Seats per tour and day, and admission of a batch of booking requests.

Requests are a DataFrame (request_id, tour_id, tour_date, people, ...). The seats of a tour on a day are
its capacity less the people of confirmed bookings on that day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.money import effective_price
from sojourn.functions.skew import join_hot
from sojourn.operators.revenue import confirmed
from sojourn.tables import Tables

# Party size a request may have.
MIN_PEOPLE, MAX_PEOPLE = 1, 20
# Requests for one tour and day that are ranked in one share.
SHARE_ROWS = 100_000


def day_load(t: Tables) -> DataFrame:
    """Confirmed people per tour and day."""
    return (
        confirmed(t)
        .groupBy("tour_id", F.to_date("booked_at").alias("tour_date"))
        .agg(F.sum("people_count").alias("booked"))
    )


def _slots(t: Tables, requests: DataFrame, *extra: str) -> DataFrame:
    """One row per requested (tour, day) of an existing tour, with the people asked for in total and the number of requests.
    A tour asked for by a third of all requests is one row here."""
    asked = requests.groupBy("tour_id", "tour_date").agg(F.sum("people").alias("asked"), F.count(F.lit(1)).alias("requests"))
    tours = t.tours.select(F.col("id").alias("tour_id"), "capacity", *extra)
    return (
        asked.join(tours, "tour_id")
        .join(day_load(t), ["tour_id", "tour_date"], "left")
        .withColumn("booked", F.coalesce("booked", F.lit(0)))
        .withColumn("available_slots", F.col("capacity") - F.col("booked"))
    )


def available_slots(t: Tables, requests: DataFrame) -> DataFrame:
    """Seats of each requested (tour, day); a missing tour gives no row."""
    return _slots(t, requests).select("tour_id", "tour_date", "capacity", "booked", "available_slots")


def check_availability(t: Tables, requests: DataFrame) -> DataFrame:
    """Whether each request alone would fit, and why not."""
    joined = join_hot(requests, available_slots(t, requests), ["tour_id", "tour_date"], "left")
    fits = F.coalesce(F.col("people") <= F.col("available_slots"), F.lit(False))
    # The reasons given.
    reason = F.when(F.col("capacity").isNull(), "Tour not found").when(~fits, "Not enough slots")
    return joined.select(
        "request_id", "tour_id", "tour_date", F.col("people").alias("requested"), "capacity", "booked",
        "available_slots", fits.alias("available"), reason.alias("reason"),
    )


def within_schedule(t: Tables, requests: DataFrame) -> DataFrame:
    """Whether each requested day lies in the tour's schedule and has a seat left."""
    slots = _slots(t, requests, "start_date", "end_date")
    joined = join_hot(requests, slots, ["tour_id", "tour_date"])
    inside = F.col("tour_date").between(F.col("start_date"), F.col("end_date"))
    # Fixed value: the reason given.
    return joined.select(
        "request_id", "tour_id", "tour_date",
        (inside & (F.col("available_slots") > 0)).alias("available"),
        F.when(~inside, "Date is outside tour schedule").alias("reason"),
        F.when(inside, F.col("available_slots")).alias("available_slots"),
    )


def available_dates(t: Tables) -> DataFrame:
    """Every scheduled day of every tour that still has seats, with the tour's capacity and running counter."""
    days = t.tours.select(
        F.col("id").alias("tour_id"), "capacity", "booked_count", F.explode(F.sequence("start_date", "end_date")).alias("tour_date")
    )
    left = F.col("capacity") - F.coalesce("booked", F.lit(0))
    return (
        days.join(day_load(t), ["tour_id", "tour_date"], "left")
        .select("tour_id", "tour_date", left.alias("available_slots"), "capacity", "booked_count")
        .filter(F.col("available_slots") > 0)
    )


def admit_bookings(t: Tables, requests: DataFrame) -> DataFrame:
    """First come, first served over a batch: a request is taken when its party still fits after
    all requests taken before it. A refused party leaves room for a later, smaller one.

    Requests need request_id, tour_id, tour_date, people and arrived_at. Days whose requests fit
    together are settled by their sum alone. For an overfull day the seats left never grow,
    so once a party size is refused every later party of that size is too: the parties taken of size p are
    the first few of that size, at most seats / p. Only those are put in order, which bounds a
    day's list by its seats (about 3.6 per seat), however many requests it had.
    """
    valid = F.col("people").between(MIN_PEOPLE, MAX_PEOPLE)
    slots = _slots(t, requests.filter(valid), "price", "discount_price").withColumn(
        "unit_price", effective_price()
    )
    offered = slots.select("tour_id", "tour_date", "asked", "requests", "available_slots", "unit_price")
    known = join_hot(requests, offered, ["tour_id", "tour_date"], "left")
    overfull = known.filter(valid & (F.col("asked") > F.col("available_slots")))
    taken = _admit_overfull(overfull)
    people, seats = F.col("people"), F.col("available_slots")
    accepted = valid & seats.isNotNull() & ((F.col("asked") <= seats) | F.col("taken").isNotNull())
    reason = (
        F.when(~valid, "Invalid party size")
        .when(seats.isNull(), "Tour not found")
        .when(people > seats, "Not enough slots")
        .when(~accepted, "Slots taken by earlier requests")
    )
    return (
        known.join(taken, "request_id", "left")
        .withColumn("accepted", F.coalesce(accepted, F.lit(False)))
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("accepted"), "pending"))
        .withColumn(
            "total_price",
            F.when(F.col("accepted"), (F.col("unit_price") * people).cast("decimal(18,2)")),
        )
        .drop("taken", "asked", "requests", "available_slots", "unit_price")
    )


def _admit_overfull(requests: DataFrame) -> DataFrame:
    """Ids of the requests taken on overfull days."""
    day = ["tour_id", "tour_date"]
    order = [F.asc("arrived_at"), F.asc("request_id")]
    most = F.floor(F.col("available_slots") / F.col("people"))
    rows = requests.filter(F.col("people") <= F.col("available_slots")).select(
        *day, "request_id", "arrived_at", "people", "available_slots", most.alias("most"),
        F.pmod(F.xxhash64("request_id"), F.ceil(F.col("requests") / SHARE_ROWS)).alias("share"),
    )
    # Rank inside shares first, as many as the day has requests for: a share keeps its first seats/p, and they contain those of the whole.
    for keys in ([*day, "people", "share"], [*day, "people"]):
        rows = _first_fitting(rows, keys, order)
    ordered = F.array_sort(F.collect_list(F.struct("arrived_at", "request_id", "people", "rank")))
    days = rows.groupBy(*day).agg(F.max("available_slots").alias("seats"), ordered.alias("queue"))
    none = F.array_repeat(F.lit(0), MAX_PEOPLE)
    start = F.struct(F.col("seats").cast("long").alias("left"), none.alias("taken"))

    def step(state, party):
        """Seats left, and how many parties of each size were taken: always the first of that size."""
        fits = party["people"] <= state["left"]
        more = F.transform(state["taken"], lambda n, i: n + F.when(i + 1 == party["people"], 1).otherwise(0))
        return F.struct(
            F.when(fits, state["left"] - party["people"]).otherwise(state["left"]).alias("left"),
            F.when(fits, more).otherwise(state["taken"]).alias("taken"),
        )

    counted = days.withColumn("counts", F.aggregate("queue", start, step, lambda s: s["taken"]))
    first = F.filter("queue", lambda party: party["rank"] <= F.get("counts", party["people"] - 1))
    return counted.select(F.explode(first["request_id"]).alias("request_id")).withColumn("taken", F.lit(True))


def _first_fitting(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", at).filter(F.col("rank") <= F.col("most"))
