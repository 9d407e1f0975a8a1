"""Live sales and payments that stay exact: running counters, late rows set aside, repeated events without effect.

The sums of an hour, or a day's customers, are kept as state by ``transformWithState``. The operators see the watermark but Spark does not drop rows by
it: the event time reaches them as a plain number, so a row whose hour or day is over comes out as a row of kind ``late`` instead of
vanishing. ``repaired_hours`` and ``repaired_days`` build those hours and days anew from the bookings themselves, and only those.

State is cleared by a timer when its hour or day is over. Hours are kept in ``SHARES`` shares by a hash of the booking, and days by a hash of the
customer, so a busy hour is many keys and a share's customers meet the state store together. Money is whole cents in the state. The session needs the RocksDB state store (``needed_settings``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sojourn.functions import dates
from sojourn.streaming.batchlog import BatchLog

LATE = "2 hours"
# Keys that an hour's sums or a day's customers are kept under.
SHARES = 16
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
_KEPT = "start long, id long, user_id long, at long, cents long"
EVENTS = f"kind string, {_KEPT}, bookings long, customers long"


def needed_settings(spark: SparkSession) -> None:
    """Timers and lists need this state store; another one set by the user is refused by Spark itself."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _confirmed(bookings: DataFrame, late: str, length: int) -> DataFrame:
    """Confirmed bookings with their time and the start of their hour or day as numbers of milliseconds. The watermark
    is on the time, which goes no further itself."""
    rows = bookings.filter(F.col("status") == "confirmed").withColumn("instant", dates.as_instant("booked_at")).withWatermark("instant", late)
    at = F.unix_millis("instant")
    cents = (F.col("total_price") * 100).cast("long")
    return rows.select((at - F.pmod(at, F.lit(length))).alias("start"), F.col("id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user_id"), at.alias("at"), cents.alias("cents"))


def _late_part(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[["start", "id", "user_id", "at", "cents"]].assign(kind="late", bookings=1, customers=0)


_COLUMNS = [f.split()[0] for f in EVENTS.split(", ")]


class _HourSums(StatefulProcessor):
    """Sums of a share of an hour, which come out once, when the watermark has passed the hour."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._sums = handle.getValueState("sums", "bookings long, cents long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[0]) + HOUR_MS
        over = end <= timerValues.getCurrentWatermarkInMs()
        n, cents = self._sums.get() if self._sums.exists() else (0, 0)
        began = n == 0
        for frame in rows:
            if over:
                yield _late_part(frame)[_COLUMNS]
            else:
                n, cents = n + len(frame), cents + int(frame["cents"].sum())
        if not over and n:
            self._sums.update((n, cents))
            if began:
                self._handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, cents = self._sums.get()
        self._sums.clear()
        yield pd.DataFrame([("hour", int(key[0]), None, None, None, cents, n, 0)], columns=_COLUMNS)

    def close(self) -> None:
        pass


class _CustomerDays(StatefulProcessor):
    """The customers of a share who have booked on a day; what each batch adds to the day's counters comes out at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getListState("seen", "user_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[0]) + DAY_MS
        if end <= timerValues.getCurrentWatermarkInMs():
            for frame in rows:
                yield _late_part(frame)[_COLUMNS]
            return
        n, cents, users = 0, 0, set()
        for frame in rows:
            n, cents = n + len(frame), cents + int(frame["cents"].sum())
            # A day's customers are counted by id; bookings without a customer are in the sums alone.
            users.update(frame["user_id"].dropna().astype("int64").tolist())
        began = not self._seen.exists()
        new = users if began else users.difference(x for (x,) in self._seen.get())
        if new:
            self._seen.appendList([(x,) for x in sorted(new)])
            if began:
                self._handle.registerTimer(end)
        yield pd.DataFrame([("change", int(key[0]), None, None, None, cents, n, len(new))], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._seen.clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def hour_events(bookings: DataFrame, late: str = LATE) -> DataFrame:
    """Rows of kind ``hour`` (a share's sums, when the hour is over) and ``late`` (a booking that came after that)."""
    needed_settings(bookings.sparkSession)
    rows = _confirmed(bookings, late, HOUR_MS)
    keyed = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES))).groupBy("start", "share")
    return keyed.transformWithStateInPandas(_HourSums(), EVENTS, "Append", "EventTime")


def day_events(bookings: DataFrame, late: str = LATE) -> DataFrame:
    """Rows of kind ``change`` (what a batch adds to a day's counters) and ``late``."""
    needed_settings(bookings.sparkSession)
    rows = _confirmed(bookings, late, DAY_MS)
    # One key for each customer would be calls to the state store for each of them.
    keyed = rows.withColumn("share", F.pmod(F.xxhash64(F.coalesce("user_id", "id")), F.lit(SHARES))).groupBy("start", "share")
    return keyed.transformWithStateInPandas(_CustomerDays(), EVENTS, "Append", "EventTime")


def event_log(spark: SparkSession, folder: str) -> BatchLog:
    return BatchLog(spark, folder, EVENTS)


def run(events: DataFrame, log: BatchLog, checkpoint: str) -> StreamingQuery:
    """Write the events of all data that is there to a log, each batch once."""
    return events.writeStream.foreachBatch(log.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _start(column: str = "start"):
    return dates.as_clock(F.timestamp_millis(column))


def hourly_sales(log: BatchLog) -> DataFrame:
    """``hour, bookings, revenue`` of the hours that are over, late bookings not among them."""
    hours = log.rows().filter("kind = 'hour'").groupBy("start")
    sums = hours.agg(F.sum("bookings").alias("bookings"), F.sum("cents").alias("cents"))
    return sums.select(_start().alias("hour"), "bookings", (F.col("cents").cast("decimal(28,0)") / 100).cast("decimal(28,2)").alias("revenue"))


def day_counters(log: BatchLog, upto: int | None = None) -> DataFrame:
    """``day, bookings_today, revenue_today, customers_today`` as of the last batch, or of an earlier one; late bookings not among them."""
    days = log.rows(upto).filter("kind = 'change'").groupBy("start")
    sums = days.agg(*[F.sum(c).alias(c) for c in ("bookings", "cents", "customers")])
    return sums.select(
        F.to_date(_start()).alias("day"), F.col("bookings").alias("bookings_today"),
        (F.col("cents").cast("decimal(28,0)") / 100).cast("decimal(28,2)").alias("revenue_today"), F.col("customers").alias("customers_today"),
    )


def late_bookings(log: BatchLog) -> DataFrame:
    """``id, user_id, booked_at, total_price`` of the bookings that came too late for their hour or day, each row as often as it came."""
    late = log.rows().filter("kind = 'late'")
    price = (F.col("cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("total_price")
    return late.select("id", "user_id", dates.as_clock(F.timestamp_millis("at")).alias("booked_at"), price)


def _rebuilt(log: BatchLog, bookings: DataFrame, length: int) -> DataFrame:
    """Confirmed bookings of the hours or days that have late rows, and nothing else of the table."""
    rows = bookings.filter(F.col("status") == "confirmed")
    at = F.unix_millis(dates.as_instant("booked_at"))
    touched = log.rows().filter("kind = 'late'").select("start").distinct()
    return rows.withColumn("start", at - F.pmod(at, F.lit(length))).join(touched, "start", "left_semi")


def repaired_hours(log: BatchLog, bookings: DataFrame) -> DataFrame:
    """``hourly_sales`` with the hours of late bookings built anew from the bookings."""
    rows = _rebuilt(log, bookings, HOUR_MS).groupBy("start").agg(F.count(F.lit(1)).alias("bookings"), F.sum("total_price").cast("decimal(28,2)").alias("revenue"))
    anew = rows.select(_start().alias("hour"), "bookings", "revenue")
    return hourly_sales(log).join(anew.select("hour"), "hour", "left_anti").unionByName(anew)


def repaired_days(log: BatchLog, bookings: DataFrame) -> DataFrame:
    """``day_counters`` with the days of late bookings built anew from the bookings."""
    per_user = _rebuilt(log, bookings, DAY_MS).groupBy("start", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("s"))
    rows = per_user.groupBy("start").agg(F.sum("n").alias("bookings_today"), F.sum("s").cast("decimal(28,2)").alias("revenue_today"), F.count("user_id").alias("customers_today"))
    anew = rows.select(F.to_date(_start()).alias("day"), "bookings_today", "revenue_today", "customers_today")
    return day_counters(log).join(anew.select("day"), "day", "left_anti").unionByName(anew)


# What is known of a booking's payments; both times are folds that a repeated event does not change.
PAYMENTS = "booking_number string, first_paid_at timestamp_ntz, last_paid_at timestamp_ntz"


def _paid_once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("booking_number").agg(F.min("first_paid_at").alias("first_paid_at"), F.max("last_paid_at").alias("last_paid_at"))


def payment_table(spark: SparkSession, folder: str) -> BatchLog:
    """One row for each paid booking, kept up to date by ``stream_payments``."""
    return BatchLog(spark, folder, PAYMENTS, _paid_once)


def stream_payments(payments: DataFrame, table: BatchLog, checkpoint: str, again: str = "1 day") -> StreamingQuery:
    """Upsert completed payment events (event_id, booking_number, payment_status, paid_at) into the table.

    An event that is sent again within ``again`` of its arrival is dropped before anything is written; one that is sent again later changes nothing, since
    the table's columns are least and greatest times. The watermark is on the time of arrival, so no payment is too late.
    """
    needed_settings(payments.sparkSession)
    arrived = payments.filter(F.col("payment_status") == "COMPLETE").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", again)
    once = arrived.dropDuplicatesWithinWatermark(["event_id"])

    def upsert(batch: DataFrame, number: int) -> None:
        paid = batch.select("booking_number", F.col("paid_at").alias("first_paid_at"), F.col("paid_at").alias("last_paid_at"))
        table.commit(_paid_once(paid), number)

    return once.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paid_bookings(bookings: DataFrame, table: BatchLog, method: str = "payfast") -> DataFrame:
    """Bookings with the payments of the table applied; ``paid_at`` is the first time each was paid."""
    paid = table.rows().select(F.col("booking_number").alias("_number"), F.col("first_paid_at").alias("_paid_at"))
    joined = bookings.join(paid, F.col("booking_number") == F.col("_number"), "left")
    hit = F.col("_number").isNotNull()
    changed = {"payment_status": F.lit("paid"), "payment_method": F.lit(method)}
    kept = [F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in bookings.columns if c != "paid_at"]
    return joined.select(*kept, F.col("_paid_at").alias("paid_at"))
