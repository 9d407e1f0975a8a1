"""Registered streaming jobs: each runs its stream over files that arrive in turn, some rows late, and returns what readers see."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sojourn.functions.shared import fresh_folder
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY
from sojourn.streaming import live
from sojourn.tables import Tables

# One row in so many comes with the last arrival, however early its time.
STRAGGLERS = 7


def in_arrivals(rows: DataFrame, at: str, folder: str, start: Callable[[DataFrame], StreamingQuery], cuts: tuple[float, ...] = (0.6,)) -> None:
    """Let rows arrive by time in as many parts as the cuts (shares of the time between the first and the last) make, and the
    stragglers at the end; after each part the stream takes what is new."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return
    bounds = [low + (high - low) * c for c in cuts]
    part = F.lit(len(bounds))
    for k, bound in reversed(list(enumerate(bounds))):
        part = F.when(F.col(at) < F.lit(bound), F.lit(k)).otherwise(part)
    dealt = rows.withColumn("_part", F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(STRAGGLERS)) == 0, F.lit(len(bounds))).otherwise(part))
    for k in range(len(bounds) + 1):
        dealt.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/in")
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")).awaitTermination()


LIVE = ("id", "user_id", "total_price", "status", "booked_at")


def _live_hours(t: Tables) -> DataFrame:
    rows, folder = t.live_bookings_src.select(*LIVE), fresh_folder(t.spark, "live-hours")
    log = live.event_log(t.spark, f"{folder}/log")
    in_arrivals(rows, "booked_at", folder, lambda s: live.run(live.hour_events(s), log, f"{folder}/checkpoint"))
    return live.repaired_hours(log, rows)


def _live_days(t: Tables) -> DataFrame:
    rows, folder = t.live_bookings_src.select(*LIVE), fresh_folder(t.spark, "live-days")
    log = live.event_log(t.spark, f"{folder}/log")
    in_arrivals(rows, "booked_at", folder, lambda s: live.run(live.day_events(s), log, f"{folder}/checkpoint"))
    return live.repaired_days(log, rows)


def payment_events(t: Tables) -> DataFrame:
    """Payment events of the bookings, each third a failure, each fifth sent twice."""
    events = t.raw_events.filter("event_type = 'purchase'")
    keys = t.raw_orders.agg(F.max("o_orderkey") + 1).scalar()
    number = F.concat(F.lit("CT-240101-"), F.lpad((F.col("event_id") * 7919 % keys).cast("string"), 9, "0"))
    status = F.when(F.col("event_id") % 3 == 0, "FAILED").otherwise("COMPLETE")
    rows = events.select("event_id", number.alias("booking_number"), status.alias("payment_status"), F.col("ts").alias("paid_at"))
    return rows.withColumn("_times", F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).select(
        *rows.columns, F.explode("_times").alias("sent")
    ).drop("sent")


def _live_payments(t: Tables) -> DataFrame:
    folder = fresh_folder(t.spark, "live-payments")
    table = live.payment_table(t.spark, f"{folder}/table")
    in_arrivals(payment_events(t), "paid_at", folder, lambda s: live.stream_payments(s, table, f"{folder}/checkpoint"))
    table.compact()
    number = F.concat(F.lit("CT-240101-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("booking_number")
    return live.paid_bookings(t.bookings.select("id", number, "payment_status", "payment_method"), table)


register(
    "live_hours",
    _live_hours,
    f"""with b as (select * from live_bookings_src where status='confirmed')
select date_trunc('hour', booked_at) as hour, count(*) bookings, {MONEY} revenue from b
where date_trunc('hour', booked_at) + interval '3' hour <= (select date_trunc('millisecond', max(booked_at)) from b) group by 1""",
)
register(
    "live_days",
    _live_days,
    f"""select cast(booked_at as date) as day, count(*) bookings_today, cast({MONEY} as decimal(28,2)) revenue_today,
  count(distinct user_id) customers_today from live_bookings_src where status='confirmed' group by 1""",
)
register(
    "live_payments",
    _live_payments,
    """with b as (select id, 'CT-240101-'||lpad(cast(id as varchar),9,'0') booking_number, payment_method from bookings),
p as (select 'CT-240101-'||lpad(cast(event_id*7919%(select max(o_orderkey)+1 from orders) as varchar),9,'0') k, min(ts) paid_at
  from events where event_type='purchase' and event_id%3<>0 group by 1)
select id, booking_number, case when k is not null then 'paid' end payment_status,
  case when k is not null then 'payfast' else payment_method end payment_method, p.paid_at from b left join p on k=booking_number""",
)
