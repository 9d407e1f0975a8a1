"""Streams whose batches come late, again, or fail half way."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sojourn.sources.commits import CommitLog
from sojourn.streaming import jobs, live
from sojourn.streaming.batchlog import BatchLog
from tests.frames import booking, frame, rows

LIVE = "id long, user_id long, total_price decimal(18,2), status string, booked_at timestamp_ntz"
PAYMENT = "event_id long, booking_number string, payment_status string, paid_at timestamp_ntz"
DAY = datetime(2001, 7, 1)


class Arrivals:
    """A folder that rows arrive in, and a stream over it that is started again for each arrival."""

    def __init__(self, spark, folder, schema, start):
        self.spark, self.folder, self.schema, self.start = spark, str(folder), schema, start
        self.all = []

    def come(self, *new):
        self.all += new
        self.spark.createDataFrame(list(new), self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.again()

    def again(self):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        self.start(stream, f"{self.folder}/checkpoint").awaitTermination()

    def forget_last_batch(self):
        """The stream lost what it knew of its last batches' ends, as after a crash between the sink and the checkpoint."""
        ended = sorted(glob.glob(f"{self.folder}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
        for path in ended[-1:]:
            os.remove(path)
            crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
            if os.path.exists(crc):
                os.remove(crc)

    def table(self):
        return self.spark.createDataFrame(self.all, self.schema)


def sale(i, minutes, user=1, price="10.00", status="confirmed"):
    from decimal import Decimal

    return (i, user, Decimal(price), status, DAY + timedelta(minutes=minutes))


@pytest.fixture
def hours(spark, tmp_path):
    log = live.event_log(spark, str(tmp_path / "log"))
    return Arrivals(spark, tmp_path, LIVE, lambda s, c: live.run(live.hour_events(s), log, c)), log


HOUR = ("hour", "bookings", "revenue")


def test_late_rows_are_set_aside_and_their_hours_rebuilt(hours):
    arrivals, log = hours
    arrivals.come(sale(1, 5), sale(2, 50, price="2.50"), sale(3, 70), sale(4, 400), sale(5, 10, status="pending"))
    assert rows(live.hourly_sales(log), *HOUR) == rows(jobs.stream_hourly_sales(arrivals.table().filter("id < 4")), *HOUR)
    # One hour is open still, two that are over get late rows, one of them twice, and a late hour nobody knew comes up.
    arrivals.come(sale(6, 20), sale(6, 20), sale(7, 380), sale(8, 130, user=None), sale(9, 100, price="-1.00"), sale(10, 1000))
    assert rows(live.late_bookings(log), "id") == [(6,), (6,), (8,), (9,)]
    closed = jobs.stream_hourly_sales(arrivals.table()).filter(F.col("hour") < DAY + timedelta(minutes=1000))
    assert rows(live.repaired_hours(log, arrivals.table()), *HOUR) == rows(closed.filter(F.col("hour") < DAY + timedelta(hours=14)), *HOUR)
    assert rows(live.hourly_sales(log).filter(F.col("hour") == DAY), *HOUR) != rows(closed.filter(F.col("hour") == DAY), *HOUR)


def test_a_batch_that_runs_again_changes_nothing(hours):
    arrivals, log = hours
    arrivals.come(sale(1, 5), sale(2, 400))
    arrivals.come(sale(3, 6), sale(4, 800))
    before, late = rows(live.hourly_sales(log), *HOUR), rows(live.late_bookings(log), "id")
    arrivals.forget_last_batch()
    arrivals.again()
    assert rows(live.hourly_sales(log), *HOUR) == before and rows(live.late_bookings(log), "id") == late == [(3,)]


COUNTERS = ("day", "bookings_today", "revenue_today", "customers_today")


def test_running_counters_are_exact_after_every_batch(spark, tmp_path):
    log = live.event_log(spark, str(tmp_path / "log"))
    arrivals = Arrivals(spark, tmp_path, LIVE, lambda s, c: live.run(live.day_events(s), log, c))
    steps = [
        [sale(1, 5), sale(2, 6), sale(3, 60, user=2), sale(4, 61, user=None)],
        [sale(5, 300), sale(6, 301, user=3), sale(7, 302, status="cancelled")],
        [sale(8, 1500), sale(9, 1400, user=2)],
        [sale(10, 1501, user=2), sale(11, 1502)],
    ]
    for step in steps:
        arrivals.come(*step)
        assert rows(live.day_counters(log), *COUNTERS) == rows(jobs.stream_today_counters(arrivals.table()), *COUNTERS)
    # A day later the first day is over: what comes for it is late.
    arrivals.come(sale(12, 5000, user=9))
    arrivals.come(sale(13, 7, user=7), sale(14, 5001, user=9))
    assert rows(live.late_bookings(log), "id") == [(13,)]
    assert rows(live.repaired_days(log, arrivals.table()), *COUNTERS) == rows(jobs.stream_today_counters(arrivals.table()), *COUNTERS)
    before = rows(live.day_counters(log), *COUNTERS)
    log.compact()
    assert rows(live.day_counters(log), *COUNTERS) == before


def paid(event, number, minutes, status="COMPLETE"):
    return (event, number, status, DAY + timedelta(minutes=minutes))


@pytest.fixture
def payments(spark, tmp_path):
    table = live.payment_table(spark, str(tmp_path / "table"))
    return Arrivals(spark, tmp_path, PAYMENT, lambda s, c: live.stream_payments(s, table, c)), table


KNOWN = ("booking_number", "first_paid_at", "last_paid_at")


def test_payments_reach_the_bookings_once(spark, payments):
    arrivals, table = payments
    arrivals.come(paid(1, "a", 1), paid(1, "a", 1), paid(2, "b", 2, "FAILED"))
    first = [("a", DAY + timedelta(minutes=1), DAY + timedelta(minutes=1))]
    assert rows(table.rows(), *KNOWN) == first
    # The same event in a later batch, an earlier payment that comes late by years, and a second one.
    arrivals.come(paid(1, "a", 1), paid(3, "a", -1_000_000), paid(4, "c", 9))
    want = [("a", DAY - timedelta(minutes=1_000_000), DAY + timedelta(minutes=1)), ("c", DAY + timedelta(minutes=9), DAY + timedelta(minutes=9))]
    assert rows(table.rows(), *KNOWN) == want
    arrivals.forget_last_batch()
    arrivals.again()
    assert rows(table.rows(), *KNOWN) == want
    table.compact()
    table.compact()
    arrivals.come(paid(5, "d", 3))
    assert rows(table.rows(), *KNOWN) == [*want, ("d", DAY + timedelta(minutes=3), DAY + timedelta(minutes=3))]
    made = frame(spark, "bookings", *[booking(i, booking_number=n) for i, n in enumerate("abcd")], booking(9, booking_number=None))
    after = live.paid_bookings(made, table)
    assert rows(after, "id", "payment_status") == [(0, "paid"), (1, None), (2, "paid"), (3, "paid"), (9, None)]


def test_repeated_events_are_dropped_before_the_table(payments):
    arrivals, table = payments
    arrivals.come(paid(1, "a", 1), paid(1, "a", 99))
    arrivals.come(paid(1, "a", 500), paid(2, "b", 1))
    written = table.spark.read.parquet(f"{table.folder}/data/*")
    assert written.filter("booking_number = 'a'").count() == 1 and written.filter("booking_number = 'b'").count() == 1


def test_a_failure_before_the_commit_leaves_no_trace(spark, payments, monkeypatch):
    arrivals, table = payments
    arrivals.come(paid(1, "a", 1))
    add = CommitLog.add

    def fails(self, number, entry):
        raise OSError("the file system is away")

    monkeypatch.setattr(CommitLog, "add", fails)
    with pytest.raises(Exception, match="away"):
        arrivals.come(paid(2, "b", 2))
    assert rows(table.rows(), "booking_number") == [("a",)]
    monkeypatch.setattr(CommitLog, "add", add)
    arrivals.again()
    assert rows(table.rows(), "booking_number") == [("a",), ("b",)]


def test_batch_log(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path), "k string, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    assert rows(log.rows(), "k", "n") == []
    log.compact()
    batch = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    log.commit(batch(("a", 1), ("b", 2)), 0)
    log.commit(batch(("a", 50)), 0)
    log.commit(batch(("a", 3)), 1)
    log.commit(batch(), 2)
    for _ in range(2):
        assert rows(log.rows(), "k", "n") == [("a", 4), ("b", 2)]
        log.compact()
    assert rows(log.rows(0), "k", "n") == [("a", 1), ("b", 2)]
    # A number below the compacted ones is known still.
    log.commit(batch(("a", 9)), 1)
    log.commit(batch(("b", 1)), 5)
    assert rows(log.rows(), "k", "n") == [("a", 4), ("b", 3)]


def test_numbered_commits(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.numbers() == [] and log.latest() is None
    log.add(3, {"path": "é"})
    log.add(10, {"path": "x"})
    with pytest.raises(FileExistsError):
        log.add(3, {"path": "other"})
    assert log.numbers() == [3, 10] and log.read(3) == {"path": "é"} and log.latest(9) == (3, {"path": "é"}) and log.latest() == (10, {"path": "x"})
    assert [n for n in os.listdir(tmp_path / "log") if n.startswith(".") and not n.endswith(".crc")] == []


def test_customers_of_a_day_share_their_state(spark, tmp_path):
    """A batch adds to a day's counters by shares of its customers, not by each customer."""
    log = live.event_log(spark, str(tmp_path / "log"))
    arrivals = Arrivals(spark, tmp_path, LIVE, lambda s, c: live.run(live.day_events(s), log, c))
    arrivals.come(*[sale(i, i, user=i % 150) for i in range(200)], sale(900, 5, user=None))
    arrivals.come(*[sale(1000 + i, 300 + i, user=100 + i) for i in range(100)], sale(901, 310, user=None))
    assert rows(live.day_counters(log), *COUNTERS) == rows(jobs.stream_today_counters(arrivals.table()), *COUNTERS)
    assert log.rows().filter("kind = 'change'").count() <= 2 * live.SHARES
    assert log.rows().agg(F.sum("customers")).first()[0] == 200
