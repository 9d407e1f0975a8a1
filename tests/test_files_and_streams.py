"""File sinks, versioned tables, streaming jobs and plan shapes."""

import csv
import glob
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.operators import bookings as lists
from sojourn.operators import availability, catalog, customers, documents, kpis, quality, revenue, tours
from sojourn.plans import QUERIES
from sojourn.schemas import SCHEMAS
from sojourn.sources import exports, warehouse
from sojourn.sources.testdata import live, load_testdata
from sojourn.streaming import jobs
from tests.frames import booking, frame, rows, tables


def test_csv_escapes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "line\nbreak", "x")], "id int, text string, more string")
    path = str(tmp_path / "csv")
    exports.sink_csv(df.coalesce(1), path)
    with open(glob.glob(f"{path}/*.csv")[0], newline="") as file:
        assert list(csv.reader(file)) == [["id", "text", "more"], ["1", 'a "b", c', ""], ["2", "line\nbreak", "x"]]


def test_report_with_its_header(spark, tmp_path):
    t = tables(spark, bookings=[booking(1, booking_number="n1", at="2001-06-15T10:20:30")],
               users=[{"id": 1, "name": "Ann, A."}], tours=[{"id": 1, "title": "Hill"}])
    path = str(tmp_path / "report")
    start, end = dates.last_days(date(2001, 7, 1))
    exports.sink_report(lists.report_bookings(t, start=start.date(), end=end.date()).coalesce(1), path)
    with open(glob.glob(f"{path}/*.csv")[0], newline="") as file:
        assert list(csv.reader(file)) == [list(exports.REPORT_HEADER), ["n1", "Ann, A.", "Hill", "100.00", "confirmed", "2001-06-15 10:20:30"]]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "json")
    exports.sink_json(spark.createDataFrame([(1, None)], "id int, text string"), path)
    lines = [line for f in glob.glob(f"{path}/*.json") for line in open(f)]
    assert [json.loads(x) for x in lines] == [{"id": 1, "text": None}]


def test_warehouse_round_trip_and_pruning(spark, tmp_path):
    root = str(tmp_path)
    made = frame(spark, "bookings", booking(1, at="2001-05-31"), booking(2, at="2001-06-01"), booking(3, at="2001-06-30T23:59:59"))
    warehouse.publish(made, root, "bookings")
    with pytest.raises(Exception, match="exists"):
        warehouse.publish(made, root, "bookings")
    t = warehouse.load_tables(spark, root)
    assert rows(t.bookings, *made.columns) == rows(made, *made.columns)
    june = warehouse.in_months(t.bookings, date(2001, 6, 1), date(2001, 6, 30))
    kpi = kpis.kpi_window(t.replace(bookings=june), start=date(2001, 6, 1), end=date(2001, 6, 30))
    assert kpi.collect()[0].total_bookings == 1
    plan = kpi._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(booked_month" in plan
    assert "PushedFilters: [IsNotNull(booked_at), GreaterThanOrEqual(booked_at" in plan
    read = plan[plan.rindex("ReadSchema") :]
    assert "special_requests" not in read and "people_count" not in read


def test_operators_on_a_published_warehouse(spark, sf_dir, tmp_path):
    made = load_testdata(spark, sf_dir)
    for name, schema in SCHEMAS.items():
        source = getattr(made, name)
        full = spark.createDataFrame([], schema).unionByName(source, allowMissingColumns=True).select(*schema.names)
        warehouse.publish(full, str(tmp_path), name)
    t = warehouse.load_tables(spark, str(tmp_path))
    year = {"start": date(2000, 9, 1), "end": date(2001, 8, 31)}
    for run in (
        lambda x: revenue.revenue_trend(x, **year),
        lambda x: customers.clv(x),
        lambda x: tours.tour_performance(x, **year),
        lambda x: catalog.browse_tours(x, search="tour"),
        lambda x: documents.flatten(documents.tour_document(x)),
        lambda x: availability.available_dates(x),
        lambda x: quality.dq_foreign_keys(x),
        lambda x: lists.user_upcoming(x, as_of=date(2001, 8, 1)),
    ):
        want = run(made)
        assert rows(run(t), *want.columns) == rows(want, *want.columns)


def test_a_busy_month_is_written_by_many_tasks(spark, tmp_path):
    busy = spark.range(200_000).selectExpr(
        "id", "concat('CT-', id) booking_number", "id user_id", "id tour_id", "sha2(cast(id as string), 256) special_requests",
        "timestamp_ntz'2001-06-01 00:00:00' + if(id % 50 = 0, id % 300, id % 30) * interval '1' day booked_at",
    )
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        path = warehouse.publish(busy, str(tmp_path), "bookings")
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)
    assert len(glob.glob(f"{path}/booked_month=2001-06-01/*.parquet")) > 5
    assert len(glob.glob(f"{path}/booked_month=2001-09-01/*.parquet")) <= 2
    assert spark.read.parquet(path).count() == 200_000


def test_late_hours_are_dropped_and_the_rest_equals_the_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    t = live(load_testdata(spark, sf_dir))
    t.bookings.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(t.bookings.schema).parquet(source)
    query = (
        jobs.stream_hourly_sales(stream).writeStream.outputMode("append").format("memory").queryName("hourly")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("hourly")
    batch = revenue.sales_by_hour(t, now=datetime(2024, 1, 31), hours=24 * 40)
    last = batch.agg(F.max("hour")).first()[0]
    closed = batch.filter(F.col("hour") < F.lit(last) - F.expr("interval '2' hour"))
    assert rows(got, "hour", "bookings", "revenue") == rows(closed, "hour", "bookings", "revenue")


def test_daily_counters(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    t = live(load_testdata(spark, sf_dir))
    t.bookings.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(t.bookings.schema).parquet(source)
    query = (
        jobs.stream_user_days(stream).writeStream.outputMode("update").format("memory").queryName("today")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # The last row of each day and customer counts.
    last = spark.table("today").groupBy("day", "user_id").agg(F.max("bookings").alias("bookings"), F.max("revenue").alias("revenue"))
    names = ("day", "bookings_today", "revenue_today", "customers_today")
    assert rows(jobs.day_counters(last), *names) == rows(jobs.stream_today_counters(t.bookings), *names)


def test_windows_prune_month_folders(spark, sf_dir, tmp_path):
    root = str(tmp_path / "lake")
    t = load_testdata(spark, sf_dir)
    for name in ("bookings", "tours", "users"):
        warehouse.publish(getattr(t, name), root, name)
    lake = warehouse.load_tables(spark, root)
    w = {"start": datetime(2001, 3, 5), "end": datetime(2001, 5, 20)}
    for report in (
        lambda x: revenue.revenue_trend(x, **w), lambda x: revenue.revenue_by_tour(x, **w), lambda x: kpis.kpi_window(x, **w),
        lambda x: revenue.revenue_comparison(x, **w, prev_start=datetime(2000, 1, 1), prev_end=datetime(2000, 2, 1)),
        lambda x: kpis.dashboard_bookings(x, as_of=w["end"].date()), lambda x: revenue.seasonal_by_tour(x, as_of=w["end"].date(), months=3),
    ):
        got = report(lake)
        plan = got._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "booked_month" in x]
        assert scans and all("PartitionFilters: []" not in x for x in scans)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, report(t).collect()))


def test_jdbc_reads_keep_zoneless_times_and_refuse_one_task(spark):
    class Reader:
        def __init__(self, rows):
            self.rows, self.set = rows, {}

        def format(self, name):
            return self

        def options(self, **given):
            self.set |= given
            return self

        def load(self):
            return self.rows

    columns = "id string, booked_at string, booking_number string, user_id string, tour_id string, people_count string, total_price string"
    source = Reader(spark.createDataFrame([("7", "2001-01-01 10:00:00", "n", "1", "2", "3", "4.50")], columns))
    bounds = {"bookings": ("2000-01-01", "2002-01-01")}
    t = warehouse.load_jdbc(spark, "jdbc:x", {}, tasks=4, bounds=bounds, reader_of=lambda s: source)
    kinds = dict(t.bookings.dtypes)
    assert kinds["id"] == "bigint" and kinds["booked_at"] == "timestamp_ntz" and kinds["total_price"] == "decimal(18,2)"
    # What the source lacks is null, but for columns that may not be.
    assert list(kinds) == SCHEMAS["bookings"].names and t.bookings.first()["trip_vibe"] is None
    with pytest.raises(ValueError, match="tours lacks .*slug"):
        t.tours
    assert source.set["preferTimestampNTZ"] == "true" and source.set["partitionColumn"] == "booked_at" and source.set["numPartitions"] == "4"
    with pytest.raises(ValueError, match="favorites"):
        t.favorites


def test_hot_users_are_cut_before_the_shuffle(spark, sf_dir):
    plan = lists.user_recent(load_testdata(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_no_query_multiplies_tables(spark, sf_dir):
    for name, query in QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan, name
