"""Commits over several tables, and counters maintained by change rows."""

import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sojourn.functions import dates, shared
from sojourn.operators import changes
from sojourn.sources import warehouse
from tests.frames import booking, frame, rows, tables

T = [datetime(2001, 7, day) for day in range(1, 9)]


def lake(spark, root):
    t = tables(
        spark, tours=[{"id": 1}, {"id": 2}, {"id": 3}], bookings=[booking(1, tour_id=1, status="cancelled")],
        tour_images=[{"id": i, "tour_id": i} for i in (1, 2, 3)], favorites=[{"user_id": 1, "tour_id": 2}],
        tour_categories=[{"tour_id": 2, "category_id": "a"}, {"tour_id": 3, "category_id": "a"}],
    )
    return warehouse.publish_set({name: getattr(t, name) for name in t.names()}, root)


def ids(t):
    return {name: rows(getattr(t, name), "tour_id" if name != "tours" else "id") for name in ("tours", *changes.TOUR_CHILDREN)}


def test_deletes_are_one_commit(spark, tmp_path):
    root = str(tmp_path)
    assert warehouse.commit_number(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        warehouse.load_set(spark, root)
    assert lake(spark, root) == 1
    old = warehouse.load_set(spark, root)
    before = ids(old)
    gone = spark.createDataFrame([(1,), (2,)], "id long")
    assert warehouse.publish_deletes(spark, root, gone) == 2
    after = ids(warehouse.load_set(spark, root))
    # Tour 1 has a booking; all of tour 2 is gone.
    assert after["tours"] == [(1,), (3,)] == after["tour_images"] and after["favorites"] == [] and after["tour_categories"] == [(3,)]
    # Who began to read before reads on; earlier commits can be read; tables that were not written are those of the commit before.
    assert ids(old) == before == ids(warehouse.load_set(spark, root, 1))
    assert rows(warehouse.load_set(spark, root).bookings, "id") == [(1,)]
    assert len(glob.glob(f"{root}/bookings/c*")) == 1


def test_a_failure_between_two_tables_is_never_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    lake(spark, root)
    before = ids(warehouse.load_set(spark, root))
    write, done = warehouse._write, []

    def fails(df, table, path, mode="errorifexists"):
        if len(done) == 2:
            raise OSError("the disk is full")
        done.append(table)
        write(df, table, path, mode)

    monkeypatch.setattr(warehouse, "_write", fails)
    gone = spark.createDataFrame([(2,), (3,)], "id long")
    with pytest.raises(OSError, match="full"):
        warehouse.publish_deletes(spark, root, gone)
    # Two of five tables are written, and readers see none of it.
    assert len(done) == 2 and ids(warehouse.load_set(spark, root)) == before and warehouse.commit_number(spark, root) == 1
    monkeypatch.setattr(warehouse, "_write", write)
    assert warehouse.publish_deletes(spark, root, gone) == 2
    assert ids(warehouse.load_set(spark, root)) == {"tours": [(1,)], "tour_images": [(1,)], "tour_categories": [], "tour_amenities": [], "favorites": []}


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path)
    lake(spark, root)
    one = frame(spark, "tours", {"id": 7})
    assert warehouse.publish_set({"tours": one}, root, after=1) == 2
    with pytest.raises(FileExistsError):
        warehouse.publish_set({"tours": frame(spark, "tours", {"id": 8})}, root, after=1)
    assert rows(warehouse.load_set(spark, root).tours, "id") == [(7,)]


CHANGES = "id long, new_status string, changed_at timestamp_ntz, seq long, reason string"


def batch(spark):
    return spark.createDataFrame(
        [(1, "cancelled", T[0], 1, None), (1, "confirmed", T[1], 2, None), (2, "cancelled", T[0], 1, None), (2, "cancelled", T[2], 2, None),
         (3, "completed", T[0], 1, None), (4, "gone", T[0], 1, None), (5, "cancelled", T[0], 1, None), (99, "cancelled", T[0], 1, None)], CHANGES,
    )


def held(spark):
    return frame(
        spark, "bookings", booking(1, people=2), booking(2, people=3), booking(3, status="cancelled", people=4, tour_id=2), booking(4, people=5),
        booking(5, status=None, people=6), booking(6, people=7, tour_id=3), booking(7, people=1, tour_id=4, at="2001-09-01"),
    )


def test_counters_follow_the_batch(spark):
    old = held(spark)
    made = batch(spark)
    deltas = changes.batch_deltas(old, made)
    assert rows(deltas, "tour_id", "delta") == [(1, -3), (2, 4)]
    whole = changes.transition_deltas(old, changes.status_transition(old, made)).groupBy("tour_id").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    assert rows(deltas, "tour_id", "delta") == rows(whole, "tour_id", "delta")
    real = old.filter("status <> 'cancelled'").groupBy(F.col("tour_id").alias("id")).agg(F.sum("people_count").alias("booked_count"))
    tours = frame(spark, "tours", *[{"id": i} for i in range(1, 6)]).drop("booked_count").join(real, "id", "left").fillna(0, ["booked_count"])
    t = tables(spark).replace(tours=changes.booked_count_fold(tours, deltas), bookings=changes.status_transition(old, made))
    assert changes.counter_drift(t).count() == 0
    # The same batch again finds nothing to change, and new bookings add their people.
    assert changes.batch_deltas(t.bookings, made).count() == 0
    fresh = frame(spark, "bookings", booking(20, people=4, tour_id=5), booking(21, people=9, tour_id=5, status="cancelled"))
    t = t.replace(tours=changes.booked_count_fold(t.tours, changes.inserted_deltas(fresh)), bookings=t.bookings.unionByName(fresh))
    assert changes.counter_drift(t).count() == 0 and rows(t.tours.filter("id = 5"), "booked_count") == [(4,)]


def test_a_batch_that_knows_the_month_reads_no_other(spark, tmp_path):
    warehouse.publish(held(spark), str(tmp_path), "bookings")
    stored = warehouse.load_tables(spark, str(tmp_path)).bookings
    made = batch(spark).withColumn(dates.MONTH, F.lit("2001-06-01").cast("date"))
    deltas = changes.batch_deltas(stored, made)
    assert rows(deltas, "tour_id", "delta") == [(1, -3), (2, 4)]
    plan = deltas._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and plan.count("FileScan parquet") == plan.count("booked_month") or "PartitionFilters: [isnotnull(booked_month" in plan


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        shared.shared_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared.shared_folder(Session())
