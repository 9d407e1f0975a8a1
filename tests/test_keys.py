"""Tables whose keys are UUIDs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sojourn.operators import bookings as lists
from sojourn.operators import customers, documents, quality, revenue, tours
from sojourn.functions.dates import period_window
from sojourn.plans.sources import as_uuids
from sojourn.sources import warehouse
from sojourn.sources.commits import CommitLog
from sojourn.sources.keys import KeyDictionary, with_whole_numbers
from sojourn.sources.testdata import load_testdata
from sojourn.tables import Tables
from tests.frames import rows

USER, TOUR = "0000000A-0000-4000-8000-{:012x}", "0000000b-0000-4000-8000-{:012x}"


def small(spark, users, bookings):
    return Tables.of(
        spark,
        users=spark.createDataFrame([(USER.format(i), f"2001-01-{31 - i:02d} 00:00:00") for i in users], "id string, created_at string"),
        tours=spark.createDataFrame([(TOUR.format(1), USER.format(9), None)], "id string, created_by string, created_at string"),
        bookings=spark.createDataFrame(
            [(f"0000000c-0000-4000-8000-{i:012x}", USER.format(u) if u else None, TOUR.format(1), "2001-02-01 00:00:00") for i, u in bookings],
            "id string, user_id string, tour_id string, booked_at string",
        ),
    )


def test_numbers_stay_and_follow_each_other(spark, tmp_path):
    dictionary = KeyDictionary(spark, str(tmp_path))
    dictionary.learn(small(spark, [1, 2], [(1, 1), (2, 5)]))
    users = lambda: dict(rows(dictionary.keys("users"), "uuid", "key"))
    name = lambda i: USER.format(i).lower()
    # By the time they were made; then those that are only named, by a tour and by a booking.
    assert users() == {name(2): 1, name(1): 2, name(5): 3, name(9): 4}
    dictionary.learn(small(spark, [1, 2, 5, 7], [(1, 1), (3, 7), (4, None)]))
    assert users() == {name(2): 1, name(1): 2, name(5): 3, name(9): 4, name(7): 5}
    assert dictionary.learn(small(spark, [7], [])) == 2 and len(users()) == 5
    loaded = with_whole_numbers(small(spark, [1], [(1, 1), (2, 5), (4, None), (5, 77)]), dictionary)
    assert sorted(map(repr, (tuple(r) for r in loaded.bookings.select("id", "user_id", "tour_id").collect()))) == sorted(
        map(repr, [(1, 2, 1), (2, 3, 1), (4, None, 1), (None, None, 1)])
    )
    assert dict(loaded.bookings.dtypes)["id"] == "bigint" and rows(dictionary.named(loaded.users, {"id": "users"}), "id") == [(name(1),)]


def test_a_failed_load_gives_no_numbers(spark, tmp_path, monkeypatch):
    dictionary = KeyDictionary(spark, str(tmp_path))
    add = CommitLog.add
    monkeypatch.setattr(CommitLog, "add", lambda self, number, entry: (_ for _ in ()).throw(OSError("away")))
    with pytest.raises(OSError):
        dictionary.learn(small(spark, [1], []))
    assert dictionary.keys().count() == 0
    monkeypatch.setattr(CommitLog, "add", add)
    dictionary.learn(small(spark, [1], []))
    assert rows(dictionary.keys("users"), "key") == [(1,), (2,)]


def test_reports_are_those_of_the_twin(spark, sf_dir, tmp_path):
    twin = load_testdata(spark, sf_dir)
    source = as_uuids(twin)
    dictionary = KeyDictionary(spark, str(tmp_path))
    dictionary.learn(source)
    t = with_whole_numbers(source, dictionary)
    w = period_window("month", as_of=date(2001, 8, 1))
    reports = [
        lambda t: revenue.revenue_trend(t, start=w.start, end=w.end), lambda t: customers.customer_segments(t), lambda t: customers.clv(t),
        lambda t: customers.churn(t, as_of=date(2001, 8, 1)), lambda t: tours.category_revenue(t, start=w.start, end=w.end),
        lambda t: quality.dq_foreign_keys(t), lambda t: quality.dq_unique(t),
        lambda t: documents.tour_document(t).select("title", "part", F.size("images").alias("n"), "created_by_name", "amenities"),
        lambda t: lists.booking_enriched(t).select("customer_name", "tour_title", "total_price", "status", "booked_at"),
    ]
    for report in reports:
        got, want = report(t), report(twin)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_uuid_ranges_cut_all_uuids(spark):
    ranges = warehouse.uuid_ranges("k", 5)
    df = spark.range(2000).select(F.expr("uuid(7)").alias("k")).unionByName(spark.createDataFrame([(None,), ("0" * 8 + "-0000-0000-0000-000000000000",), ("f" * 8 + "-ffff-ffff-ffff-ffffffffffff",)], "k string"))
    counts = [df.filter(r).count() for r in ranges]
    assert sum(counts) == 2003 and min(counts) > 300 and warehouse.uuid_ranges("k", 1) == ["(true) or k is null"]


def test_jdbc_reads_uuid_tables_by_ranges(spark):
    asked = {}

    class Reader:
        def format(self, name):
            return self

        def options(self, **given):
            return self

        def jdbc(self, url, name, predicates, properties):
            asked[name] = predicates
            return spark.createDataFrame([(TOUR.format(1), "a")], "tour_id string, category_id string")

    t = warehouse.load_jdbc(spark, "jdbc:x", {}, tasks=3, reader_of=lambda s: Reader(), uuid_keys=True)
    assert rows(t.tour_categories, "tour_id", "category_id") == [(TOUR.format(1), "a")]
    assert len(asked["tour_categories"]) == 3 and "tour_id is null" in asked["tour_categories"][0]


def test_each_table_is_read_once_to_learn_its_keys(spark, tmp_path, monkeypatch, capsys):
    from sojourn.sources import keys

    plans = []

    def running_number(df, *more):
        df.explain()
        plans.append(capsys.readouterr().out)
        return number(df, *more)

    number = keys.running_number
    monkeypatch.setattr(keys, "running_number", running_number)
    KeyDictionary(spark, str(tmp_path)).learn(small(spark, [1, 2], [(1, 1), (2, 5)]))
    # Users, tours and bookings, and the keys known so far.
    assert plans[0].count("Scan") <= 4
