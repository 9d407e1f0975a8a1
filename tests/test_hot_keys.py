"""Operators that must split hot keys, against brute force."""

import random
import statistics
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sojourn.functions import numbering, skew
from sojourn.operators import availability, catalog
from sojourn.operators import bookings as lists
from tests.frames import booking, rows, tables

DAY = date(2001, 6, 15)


@pytest.mark.parametrize("seed", range(3))
def test_exact_median(spark, seed):
    rng = random.Random(seed)
    data = []
    for key, n in (("hot", 3000), ("even", 10), ("one", 1), ("same", 7)):
        for _ in range(n):
            value = 12345 if key == "same" else int(rng.lognormvariate(8, 2 + seed))
            data.append((key, Decimal(value) / 100))
    data.append(("hot", Decimal(10**13)))
    df = spark.createDataFrame(data, "k string, v decimal(18,2)")
    want = {k: statistics.median([v for key, v in data if key == k]) for k in ("hot", "even", "one", "same")}
    for few in (True, False):
        got = {r.k: r.m for r in numbering.exact_median(df, ["k"], "v", "m", few_keys=few, bits=4 if seed else 18).collect()}
        assert got == {k: pytest.approx(float(v), abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_spread_and_nothing_else_changes(spark, how):
    left = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3, i % 2) for i in range(500)], "id int, k int, j int")
    right = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (9, 0, "d"), (None, 0, "e")], "k int, j int, v string")
    want = left.join(right, ["k", "j"], how)
    for hot_rows in (1, 20, 80, 10**6):
        got = skew.join_hot(left, right, ["k", "j"], how, hot_rows=hot_rows)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, *want.columns) == rows(want, *want.columns)


def test_operators_with_every_key_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    test_admission_equals_brute_force(spark, 0)
    test_similar_tours_equal_all_pairs(spark)
    test_confirmed_bookings_take_seats(spark)


def test_exact_median_of_negative_values(spark):
    rng = random.Random(3)
    values = [Decimal(rng.randint(-(10**9), 10**6)) / 100 for _ in range(801)]
    for some in (values, values[:-1], [Decimal(v) for v in (-5, -1, 0, 4)], [Decimal(-3)]):
        df = spark.createDataFrame([("a", v) for v in some], "k string, v decimal(18,2)")
        for bits in (2, 18):
            got = numbering.exact_median(df, ["k"], "v", "m", bits=bits).collect()[0].m
            assert got == pytest.approx(float(statistics.median(some)), abs=1e-9)


def test_running_number_over_tasks(spark):
    data = [(i, "hot" if i % 3 else "cold", i % 2 or None) for i in random.Random(1).sample(range(5000), 900)]
    df = spark.createDataFrame(data, "id long, k string, half int")
    got = numbering.running_number(df.repartition(9), ["k", "half"], "id", "n")
    seen: dict = {}
    want = []
    for i, k, half in sorted(data):
        seen[k, half] = seen.get((k, half), 0) + 1
        want.append((i, seen[k, half]))
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == want


def test_first_rows_for_large_k(spark):
    df = spark.range(5000).selectExpr("id", "id % 2 k", "id * 7919 % 5003 v")
    got = numbering.first_rows(df, ["k"], [F.asc("v")], 1500)
    want = numbering.first_rows(df, ["k"], [F.asc("v")], 900)
    assert rows(got.groupBy("k").count(), "k", "count") == [(0, 1500), (1, 1500)]
    assert rows(got.filter("rank <= 900"), "id", "rank") == rows(want, "id", "rank")


def _brute(seats: dict, requests: list[tuple]) -> set[int]:
    left, taken = dict(seats), set()
    for rid, tour, day, people, at in sorted(requests, key=lambda r: (r[4], r[0])):
        if 1 <= people <= 20 and tour in left and people <= left.setdefault((tour, day), left[tour]):
            left[tour, day] -= people
            taken.add(rid)
    return taken


def _request_frame(spark, requests):
    return spark.createDataFrame(
        requests, "request_id long, tour_id long, tour_date date, people int, arrived_at timestamp_ntz"
    )


def test_admission_in_order(spark):
    t = tables(spark, tours=[{"id": 1, "capacity": 9, "price": Decimal(10), "discount_price": Decimal(8)}])
    at = datetime(2001, 1, 1)
    made = [(i, 1, DAY, p, at + timedelta(hours=i)) for i, p in enumerate((3, 5, 2, 4))]
    got = availability.admit_bookings(t, _request_frame(spark, made))
    assert rows(got, "request_id", "accepted", "reason", "total_price") == [
        (0, True, None, Decimal(24)), (1, True, None, Decimal(40)),
        (2, False, "Slots taken by earlier requests", None), (3, False, "Slots taken by earlier requests", None),
    ]


@pytest.mark.parametrize("seed", range(4))
def test_admission_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    seats = {tour: rng.choice([0, 5, 30, 80]) for tour in range(1, 8)}
    t = tables(spark, tours=[{"id": i, "capacity": c, "price": Decimal(10)} for i, c in seats.items()])
    made = []
    for rid in range(1500):
        # A third of all requests want one tour on one day.
        tour, day = (1, DAY) if rng.random() < 0.33 else (rng.randint(1, 9), DAY + timedelta(days=rng.randint(0, 3)))
        made.append((rid, tour, day, rng.randint(0, 22), datetime(2001, 1, 1) + timedelta(minutes=rng.randint(0, 500))))
    got = availability.admit_bookings(t, _request_frame(spark, made))
    assert got.count() == len(made)
    assert {r.request_id for r in got.filter("accepted").collect()} == _brute(seats, made)


def test_confirmed_bookings_take_seats(spark):
    t = tables(
        spark, tours=[{"id": 1, "capacity": 5, "start_date": DAY, "end_date": DAY + timedelta(days=2), "price": Decimal(1)}],
        bookings=[booking(1, people=3), booking(2, people=2, status="pending"), booking(3, people=5, at="2001-06-16T08:00:00")],
    )
    assert rows(availability.available_dates(t), "tour_date", "available_slots") == [(DAY, 2), (DAY + timedelta(days=2), 5)]
    wanted = _request_frame(spark, [(1, 1, DAY, 3, datetime(2001, 1, 1)), (2, 1, DAY + timedelta(days=3), 1, datetime(2001, 1, 1)),
                                    (3, 7, DAY, 1, datetime(2001, 1, 1))])
    assert rows(availability.check_availability(t, wanted), "request_id", "available", "reason") == [
        (1, False, "Not enough slots"), (2, True, None), (3, False, "Tour not found"),
    ]
    assert rows(availability.within_schedule(t, wanted), "request_id", "available", "reason") == [
        (1, True, None), (2, False, "Date is outside tour schedule"),
    ]


def test_similar_tours_equal_all_pairs(spark):
    rng = random.Random(5)
    made = [{"id": i, "title": f"t{i}", "status": rng.choice(["available", "cancelled"]),
             "created_at": datetime(2001, 1, 1) + timedelta(days=rng.randint(0, 9))} for i in range(60)]
    links = {(i, "hot") for i in range(0, 60, 2)} | {(i, f"c{rng.randint(0, 9)}") for i in range(60)}
    t = tables(spark, tours=made, tour_categories=[{"tour_id": a, "category_id": c} for a, c in links])
    want = []
    for a in made:
        shared = {c for i, c in links if i == a["id"]}
        others = [b for b in made if b["id"] != a["id"] and b["status"] == "available" and any((b["id"], c) in links for c in shared)]
        others.sort(key=lambda b: (b["created_at"], b["id"]), reverse=True)
        want += [(a["id"], b["id"], n + 1) for n, b in enumerate(others[:4])]
    got = rows(catalog.similar_tours(t), "tour_id", "similar_id", "rank")
    assert got == sorted(want, key=repr)


def test_a_hot_tour_and_a_hot_user_are_split_in_row_level_joins(spark):
    n = 300_000
    made = spark.range(n).selectExpr(
        "id", "cast(null as string) booking_number", "if(id % 3 = 0, 1, id % 5000) user_id", "if(id % 3 = 1, 1, id % 5000) tour_id",
        "1 people_count", "cast(id as decimal(18,2)) total_price", "'confirmed' status", "sha2(cast(id as string), 256) payment_method",
        "timestamp_ntz'2001-06-01 00:00:00' booked_at", "cast(null as timestamp_ntz) confirmed_at", "cast(null as timestamp_ntz) cancelled_at",
    )
    t = tables(spark).replace(
        bookings=made,
        tours=spark.range(5000).selectExpr("id", "'t' title", "'s' slug", "'l' location", "current_date() start_date", "current_date() end_date", "1 duration_days"),
        users=spark.range(5000).selectExpr("id", "'n' name", "'e' email"),
    )
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        joined = lists.booking_enriched(t)
        assert len(joined.collect()) == n
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("(skew=true)") == 2
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_running_numbers_of_hashes_and_texts(spark):
    """Sparse 64-bit ids and UUID-like texts; a key with half of the rows lies in many tasks; without keys the whole table is numbered."""
    df = spark.range(3000).select(
        F.xxhash64("id").alias("h"), F.md5(F.col("id").cast("string")).alias("u"), (F.col("id") % 4 > 1).cast("int").alias("k")
    )
    for column in ("h", "u"):
        for keys in (["k"], []):
            got = numbering.running_number(df, keys, column, "n")
            want = df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(column)))
            assert sorted(map(tuple, got.select("h", "n").collect())) == sorted(map(tuple, want.select("h", "n").collect()))
        # Without tasks put together, as they are in small tests.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            dealt = numbering.dealt_by_range(df, ["k", column])
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert dealt.filter("k = 1").select("_task").distinct().count() >= 3
    assert numbering.running_number(df.limit(0), ["k"], "h", "n").count() == numbering.running_number(df.limit(0), [], "h", "n").count() == 0


def test_first_rows_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SHARE_ROWS", 700)
    monkeypatch.setattr(numbering, "SPLIT_KEYS", 1)
    df = spark.range(9000).selectExpr("id", "if(id % 9 < 6, null, id % 9) k", "id * 7919 % 9007 v")
    got = numbering.first_rows(df, ["k"], [F.asc("v")], 1200)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v"))).filter("rank <= 1200")
    assert rows(got, "id", "k", "rank") == rows(want, "id", "k", "rank")


def test_the_list_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    left = spark.range(400).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = skew.join_hot(left, right, ["k"], hot_rows=5)
    assert got.count() == 400 and got.filter("w <> 2 * k").count() == 0


def test_a_category_joins_its_tours_as_one_list(spark, monkeypatch):
    """A hot category's links stay one row each in the join, however many tours the category offers them."""
    made = [{"id": i, "title": f"t{i}", "status": "available", "created_at": datetime(2001, 1, 1) + timedelta(days=i)} for i in range(40)]
    t = tables(spark, tours=made, tour_categories=[{"tour_id": i, "category_id": "hot"} for i in range(40)])
    joined = []

    def join(links, other, *more):
        out = skew.join_hot(links, other, *more)
        joined.append(out.count())
        return out

    monkeypatch.setattr(catalog, "join_hot", join)
    got = rows(catalog.similar_tours(t), "tour_id", "similar_id", "rank")
    newest = {i: [j for j in range(39, -1, -1) if j != i][:4] for i in range(40)}
    assert got == sorted([(i, j, k + 1) for i, js in newest.items() for k, j in enumerate(js)], key=repr)
    assert joined == [40]
