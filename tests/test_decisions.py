"""Edge cases on hand-made rows."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from sojourn.functions import dates, money, text
from sojourn.operators import bookings as lists
from sojourn.operators import catalog, customers, documents, kpis, revenue, tours
from tests.frames import booking, rows, tables

AS_OF = date(2001, 8, 1)


def test_trend_keeps_empty_months_and_conserves_revenue(spark):
    t = tables(spark, bookings=[
        booking(1, at="2001-05-31T23:59:59"), booking(2, at="2001-07-01", price=7), booking(3, at="2001-06-10", status="pending"),
    ])
    got = rows(revenue.revenue_trend(t, start=date(2001, 5, 20), end=date(2001, 7, 2)), "period", "revenue", "bookings")
    assert got == [("2001-05-01", Decimal(100), 1), ("2001-06-01", Decimal(0), 0), ("2001-07-01", Decimal(7), 1)]


def test_reviews_do_not_multiply_bookings(spark):
    t = tables(
        spark,
        tours=[{"id": 1, "title": "a", "price": Decimal(10), "capacity": 5, "status": "available"},
               {"id": 2, "title": "b", "price": Decimal(0), "capacity": 0, "status": "available"}],
        bookings=[booking(1, user_id=1, people=2), booking(2, user_id=1, people=3, status="cancelled", price=50),
                  booking(3, user_id=2, at="2001-06-16"), booking(4, tour_id=2)],
        reviews=[{"id": i, "tour_id": 1, "rating": r, "is_approved": ok} for i, r, ok in ((1, 4, True), (2, 5, True), (3, 1, False))],
    )
    perf = tours.tour_performance(t, start=date(2001, 6, 1), end=date(2001, 6, 30))
    columns = ("id", "bookings", "revenue", "lost_revenue", "unique_customers", "repeat_customers", "avg_rating",
               "review_count", "total_participants", "occupancy_rate", "profitability")
    assert rows(perf, *columns) == [
        # 3 people on 2 days of 5 seats; 200 / (10 * 5)
        (1, 3, Decimal(200), Decimal(50), 2, 1, 4.5, 2, 3, 30.0, 4.0),
        (2, 1, Decimal(100), Decimal(0), 1, 0, None, 0, 1, None, 0.0),
    ]


def test_a_tour_counts_in_each_of_its_categories(spark):
    t = tables(
        spark,
        categories=[{"id": c, "name": c} for c in ("hike", "camp", "empty")],
        tour_categories=[{"tour_id": 1, "category_id": "hike"}, {"tour_id": 1, "category_id": "camp"},
                         {"tour_id": 2, "category_id": "camp"}],
        bookings=[booking(1, user_id=1), booking(2, user_id=1, tour_id=2), booking(3, user_id=2, tour_id=2, price=200)],
    )
    span = {"start": date(2001, 6, 1), "end": date(2001, 7, 1)}
    assert rows(tours.category_revenue(t, **span), "id", "revenue", "bookings") == [
        ("camp", Decimal(400), 3), ("empty", Decimal(0), 0), ("hike", Decimal(100), 1),
    ]
    # User 1 booked two tours of one category and is one customer; shares add up to more than 100.
    assert rows(tours.category_share(t, **span), "id", "customers", "tour_count", "market_share") == [
        ("camp", 2, 2, 100.0), ("hike", 1, 1, 25.0),
    ]
    assert rows(tours.category_share_chart(t, **span), "id", "share") == [("camp", 80.0), ("hike", 20.0)]


def _users(spark, counts: dict[int, int], **more):
    made = [booking(u * 100 + i, user_id=u) for u, n in counts.items() for i in range(n)]
    return tables(spark, users=[{"id": u, "name": f"u{u}"} for u in counts], bookings=made, **more)


def test_segments_at_their_limits(spark):
    t = _users(spark, {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0})
    got = customers.customer_segments(t).collect()
    assert [(r.segment, r.customer_count) for r in got] == [("VIP", 1), ("Regular", 2), ("New", 2)]
    value = rows(customers.clv(t), "customer_type", "segment", "customer_count", "median_value")
    assert value == [("One-time", "New", 1, 100.0), ("Repeat", "New", 1, 200.0), ("Repeat", "Regular", 2, 350.0),
                     ("Repeat", "VIP", 1, 500.0)]


def test_churn_limits_are_exclusive(spark):
    t = tables(
        spark,
        users=[{"id": i} for i in range(1, 6)],
        bookings=[booking(1, user_id=1, at="2001-07-02"), booking(2, user_id=2, at="2001-07-01T23:59:59"),
                  booking(3, user_id=3, at="2001-05-03"), booking(4, user_id=4, at="2001-05-02"),
                  booking(5, user_id=5, status="pending")],
    )
    got = [(r.status, r.customer_count, r.percentage) for r in customers.churn(t, as_of=AS_OF).collect()]
    assert got == [("Active", 1, 25.0), ("At Risk", 2, 50.0), ("Churned", 1, 25.0)]


def test_cohort_month_number_is_a_true_difference(spark):
    t = tables(
        spark,
        users=[{"id": 1, "created_at": datetime(2000, 8, 5)}, {"id": 2, "created_at": datetime(2000, 7, 31)}],
        bookings=[booking(1, at="2001-08-01"), booking(5, at="2001-08-20"), booking(2, at="2000-08-01"), booking(3, at="2000-07-01"), booking(4, user_id=2)],
    )
    got = rows(customers.cohorts(t, as_of=AS_OF), "cohort", "month", "month_number", "active_users")
    assert got == [("2000-08", "2000-08", 0, 1), ("2000-08", "2001-08", 12, 1)]


def test_growth_from_nothing(spark):
    pairs = spark.createDataFrame([(5, 0), (0, 0), (5, 10), (1, 3)], "c long, p long")
    got = [r[0] for r in pairs.select(money.growth(F.col("c"), F.col("p"))).collect()]
    assert got == [100.0, 0.0, -50.0, -66.6667]


def test_empty_window_is_all_zero(spark):
    t = tables(spark)
    row = kpis.kpi_full(t, start=AS_OF, end=AS_OF, prev_start=AS_OF, prev_end=AS_OF).collect()[0]
    assert set(row.asDict().values()) == {0}


def test_returning_customers_and_retention(spark):
    t = tables(spark, bookings=[booking(1), booking(2, status="pending"), booking(3, user_id=2)])
    row = kpis.retention_rate(t, start=date(2001, 6, 1), end=date(2001, 7, 1)).collect()[0]
    assert tuple(row) == (1, 2, 50.0)


def test_funnel_counts_users_once(spark):
    t = tables(
        spark,
        users=[{"id": i, "created_at": datetime(2001, 6, 2)} for i in (1, 2, 3, 4)],
        favorites=[{"user_id": 1, "tour_id": 1, "created_at": datetime(2001, 6, 3)},
                   {"user_id": 3, "tour_id": 1, "created_at": datetime(2001, 6, 3)}],
        bookings=[booking(1), booking(2), booking(3, user_id=2, status="pending")],
    )
    row = kpis.funnel(t, start=date(2001, 6, 1), end=date(2001, 7, 1)).collect()[0]
    assert tuple(row) == (4, 3, 2, 2, 50.0)


def test_end_of_a_bare_date(spark):
    t = tables(spark, bookings=[booking(1, at="2001-06-30"), booking(2, at="2001-06-30T10:00:00")])
    by_time = kpis.kpi_window(t, start=date(2001, 6, 1), end=date(2001, 6, 30)).collect()[0]
    assert by_time.total_bookings == 1
    t = t.replace(tours=tables(spark, tours=[{"id": 1}]).tours, users=tables(spark, users=[{"id": 1}]).users)
    assert lists.report_bookings(t, start=date(2001, 6, 30), end=date(2001, 6, 30)).count() == 2


def test_windows():
    week = dates.period_window("week", date(2001, 8, 1))  # a Wednesday
    assert (week.start, week.prev_start) == (datetime(2001, 7, 29), datetime(2001, 7, 22))
    assert dates.period_window("week", date(2001, 7, 29)).start == datetime(2001, 7, 29)
    year = dates.period_window("month", date(2001, 8, 31))
    assert (year.start, year.prev_start) == (datetime(2000, 9, 1), datetime(1999, 9, 1))
    assert year.prev_end < year.start <= year.end < datetime(2001, 9, 1)
    quarter = dates.period_window("quarter", date(2001, 1, 1))
    assert (quarter.prev_start, quarter.end.date()) == (datetime(2000, 10, 1), date(2001, 3, 31))
    assert dates.trailing_months(date(2001, 8, 1))[0] == datetime(2000, 8, 1)
    assert dates.months_before(date(2001, 3, 31), 1) == date(2001, 2, 28)


def test_calendar_expressions(spark):
    days = spark.createDataFrame([(date(2001, 1, 1),), (date(2001, 1, 8),), (date(2000, 12, 31),), (date(2001, 1, 7),)], "d date")
    got = days.select(dates.week_of_year(F.col("d")), dates.sunday_of("d"), dates.bucket("d", "week"), dates.period_label("d", "week"))
    assert [tuple(r) for r in got.collect()] == [
        ("01", date(2000, 12, 31), date(2001, 1, 1), "Week 1"),
        ("02", date(2001, 1, 7), date(2001, 1, 8), "Week 2"),
        ("53", date(2000, 12, 31), date(2000, 12, 25), "Week 5"),
        ("01", date(2001, 1, 7), date(2001, 1, 1), "Week 1"),
    ]


def test_prices(spark):
    t = tables(spark, tours=[{"id": 1, "price": Decimal(200), "discount_price": Decimal(150)}, {"id": 2, "price": Decimal(80)},
                             {"id": 3, "price": Decimal(0), "discount_price": Decimal(0)}])
    got = rows(catalog.price_projections(t, people=3), "id", "effective_price", "saving", "saving_percent", "order_total")
    assert got == [(1, Decimal(150), Decimal(50), 25, Decimal(450)), (2, Decimal(80), None, None, Decimal(240)),
                   (3, Decimal(0), Decimal(0), None, Decimal(0))]


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("Sea & Sun -- Tour!", "https://img.host.com/v1/tours/a.b.jpg", "CT-010801-00042", "x"),
         ("  A  ", "https://other.org/a/b/c.png", "CT-010801-AB12CD", '["x","y"]'), (None, None, None, " ")],
        "title string, url string, number string, field string",
    )
    got = df.select(
        text.slugify("title"), text.image_key("url", "host"), text.number_sequence("number"), text.as_list("field")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("sea-sun-tour", "v1/tours/a", 42, ["x"]), ("-a-", None, None, ["x", "y"]), (None, None, None, []),
    ]


def test_category_search_and_duplicates(spark):
    t = tables(
        spark,
        tours=[{"id": i, "title": f"t{i}", "status": "available", "created_at": datetime(2001, 1, i), "featured": i == 1,
                "price": Decimal(100 * i), "discount_price": Decimal(50) if i == 3 else None} for i in (1, 2, 3)],
        categories=[{"id": "a", "name": "Hill walk"}, {"id": "b", "name": "Hill run"}],
        tour_categories=[{"tour_id": 2, "category_id": "a"}, {"tour_id": 2, "category_id": "b"}, {"tour_id": 3, "category_id": "a"}],
    )
    assert [r.id for r in catalog.browse_tours(t).collect()] == [1, 3, 2]
    assert [r.id for r in catalog.browse_tours(t, category="hill").collect()] == [3, 2]
    assert [r.id for r in catalog.tours_by_category_name(t, category="hill").collect()] == [3, 2, 2]
    # Effective price against either price.
    assert [r.id for r in catalog.browse_tours(t, price_min=100).collect()] == [1, 2]
    assert [r.id for r in catalog.search_tours(t, min_price=100).collect()] == [3, 2, 1]
    second = catalog.browse_tours(t, page=2, limit=2).collect()
    assert [(r.id, r.total, r.pages) for r in second] == [(2, 3, 2)]
    assert rows(catalog.featured_filter(t, tag="All"), "id", "categories") == [(1, "General")]


def test_keyset_pages_equal_offset_pages(spark):
    t = tables(spark, bookings=[booking(i, at=f"2001-06-{1 + i // 3:02d}") for i in range(20)])
    order = [F.desc("booked_at"), F.desc("id")]
    first = catalog.paginate(t.bookings, order, 1, 7).collect()
    second = catalog.paginate(t.bookings, order, 2, 7).collect()
    after = catalog.page_after(t.bookings, "booked_at", first[-1].booked_at, first[-1].id, 7).collect()
    assert [r.id for r in after] == [r.id for r in second]


def test_user_bookings_of_one_and_of_all(spark):
    t = tables(spark, tours=[{"id": 1, "title": "a"}],
               bookings=[booking(i, user_id=1 + i % 2, at=f"2001-06-{1 + i:02d}") for i in range(20)])
    every = rows(lists.user_bookings(t, page=2, size=4).filter("user_id = 1"), "id", "rank", "total")
    one = rows(lists.user_bookings(t, user_id=1, page=2, size=4), "id", "rank", "total")
    assert one == every and len(one) == 4


def test_documents_cut_long_lists(spark):
    t = tables(
        spark, tours=[{"id": 1, "title": "a"}, {"id": 2, "title": "b"}],
        tour_images=[{"id": 10 - i, "tour_id": 1, "image_url": f"u{i}", "display_order": i} for i in range(5)],
    )
    got = documents.flatten(documents.tour_document(t, part_size=2))
    assert rows(got, "id", "part", "image_count", "images") == [
        (1, 0, 2, "u0 u1"), (1, 1, 2, "u2 u3"), (1, 2, 1, "u4"), (2, 0, 0, None),
    ]


def test_images_that_share_a_display_order_are_cut_by_id(spark):
    made = [{"id": i, "tour_id": 1, "image_url": f"u{i}", "display_order": 0 if i < 19 else 1} for i in range(25)]
    t = tables(spark, tours=[{"id": 1, "title": "a"}], tour_images=made)
    got = documents.tour_document(t, part_size=5).orderBy("part").collect()
    lists = [[i.image_url for i in r.images] for r in got if r.images]
    assert [r.title for r in got] == ["a"] + [None] * (len(got) - 1)
    assert [len(x) for x in lists] == [5] * 5
    assert [u for x in lists for u in x] == [f"u{i}" for i in range(25)]


def test_images_with_large_ids_keep_their_order(spark):
    big = 2**62
    made = [{"id": big + 7 * i, "tour_id": 1, "image_url": f"u{i}", "display_order": 0 if i % 2 else 1} for i in range(9)]
    t = tables(spark, tours=[{"id": 1, "title": "a"}], tour_images=made)
    got = documents.ordered_images(t, part_size=4).orderBy("part").collect()
    assert [[i.image_url for i in r.images] for r in got] == [["u1", "u3", "u5", "u7"], ["u0", "u2", "u4", "u6"], ["u8"]]


def test_users_without_rows_have_zeros(spark):
    t = tables(spark, users=[{"id": 1}, {"id": 2}], bookings=[booking(1, user_id=2)], tours=[{"id": 1, "title": "a"}], favorites=[])
    assert rows(customers.user_stats(t), "user_id", "total_trips") == [(1, 0), (2, 1)]


def test_null_method_and_source(spark):
    t = tables(spark, bookings=[booking(1), booking(2, payment_method="card")], users=[{"id": 1}, {"id": 2, "utm_source": "ads"}])
    span = {"start": date(2001, 6, 1), "end": date(2001, 7, 1)}
    assert rows(revenue.payment_methods(t, **span), "payment_method", "bookings") == [("card", 1), ("unknown", 1)]
    assert rows(customers.referral_sources(t), "source", "signups", "bookings") == [("ads", 1, 0), ("direct", 1, 2)]


def test_moving_average_skips_missing_hours(spark):
    t = tables(spark, bookings=[booking(i, at=f"2001-06-15T{h:02d}:10:00") for i, h in enumerate((1, 1, 5, 6, 7, 7, 7, 9))])
    got = revenue.sales_velocity(t, now=datetime(2001, 6, 15, 12)).collect()
    assert [(r.hour.hour, r.bookings, r.moving_avg_bookings) for r in got] == [
        (9, 1, 1.5), (7, 3, 1.75), (6, 1, 1.33), (5, 1, 1.5), (1, 2, 2.0),
    ]
