"""Facts that must hold on the test data whatever the numbers are."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sojourn.functions import dates
from sojourn.operators import availability, customers, kpis, revenue, shares, tours
from sojourn.plans import QUERIES
from sojourn.schemas import FOREIGN_KEYS, NOT_NULL, UNIQUE_KEYS
from sojourn.sources.testdata import load_testdata

SPAN = {"start": date(1995, 1, 1), "end": date(2001, 8, 1)}


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return load_testdata(spark, sf_dir)


def test_every_grain_holds_all_confirmed_revenue(t):
    want = revenue.confirmed(t).agg(F.sum("total_price"), F.count(F.lit(1))).first()
    trend = revenue.revenue_trend(t, **SPAN)
    assert trend.count() == 80
    assert tuple(trend.agg(F.sum("revenue"), F.sum("bookings")).first()) == tuple(want)
    for grain, buckets in (("day", 2405), ("week", 345), ("month", 80), ("quarter", 27), ("year", 7)):
        got = revenue.revenue_trend_grain(t, **SPAN, grain=grain)
        assert got.count() == buckets
        assert tuple(got.agg(F.sum("revenue"), F.sum("bookings")).first()) == tuple(want)
    assert revenue.seasonality(t, **SPAN).agg(F.sum("revenue")).first()[0] == want[0]
    methods = revenue.payment_methods(t, **SPAN)
    assert methods.agg(F.sum("revenue")).first()[0] == want[0]


def test_shares_add_up(t):
    total = shares.global_share(t).agg(F.sum("share")).first()[0]
    assert total == pytest.approx(100, abs=0.01)
    assert customers.churn(t, as_of=date(2001, 8, 1)).agg(F.sum("percentage")).first()[0] == pytest.approx(100, abs=0.01)
    chart = tours.category_share_chart(t, **SPAN)
    assert chart.agg(F.sum("share")).first()[0] == pytest.approx(100, abs=0.05 * chart.count())


def test_segments_hold_every_paying_customer(t):
    want = revenue.confirmed(t).agg(F.countDistinct("user_id"), F.sum("total_price")).first()
    for df in (customers.customer_segments(t), customers.clv(t)):
        assert tuple(df.agg(F.sum("customer_count"), F.sum("total_revenue")).first()) == tuple(want)


def test_funnel_narrows(t):
    f = kpis.funnel(t, **SPAN).first()
    assert f.visitors >= f.interested_users >= f.booked_users > 0


def test_admission_never_overfills(t):
    taken = availability.admit_bookings(t, t.requests).filter("accepted").groupBy("tour_id", "tour_date").agg(F.sum("people").alias("n"))
    slots = availability.available_slots(t, t.requests)
    assert taken.join(slots, ["tour_id", "tour_date"]).filter("n > available_slots").count() == 0


def test_counter_of_the_test_data_does_not_drift(t):
    from sojourn.operators.changes import counter_drift

    assert counter_drift(t).count() == 0


def test_windows_of_neighbouring_years_do_not_overlap():
    for period in ("day", "week", "month", "quarter", "year"):
        for as_of in (date(2000, 2, 29), date(2001, 1, 1), date(2001, 12, 31)):
            w = dates.period_window(period, as_of)
            assert w.prev_start < w.prev_end < w.start <= dates.stamp(as_of) <= w.end
            assert (w.start - w.prev_end).total_seconds() == 1e-6


def test_every_rule_finds_its_faults(spark):
    """Each rule has violations where faults were put in, and the two engines count the same (see the oracle)."""
    found = {(r["report"], r["rule"]): r["violations"] for r in QUERIES["dq_faults"](spark, "/root/testdata/sf0.01").collect()}
    rules = sum(map(len, UNIQUE_KEYS.values())) + len(FOREIGN_KEYS) + sum(map(len, NOT_NULL.values())) + 6 + 10 + 2 + 3 + 3
    assert len(found) == rules and [rule for rule, n in found.items() if n == 0] == []
