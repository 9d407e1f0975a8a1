"""Registered revenue queries."""

from __future__ import annotations

from datetime import date

from sojourn.operators import revenue as op
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY, avg, div, pct
from sojourn.plans.windows import AS_OF, AS_OF_SQL, BOTH, IN_PREV, IN_SPAN, IN_SPAN13, NOW, NOW_SQL, SPAN, SPAN13
from sojourn.sources.testdata import live

AVG = avg("total_price")

register(
    "revenue_trend",
    lambda t: op.revenue_trend(t, **SPAN),
    f"""
with cal as (select cast(unnest(generate_series(timestamp '2000-09-01', timestamp '2001-08-01', interval 1 month)) as date) m),
f as (select cast(date_trunc('month', booked_at) as date) m, {MONEY} revenue, count(*) n
      from bookings where status='confirmed' group by 1)
select strftime(cal.m, '%Y-%m-%d') period, coalesce(f.revenue, 0) revenue, coalesce(f.n, 0) bookings
from cal left join f on f.m=cal.m""",
)

register(
    "revenue_trend_grain",
    lambda t: op.revenue_trend_grain(t, start=date(2000, 12, 28), end=date(2001, 8, 1), grain="week"),
    f"""
with cal as (select cast(unnest(generate_series(timestamp '2000-12-25', timestamp '2001-07-30', interval 7 day)) as date) m),
f as (select cast(date_trunc('week', booked_at) as date) m, {MONEY} revenue, count(*) n, count(distinct user_id) c
      from bookings where status='confirmed' group by 1)
select cal.m period, coalesce(n, 0) bookings, coalesce(revenue, 0) revenue, coalesce(c, 0) customers,
  coalesce({div('revenue','n')}, 0) avg_booking_value
from cal left join f on f.m=cal.m""",
)

register(
    "revenue_by_time",
    lambda t: op.revenue_by_time(t, **SPAN13, grain="month"),
    f"""
select cast(date_trunc('month', booked_at) as date) period, count(distinct b.id) bookings,
  count(distinct user_id) unique_customers, {MONEY} revenue, {AVG} avg_order_value, count(distinct tour_id) unique_tours
from bookings b where status='confirmed' and booked_at {IN_SPAN13}
group by 1 order by 1 desc limit 24""",
)

register(
    "revenue_by_period_lookback",
    lambda t: op.revenue_by_period_lookback(t, as_of=AS_OF),
    "\nunion all\n".join(
        f"""select '{g}' as grain, cast(date_trunc('{g}', booked_at) as date) period, {MONEY} revenue, count(*) bookings,
  {AVG} avg_booking_value
from bookings where status='confirmed' and booked_at >= {AS_OF_SQL} - interval {back} group by 2"""
        for g, back in (("day", "30 day"), ("week", "84 day"), ("month", "12 month"), ("year", "60 month"))
    ),
)

register(
    "revenue_by_period_range",
    lambda t: op.revenue_by_period_lookback(
        t, as_of=AS_OF, periods=("week",), start=date(1999, 3, 3), end=date(2000, 3, 3)
    ),
    f"""select 'week' as grain, cast(date_trunc('week', booked_at) as date) period, {MONEY} revenue, count(*) bookings,
  {AVG} avg_booking_value
from bookings where status='confirmed' and booked_at between timestamp '1999-03-03' and timestamp '2000-03-03' group by 2""",
)

register(
    "revenue_by_period_text",
    lambda t: op.revenue_by_period_text(t, as_of=AS_OF, period="week"),
    f"""
select strftime(wk, '%Y-') || lpad(cast((dayofyear(wk)-1)//7+1 as varchar), 2, '0') period, count(*) bookings_count, {MONEY} revenue
from (select date_trunc('week', booked_at) wk, total_price from bookings
      where status='confirmed' and booked_at >= {AS_OF_SQL} - interval 84 day) x group by wk""",
)

register(
    "revenue_comparison",
    lambda t: op.revenue_comparison(t, **BOTH),
    "\nunion all\n".join(
        f"""select '{label}' as period, cast(date_trunc('month', booked_at) as date) as month, {MONEY} revenue, count(*) bookings
from bookings where status='confirmed' and booked_at {span} group by 2"""
        for label, span in (("current", IN_SPAN), ("previous", IN_PREV))
    ),
)

register(
    "revenue_by_tour",
    lambda t: op.revenue_by_tour(t, **SPAN13),
    f"""
select t.id, title, slug, location, count(*) bookings, {MONEY} revenue, {AVG} avg_price, count(distinct user_id) unique_customers
from bookings b join tours t on b.tour_id=t.id where b.status='confirmed' and booked_at {IN_SPAN13}
group by 1, 2, 3, 4 order by revenue desc, t.id limit 20""",
)

register(
    "top_tours",
    lambda t: op.top_tours(t, **SPAN),
    f"""
select t.id, title, location, count(*) bookings, {MONEY} revenue, {AVG} avg_booking_value
from bookings b join tours t on b.tour_id=t.id where b.status='confirmed' and booked_at {IN_SPAN}
group by 1, 2, 3 order by revenue desc, t.id limit 10""",
)

register(
    "top_tours_share",
    lambda t: op.top_tours_share(t, **SPAN),
    f"""
select t.id, title, location, count(*) bookings, {MONEY} revenue, {AVG} avg_booking_value,
  count(distinct user_id) unique_customers,
  {pct('sum(total_price)', f"(select cast(sum(total_price) as double) from bookings where status='confirmed' and booked_at {IN_SPAN})")} revenue_share
from bookings b join tours t on b.tour_id=t.id where b.status='confirmed' and booked_at {IN_SPAN}
group by 1, 2, 3 order by revenue desc, t.id limit 10""",
)

register(
    "top_revenue_tours",
    lambda t: op.top_revenue_tours(t),
    f"""
select t.id, title, {MONEY} revenue, count(b.id) bookings
from tours t left join bookings b on b.tour_id=t.id and b.status='confirmed'
group by 1, 2 order by revenue desc nulls last, t.id limit 10""",
)

_POPULAR = f"""
select t.id, title, slug, price, count(b.id) bookings_count, {MONEY} revenue,
  {avg('people_count')} avg_people
from tours t left join bookings b on b.tour_id=t.id and b.status='confirmed'"""

register(
    "popular_tours",
    lambda t: op.popular_tours(t),
    f"{_POPULAR} group by 1, 2, 3, 4 order by bookings_count desc, t.id limit 5",
)
register(
    "popular_tours_in_range",
    lambda t: op.popular_tours(t, **SPAN, limit=None),
    f"{_POPULAR} where booked_at {IN_SPAN} group by 1, 2, 3, 4",
)
register(
    "popular_tours_bookable",
    lambda t: op.popular_tours(t, bookable_only=True),
    f"""{_POPULAR} where t.status in ('upcoming','available')
group by 1, 2, 3, 4 order by bookings_count desc, t.id limit 5""",
)

register(
    "payment_methods",
    lambda t: op.payment_methods(t, **SPAN13),
    f"""
select coalesce(payment_method,'unknown') payment_method, count(*) bookings, {MONEY} revenue, {AVG} avg_amount,
  count(distinct user_id) unique_customers
from bookings where status='confirmed' and booked_at {IN_SPAN13} group by 1""",
)

register(
    "seasonality",
    lambda t: op.seasonality(t, start=date(1995, 1, 1), end=AS_OF),
    f"""
select cast(year(booked_at) as int) as year, cast(month(booked_at) as int) as month, count(*) bookings, {MONEY} revenue, {AVG} avg_amount
from bookings where status='confirmed' and booked_at between timestamp '1995-01-01' and timestamp '2001-08-01' group by 1, 2""",
)

register(
    "seasonal_by_tour",
    lambda t: op.seasonal_by_tour(t, as_of=AS_OF),
    f"""
select t.id, title, cast(month(booked_at) as int) as month, count(*) bookings, {MONEY} revenue, {AVG} avg_value
from bookings b join tours t on b.tour_id=t.id
where b.status='confirmed' and booked_at >= {AS_OF_SQL} - interval 24 month group by 1, 2, 3""",
)

_HOURLY = f"""
select date_trunc('hour', booked_at) as hour, count(*) bookings, {MONEY} revenue from live_bookings_src
where status='confirmed' and booked_at >= {NOW_SQL} - interval 24 hour group by 1"""

register("hourly_sales", lambda t: op.sales_by_hour(live(t), now=NOW), _HOURLY)
register(
    "sales_velocity",
    lambda t: op.sales_velocity(live(t), now=NOW),
    f"""
with h as ({_HOURLY})
select hour, bookings, revenue,
  {div('sum(bookings) over w','count(*) over w')} moving_avg_bookings,
  {div('sum(revenue) over w','count(*) over w')} moving_avg_revenue
from h window w as (order by hour rows between 3 preceding and current row)""",
)
