"""Registered customer queries."""

from __future__ import annotations

from datetime import date

from sojourn.operators import customers as op
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY, avg, div, money_if, pct
from sojourn.plans.windows import AS_OF, AS_OF_SQL, IN_SPAN, NOW, NOW_SQL, SPAN
from sojourn.sources.testdata import live

MONTHS = (
    "with cal as (select cast(unnest(generate_series(timestamp '{a}', timestamp '{b}', interval 1 month)) as date) m)"
)
CONFIRMED = "status='confirmed'"
SEGMENT = "case when n>=5 then 'VIP' when n>=3 then 'Regular' else 'New' end"
PER_USER = f"""select u.id, count(*) n, {MONEY} s, max(booked_at) last_at
from users u join bookings b on b.user_id=u.id where b.{CONFIRMED} group by 1"""

register(
    "customer_acquisition",
    lambda t: op.customer_acquisition(t, start=date(2000, 1, 1), end=AS_OF),
    MONTHS.format(a="2000-01-01", b="2001-08-01")
    + """ select strftime(m, '%Y-%m-%d') as month, count(u.id) new_customers
from cal left join users u on date_trunc('month', u.created_at)=m and u.role='user' group by 1""",
)


def _first(extra: str) -> str:
    return f"""select user_id, arg_min(id, (booked_at, id)) id, arg_min(total_price, (booked_at, id)) total_price,
  min(booked_at) booked_at from bookings where {CONFIRMED} {extra} group by 1"""


def _acquisition(extra: str, a: str) -> str:
    return MONTHS.format(a=a, b="2001-08-01") + f""", f as ({_first(extra)})
select m as month, count(u.id) new_customers, count(f.id) first_bookings,
  cast(coalesce(sum(total_price),0) as decimal(28,2)) initial_revenue
from cal left join users u on date_trunc('month', u.created_at)=m left join f on f.user_id=u.id group by 1"""


register(
    "acquisition_first_value",
    lambda t: op.acquisition_first_value(t, start=date(1999, 9, 1), end=AS_OF),
    _acquisition("", "1999-09-01"),
)
register(
    "acquisition_first_value_in_window",
    lambda t: op.acquisition_first_value(t, **SPAN, first_in_window=True),
    _acquisition(f"and booked_at {IN_SPAN}", "2000-09-01"),
)
register(
    "lateral_first_booking",
    lambda t: op.lateral_first_booking(t, **SPAN),
    f"""with f as ({_first(f"and booked_at {IN_SPAN}")})
select u.id, u.name, f.id booking_id, f.booked_at, f.total_price from users u left join f on f.user_id=u.id""",
)


def _top(role: str, limit: int) -> str:
    return f"""select u.id, u.name, email, count(*) total_bookings, {MONEY} total_spent, {avg('total_price')} avg_booking_value
from users u join bookings b on b.user_id=u.id where b.{CONFIRMED} and booked_at {IN_SPAN} {role}
group by 1, 2, 3 order by total_spent desc, u.id limit {limit}"""


register("top_customers", lambda t: op.top_customers(t, **SPAN), _top("and u.role='user'", 10))
register(
    "top_customers_any_role", lambda t: op.top_customers(t, **SPAN, role=None, limit=7), _top("", 7)
)
register(
    "top_customers_detail",
    lambda t: op.top_customers_detail(t, start=date(1998, 1, 1), end=AS_OF),
    f"""select u.id, u.name, email, u.created_at joined_date, count(*) total_bookings, {MONEY} total_spent,
  min(booked_at) first_booking, max(booked_at) last_booking, {avg('total_price')} avg_booking_value,
  count(distinct year(booked_at)) active_years
from users u join bookings b on b.user_id=u.id
where b.{CONFIRMED} and booked_at between timestamp '1998-01-01' and timestamp '2001-08-01'
group by 1, 2, 3, 4 order by total_spent desc, u.id limit 10""",
)
_SEGMENTS = f"""select {SEGMENT} segment, count(*) customer_count, cast(sum(s) as decimal(28,2)) total_revenue,
  {div('sum(s)', 'count(*)')} avg_value from ({PER_USER}) p where s>0 group by 1"""
register("customer_segments", lambda t: op.customer_segments(t), _SEGMENTS)
register(
    "clv",
    lambda t: op.clv(t),
    f"""select case when n=1 then 'One-time' else 'Repeat' end customer_type, {SEGMENT} segment, count(*) customer_count,
  {div('sum(s)', 'count(*)')} avg_lifetime_value, {div('sum(n)', 'count(*)')} avg_bookings,
  round(quantile_cont(cast(s as double), 0.5)*100)/100 median_value, cast(sum(s) as decimal(28,2)) total_revenue
from ({PER_USER}) p group by 1, 2""",
)
_CHURN = f"""select case when last_at < {AS_OF_SQL} - interval 90 day then 'Churned'
  when last_at < {AS_OF_SQL} - interval 30 day then 'At Risk' else 'Active' end status, count(*) customer_count
from ({PER_USER}) p group by 1"""
register(
    "churn",
    lambda t: op.churn(t, as_of=AS_OF),
    f"select status, customer_count, {pct('customer_count', 'sum(customer_count) over ()')} percentage from ({_CHURN}) c",
)
register(
    "referral_sources",
    lambda t: op.referral_sources(t),
    """select coalesce(utm_source,'direct') source, count(distinct u.id) signups, count(distinct b.id) bookings,
  cast(coalesce(sum(total_price),0) as decimal(28,2)) revenue
from users u left join bookings b on b.user_id=u.id and b.status='confirmed' group by 1""",
)
register(
    "cohorts",
    lambda t: op.cohorts(t, as_of=date(2001, 4, 1)),
    f"""select strftime(c, '%Y-%m') cohort, strftime(m, '%Y-%m') as month, cast(datediff('month', c, m) as int) month_number,
  count(distinct user_id) active_users, count(*) bookings, {MONEY} revenue
from (select date_trunc('month', u.created_at) c, date_trunc('month', booked_at) m, user_id, total_price
      from users u join bookings b on b.user_id=u.id
      where b.{CONFIRMED} and u.created_at >= date '2001-04-01' - interval 12 month and booked_at < date '2001-04-02') x
where m>=c group by c, m""",
)
register(
    "export_customers",
    lambda t: op.export_customers(t),
    f"""select u.id, u.name, email, phone, u.created_at, count(b.id) total_bookings, {money_if("b.status='confirmed'")} lifetime_value,
  min(booked_at) first_booking, max(booked_at) last_booking
from users u left join bookings b on b.user_id=u.id group by 1, 2, 3, 4, 5""",
)
register(
    "user_list_stats",
    lambda t: op.user_list_stats(t, role="user", search="customer", page=2),
    f"""select u.id, u.name, email, role, u.created_at, count(b.id) total_bookings, {money_if("b.status='confirmed'")} total_spent
from users u left join bookings b on b.user_id=u.id
where is_active and role='user' and (u.name ilike '%customer%' or email ilike '%customer%')
group by 1, 2, 3, 4, 5 order by u.created_at desc, u.id limit 20 offset 20""",
)
register(
    "user_count",
    lambda t: op.user_count(t, role="user"),
    "select count(*) total from users where is_active and role='user'",
)
register(
    "user_stats",
    lambda t: op.user_stats(t),
    f"""select u.id user_id, count(case when status='confirmed' then 1 end) total_trips,
  count(case when status='pending' then 1 end) pending_trips, count(case when status='cancelled' then 1 end) cancelled_trips,
  {money_if(CONFIRMED)} total_spent from users u left join bookings b on b.user_id=u.id group by 1""",
)
register(
    "live_users",
    lambda t: op.live_users(live(t), now=NOW),
    f"""select u.id, u.name, email, last_login_at, count(b.id) session_bookings, {MONEY} session_spend
from users u left join live_bookings_src b on b.user_id=u.id and booked_at >= {NOW_SQL} - interval 1 hour
where last_login_at >= {NOW_SQL} - interval 1 hour group by 1, 2, 3, 4 order by last_login_at desc, u.id limit 10""",
)
