"""Registered KPI, dashboard and funnel queries."""

from __future__ import annotations

from datetime import date, datetime

from sojourn.operators import kpis as op
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY, div, grow, money_if, pct
from sojourn.plans.windows import AS_OF, AS_OF_SQL, BOTH, IN_PREV, IN_SPAN, SPAN
from sojourn.sources.testdata import live

NOON = datetime(2024, 1, 30, 12)
CONFIRMED = "status='confirmed'"


def _kpi(span: str) -> str:
    return f"""select count(*) n, {money_if(CONFIRMED)} r, count(distinct user_id) c, count(case when {CONFIRMED} then 1 end) k,
  count(distinct tour_id) tours from bookings where booked_at {span}"""


def _returning(span: str) -> str:
    return f"""select count(*) ret from (select user_id from bookings where booked_at {span}
  group by user_id having count(*)>1) x"""


register(
    "kpi_window",
    lambda t: op.kpi_window(t, **SPAN),
    f"select n total_bookings, r total_revenue, c total_customers from ({_kpi(IN_SPAN)}) x",
)
register(
    "kpi_growth",
    lambda t: op.kpi_growth(t, **BOTH),
    f"""with now as ({_kpi(IN_SPAN)}), prev as ({_kpi(IN_PREV)})
select {grow('now.n', 'prev.n')} booking_growth, {grow('now.r', 'prev.r')} revenue_growth,
  {grow('now.c', 'prev.c')} customer_growth from now, prev""",
)
register(
    "kpi_avg_booking",
    lambda t: op.kpi_avg_booking(t, **SPAN),
    f"select {div('r', 'n')} avg_over_all, {div('r', 'k')} avg_over_confirmed from ({_kpi(IN_SPAN)}) x",
)
_CAPACITY = f"""select cast(coalesce(sum(capacity),0) as bigint) total_capacity, cast(coalesce(sum(booked_count),0) as bigint) total_booked,
  coalesce({pct('sum(booked_count)', 'sum(capacity)')}, 0) occupancy_rate
from tours where status in ('upcoming','available')"""
register("kpi_capacity", lambda t: op.kpi_capacity(t), _CAPACITY)


def _full(span: str, prev: str) -> str:
    return f"""with now as ({_kpi(span)}), prev as ({_kpi(prev)}), ret as ({_returning(span)}), cap as ({_CAPACITY})
select now.n total_bookings, now.r total_revenue, now.c total_customers, ret returning_customers, now.tours active_tours,
  coalesce({div('now.r', 'now.k')}, 0) avg_booking_value, total_capacity, total_booked total_booked_capacity, occupancy_rate,
  {grow('now.n', 'prev.n')} booking_growth, {grow('now.r', 'prev.r')} revenue_growth,
  {grow('now.c', 'prev.c')} customer_growth, coalesce({pct('ret', 'now.c')}, 0) customer_retention
from now, prev, ret, cap"""


register("kpi_full", lambda t: op.kpi_full(t, **BOTH), _full(IN_SPAN, IN_PREV))
# A window after the last booking, compared with one before the first.
register(
    "zero_kpis",
    lambda t: op.kpi_full(
        t, start=date(2002, 1, 1), end=date(2002, 12, 31), prev_start=date(1990, 1, 1), prev_end=date(1990, 12, 31)
    ),
    _full("between timestamp '2002-01-01' and timestamp '2002-12-31'",
          "between timestamp '1990-01-01' and timestamp '1990-12-31'"),
)
register(
    "retention_rate",
    lambda t: op.retention_rate(t, **SPAN),
    f"""with now as ({_kpi(IN_SPAN)}), ret as ({_returning(IN_SPAN)})
select ret returning_customers, c total_customers, {pct('ret', 'c')} retention_rate from now, ret""",
)
register(
    "exists_other_row",
    lambda t: op.exists_other_row(t, **SPAN),
    f"""select user_id, count(*) bookings from bookings b where booked_at {IN_SPAN}
and exists (select 1 from bookings o where o.user_id=b.user_id and o.id<>b.id and o.booked_at {IN_SPAN}) group by 1""",
)
_INTERESTED = f"""select user_id from favorites where created_at {IN_SPAN} union
select user_id from bookings where booked_at {IN_SPAN}"""
register("interested_users", lambda t: op.interested_users(t, **SPAN), _INTERESTED)
_FUNNEL = f"""select (select count(*) from users where created_at {IN_SPAN}) visitors,
  (select count(*) from ({_INTERESTED}) i) interested_users, c booked_users, k confirmed_count from ({_kpi(IN_SPAN)}) x"""
register(
    "funnel",
    lambda t: op.funnel(t, **SPAN),
    f"select visitors, interested_users, booked_users, confirmed_count, {pct('booked_users', 'visitors')} conversion_rate from ({_FUNNEL}) f",
)
register(
    "funnel_step_rates",
    lambda t: op.funnel_step_rates(t, **SPAN),
    f"""select coalesce({pct('interested_users', 'visitors', 1)}, 0) interested_users_rate,
  coalesce({pct('booked_users', 'visitors', 1)}, 0) booked_users_rate from ({_FUNNEL}) f""",
)
register(
    "funnel_simplified",
    lambda t: op.funnel_simplified(t, **SPAN),
    f"""select 0 visitors, 0 interested_users, c booked_users, n confirmed_count, 0 conversion_rate from ({_kpi(IN_SPAN)}) x""",
)

_LAST30 = f"booked_at >= {AS_OF_SQL} - interval 30 day"
register(
    "dashboard_revenue",
    lambda t: op.dashboard_revenue(t, as_of=AS_OF),
    f"""with s as (select {money_if(_LAST30)} cur, {money_if(f"booked_at >= {AS_OF_SQL} - interval 60 day and not ({_LAST30})")} prev
from bookings where {CONFIRMED})
select cur current_period, prev previous_period,
  case when prev>0 then {pct('cur-prev', 'prev', 1)} when cur>0 then 100.0 else 0.0 end trend from s""",
)


def _count(condition: str, name: str) -> str:
    return f"count(case when {condition} then 1 end) {name}"


_STATES = ", ".join(_count(f"status='{s}'", s) for s in ("pending", "confirmed", "cancelled"))
register(
    "dashboard_bookings",
    lambda t: op.dashboard_bookings(t, as_of=AS_OF),
    f"select count(*) total, {_STATES} from bookings where {_LAST30}",
)
register(
    "dashboard_tours",
    lambda t: op.dashboard_tours(t),
    f"""select count(*) total, {_count("status='available'", "available")}, {_count("status='upcoming'", "upcoming")},
  {_count("featured", "featured")} from tours where status in ('available','upcoming')""",
)
register(
    "dashboard_users",
    lambda t: op.dashboard_users(t, as_of=date(2001, 4, 1)),
    f"""select count(*) total, {_count("created_at >= date '2001-04-01' - interval 30 day", "new_this_month")},
  {_count("role='admin'", "admins")}, {_count("role='manager'", "managers")}, {_count("role='user'", "users")}
from users where is_active and role<>'admin'""",
)
register(
    "public_stats",
    lambda t: op.public_stats(t, as_of=AS_OF),
    f"""select * from (select count(*) total_tours, {_count("status='available'", "available_tours")},
  {_count("status='upcoming'", "upcoming_tours")}, {_count("featured", "featured_tours")} from tours) a,
(select count(*) total_bookings, {_count(CONFIRMED, "confirmed_bookings")}, {_count("status='pending'", "pending_bookings")}
 from bookings where {_LAST30}) b,
(select {money_if(_LAST30)} revenue_30_days, {money_if(f"booked_at >= {AS_OF_SQL} - interval 7 day")} revenue_7_days
 from bookings where {CONFIRMED}) c""",
)
register(
    "home_stats",
    lambda t: op.home_stats(t),
    f"""select (select count(*) from bookings where {CONFIRMED}) happy_travelers,
  (select count(*) from tours where status='available') active_tours""",
)
register("status_counts", lambda t: op.tour_status_counts(t), 'select status, count(*) as "count" from tours group by 1')
register("role_counts", lambda t: op.role_counts(t), 'select role, count(*) as "count" from users where is_active group by 1')
register(
    "booking_status_counts",
    lambda t: op.booking_status_counts(t, start=date(2001, 7, 2)),
    f"""select status, count(*) as "count", {MONEY} total_amount from bookings where {_LAST30} group by 1""",
)
register(
    "booking_status_summary",
    lambda t: op.booking_status_summary(t, **SPAN),
    f"select {_STATES}, count(*) total, {money_if(CONFIRMED)} revenue from bookings where booked_at {IN_SPAN}",
)
register(
    "user_status_counts",
    lambda t: op.user_status_counts(t),
    f"""select u.id user_id, {_STATES}, {_count("status='completed'", "completed")} from users u left join bookings b on b.user_id=u.id group by 1""",
)
_LIVE = f"""from live_bookings_src where {CONFIRMED}"""
register(
    "today_stats",
    lambda t: op.today_stats(live(t), now=NOON),
    f"""select count(*) bookings_today, cast(coalesce(sum(total_price),0) as decimal(28,2)) revenue_today,
  count(distinct user_id) customers_today, {div('sum(total_price)', 'count(*)')} avg_booking_today
{_LIVE} and booked_at between timestamp '2024-01-30' and timestamp '2024-01-30 12:00:00'""",
)
register(
    "month_stats",
    lambda t: op.month_stats(live(t), now=NOON),
    f"""select count(*) bookings_month, cast(coalesce(sum(total_price),0) as decimal(28,2)) revenue_month,
  count(distinct user_id) customers_month {_LIVE} and booked_at between timestamp '2024-01-01' and timestamp '2024-01-30 12:00:00'""",
)


def _windows() -> str:
    # The windows around the registered as-of day.
    spans = {
        ("day", "current"): ("2001-08-01", "2001-08-02"), ("day", "previous"): ("2001-07-31", "2001-08-01"),
        ("week", "current"): ("2001-07-29", "2001-08-05"), ("week", "previous"): ("2001-07-22", "2001-07-29"),
        ("month", "current"): ("2000-09-01", "2001-09-01"), ("month", "previous"): ("1999-09-01", "2000-09-01"),
        ("quarter", "current"): ("2001-07-01", "2001-10-01"), ("quarter", "previous"): ("2001-04-01", "2001-07-01"),
        ("year", "current"): ("2001-01-01", "2002-01-01"), ("year", "previous"): ("2000-01-01", "2001-01-01"),
    }
    return "\nunion all\n".join(
        f"""select '{p}' as period, '{s}' as side, count(*) bookings, {money_if(CONFIRMED)} revenue
from bookings where booked_at >= timestamp '{a}' and booked_at < timestamp '{b}' having count(*)>0"""
        for (p, s), (a, b) in spans.items()
    )


register("period_window", lambda t: op.period_windows(t, as_of=AS_OF), _windows())
