"""Registered tour, category and amenity queries."""

from __future__ import annotations

from datetime import date

from sojourn.operators import tours as op
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY, avg, div, money_if, pct
from sojourn.plans.windows import AS_OF, AS_OF_SQL, IN_SPAN, IN_SPAN13, NOW, NOW_SQL, SPAN, SPAN13
from sojourn.sources.testdata import live

CONFIRMED = "b.status='confirmed'"


def _links(what: str, extra: str) -> str:
    """Bookings attached to each category or amenity."""
    table, link, key = (
        ("categories", "tour_categories", "category_id") if what == "c" else ("amenities", "tour_amenities", "amenity_id")
    )
    return f"""from {table} c left join {link} l on l.{key}=c.id
left join bookings b on b.tour_id=l.tour_id and {CONFIRMED} {extra}"""


_CATEGORY = f"""select c.id, c.name category, cast(coalesce(sum(total_price),0) as decimal(28,2)) revenue, count(b.id) bookings
{_links('c', f'and booked_at {IN_SPAN}')} group by 1, 2"""
register("category_revenue", lambda t: op.category_revenue(t, **SPAN), _CATEGORY)
_NONZERO = f"select * from ({_CATEGORY}) c where revenue>0"
register("category_revenue_nonzero", lambda t: op.category_revenue_nonzero(t, **SPAN), _NONZERO)
register(
    "category_share_chart",
    lambda t: op.category_share_chart(t, **SPAN),
    f"select id, category, revenue, {pct('revenue', 'cast(sum(revenue) over () as double)', 1)} as share from ({_NONZERO}) c",
)
_TOTAL = f"(select cast(sum(total_price) as double) from bookings b where {CONFIRMED} and booked_at {IN_SPAN})"
register(
    "category_share",
    lambda t: op.category_share(t, **SPAN),
    f"""select c.id, c.name, c.color, c.icon, count(distinct b.id) bookings, {MONEY} revenue, count(distinct user_id) customers,
  {avg('total_price')} avg_booking_value, count(distinct l.tour_id) tour_count, {pct('sum(total_price)', _TOTAL)} market_share
{_links('c', f'and booked_at {IN_SPAN}')} group by 1, 2, 3, 4 having sum(total_price)>0""",
)
register(
    "category_popularity",
    lambda t: op.category_popularity(t),
    f"""select c.id, c.name category, count(distinct l.tour_id) tour_count, count(b.id) bookings_count, {MONEY} revenue
{_links('c', '')} group by 1, 2""",
)
register(
    "category_tour_counts",
    lambda t: op.category_tour_counts(t),
    """select c.id, c.name, c.description, c.icon, c.color, count(t.id) tour_count
from categories c left join tour_categories l on l.category_id=c.id
left join tours t on t.id=l.tour_id and t.status in ('available','upcoming') group by 1, 2, 3, 4, 5""",
)


def _rating(key: str, link: str) -> str:
    return f"""select {key} k, {avg('rating')} avg_rating from {link} l join reviews r on r.tour_id=l.tour_id
where r.is_approved group by 1"""


register(
    "category_performance",
    lambda t: op.category_performance(t, as_of=AS_OF),
    f"""with r as ({_rating('category_id', 'tour_categories')}), f as (
select c.id, c.name, c.color, count(distinct l.tour_id) tour_count, count(b.id) bookings, {MONEY} revenue,
  {avg('total_price')} avg_booking_value, count(distinct user_id) unique_customers
{_links('c', f'and booked_at >= {AS_OF_SQL} - interval 12 month')} group by 1, 2, 3 having count(b.id)>0)
select f.*, avg_rating from f left join r on k=id""",
)
register(
    "amenity_impact",
    lambda t: op.amenity_impact(t),
    f"""with r as ({_rating('amenity_id', 'tour_amenities')}), f as (
select c.id, c.name, c.icon, count(distinct l.tour_id) tour_count, count(b.id) bookings, {MONEY} revenue,
  {avg('total_price')} avg_price
{_links('a', '')} group by 1, 2, 3 having count(b.id)>0)
select f.*, avg_rating from f left join r on k=id""",
)
_PERFORMANCE = f"""
w as (select * from bookings where booked_at {IN_SPAN13}),
rep as (select tour_id, count(*) repeat_customers from
        (select tour_id, user_id from w group by 1, 2 having count(*)>1) x group by 1),
r as (select tour_id, {avg('rating')} avg_rating, count(*) review_count from reviews where is_approved group by 1),
f as (select tour_id, count(*) bookings, count(case when status='confirmed' then 1 end) confirmed_bookings,
  count(case when status='cancelled' then 1 end) cancelled_bookings,
  {money_if("status='confirmed'")} revenue, {money_if("status='cancelled'")} lost_revenue,
  count(distinct user_id) unique_customers, count(distinct cast(booked_at as date)) n_days,
  cast(coalesce(sum(case when status='confirmed' then people_count end),0) as bigint) total_participants
  from w group by 1),
perf as (select t.id, title, slug, location, price, capacity, t.status, bookings, confirmed_bookings, cancelled_bookings,
  revenue, lost_revenue, {div('revenue', 'bookings')} avg_value_incl_zero, unique_customers,
  coalesce(repeat_customers, 0) repeat_customers, total_participants,
  {pct('total_participants', '(cast(capacity as double)*n_days)')} occupancy_rate, avg_rating,
  coalesce(review_count, 0) review_count,
  case when price>0 then {div('revenue', '(cast(price as double)*capacity)', 4)} else 0 end profitability
  from f join tours t on t.id=f.tour_id left join rep on rep.tour_id=t.id left join r on r.tour_id=t.id)"""
register(
    "tour_performance",
    lambda t: op.tour_performance(t, **SPAN13),
    f"with {_PERFORMANCE} select * from perf order by revenue desc nulls first, id limit 20",
)
register(
    "sort_modes",
    lambda t: op.sort_modes(t, **SPAN13),
    f"with {_PERFORMANCE}"
    + "\nunion all\n".join(
        f"""select * from (select id, title, '{mode}' sort_by, cast({c} as double) sort_value,
  cast(row_number() over (order by {c} desc nulls {'last' if last else 'first'}, id) as int) as "rank" from perf) x where "rank"<=20"""
        for mode, (c, last) in op.SORT_KEYS.items()
    ),
)
register(
    "cancellation_analysis",
    lambda t: op.cancellation_analysis(t, as_of=AS_OF),
    f"""select t.id, title, count(case when b.status='cancelled' then 1 end) cancelled_bookings,
  count(case when b.status='confirmed' then 1 end) confirmed_bookings,
  {pct("count(case when b.status='cancelled' then 1 end)", 'count(*)')} cancellation_rate,
  {avg("case when b.status='cancelled' then datediff('day', booked_at, cancelled_at) end")} avg_days_before_cancellation
from tours t join bookings b on b.tour_id=t.id where booked_at >= {AS_OF_SQL} - interval 12 month
group by 1, 2 having count(case when b.status='cancelled' then 1 end)>0
order by cancellation_rate desc, t.id limit 10""",
)
register(
    "export_tours",
    lambda t: op.export_tours(t),
    f"""select t.id, title, location, price, capacity, t.status, count(b.id) total_bookings,
  {money_if(CONFIRMED)} revenue,
  coalesce({div("sum(case when b.status='confirmed' then total_price else 0 end)", 'count(b.id)')}, 0) avg_value_incl_zero,
  count(distinct user_id) unique_customers
from tours t left join bookings b on b.tour_id=t.id group by 1, 2, 3, 4, 5, 6""",
)
register(
    "slots_left_counter",
    lambda t: op.slots_left_counter(t),
    "select id, title, capacity, booked_count, capacity-booked_count available_slots from tours",
)
register(
    "tour_availability_live",
    lambda t: op.tour_availability_live(live(t), now=NOW),
    f"""select t.id, title, capacity, booked_count, capacity-booked_count available_slots,
  count(case when b.status='pending' then 1 end) pending_bookings,
  count(case when booked_at >= {NOW_SQL} - interval 1 hour then 1 end) recent_bookings
from tours t left join live_bookings_src b on b.tour_id=t.id and booked_at >= {NOW_SQL} - interval 24 hour
where t.status in ('upcoming','available') and capacity-booked_count>0
group by 1, 2, 3, 4 order by recent_bookings desc, pending_bookings desc, t.id limit 10""",
)
