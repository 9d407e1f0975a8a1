"""Registered booking lists, joins and documents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sojourn.operators import bookings as op
from sojourn.operators import documents, kpis, revenue
from sojourn.operators import shares
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MONEY, pct
from sojourn.plans.windows import AS_OF, IN_SPAN, NOW, NOW_SQL, SPAN
from sojourn.sources.testdata import live

SHOWN = "b.id, cast(null as varchar) booking_number, b.user_id, b.tour_id, b.people_count, b.total_price, b.status, b.booked_at"
NAMES = "t.title tour_title, t.slug tour_slug, u.name customer_name, u.email customer_email"
JOINED = "from bookings b join tours t on t.id=b.tour_id join users u on u.id=b.user_id"
NEWEST = "b.booked_at desc, b.id desc"

register(
    "booking_enriched",
    lambda t: op.booking_enriched(t),
    f"""select {SHOWN}, payment_method, confirmed_at, cancelled_at, {NAMES}, t.location tour_location, start_date, end_date,
  duration_days {JOINED}""",
)
_FILTER = f"""{JOINED} where b.status='confirmed' and cast(booked_at as date) between date '2001-01-10' and date '2001-03-31'
  and (u.name ilike '%00001%' or u.email ilike '%00001%')"""
register(
    "bookings_by_filter",
    lambda t: op.bookings_by_filter(
        t, status="confirmed", start=date(2001, 1, 10), end=date(2001, 3, 31), search="00001"
    ),
    f"""select {SHOWN}, {NAMES}, (select count(*) {_FILTER}) total, cast(ceil((select count(*) {_FILTER})/20.0) as bigint) pages
{_FILTER} order by {NEWEST} limit 20""",
)
register(
    "calendar_bookings",
    lambda t: op.calendar_bookings(t, year=2001, month=2),
    f"select {SHOWN}, {NAMES} {JOINED} where booked_at >= timestamp '2001-02-01' and booked_at < timestamp '2001-03-01'",
)
register(
    "recent_bookings",
    lambda t: op.recent_bookings(t),
    f"select {SHOWN}, {NAMES} {JOINED} order by {NEWEST} limit 10",
)
register(
    "live_bookings",
    lambda t: op.live_bookings(live(t), now=NOW),
    f"""select {SHOWN.replace('cast(null as varchar) booking_number, ', '')}, {NAMES} {JOINED.replace('bookings b', 'live_bookings_src b')}
where booked_at >= {NOW_SQL} - interval 24 hour order by {NEWEST} limit 20""",
)
_RANK = 'cast(row_number() over (partition by b.user_id order by {0}) as int) as "rank"'
register(
    "user_bookings",
    lambda t: op.user_bookings(t, status="confirmed", size=2, page=2),
    f"""select x.*, t.title, main_image from (
select {SHOWN}, {_RANK.format(NEWEST)}, count(*) over (partition by b.user_id) total from bookings b where status='confirmed') x
join tours t on t.id=x.tour_id left join main_images mi on mi.tour_id=t.id where "rank" between 3 and 4""",
)
register(
    "user_recent",
    lambda t: op.user_recent(t),
    f"""select user_id, "rank", x.id, x.status, booked_at, total_price, title
from (select {SHOWN}, {_RANK.format(NEWEST)} from bookings b) x join tours t on t.id=x.tour_id where "rank"<=5""",
)
register(
    "user_upcoming",
    lambda t: op.user_upcoming(t, as_of=AS_OF),
    f"""select user_id, {_RANK.format('t.start_date, b.id')}, b.id, people_count, total_price, booked_at, t.title, t.start_date,
  t.location, main_image as image
from bookings b join tours t on t.id=b.tour_id left join main_images mi on mi.tour_id=t.id
where b.status='confirmed' and t.start_date >= date '2001-08-01' qualify "rank"<=3""",
)
register(
    "user_favorites",
    lambda t: op.user_favorites(t, k=2),
    """select f.user_id, f.tour_id, f.created_at favorited_at, t.title, t.slug, t.price, t.discount_price,
  cast(row_number() over (partition by f.user_id order by f.created_at desc, f.tour_id) as int) as "rank", main_image as image
from favorites f join tours t on t.id=f.tour_id left join main_images mi on mi.tour_id=t.id
where t.status in ('upcoming','available') qualify "rank"<=2""",
)
register(
    "user_favorites_counts",
    lambda t: op.user_favorites_counts(t),
    """select u.id user_id, count(f.user_id) total, count(case when t.status in ('upcoming','available') then 1 end) bookable
from users u left join favorites f on f.user_id=u.id left join tours t on t.id=f.tour_id group by 1""",
)
register(
    "user_notifications",
    lambda t: op.user_notifications(t, k=3),
    """select *, cast(row_number() over (partition by user_id order by created_at desc, id desc) as int) as "rank"
from notifications qualify "rank"<=3""",
)
register(
    "export_revenue",
    lambda t: op.export_revenue(t, start=date(2001, 7, 2), end=AS_OF),
    f"""select b.id, cast(null as varchar) booking_number, u.name customer_name, email, t.title tour_name, total_price, b.status,
  payment_method, booked_at, confirmed_at {JOINED} where booked_at between timestamp '2001-07-02' and timestamp '2001-08-01'""",
)
register(
    "report_bookings",
    lambda t: op.report_bookings(t, start=date(2001, 1, 1)),
    f"""select cast(null as varchar) booking_number, u.name customer_name, t.title tour, total_price, b.status,
  strftime(booked_at, '%Y-%m-%d %H:%M:%S') booked_at {JOINED} where booked_at >= timestamp '2001-01-01'""",
)
register(
    "conditional_left_join",
    lambda t: op.conditional_left_join(t, **SPAN),
    f"""select u.id, u.name, count(b.id) bookings from users u left join bookings b on b.user_id=u.id and b.status='confirmed'
and booked_at {IN_SPAN} group by 1, 2""",
)
register(
    "left_join_null_rejected",
    lambda t: op.left_join_null_rejected(t, **SPAN),
    f"""select t.id, t.title, count(b.id) bookings from tours t left join bookings b on b.tour_id=t.id and b.status='confirmed'
where booked_at {IN_SPAN} group by 1, 2""",
)
register(
    "calendar_left_join",
    lambda t: op.calendar_left_join(t, start=date(2001, 6, 1), end=date(2001, 8, 10)),
    """select cal.d as day, count(b.id) bookings
from (select cast(unnest(generate_series(timestamp '2001-06-01', timestamp '2001-08-10', interval 1 day)) as date) d) cal
left join bookings b on cast(b.booked_at as date)=cal.d group by 1""",
)
_PLACED = """(select *, cast((row_number() over (partition by tour_id order by display_order, id)-1)//1000 as bigint) part
  from tour_images) p"""
register(
    "ordered_images",
    lambda t: documents.ordered_images(t).select(
        "tour_id", "part", F.array_join("images.image_url", " ").alias("images")
    ),
    f"""select tour_id, part, string_agg(image_url, ' ' order by display_order, id) images from {_PLACED} group by 1, 2""",
)
register(
    "tour_document",
    lambda t: documents.flatten(documents.tour_document(t)),
    f"""with i as (select tour_id, cast(count(*) as int) n, string_agg(image_url, ' ' order by display_order, id) images
  from {_PLACED} where part=0 group by 1),
a as (select tour_id, string_agg(m.name, ', ' order by m.name) amenities from tour_amenities l join amenities m on m.id=l.amenity_id group by 1),
c as (select tour_id, string_agg(c.name, ', ' order by c.name) categories, string_agg(c.color, ', ' order by c.name) colors
  from tour_categories l join categories c on c.id=l.category_id group by 1)
select t.id, cast(0 as bigint) part, title, u.name created_by_name, coalesce(i.n, 0) image_count, images, amenities, categories, colors
from tours t left join users u on u.id=t.created_by left join i on i.tour_id=t.id left join a on a.tour_id=t.id
left join c on c.tour_id=t.id
union all select tour_id, part, null, null, cast(count(*) as int),
  string_agg(image_url, ' ' order by display_order, id), null, null, null
from {_PLACED} where part>0 and tour_id in (select id from tours) group by 1, 2""",
)
register(
    "topk",
    lambda t: revenue.confirmed(t).select("id", "user_id", "total_price").orderBy(F.desc("total_price"), "id").limit(24),
    "select id, user_id, total_price from bookings where status='confirmed' order by total_price desc, id limit 24",
)
register(
    "null_order",
    lambda t: t.bookings.select("id", "confirmed_at", "payment_method")
    .orderBy(F.desc_nulls_first("confirmed_at"), F.asc_nulls_last("payment_method"), "id")
    .limit(50),
    """select id, confirmed_at, payment_method from bookings
order by confirmed_at desc nulls first, payment_method asc nulls last, id limit 50""",
)
register(
    "scalar_global_subquery",
    lambda t: shares.global_share(t),
    f"""select tour_id, {MONEY} revenue,
  {pct('sum(total_price)', "(select cast(sum(total_price) as double) from bookings where status='confirmed')", 6)} as share
from bookings where status='confirmed' group by 1""",
)
_STATUS = """select status, count(*) bookings from bookings group by 1"""
register(
    "pct_of_total",
    lambda t: shares.status_share(t).select("status", "bookings", "percentage"),
    f"select status, bookings, {pct('bookings', 'sum(bookings) over ()')} percentage from ({_STATUS}) s",
)
register(
    "order_by_case",
    lambda t: shares.status_share(t).select("status", "position"),
    """select status, cast(case status when 'pending' then 1 when 'confirmed' then 2 when 'cancelled' then 3 else 4 end as bigint) as "position"
from bookings group by 1""",
)
register(
    "cross_join_singletons",
    lambda t: kpis.side_by_side(
        t,
        t.users.agg(F.count(F.lit(1)).alias("users")),
        t.tours.agg(F.count(F.lit(1)).alias("tours")),
        t.bookings.agg(F.count(F.lit(1)).alias("bookings")),
        t.favorites.agg(F.count(F.lit(1)).alias("favorites")),
    ),
    """select * from (select count(*) as users from users) a, (select count(*) as tours from tours) b,
(select count(*) as bookings from bookings) c, (select count(*) as favorites from favorites) d""",
)
