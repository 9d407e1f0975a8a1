"""Registered catalogue queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from sojourn.operators import catalog as op
from sojourn.plans.registry import register
from sojourn.plans.sqltext import MAIN_IMAGE

BOOKABLE = "t.status in ('upcoming','available')"
CARD = "t.id, t.title, t.slug, t.short_description, t.location, t.price, t.discount_price, t.start_date, t.end_date, \
t.duration_days, t.capacity, t.booked_count, t.status, t.featured"
NEWEST = "t.created_at desc, t.id desc"


def _search(text: str) -> str:
    return f"(t.title ilike '%{text}%' or t.short_description ilike '%{text}%' or t.location ilike '%{text}%')"


def _in_category(test: str) -> str:
    return f"""exists (select 1 from tour_categories l join categories c on c.id=l.category_id
  where l.tour_id=t.id and {test})"""


_BROWSE = f"""from tours t where {BOOKABLE} and {_search('econ')} and {_in_category("c.name ilike '%ring%'")}
  and coalesce(t.discount_price, t.price) between 850 and 1500 and t.start_date >= date '2001-06-10' and t.location ilike '%brand%'"""
register(
    "browse_tours",
    lambda t: op.browse_tours(
        t, search="econ", category="RING", price_min=850, price_max=1500, date=date(2001, 6, 10), location="brand"
    ),
    f"""select m.*, main_image, (select count(*) {_BROWSE}) total,
  cast(ceil((select count(*) {_BROWSE})/12.0) as bigint) pages
from (select {CARD} {_BROWSE} order by t.featured desc, {NEWEST} limit 12) m
left join main_images mi on mi.tour_id=m.id""",
)
register(
    "browse_tours_second_page",
    lambda t: op.browse_tours(t, page=2),
    f"""select {CARD}, main_image, (select count(*) from tours t where {BOOKABLE}) total,
  cast(ceil((select count(*) from tours t where {BOOKABLE})/12.0) as bigint) pages
from tours t {MAIN_IMAGE} where {BOOKABLE} order by t.featured desc, {NEWEST} limit 12 offset 12""",
)
_EITHER = "(t.discount_price >= 820 or t.price >= 820) and (t.discount_price <= 950 or t.price <= 950)"
register(
    "filter_tours_or_price",
    lambda t: op.filter_tours_or_price(
        t, status="available", featured=True, category_id="ring", price_min=820, price_max=950
    ),
    f"""select {CARD}, t.created_at, main_image from tours t {MAIN_IMAGE}
where t.status='available' and t.featured and {_in_category("c.id='ring'")} and {_EITHER}
order by t.featured desc, {NEWEST} limit 12""",
)
register(
    "count_tours",
    lambda t: op.count_tours(t, status="available", featured=True, category_id="ring", location="brand"),
    f"""select count(*) total from tours t where t.status='available' and t.featured
and {_in_category("c.id='ring'")} and t.location ilike '%brand%'""",
)
register(
    "search_tours",
    lambda t: op.search_tours(t, q="tour", category="ring", date=date(2001, 6, 5), min_price=820, max_price=950),
    f"""select distinct {CARD}, t.created_at, main_image from tours t left join tour_categories l on l.tour_id=t.id
left join categories c on c.id=l.category_id {MAIN_IMAGE}
where {BOOKABLE} and {_search('tour')} and c.name ilike '%ring%' and t.start_date >= date '2001-06-05' and {_EITHER}
order by {NEWEST} limit 20""",
)
_NAMED = f"""from tours t join tour_categories l on l.tour_id=t.id join categories c on c.id=l.category_id
where c.name ilike '%e%' and {BOOKABLE}"""
register(
    "tours_by_category_name",
    lambda t: op.tours_by_category_name(t, category="e", page=2),
    f"""select m.*, main_image, (select count(*) {_NAMED}) total, cast(ceil((select count(*) {_NAMED})/12.0) as bigint) pages
from (select {CARD}, t.created_at, category_id, c.name category, c.description category_info {_NAMED}
  order by {NEWEST}, category_id limit 12 offset 12) m left join main_images mi on mi.tour_id=m.id""",
)
register(
    "tours_by_category_id",
    lambda t: op.tours_by_category_id(t, category_id="ring"),
    f"""select {CARD}, t.created_at, main_image from tours t join tour_categories l on l.tour_id=t.id {MAIN_IMAGE}
where l.category_id='ring' and {BOOKABLE} order by {NEWEST} limit 12""",
)
register(
    "semi_category_filter",
    lambda t: op.semi_category_filter(t, category="ring"),
    f"""select t.id, t.title, t.status from tours t where {_in_category("c.name ilike '%ring%'")}""",
)
_API = f"from tours t where t.status='upcoming' and {_in_category("c.name ilike '%e%'")}"
register(
    "api_tours",
    lambda t: op.api_tours(t, status="upcoming", category="e", limit=20, offset=10),
    f"""select {CARD}, t.created_at, main_image, (select count(*) {_API}) total
{_API.replace('from tours t', f'from tours t {MAIN_IMAGE}')} order by {NEWEST} limit 20 offset 10""",
)
_TAGS = """select tour_id, min(c.name) primary_tag from tour_categories l join categories c on c.id=l.category_id group by 1"""
register(
    "featured_tours",
    lambda t: op.featured_tours(t),
    f"""select {CARD}, t.created_at, main_image, primary_tag from tours t {MAIN_IMAGE}
left join ({_TAGS}) g on g.tour_id=t.id where t.featured and {BOOKABLE} order by {NEWEST} limit 6""",
)
register(
    "admin_tours",
    lambda t: op.admin_tours(t, status="available", page=2),
    f"""select t.id, t.title, t.status, t.price, t.capacity, t.created_by, t.created_at, u.name created_by_name,
  (select count(*) from bookings b where b.tour_id=t.id and b.status='confirmed') confirmed_bookings, main_image,
  (select count(*) from tours where status='available') total,
  cast(ceil((select count(*) from tours where status='available')/15.0) as bigint) pages
from tours t left join users u on u.id=t.created_by {MAIN_IMAGE} where t.status='available' order by {NEWEST} limit 15 offset 15""",
)
register(
    "scalar_count_subquery",
    lambda t: op.scalar_count_subquery(t),
    """select t.id, title, (select count(*) from bookings b where b.tour_id=t.id and b.status='confirmed') confirmed_bookings
from tours t""",
)
register(
    "first_child_scalar",
    lambda t: op.first_child_scalar(t),
    f"select t.id, title, main_image, primary_tag from tours t {MAIN_IMAGE} left join ({_TAGS}) g on g.tour_id=t.id",
)
register(
    "similar_tours",
    lambda t: op.similar_tours(t),
    f"""select tour_id, similar_id, similar_title, cast(row_number() over (partition by tour_id order by created_at desc, similar_id desc) as int) as "rank"
from (select distinct a.tour_id, t.id similar_id, t.title similar_title, t.created_at
      from tour_categories a join tour_categories b on b.category_id=a.category_id and b.tour_id<>a.tour_id
      join tours t on t.id=b.tour_id where {BOOKABLE}) p
qualify "rank"<=4""",
)
_NAMES = """select tour_id, string_agg(c.name, ', ' order by c.name) names from tour_categories l
join categories c on c.id=l.category_id group by 1"""
register(
    "tour_categories_string",
    lambda t: op.tour_categories_string(t),
    f"""select t.id, title, location, price, start_date, duration_days, short_description, slug, capacity,
  coalesce(names, 'General') category from tours t left join ({_NAMES}) n on n.tour_id=t.id where {BOOKABLE}""",
)
register(
    "featured_filter",
    lambda t: op.featured_filter(t, tag="ring"),
    f"""select t.id, title, location, coalesce(names, 'General') categories from tours t left join ({_NAMES}) n on n.tour_id=t.id
where featured and {BOOKABLE} and (list_contains(string_split(names, ', '), 'ring') or contains(title, 'ring'))""",
)
register(
    "lookup_lists",
    lambda t: op.lookup_lists(t),
    """select 'categories' as list, 0 as list_number, id, name as label from categories
union all select * from (select 'home_categories', 1, id, name from categories order by name limit 6) h
union all select 'amenities', 2, id, name from amenities
union all select 'tours', 3, cast(id as varchar), title from tours""",
)
register(
    "knowledge_base_list",
    lambda t: op.knowledge_base_list(t),
    "select conv_id, turn, question, answer from bot_knowledge",
)
register(
    "price_projections",
    lambda t: op.price_projections(t),
    """select id, price, discount_price, coalesce(discount_price, price) effective_price,
  cast(price-discount_price as decimal(11,2)) saving,
  cast(round((1-cast(discount_price as double)/cast(price as double))*100) as int) saving_percent,
  cast(coalesce(discount_price, price)*2 as decimal(18,2)) order_total from tours""",
)
register(
    "tour_with_creator",
    lambda t: op.tour_with_creator(t),
    """select t.id, title, slug, location, price, t.status, created_by, u.name created_by_name
from tours t left join users u on u.id=t.created_by""",
)
register(
    "membership_check",
    lambda t: op.membership_check(t),
    """select user_id, tour_id, exists (select 1 from favorites f where f.user_id=b.user_id and f.tour_id=b.tour_id) is_favorite
from (select distinct user_id, tour_id from bookings) b""",
)
_SHOWN = ("id", "user_id", "booked_at", "total_price")
register(
    "pagination",
    lambda t: op.with_totals(
        op.paginate(t.bookings.select(*_SHOWN), [F.desc("booked_at"), F.desc("id")], page=5, size=20), t.bookings, 20
    ),
    """select id, user_id, booked_at, total_price, (select count(*) from bookings) total,
  cast(ceil((select count(*) from bookings)/20.0) as bigint) pages
from bookings order by booked_at desc, id desc limit 20 offset 80""",
)
register(
    "pagination_keyset",
    lambda t: op.page_after(t.bookings.select(*_SHOWN), "booked_at", datetime(2000, 1, 5), 5000, 20),
    """select id, user_id, booked_at, total_price from bookings
where booked_at < timestamp '2000-01-05' or (booked_at = timestamp '2000-01-05' and id < 5000)
order by booked_at desc, id desc limit 20""",
)
register(
    "multi_key_sort",
    lambda t: t.tours.select("id", "title", "featured", "created_at").orderBy(*op.featured_first()).limit(24),
    "select id, title, featured, created_at from tours order by featured desc, created_at desc, id desc limit 24",
)
