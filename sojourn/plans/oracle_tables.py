"""The booking tables in DuckDB SQL, prepended to each oracle query that uses them."""

from __future__ import annotations

import re

from sojourn.plans.change_sets import CHANGE_SQL, TOUR, oracle

CTES: dict[str, str] = {
    "users": """
select c_custkey id, c_name as name, lower(replace(c_name,'#','.'))||'@example.com' email, cast(null as varchar) phone,
  case when c_custkey%50=0 then 'admin' when c_custkey%25=0 then 'manager' else 'user' end as role,
  c_custkey%20<>0 is_active,
  timestamp '1995-01-01 00:00:00' + (c_custkey*37%2300)*interval '1' day created_at,
  case when c_mktsegment<>'HOUSEHOLD' then lower(c_mktsegment) end utm_source, e.last_login_at
from customer left join (select user_id, max(ts) last_login_at from events group by user_id) e on e.user_id=c_custkey""",
    "bookings": """
select o_orderkey id, o_custkey user_id, li.tour_id, (li.q%20)+1 people_count,
  cast(o_totalprice as decimal(18,2)) total_price,
  case o_orderstatus when 'F' then 'confirmed' when 'O' then 'pending' else 'cancelled' end status,
  o_orderdate booked_at,
  case when o_orderstatus='F' then o_orderdate+(o_orderkey%5)*interval '1' day end confirmed_at,
  case when o_orderstatus='P' then o_orderdate+(o_orderkey%60)*interval '1' day end cancelled_at,
  case when o_orderpriority<>'4-NOT SPECIFIED' then o_orderpriority end payment_method
from orders join (select l_orderkey, min(l_partkey) tour_id, cast(min(l_quantity) as int) q
                  from lineitem group by l_orderkey) li on l_orderkey=o_orderkey""",
    "tours": """
select p_partkey id, p_name||' '||cast(p_partkey as varchar) title,
  replace(p_name,' ','-')||'-'||cast(p_partkey as varchar) slug,
  p_type||' tour by '||p_brand short_description, p_brand as location,
  cast(p_retailprice as decimal(10,2)) price,
  case when p_partkey%3=0 then cast(p_retailprice*0.9 as decimal(10,2)) end discount_price,
  cast(timestamp '2001-06-01 00:00:00'+(p_partkey%120)*interval '1' day as date) start_date,
  cast(timestamp '2001-06-01 00:00:00'+(p_partkey%120+1+p_size%10)*interval '1' day as date) end_date,
  1+p_size%10 duration_days, 40+2*p_size capacity, cast(coalesce(b.n,0) as bigint) booked_count,
  case when p_partkey%10<4 then 'available' when p_partkey%10<7 then 'upcoming'
       when p_partkey%10=7 then 'fully_booked' when p_partkey%10=8 then 'cancelled' else 'completed' end status,
  p_partkey%8=0 featured, p_partkey%50 created_by,
  timestamp '1995-01-01 00:00:00'+p_partkey*interval '1' day created_at
from part left join (select tour_id, sum(people_count) n from bookings where status<>'cancelled'
                     group by tour_id) b on b.tour_id=p_partkey""",
    "tour_categories": """
select distinct p_partkey tour_id, w category_id from (select p_partkey, unnest(string_split(p_name,' ')) w from part) x""",
    "tour_amenities": """
select p_partkey tour_id, p_type amenity_id from part union all select p_partkey, p_brand from part""",
    "categories": """
select distinct category_id id, category_id as name, cast(null as varchar) description, 'icon-'||category_id icon,
  '#'||substr(md5(category_id),1,6) color from tour_categories""",
    "amenities": """
select distinct amenity_id id, amenity_id as name, cast(null as varchar) description, 'icon-'||lower(amenity_id) icon
from tour_amenities""",
    "tour_images": """
select page_id id, page_id*7919%((select max(p_partkey)//8 from part)+1) tour_id, url image_url, page_id%3=0 is_main,
  cast(page_id%4 as int) display_order from pages""",
    "favorites": """
select user_id, cast(json_extract(props,'$.k') as bigint) tour_id, min(ts)-interval '8400' day created_at
from events where event_type='click' group by 1, 2""",
    "reviews": """
select event_id id, user_id, cast(json_extract(props,'$.k') as bigint) tour_id, cast(1+event_id%5 as int) rating,
  event_id%3<>0 is_approved, ts-interval '8400' day created_at from events where event_type='view'""",
    "live_bookings_src": """
select event_id id, user_id, cast(json_extract(props,'$.k') as bigint) tour_id, cast(1+event_id%4 as int) people_count,
  cast(value as decimal(18,2)) total_price,
  case when event_id%10<7 then 'confirmed' when event_id%10<9 then 'pending' else 'cancelled' end status,
  ts booked_at from events where event_type='purchase'""",
    "notifications": """
select event_id id, user_id, event_type as type, props message, event_id%2=0 is_read, ts created_at
from events where event_type='error'""",
    "bot_knowledge": """
select q.conv_id, q.turn, q.text question, a.text answer from conversations q
join conversations a on a.conv_id=q.conv_id and a.turn=q.turn+1 where q.role='user' and a.role<>'user'""",
    "requests": f"""
select event_id request_id, user_id, cast({TOUR % "json_extract(props,'$.k')"} as bigint) tour_id,
  cast(timestamp '2001-06-01 00:00:00' + (event_id%3*30)*interval '1' day as date) tour_date,
  cast(event_id%23 as int) people, ts arrived_at from events where event_type='click'""",
    "contact_messages": """
select case when conv_id%5=0 then ' ' else 'Guest '||conv_id end as name,
  case when conv_id%7=0 then 'nobody' else 'guest'||conv_id||'@example.com' end email, text message
from conversations where role='user'""",
    # main image of a tour, shared by the catalogue queries
    "main_images": """
select tour_id, min_by(image_url, (display_order, id)) main_image from tour_images where is_main group by tour_id""",
    # confirmed bookings per tour and day
    "day_load": """
select tour_id, cast(booked_at as date) as day, cast(sum(people_count) as bigint) booked
from bookings where status='confirmed' group by 1, 2""",
}

CTES.update({name: oracle(name) for name in CHANGE_SQL})


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def with_tables(sql: str) -> str:
    """Prepend the table definitions that the query (or a definition it uses) names."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in CTES.items():
            if name not in needed and _uses(text, name):
                needed.add(name)
                pending.append(body)
    order: list[str] = []

    def place(name: str) -> None:
        for other in CTES:
            if other in needed and other != name and other not in order and _uses(CTES[name], other):
                place(other)
        if name not in order:
            order.append(name)

    for name in CTES:
        if name in needed:
            place(name)
    sql = sql.strip()
    if not order:
        return sql
    head = ",\n".join(f"{n} as ({CTES[n]})" for n in order)
    if sql.startswith("with recursive "):
        return f"with recursive {head},\n{sql[15:]}"
    if sql.startswith("with "):
        return f"with {head},\n{sql[5:]}"
    return f"with {head}\n{sql}"
