"""Change sets derived from the events, for the registered change queries. A third of the events names the hundred tours of ``props.k``, so
some pairs come again; the others are spread over all tours."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sojourn.tables import Tables

# name -> (Spark rows, DuckDB rows). Both read the whole events table.
CHANGE_SQL = {
    "status_changes": """
select event_id*7919%(select max(o_orderkey)+1 from orders) id, case event_id%4 when 0 then 'confirmed' when 1 then 'cancelled' when 2 then 'completed' else 'lost' end new_status,
  ts changed_at, event_id seq, 'reason '||(event_id%7) reason from events where event_type='purchase'""",
    "profile_changes": """
select user_id id, case when event_id%3=0 then 'Name '||event_id when event_id%3=1 then ' ' end as name,
  case when event_id%5=0 then '+27 65 '||event_id end phone, ts changed_at, event_id seq from events where event_type='view'""",
    "role_changes": """
select user_id id, case event_id%4 when 0 then 'admin' when 1 then 'manager' when 2 then 'user' else 'owner' end as role, ts changed_at, event_id seq
from events where event_type='view'""",
    "tour_states": """
select cast({k} as bigint) id, case event_id%4 when 0 then 'fully_booked' when 1 then 'completed' when 2 then 'upcoming' else 'open' end status,
  ts changed_at, event_id seq from events where event_type='click'""",
    "toggles": """
select user_id, cast({k} as bigint) tour_id, ts created_at from events where event_type in ('click', 'view')""",
    "new_favorites": """
select user_id, cast({k} as bigint) tour_id, min(ts) created_at from events where event_type='view' group by 1, 2""",
    "new_bookings": """
select event_id+100000000 id, user_id, cast({k} as bigint) tour_id, cast(1+event_id%4 as int) people_count,
  cast(value as decimal(18,2)) total_price, ts booked_at from events where event_type='purchase'""",
    "contacts": """
select event_id contact_id, case when event_id%2=0 then 'customer.'||lpad(cast(user_id as {text}),9,'0')||'@example.com'
  else 'new'||user_id||'@example.com' end email, 'Guest '||event_id as name, cast(null as {text}) phone, ts arrived_at
from events where event_type='click'""",
    "uploads": """
select event_id id, cast({k} as bigint) tour_id, 'https://images.example.com/up/tours/'||event_id||'.jpg' image_url
from events where event_type='view'""",
    "edited_tours": """
select distinct cast({k} as bigint) tour_id from events where event_type='click' and event_id%2=0""",
    "chosen_categories": """
select cast({k} as bigint) tour_id, case event_id%3 when 0 then 'ring' when 1 then 'widget' else 'gizmo' end category_id
from events where event_type='view'""",
    "gone_tours": """
select distinct cast({k} as bigint) id from events where event_type='click'""",
    "gone_users": """
select distinct user_id id from events where event_type='purchase' and event_id%3=0""",
    "payments": """
select 'CT-240101-'||lpad(cast(event_id*7919%(select max(o_orderkey)+1 from orders) as {text}),9,'0') booking_number, case when event_id%3=0 then 'FAILED' else 'COMPLETE' end payment_status
from events where event_type='purchase'""",
    "tour_edits": """
select cast({k} as bigint) id, 'Tour '||event_id title, cast(value as decimal(10,2)) price, cast(null as {text}) location, ts changed_at, event_id seq
from events where event_type='click'""",
}


# The tour that an event names; ``%s`` takes ``props.k`` out.
TOUR = "(case when event_id%%3=0 then cast(%s as bigint) else event_id*7919%%(select max(p_partkey)+1 from part) end)"


def oracle(name: str) -> str:
    return CHANGE_SQL[name].format(k=TOUR % "json_extract(props,'$.k')", text="varchar")


def change_set(t: Tables, name: str) -> DataFrame:
    sql = CHANGE_SQL[name].format(k=TOUR % "get_json_object(props,'$.k')", text="string")
    sources = ("events", "orders", "part")
    for source in sources:
        sql = sql.replace(f"from {source}", f"from {{{source}}}")
    frames = {source: getattr(t, f"raw_{source}") for source in sources if f"{{{source}}}" in sql}
    return t.spark.sql(sql, **frames)
