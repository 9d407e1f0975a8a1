"""Registered scalar families."""

from __future__ import annotations

from datetime import date

from sojourn.operators import scalars as op
from sojourn.plans.registry import register
from sojourn.plans.sqltext import pct
from sojourn.plans.windows import AS_OF
from sojourn.sources.testdata import live

register(
    "scalar_null_handling",
    lambda t: op.null_handling(t),
    """select id, coalesce(payment_method,'unknown') as method, nullif(status,'cancelled') kept_status,
  payment_method is null no_method, cancelled_at is not null was_cancelled from bookings""",
)
register(
    "scalar_conditional",
    lambda t: op.conditional(t),
    """select id, case when people_count>=15 then 'group' when people_count>=5 then 'party' else 'few' end party,
  case status when 'confirmed' then 1 when 'pending' then 2 end as "position" from bookings""",
)
register(
    "scalar_date_truncation",
    lambda t: op.date_truncation(live(t)),
    """select id, date_trunc('hour', booked_at) as hour, cast(booked_at as date) as day,
  cast(date_trunc('week', booked_at) as date) as week, cast(date_trunc('month', booked_at) as date) as month,
  cast(date_trunc('quarter', booked_at) as date) as quarter, cast(date_trunc('year', booked_at) as date) as year,
  cast(booked_at as date) - cast(dayofweek(booked_at) as int) sunday_week from live_bookings_src""",
)
register(
    "scalar_date_parts",
    lambda t: op.date_parts(t),
    """select id, cast(month(booked_at) as int) as month, cast(year(booked_at) as int) as year,
  datediff('day', booked_at, cancelled_at) days_to_cancel, cast(epoch(booked_at) as bigint) as epoch from bookings""",
)
register(
    "scalar_age",
    lambda t: op.age(t, as_of=AS_OF),
    """select id, cast(datediff('month', created_at, timestamp '2001-08-01') as int) age_months,
  cast(datediff('month', created_at, timestamp '2001-08-01')%12 as int) month_component from users""",
)
register(
    "scalar_date_arithmetic",
    lambda t: op.date_arithmetic(t),
    """select id, cast(booked_at as date) - 30 a_month_of_days_before, cast(booked_at + interval 1 month as date) a_month_later,
  booked_at - interval 1 hour an_hour_before, booked_at + interval 90 day ninety_days_later from bookings""",
)
register(
    "scalar_date_casts",
    lambda t: op.date_casts(live(t), start=date(2024, 1, 5)),
    """select id, cast(booked_at as date) as day, cast(cast(booked_at as date) as timestamp) midnight, true as same
from live_bookings_src where cast(booked_at as date) >= date '2024-01-05'""",
)
register(
    "scalar_generator",
    lambda t: op.generator(t, as_of=AS_OF),
    """select cast(m as date) as month, count(*) members from (
select unnest(generate_series(date_trunc('month', created_at), timestamp '2001-08-01', interval 1 month)) m from users) x group by 1""",
)
register(
    "scalar_day_loop",
    lambda t: op.day_loop(t),
    """select id, cast(unnest(generate_series(cast(start_date as timestamp), cast(end_date as timestamp), interval 1 day)) as date) as day
from tours""",
)
register(
    "scalar_formatting",
    lambda t: op.formatting(live(t)),
    """select id, strftime(booked_at, '%Y-%m-%d') day_text, strftime(booked_at, '%Y-%m') month_text,
  strftime(booked_at, '%Y-')||lpad(cast((dayofyear(booked_at)-1)//7+1 as varchar),2,'0') week_text,
  strftime(booked_at, '%y%m%d') short_text, strftime(booked_at, '%Y-%m-%d %H:%M:%S') time_text from live_bookings_src""",
)
register(
    "scalar_string_match",
    lambda t: op.string_match(t),
    """select id, (title ilike '%ring%' or short_description ilike '%ring%') has_ring, slug like 'red-%' starts_red,
  title ilike '%l_%g%' wildcards from tours""",
)
register(
    "scalar_string_build",
    lambda t: op.string_build(t),
    """select id, 'B-'||lpad(cast(id as varchar),12,'0') code, id as number, concat_ws('|', status, payment_method) labels
from bookings""",
)
register(
    "scalar_string_clean",
    lambda t: op.string_clean(t),
    r"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(lower(question), '[^a-z0-9\s-]', '', 'g'),
  '\s+', '-', 'g'), '-+', '-', 'g') slug from bot_knowledge""",
)
_KEY = """case when contains(image_url, 'example') then
  concat_ws('/', string_split(image_url,'/')[-3], string_split(image_url,'/')[-2],
            string_split(string_split(image_url,'/')[-1],'.')[1]) end"""
register("scalar_url_part", lambda t: op.url_part(t, host="example"), f"select id, {_KEY} image_key from tour_images")
register(
    "image_public_ids",
    lambda t: op.url_part(t, host="example.net"),
    f"select id, {_KEY.replace(chr(39) + 'example' + chr(39), chr(39) + 'example.net' + chr(39))} image_key from tour_images",
)
register(
    "scalar_math",
    lambda t: op.math(t),
    f"""select id, round((cast(price as double)*capacity+1)*100)/100 worth, {pct('booked_count', 'capacity', 1)} booked_percent,
  cast(ceil(capacity/12.0) as bigint) pages, abs(capacity-booked_count) distance from tours""",
)
register(
    "scalar_membership",
    lambda t: op.membership(t),
    """select id, status, capacity from tours where status in ('upcoming','available') and capacity between 60 and 100
and id in (select tour_id from favorites)""",
)
register(
    "scalar_json_array",
    lambda t: op.json_array(t),
    """select id, cast(len(items) as int) item_count, items[1] first_item, cast(to_json(items) as varchar) json
from (select id, case when id%3=0 then cast([] as varchar[]) when id%3=1 then [m] else [m, 'x,y'] end items
      from (select id, coalesce(payment_method,'none') m from bookings) b) x""",
)
register(
    "scalar_hash_id",
    lambda t: op.hash_id(t),
    """select id, sha256(cast(id as varchar)) digest,
  'CT-'||strftime(booked_at,'%y%m%d')||'-'||upper(substr(sha256(id||'|'||user_id),1,6)) as number from bookings""",
)
register(
    "scalar_js_coercion",
    lambda t: op.js_coercion(t),
    r"""select id, coalesce(try_cast(regexp_extract(payment_method, '^\s*([+-]?\d+)', 1) as bigint), 0) as number from bookings""",
)
register(
    "period_label",
    lambda t: op.period_labels(t),
    """select "period", label, count(*) bookings from (
select 'day' as "period", cast(day(booked_at) as varchar)||' '||strftime(booked_at,'%a') as label from bookings
union all select 'week', 'Week '||cast(cast(ceil(day(booked_at)/7.0) as int) as varchar) from bookings
union all select 'month', strftime(booked_at,'%b %y') from bookings
union all select 'quarter', 'Q'||quarter(booked_at)||' '||strftime(booked_at,'%y') from bookings
union all select 'year', strftime(booked_at,'%Y') from bookings) x group by 1, 2""",
)
