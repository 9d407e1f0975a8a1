"""Registered change-set and data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.shared import fresh_folder
from sojourn.operators import changes as op
from sojourn.operators import quality as dq
from sojourn.plans.change_sets import change_set
from sojourn.plans.registry import register
from sojourn.plans.windows import NOW, NOW_SQL
from sojourn.schemas import ROLES, TOUR_STATUSES
from sojourn.sources import warehouse
from sojourn.sources.seeds import AMENITIES, CATEGORIES, seed_dimensions
from sojourn.tables import Tables

STAMP = "cast(null as timestamp)"
LAST = "(changed_at, seq)"

register(
    "insert_rows",
    lambda t: op.insert_rows(
        t.bookings, change_set(t, "new_bookings"), {"status": F.lit("pending"), "payment_status": F.lit("pending")}
    ).select("id", "user_id", "tour_id", "people_count", "total_price", "status", "payment_status", "booked_at"),
    """select id, user_id, tour_id, people_count, total_price, status, cast(null as varchar) payment_status, booked_at from bookings
union all select id, user_id, tour_id, people_count, total_price, 'pending', 'pending', booked_at from new_bookings""",
)
register(
    "insert_ignore",
    lambda t: op.insert_ignore(t.favorites, change_set(t, "new_favorites"), ["user_id", "tour_id"]),
    """select user_id, tour_id, created_at from favorites
union all select n.user_id, n.tour_id, n.created_at from new_favorites n
left join favorites f on f.user_id=n.user_id and f.tour_id=n.tour_id where f.user_id is null""",
)
register(
    "toggle_pairs",
    lambda t: op.toggle_pairs(t.favorites, change_set(t, "toggles"), ["user_id", "tour_id"], "created_at"),
    """with odd as (select user_id, tour_id, max(created_at) last_at from toggles group by 1, 2 having count(*)%2=1)
select coalesce(f.user_id, o.user_id) user_id, coalesce(f.tour_id, o.tour_id) tour_id, coalesce(f.created_at, last_at) created_at
from favorites f full join odd o on o.user_id=f.user_id and o.tour_id=f.tour_id where f.user_id is null or o.user_id is null""",
)
_USER = ("id", "name", "email", "phone", "role", "is_active", "updated_at")
_GIVEN = "trim({0})<>''"
register(
    "partial_update",
    lambda t: op.partial_update(
        t.users.select(*_USER), change_set(t, "profile_changes"), ["name", "phone"], NOW, ["changed_at", "seq"]
    ),
    f"""with c as (select id k, arg_max(name, {LAST}) filter (where {_GIVEN.format('name')}) new_name,
  arg_max(phone, {LAST}) filter (where {_GIVEN.format('phone')}) new_phone from profile_changes group by 1)
select id, coalesce(new_name, u.name) as name, email, coalesce(new_phone, phone) phone, role, is_active,
  case when new_name is not null or new_phone is not null then {NOW_SQL} else {STAMP} end updated_at
from users u left join c on k=id""",
)
register(
    "full_update",
    lambda t: op.full_update(
        t.tours.select("id", "title", "price", "location", "updated_at"), change_set(t, "tour_edits"),
        ["title", "price", "location"], NOW, ["changed_at", "seq"],
    ),
    f"""with c as (select id k, title new_title, price new_price from tour_edits
  qualify row_number() over (partition by id order by changed_at desc, seq desc)=1)
select id, coalesce(new_title, title) title, coalesce(new_price, price) price, case when k is null then location end as location,
  case when k is not null then {NOW_SQL} else {STAMP} end updated_at from tours left join c on k=id""",
)
register(
    "updated_at_stamp",
    lambda t: op.updated_at_stamp(t.users.select("id", "updated_at"), change_set(t, "gone_users"), NOW),
    f"""select id, case when id in (select id from gone_users) then {NOW_SQL} else {STAMP} end updated_at from users""",
)
_STATES = ("id", "tour_id", "people_count", "status", "confirmed_at", "cancelled_at", "cancellation_reason")
_VALID = "new_status in ('pending','confirmed','cancelled','completed')"
_MOVED = f"""select id, tour_id, people_count, coalesce(s, status) status, coalesce(c_at, confirmed_at) confirmed_at,
  coalesce(x_at, cancelled_at) cancelled_at, why cancellation_reason
from bookings left join (select id k, arg_max(new_status, {LAST}) s,
  max(case when new_status='confirmed' then changed_at end) c_at, max(case when new_status='cancelled' then changed_at end) x_at,
  arg_max(reason, {LAST}) filter (where new_status='cancelled') why from status_changes where {_VALID} group by 1) c on k=id"""


def _moved(t: Tables) -> DataFrame:
    return op.status_transition(t.bookings.select(*_STATES), change_set(t, "status_changes"))


register("status_transition", _moved, _MOVED)
register(
    "status_rejects",
    lambda t: op.rejected_status(change_set(t, "status_changes")),
    f"select id, new_status, changed_at, seq, reason from status_changes where not {_VALID}",
)
_COUNTED = f"""select t.id, title, cast(coalesce(n, 0) as bigint) booked_count
from tours t left join (select tour_id, sum(people_count) n from ({_MOVED}) m where status<>'cancelled' group by 1) b on b.tour_id=t.id"""
register(
    "booked_count_fold",
    lambda t: op.booked_count_fold(
        t.tours.select("id", "title", "booked_count"), op.transition_deltas(t.bookings.select(*_STATES), _moved(t))
    ),
    _COUNTED,
)
register(
    "booked_count_batch",
    lambda t: op.booked_count_fold(t.tours.select("id", "title", "booked_count"), op.batch_deltas(t.bookings, change_set(t, "status_changes"))),
    _COUNTED,
)
register(
    "find_or_create_user",
    lambda t: op.find_or_create_user(t.users.select("id", "name", "email", "phone", "role"), change_set(t, "contacts").select("contact_id", "email", "name", "phone", "arrived_at"))
    .select("id", "name", "email", "role"),
    """select id, name, email, role from users
union all select (select max(id) from users)+row_number() over (order by contact_id), name, email, 'user'
from (select email, min(contact_id) contact_id, arg_min(name, contact_id) as name from contacts
      where email not in (select email from users) group by 1) n""",
)


def _numbered(t: Tables) -> DataFrame:
    """All bookings with a number: a running one or one with a hexadecimal tail."""
    running = F.concat(F.lit("CT-"), F.date_format("booked_at", "yyMMdd"), F.lit("-"), F.lpad((F.col("id") % 50).cast("string"), 5, "0"))
    random = op.text.random_number(F.to_date("booked_at"), F.col("id"))
    return t.bookings.withColumn("booking_number", F.when(F.col("id") % 2 == 0, running).otherwise(random))


def _fresh(t: Tables) -> DataFrame:
    rows = change_set(t, "new_bookings")
    return rows.select("id", "user_id", F.expr("booked_at - interval '8400' day").alias("booked_at"))


register(
    "next_booking_number",
    lambda t: op.next_booking_number(_numbered(t), _fresh(t)),
    """with taken as (select cast(booked_at as date) d, max(case when id%2=0 then id%50
  when regexp_matches(hex, '^[0-9]+$') then cast(hex as bigint) end) last
  from (select *, upper(substr(sha256(cast(id as varchar)),1,6)) hex from bookings) h group by 1),
f as (select id, user_id, booked_at - interval 8400 day booked_at from new_bookings)
select f.id, user_id, booked_at, 'CT-'||strftime(booked_at,'%y%m%d')||'-'||
  (case when n<100000 then lpad(cast(n as varchar), 5, '0') else cast(n as varchar) end) booking_number
from (select f.*, coalesce(last, 0)+row_number() over (partition by cast(booked_at as date) order by f.id) n from f left join taken on d=cast(booked_at as date)) f""",
)
register(
    "random_booking_number",
    lambda t: op.random_booking_number(t.bookings.select("id", "booked_at")),
    """select id, booked_at, 'CT-'||strftime(booked_at,'%y%m%d')||'-'||upper(substr(sha256(cast(id as varchar)),1,6)) booking_number
from bookings""",
)
register(
    "replace_associations",
    lambda t: op.replace_associations(t.tour_categories, change_set(t, "chosen_categories"), change_set(t, "edited_tours")),
    """select tour_id, category_id from tour_categories where tour_id not in (select tour_id from edited_tours)
union all select distinct tour_id, category_id from chosen_categories where tour_id in (select tour_id from edited_tours)""",
)
register(
    "append_images",
    lambda t: op.append_images(t.tour_images, change_set(t, "uploads")).drop("alt_text"),
    """select id, tour_id, image_url, is_main, display_order from tour_images
union all select u.id, u.tour_id, image_url, false,
  cast(coalesce(n, 0)+row_number() over (partition by u.tour_id order by u.id)-1 as int)
from uploads u left join (select tour_id, count(*) n from tour_images group by 1) c on c.tour_id=u.tour_id""",
)
_FREE = "id in (select id from gone_tours) and id not in (select tour_id from bookings)"
register(
    "guarded_delete",
    lambda t: op.guarded_delete(t, change_set(t, "gone_tours")).tours.select("id", "title"),
    f"select id, title from tours where not ({_FREE})",
)
register(
    "guarded_delete_refused",
    lambda t: op.refused_deletes(t, change_set(t, "gone_tours")),
    "select id from gone_tours where id in (select tour_id from bookings)",
)


def _children_left(t: Tables) -> DataFrame:
    after = op.guarded_delete(t, change_set(t, "gone_tours"))
    parts = [
        getattr(after, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("child"), "rows")
        for name in ("tour_images", "tour_categories", "tour_amenities", "favorites")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


register(
    "guarded_delete_cascade",
    _children_left,
    "\nunion all\n".join(
        f"""select '{c}' child, count(*) as "rows" from {c} where tour_id not in (select id from gone_tours where id not in (select tour_id from bookings))"""
        for c in ("tour_images", "tour_categories", "tour_amenities", "favorites")
    ),
)


_SET = ("tours", *op.TOUR_CHILDREN, "bookings")


def _published_deletes(t: Tables) -> DataFrame:
    """The tables as one commit, the deletes as the next, and what is in both."""
    root = fresh_folder(t.spark, "deletes")
    warehouse.publish_set({name: getattr(t, name) for name in _SET}, root)
    last = warehouse.publish_deletes(t.spark, root, change_set(t, "gone_tours"))
    parts = []
    for number in (1, last):
        read = warehouse.load_set(t.spark, root, number)
        for name in _SET:
            key = F.col("id" if name == "tours" else "tour_id").alias("tour_id")
            counts = getattr(read, name).groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
            parts.append(counts.select(F.lit(number).alias("commit"), F.lit(name).alias("table_name"), "tour_id", "row_count"))
    return reduce(DataFrame.unionByName, parts)


def _rows_of(name: str, number: int, left: str) -> str:
    key = "id" if name == "tours" else "tour_id"
    return f"select {number} \"commit\", '{name}' table_name, {key} tour_id, count(*) row_count from {name} where {left.format(key=key)} group by {key}"


register(
    "published_deletes",
    _published_deletes,
    "\nunion all\n".join(
        [_rows_of(name, 1, "true") for name in _SET]
        + [_rows_of(name, 2, "not ({key} in (select id from gone_tours) and {key} not in (select tour_id from bookings))") for name in _SET]
    ),
)
register(
    "delete_rows",
    lambda t: op.delete_rows(t.bookings.select("id", "user_id", "tour_id"), change_set(t, "status_changes")),
    "select id, user_id, tour_id from bookings where id not in (select id from status_changes)",
)
register(
    "soft_delete_users",
    lambda t: op.soft_delete_users(t.users.select(*_USER), change_set(t, "gone_users"), NOW, free_email=True).drop("phone"),
    f"""select u.id, name, role, case when g.id is null then is_active else false end is_active,
  case when g.id is null then email else email||'_deleted_1706659200' end email,
  case when g.id is null then {STAMP} else {NOW_SQL} end updated_at
from users u left join gone_users g on g.id=u.id""",
)
register(
    "set_role_status",
    lambda t: op.set_checked(
        t.users.select("id", "role", "updated_at"), change_set(t, "role_changes"), "role", ROLES, ["changed_at", "seq"], NOW
    ),
    f"""with c as (select id k, arg_max(role, {LAST}) r from role_changes where role in ('admin','manager','user') group by 1)
select id, coalesce(r, role) as role, case when k is null then {STAMP} else {NOW_SQL} end updated_at from users left join c on k=id""",
)
register(
    "set_tour_status",
    lambda t: op.set_checked(
        t.tours.select("id", "status", "updated_at"), change_set(t, "tour_states"), "status", TOUR_STATUSES, ["changed_at", "seq"], NOW
    ),
    f"""with c as (select id k, arg_max(status, {LAST}) s from tour_states where status<>'open' group by 1)
select id, coalesce(s, status) status, case when k is null then {STAMP} else {NOW_SQL} end updated_at from tours left join c on k=id""",
)
register(
    "mark_notifications_read",
    lambda t: op.mark_notifications_read(t.notifications, users=change_set(t, "gone_users").withColumnRenamed("id", "user_id")),
    """select id, user_id, type, message, is_read or user_id in (select id from gone_users) is_read, created_at from notifications""",
)
register(
    "apply_payments",
    lambda t: op.apply_payments(
        t.bookings.select("id", F.concat(F.lit("CT-240101-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("booking_number"), "payment_status", "payment_method"),
        change_set(t, "payments"),
    ),
    """with b as (select id, 'CT-240101-'||lpad(cast(id as varchar),9,'0') booking_number, payment_method from bookings),
p as (select distinct booking_number k from payments where payment_status='COMPLETE')
select id, booking_number, case when k is not null then 'paid' end payment_status,
  case when k is not null then 'payfast' else payment_method end payment_method from b left join p on k=booking_number""",
)
register(
    "slugify_tours",
    lambda t: op.slugify_tours(t.tours),
    r"""select id, title, slug, count(*) over (partition by slug) as tours from (select id, title,
  regexp_replace(regexp_replace(regexp_replace(lower(title),'[^a-z0-9\s-]','','g'),'\s+','-','g'),'-+','-','g') slug from tours) s""",
)


def _seeded(t: Tables) -> DataFrame:
    after = seed_dimensions(t)
    return after.amenities.selectExpr("'amenity' kind", "name", "icon", "description").unionByName(
        after.categories.selectExpr("'category' kind", "name", "icon", "description")
    )


_SEED_A = ", ".join(f"('{n}','{i}')" for n, i in AMENITIES)
_SEED_C = ", ".join(f"('{n}','{d}')" for n, d in CATEGORIES)
register(
    "seed_dimensions",
    _seeded,
    f"""select 'amenity' kind, name, icon, description from amenities
union all select 'amenity', n, i, null from (values {_SEED_A}) v(n, i) where n not in (select name from amenities)
union all select 'category', name, icon, description from categories
union all select 'category', n, null, d from (values {_SEED_C}) v(n, d) where n not in (select name from categories)""",
)


def _rules(table: str, rules: dict[str, str]) -> str:
    """Violations of each rule; the text is the test a good row passes."""
    return "\nunion all\n".join(
        f"select '{name}' as rule, count(case when not ({test}) then 1 end) violations from {table}" for name, test in rules.items()
    )


register(
    "dq_domain",
    lambda t: dq.dq_domain(t),
    "\nunion all\n".join(
        [
            _rules("users", {"users.role": "role in ('admin','manager','user')"}),
            _rules("tours", {"tours.status": "status in ('upcoming','available','fully_booked','cancelled','completed')"}),
            _rules("bookings", {
                "bookings.status": "status in ('pending','confirmed','cancelled','completed')",
                "bookings.payment_status": "true", "bookings.people_count": "people_count>0"}),
            _rules("reviews", {"reviews.rating": "rating between 1 and 5"}),
        ]
    ),
)


def _duplicates() -> str:
    keys = [
        ("users", "id"), ("users", "email"), ("tours", "id"), ("tours", "slug"), ("bookings", "id"),
        ("categories", "name"), ("amenities", "name"), ("tour_categories", "tour_id, category_id"),
        ("tour_amenities", "tour_id, amenity_id"), ("favorites", "user_id, tour_id"),
    ]
    found = "\nunion all\n".join(
        f"select '{t}.{k.replace(', ', '+')}' as rule, count(*) violations from (select {k} from {t} group by {k} having count(*)>1) x"
        for t, k in keys
    )
    return found + """
union all select 'bookings.booking_number', 0 union all select 'reviews.user_id+tour_id+booking_id', 0"""


register("dq_unique", lambda t: dq.dq_unique(t), _duplicates())


def _orphans() -> str:
    return "\nunion all\n".join(
        f"""select '{c}.{col} -> {p}' as rule, count(*) violations from {c} where {col} is not null and {col} not in (select id from {p})"""
        for c, col, p in dq.FOREIGN_KEYS
        if col != "booking_id"
    ) + "\nunion all select 'reviews.booking_id -> bookings', 0"


register("dq_foreign_keys", lambda t: dq.dq_foreign_keys(t), _orphans())
_EMPTY = {"tours.full_description": "tours", "bookings.booking_number": "bookings"}
register(
    "dq_not_null",
    lambda t: dq.dq_not_null(t),
    "\nunion all\n".join(
        f"select '{t}.{c}' as rule, count(*) violations from {t}"
        + ("" if f"{t}.{c}" in _EMPTY else f" where {c} is null")
        for t, columns in dq.NOT_NULL.items()
        for c in columns
    ),
)
_given = "coalesce(trim({0})<>'', false)".format
register(
    "dq_tour_rules",
    lambda t: dq.dq_tour_rules(t),
    _rules("tours", {
        "title is given": _given("title"), "short_description is given": _given("short_description"),
        "full_description is given": "false", "location is given": _given("location"),
        "price >= 0": "coalesce(price>=0, false)", "capacity >= 1": "coalesce(capacity>=1, false)",
        "duration_days >= 1": "coalesce(duration_days>=1, false)", "start_date is given": "start_date is not null",
        "end_date is given": "end_date is not null", "end_date > start_date": "end_date>start_date"}),
)
register(
    "dq_booking_rules",
    lambda t: dq.dq_booking_rules(t.requests),
    _rules("requests", {
        "tour_date is given": "tour_date is not null", "people between 1 and 20": "coalesce(people between 1 and 20, false)"}),
)
_EMAIL = r"coalesce(regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$'), false)"
register(
    "dq_user_rules",
    lambda t: dq.dq_user_rules(t),
    _rules("users", {
        "name has two characters": "coalesce(length(trim(name))>=2, false)", "email is valid": _EMAIL, "phone is valid": "true"}),
)
register(
    "dq_contact_rules",
    lambda t: dq.dq_contact_rules(t.contact_messages),
    _rules("contact_messages", {
        "name is given": _given("name"), "email is valid": _EMAIL, "message is given": _given("message")}),
)
register("counter_drift", lambda t: op.counter_drift(t.replace(bookings=_moved(t))), f"""
select t.id, booked_count, cast(coalesce(n, 0) as bigint) people
from tours t left join (select tour_id, sum(people_count) n from ({_MOVED}) m where status<>'cancelled' group by 1) b on b.tour_id=t.id
where booked_count<>coalesce(n, 0)""")
