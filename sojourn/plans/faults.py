"""Data-quality reports over tables with injected faults, so that every rule has something to find.

Which rows get a fault follows from a hash of the row's key and a seed, the same in Spark and in the oracle: the faults are expressions that both
understand. Some rows are also there twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators import quality as dq
from sojourn.plans.oracle_tables import CTES
from sojourn.plans.registry import register
from sojourn.schemas import BOOKING_STATUSES, FOREIGN_KEYS, NOT_NULL, PAYMENT_STATUSES, ROLES, TOUR_STATUSES, UNIQUE_KEYS
from sojourn.tables import Tables

SEED, CLASSES, FAR = 17, 101, 900_000_000


def _hash(key: str) -> str:
    return f"(({key}*7919+{SEED})%{CLASSES})"


def _picked(column: str, key: str, **faults: str) -> str:
    """The column, or in the classes of rows named ``c<number>`` another value."""
    cases = " ".join(f"when {_hash(key)}={name[1:]} then {value}" for name, value in faults.items())
    return f"case {cases} else {column} end"


def _blank(column: str, of: str) -> str:
    """Null for the rows whose text hashes to one of the first digits."""
    return f"case when substr(md5({of}),1,1) in ('0','1','2','3','4') then null else {column} end"


# table -> column -> its value with faults.
FAULTS: dict[str, dict[str, str]] = {
    "users": {
        "role": _picked("role", "id", c1="'owner'"),
        "name": _picked("name", "id", c2="null", c3="'x'"),
        "email": _picked("email", "id", c4="null", c5="'nobody'"),
        "phone": f"case when {_hash('id')}=6 then '12' when {_hash('id')}<50 then '+27 65 000 1112' end",
    },
    "tours": {
        "status": _picked("status", "id", c1="'lost'"),
        "title": _picked("title", "id", c2="null"),
        "slug": _picked("slug", "id", c3="null"),
        "short_description": _picked("short_description", "id", c4="null", c5="' '"),
        "full_description": _picked("'About '||id", "id", c6="null"),
        "location": _picked("location", "id", c7="null"),
        "price": _picked("price", "id", c8="null", c9="-1"),
        "start_date": _picked("start_date", "id", c10="null"),
        "end_date": _picked("end_date", "id", c11="null", c12="start_date"),
        "duration_days": _picked("duration_days", "id", c13="null", c14="0"),
        "capacity": _picked("capacity", "id", c15="null", c16="0"),
        "created_by": _picked("created_by", "id", c17=str(FAR)),
    },
    "bookings": {
        "status": _picked("status", "id", c1="'lost'"),
        "payment_status": f"case when {_hash('id')}=2 then 'lent' when {_hash('id')}<50 then 'paid' end",
        "people_count": _picked("people_count", "id", c3="0", c4="null"),
        "booking_number": _picked("'N-'||id", "id", c5="null"),
        "user_id": _picked("user_id", "id", c6="null", c7=str(FAR)),
        "tour_id": _picked("tour_id", "id", c8="null", c9=str(FAR)),
        "total_price": _picked("total_price", "id", c10="null"),
    },
    "categories": {"name": _blank("name", "id")},
    "amenities": {"name": _blank("name", "id")},
    "tour_images": {"image_url": _picked("image_url", "id", c1="null"), "tour_id": _picked("tour_id", "id", c2=str(FAR))},
    "tour_categories": {"tour_id": _picked("tour_id", "tour_id", c1=str(FAR)), "category_id": _picked("category_id", "tour_id", c2="'nowhere'")},
    "tour_amenities": {"tour_id": _picked("tour_id", "tour_id", c1=str(FAR)), "amenity_id": _picked("amenity_id", "tour_id", c2="'nowhere'")},
    "favorites": {"user_id": _picked("user_id", "user_id", c1=str(FAR)), "tour_id": _picked("tour_id", "user_id", c2=str(FAR))},
    "reviews": {
        "rating": _picked("rating", "id", c1="9"),
        "user_id": _picked("user_id", "id", c2=str(FAR)),
        "tour_id": _picked("tour_id", "id", c3=str(FAR)),
        "booking_id": f"case when {_hash('id')}=4 then {FAR} when {_hash('id')}<60 then id%50 end",
    },
    "requests": {"tour_date": _picked("tour_date", "request_id", c1="null")},
    "contact_messages": {"message": _blank("message", "message")},
}
_OFTEN = "substr(md5(id),1,1) in ('5','6','7','8','9')"
# table -> which of its rows are there twice.
TWICE = {
    **{table: f"{_hash('id')}=20" for table in ("users", "tours", "bookings", "reviews")},
    **{table: f"{_hash('tour_id')}=20" for table in ("tour_categories", "tour_amenities")},
    "favorites": f"{_hash('user_id')}=20",
    "categories": _OFTEN,
    "amenities": _OFTEN,
}
# Columns that the oracle's tables do not have, since they are null in the given data.
_NEW = {"tours": ("full_description",), "bookings": ("payment_status", "booking_number"), "reviews": ("booking_id",)}


def with_faults(t: Tables) -> Tables:
    def faulty(name: str) -> DataFrame:
        rows = getattr(t, name)
        rows = rows.withColumns({c: F.expr(e).cast(rows.schema[c].dataType) for c, e in FAULTS[name].items()})
        return rows.unionByName(rows.filter(TWICE[name])) if name in TWICE else rows

    return t.replace(**{name: faulty(name) for name in FAULTS})


def _faulty_sql(name: str) -> str:
    new = _NEW.get(name, ())
    replaced = ", ".join(f"{e} as {c}" for c, e in FAULTS[name].items() if c not in new)
    rows = f"select * replace ({replaced})" + "".join(f", {FAULTS[name][c]} as {c}" for c in new) + f" from {name}"
    return f"{rows} union all select * from ({rows}) x where {TWICE[name]}" if name in TWICE else rows


CTES.update({f"faulty_{name}": _faulty_sql(name) for name in FAULTS})

_REPORTS = {
    "domain": dq.dq_domain,
    "unique": dq.dq_unique,
    "foreign keys": dq.dq_foreign_keys,
    "not null": dq.dq_not_null,
    "tours": dq.dq_tour_rules,
    "requests": lambda t: dq.dq_booking_rules(t.requests),
    "users": dq.dq_user_rules,
    "messages": lambda t: dq.dq_contact_rules(t.contact_messages),
}


def _all_reports(t: Tables) -> DataFrame:
    faulty = with_faults(t)
    parts = [report(faulty).select(F.lit(name).alias("report"), "rule", "violations") for name, report in _REPORTS.items()]
    return reduce(DataFrame.unionByName, parts)


def _count(report: str, rule: str, table: str, broken: str) -> str:
    return f"select '{report}' report, '{rule}' as rule, count(*) violations from faulty_{table} where {broken}"


def _among(column: str, values: tuple[str, ...]) -> str:
    return f"{column} not in ({', '.join(map(repr, values))})"


def _oracle() -> str:
    blank = "not coalesce(trim({0})<>'', false)".format
    email = r"not coalesce(regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$'), false)"
    parts = [
        _count("domain", "users.role", "users", _among("role", ROLES)),
        _count("domain", "tours.status", "tours", _among("status", TOUR_STATUSES)),
        _count("domain", "bookings.status", "bookings", _among("status", BOOKING_STATUSES)),
        _count("domain", "bookings.payment_status", "bookings", _among("payment_status", PAYMENT_STATUSES)),
        _count("domain", "bookings.people_count", "bookings", "people_count<=0"),
        _count("domain", "reviews.rating", "reviews", "rating not between 1 and 5"),
    ]
    for table, keys in UNIQUE_KEYS.items():
        for key in keys:
            given = " and ".join(f"{c} is not null" for c in key)
            twice = f"(select 1 from faulty_{table} where {given} group by {', '.join(key)} having count(*)>1) x"
            parts.append(f"select 'unique', '{table}.{'+'.join(key)}', count(*) from {twice}")
    for child, column, parent in FOREIGN_KEYS:
        parts.append(_count("foreign keys", f"{child}.{column} -> {parent}", child, f"{column} is not null and {column} not in (select id from faulty_{parent})"))
    parts += [_count("not null", f"{table}.{c}", table, f"{c} is null") for table, columns in NOT_NULL.items() for c in columns]
    parts += [_count("tours", f"{c} is given", "tours", blank(c)) for c in ("title", "short_description", "full_description", "location")]
    parts += [_count("tours", f"{c} >= {n}", "tours", f"not coalesce({c}>={n}, false)") for c, n in (("price", 0), ("capacity", 1), ("duration_days", 1))]
    parts += [_count("tours", f"{c} is given", "tours", f"{c} is null") for c in ("start_date", "end_date")]
    parts += [
        _count("tours", "end_date > start_date", "tours", "end_date<=start_date"),
        _count("requests", "tour_date is given", "requests", "tour_date is null"),
        _count("requests", "people between 1 and 20", "requests", "not coalesce(people between 1 and 20, false)"),
        _count("users", "name has two characters", "users", "not coalesce(length(trim(name))>=2, false)"),
        _count("users", "email is valid", "users", email),
        _count("users", "phone is valid", "users", r"not regexp_matches(phone, '^[+]?[\d\s-]{10,}$')"),
        _count("messages", "name is given", "contact_messages", blank("name")),
        _count("messages", "email is valid", "contact_messages", email),
        _count("messages", "message is given", "contact_messages", blank("message")),
    ]
    return "\nunion all\n".join(parts)


register("dq_faults", _all_reports, _oracle())
