"""Data-quality reports: one row per rule with the number of violations.

Domain, null and form rules are conditional counts in one pass per table. Keys are folded before
they are compared, so a key that repeats often is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.schemas import (
    BOOKING_STATUSES,
    FOREIGN_KEYS,
    NOT_NULL,
    PAYMENT_STATUSES,
    ROLES,
    TOUR_STATUSES,
    UNIQUE_KEYS,
)
from sojourn.tables import Tables

# Form patterns.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^[+]?[\d\s-]{10,}$"


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule. A rule is a test that must not be false; null passes."""
    counts = df.agg(*[F.count_if(~test).alias(f"r{i}") for i, test in enumerate(rules.values())])
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _stack(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def _required(column: str) -> Column:
    """Present and not blank."""
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def dq_domain(t: Tables) -> DataFrame:
    return _stack(
        [
            count_rules(t.users, {"users.role": F.col("role").isin(*ROLES)}),
            count_rules(t.tours, {"tours.status": F.col("status").isin(*TOUR_STATUSES)}),
            count_rules(
                t.bookings,
                {
                    "bookings.status": F.col("status").isin(*BOOKING_STATUSES),
                    "bookings.payment_status": F.col("payment_status").isin(*PAYMENT_STATUSES),
                    "bookings.people_count": F.col("people_count") > 0,
                },
            ),
            count_rules(t.reviews, {"reviews.rating": F.col("rating").between(1, 5)}),
        ]
    )


def dq_unique(t: Tables) -> DataFrame:
    """Key values that occur more than once; a key with a null part is never a duplicate."""
    reports = []
    for table, keys in UNIQUE_KEYS.items():
        for key in keys:
            counts = getattr(t, table).dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            name = f"{table}.{'+'.join(key)}"
            reports.append(
                counts.agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(name).alias("rule"), "violations")
            )
    return _stack(reports)


def orphans(t: Tables, child: str, column: str, parent: str) -> DataFrame:
    """Referring values without a parent, with the number of rows that use them."""
    used = (
        getattr(t, child).filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    )
    return used.join(getattr(t, parent).select("id"), "id", "left_anti")


def dq_foreign_keys(t: Tables) -> DataFrame:
    """Rows that refer to a missing parent; null refers to nothing and is allowed.

    A parent's own ids and all references to it meet in one aggregation, in the ids' own type: an id is one row of counts, one for each rule
    of its parent, and tells whether the parent is there. So each table is read once and its ids are shuffled once, folded, without a join.
    """
    rules: dict[str, list[tuple[str, str]]] = {}
    for child, column, parent in FOREIGN_KEYS:
        rules.setdefault(parent, []).append((child, column))
    number = {parent: i for i, parent in enumerate(rules)}
    slots = max(map(len, rules.values()))
    is_text = {parent: isinstance(getattr(t, parent).schema["id"].dataType, T.StringType) for parent in rules}
    missing = []
    for as_text in (False, True):
        kind = "string" if as_text else "bigint"
        asked: dict[str, list[Column]] = {}
        for parent in (p for p in rules if is_text[p] == as_text):
            own = [(parent, "id", -1), *((child, column, slot) for slot, (child, column) in enumerate(rules[parent]))]
            for table, column, slot in own:
                row = F.struct(F.lit(number[parent]).cast("byte").alias("parent"), F.lit(slot).cast("byte").alias("slot"), F.col(column).cast(kind).alias("id"))
                asked.setdefault(table, []).append(row)
        if not asked:
            continue
        ids = _stack([getattr(t, table).select(F.inline(F.array(*rows))) for table, rows in asked.items()]).filter(F.col("id").isNotNull())
        counts = [F.count_if(F.col("slot") == k).alias(f"n{k}") for k in range(slots)]
        met = ids.groupBy("parent", "id").agg(F.max(F.col("slot") == -1).alias("known"), *counts)
        missing.append(met.filter(~F.col("known")).groupBy("parent").agg(F.array(*[F.sum(f"n{k}") for k in range(slots)]).alias("counts")))
    named = [
        F.struct(F.lit(f"{child}.{column} -> {parent}").alias("rule"), F.lit(number[parent]).alias("_parent"), F.lit(slot).alias("_slot"))
        for parent, children in rules.items()
        for slot, (child, column) in enumerate(children)
    ]
    # One row per parent table, which bounds the broadcast.
    broken = F.broadcast(_stack(missing))
    every = t.spark.range(1).select(F.inline(F.array(*named))).join(broken, F.col("_parent") == F.col("parent"), "left")
    return every.select("rule", F.coalesce(F.get("counts", F.col("_slot")), F.lit(0)).alias("violations"))


def dq_not_null(t: Tables) -> DataFrame:
    return _stack(
        [
            count_rules(getattr(t, table), {f"{table}.{c}": F.col(c).isNotNull() for c in columns})
            for table, columns in NOT_NULL.items()
        ]
    )


def dq_tour_rules(t: Tables) -> DataFrame:
    return count_rules(
        t.tours,
        {
            **{f"{c} is given": _required(c) for c in ("title", "short_description", "full_description", "location")},
            "price >= 0": F.coalesce(F.col("price") >= 0, F.lit(False)),
            "capacity >= 1": F.coalesce(F.col("capacity") >= 1, F.lit(False)),
            "duration_days >= 1": F.coalesce(F.col("duration_days") >= 1, F.lit(False)),
            "start_date is given": F.col("start_date").isNotNull(),
            "end_date is given": F.col("end_date").isNotNull(),
            "end_date > start_date": F.col("end_date") > F.col("start_date"),
        },
    )


def dq_booking_rules(requests: DataFrame) -> DataFrame:
    """Booking requests: a date, and 1 to 20 people."""
    return count_rules(
        requests,
        {
            "tour_date is given": F.col("tour_date").isNotNull(),
            "people between 1 and 20": F.coalesce(F.col("people").between(1, 20), F.lit(False)),
        },
    )


def dq_user_rules(t: Tables) -> DataFrame:
    return count_rules(
        t.users,
        {
            "name has two characters": F.coalesce(F.length(F.trim("name")) >= 2, F.lit(False)),
            "email is valid": F.coalesce(F.col("email").rlike(EMAIL), F.lit(False)),
            "phone is valid": F.col("phone").rlike(PHONE),
        },
    )


def dq_contact_rules(messages: DataFrame) -> DataFrame:
    return count_rules(
        messages,
        {
            "name is given": _required("name"),
            "email is valid": F.coalesce(F.col("email").rlike(EMAIL), F.lit(False)),
            "message is given": _required("message"),
        },
    )
