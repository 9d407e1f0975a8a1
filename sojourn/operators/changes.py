"""Batches of changes applied to table snapshots.

Each operator takes a snapshot and a DataFrame of changes and returns the new snapshot (some
also the rejected changes). Changes of one key are folded to one row by partial aggregation
before they meet the snapshot, so a key that changes very often is still one row. Parquet has no
MERGE; ``sources.warehouse.publish`` writes the result as a new version.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import dates, text
from sojourn.functions.numbering import running_number
from sojourn.functions.shared import written
from sojourn.functions.skew import join_hot
from sojourn.schemas import BOOKING_STATUSES
from sojourn.tables import Tables


def latest(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key; ``order`` must be unique within a key."""
    rest = [c for c in changes.columns if c != key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return changes.groupBy(key).agg(last).select(key, "_last.*")


def _renamed(changes: DataFrame, key: str) -> DataFrame:
    """Change columns under names that cannot clash with the table's."""
    return changes.withColumnsRenamed({c: f"_{c}" for c in changes.columns}).withColumnRenamed(f"_{key}", "_key")


def insert_rows(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Append rows. A column that is absent or null takes its default, other absent ones are null."""
    for name, value in defaults.items():
        kind = table.schema[name].dataType
        given = F.coalesce(F.col(name), value) if name in rows.columns else value
        rows = rows.withColumn(name, given.cast(kind))
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows whose key is new; of several new rows with one key the smallest stays."""
    rest = [c for c in table.columns if c not in key]
    if rest:
        first = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")
    else:
        first = rows.select(*key).distinct()
    return table.unionByName(first.join(table, list(key), "left_anti").select(*table.columns))


def toggle_pairs(table: DataFrame, toggles: DataFrame, key: Sequence[str], stamp: str) -> DataFrame:
    """Flip membership once per toggle: an even number changes nothing. A pair that gets added is stamped
    with its last toggle."""
    odd = (
        toggles.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(stamp).alias("_at"))
        .filter(F.col("_n") % 2 == 1)
    )
    present = table.withColumn("_present", F.lit(True))
    joined = present.join(odd, list(key), "full_outer")
    return joined.filter(F.col("_present").isNull() | F.col("_n").isNull()).select(
        *[F.coalesce(F.col(c), F.col("_at")).alias(c) if c == stamp else F.col(c) for c in table.columns]
    )


def partial_update(
    table: DataFrame, changes: DataFrame, columns: Sequence[str], now: datetime, order: Sequence[str], key: str = "id"
) -> DataFrame:
    """Set only the columns a change supplies: null and blank leave the old value. Several changes
    of one key count in order, column by column. ``updated_at`` moves only when something was supplied."""
    at = F.struct(*order)

    def last_supplied(name: str) -> Column:
        value = F.col(name)
        supplied = value.isNotNull() & (F.trim(value.cast("string")) != "")
        return F.max_by(value, F.when(supplied, at)).alias(f"_{name}")

    folded = changes.groupBy(F.col(key).alias("_key")).agg(*[last_supplied(c) for c in columns])
    supplied_any = F.coalesce(*[F.col(f"_{c}").cast("string") for c in columns]).isNotNull()
    joined = table.join(folded, F.col("_key") == F.col(key), "left")
    updated = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    updated["updated_at"] = F.when(supplied_any, dates.ts(now)).otherwise(F.col("updated_at"))
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in table.columns])


def full_update(
    table: DataFrame, changes: DataFrame, columns: Sequence[str], now: datetime, order: Sequence[str], key: str = "id"
) -> DataFrame:
    """Replace all listed columns of matched rows, nulls included."""
    last = _renamed(latest(changes, key, order), key)
    joined = table.join(last, F.col("_key") == F.col(key), "left")
    hit = F.col("_key").isNotNull()
    updated = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    if "updated_at" in table.columns:
        updated["updated_at"] = F.when(hit, dates.ts(now)).otherwise(F.col("updated_at"))
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in table.columns])


def updated_at_stamp(table: DataFrame, touched: DataFrame, now: datetime, key: str = "id") -> DataFrame:
    """Stamp every row whose key was touched."""
    keys = touched.select(F.col(key).alias("_key")).distinct()
    joined = table.join(keys, F.col("_key") == F.col(key), "left")
    stamped = F.when(F.col("_key").isNotNull(), dates.ts(now)).otherwise(F.col("updated_at"))
    return joined.select(*[stamped.alias(c) if c == "updated_at" else F.col(c) for c in table.columns])


def rejected_status(changes: DataFrame, allowed: Sequence[str] = BOOKING_STATUSES) -> DataFrame:
    """Changes that name no valid state."""
    return changes.filter(~F.coalesce(F.col("new_status").isin(*allowed), F.lit(False)))


def status_transition(
    bookings: DataFrame, changes: DataFrame, allowed: Sequence[str] = BOOKING_STATUSES
) -> DataFrame:
    """Apply the valid changes (id, new_status, changed_at, seq, reason) in order. The last one gives the
    state; the last confirmation stamps ``confirmed_at``, the last cancellation ``cancelled_at`` and
    the reason. Applying a batch again changes nothing."""
    at = F.struct("changed_at", "seq")
    confirms, cancels = F.col("new_status") == "confirmed", F.col("new_status") == "cancelled"
    folded = (
        changes.filter(F.col("new_status").isin(*allowed))
        .groupBy(F.col("id").alias("_key"))
        .agg(
            F.max_by("new_status", at).alias("_status"),
            F.max(F.when(confirms, F.col("changed_at"))).alias("_confirmed_at"),
            F.max(F.when(cancels, F.col("changed_at"))).alias("_cancelled_at"),
            F.max_by("reason", F.when(cancels, at)).alias("_cancellation_reason"),
            F.max("changed_at").alias("_updated_at"),
        )
    )
    joined = bookings.join(folded, F.col("_key") == F.col("id"), "left")
    changed = ("status", "confirmed_at", "cancelled_at", "cancellation_reason", "updated_at")
    return joined.select(
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in bookings.columns]
    )


def set_checked(
    table: DataFrame, changes: DataFrame, column: str, allowed: Sequence, order: Sequence[str], now: datetime
) -> DataFrame:
    """Set one column to the last whitelisted value of each id (role, active flag, tour status)."""
    valid = changes.filter(F.col(column).isin(*allowed))
    last = _renamed(latest(valid.select("id", column, *order), "id", order), "id")
    joined = table.join(last, F.col("_key") == F.col("id"), "left")
    updated = {
        column: F.coalesce(F.col(f"_{column}"), F.col(column)),
        "updated_at": F.when(F.col("_key").isNotNull(), dates.ts(now)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[updated[c].alias(c) if c in updated else F.col(c) for c in table.columns])


def transition_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Seats each tour gains or loses between two booking snapshots: a booking counts while it exists and is
    not cancelled, so repeating a cancellation changes nothing."""

    def held(bookings: DataFrame, sign: int) -> DataFrame:
        return bookings.filter(F.col("status") != "cancelled").select(
            "tour_id", (F.col("people_count") * sign).alias("delta")
        )

    return held(before, -1).unionByName(held(after, 1))


def batch_deltas(bookings: DataFrame, changes: DataFrame, allowed: Sequence[str] = BOOKING_STATUSES) -> DataFrame:
    """The seat changes (tour_id, delta) that ``status_transition`` makes, from the bookings of the batch alone.

    Each booking that the valid changes (id, new_status, changed_at, seq) name is met once, and its state before is weighed against the one
    after; the others never leave their files, and those of other months are not read where the changes know the month. One row for each
    tour of the batch comes out, so the running counters are maintained by what changed.
    """
    month = [dates.MONTH] if dates.MONTH in bookings.columns and dates.MONTH in changes.columns else []
    last = F.max_by("new_status", F.struct("changed_at", "seq")).alias("_after")
    asked = changes.filter(F.col("new_status").isin(*allowed)).groupBy("id", *month).agg(last)
    met = bookings.select("id", "tour_id", "status", "people_count", *month).join(asked, ["id", *month])
    held = lambda status: F.coalesce((F.col(status) != "cancelled").cast("int"), F.lit(0))
    delta = F.col("people_count") * (held("_after") - held("status"))
    return met.groupBy("tour_id").agg(F.sum(delta).alias("delta")).filter("delta <> 0")


def inserted_deltas(rows: DataFrame) -> DataFrame:
    """The seat changes of new bookings."""
    return rows.filter(F.col("status") != "cancelled").groupBy("tour_id").agg(F.sum("people_count").alias("delta"))


def booked_count_fold(tours: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the signed seat changes (tour_id, delta) to the running counter."""
    sums = deltas.groupBy(F.col("tour_id").alias("_key")).agg(F.sum("delta").alias("_delta"))
    joined = tours.join(sums, F.col("_key") == F.col("id"), "left")
    count = F.col("booked_count") + F.coalesce("_delta", F.lit(0))
    return joined.select(*[count.alias(c) if c == "booked_count" else F.col(c) for c in tours.columns])


def counter_drift(t: Tables) -> DataFrame:
    """Tours whose running counter differs from the people of their bookings that are not cancelled."""
    real = (
        t.bookings.filter(F.col("status") != "cancelled")
        .groupBy("tour_id")
        .agg(F.sum("people_count").alias("people"))
    )
    people = F.coalesce("people", F.lit(0))
    return (
        t.tours.join(real, F.col("id") == F.col("tour_id"), "left")
        .filter(F.col("booked_count") != people)
        .select("id", "booked_count", people.alias("people"))
    )


def find_or_create_user(users: DataFrame, contacts: DataFrame) -> DataFrame:
    """Users plus one new plain user per unknown e-mail (name and phone of the first contact by
    ``arrived_at``). New ids follow the largest old one in order of arrival."""
    first = F.min(F.struct("arrived_at", "contact_id", "name", "phone")).alias("_first")
    fresh = (
        contacts.filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(first)
        .select("email", "_first.*")
        .join(users.select("email"), "email", "left_anti")
    )
    numbered = running_number(fresh, [], "contact_id", "_n")
    last_id = users.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = numbered.select(
        (last_id + F.col("_n")).alias("id"), "name", "email", "phone",
        F.lit("user").alias("role"), F.lit(True).alias("is_active"), F.col("arrived_at").alias("created_at"),
    )
    return users.unionByName(rows, allowMissingColumns=True)


def next_booking_number(bookings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Give each new booking (id, booked_at) the next number of its day, in order of id. Only tails of
    digits count; a random tail without letters counts too, so the new number differs from it."""
    day = F.to_date("booked_at")
    taken = (
        bookings.filter(F.col("booking_number").rlike(f"^{text.NUMBER_PREFIX}[0-9]{{6}}-"))
        .groupBy(F.substring("booking_number", 1, len(text.NUMBER_PREFIX) + 7).alias("_stem"))
        .agg(F.max(text.number_sequence("booking_number")).alias("_last"))
    )
    numbered = running_number(fresh.withColumn("_day", day), ["_day"], "id", "_n").withColumn(
        "_stem", text.number_stem(F.col("_day"))
    )
    # A number of more than five digits is kept whole.
    tail = (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("string")
    padded = F.when(F.length(tail) < 5, F.lpad(tail, 5, "0")).otherwise(tail)
    # One row per calendar day, which bounds the broadcast.
    joined = numbered.join(F.broadcast(taken), "_stem", "left")
    return joined.withColumn("booking_number", F.concat("_stem", padded)).select(*fresh.columns, "booking_number")


def random_booking_number(fresh: DataFrame) -> DataFrame:
    """Give each new booking a number with a hexadecimal tail derived from its id."""
    return fresh.withColumn("booking_number", text.random_number(F.to_date("booked_at"), F.col("id")))


def number_collisions(fresh: DataFrame) -> DataFrame:
    """Random numbers given more than once."""
    counts = random_booking_number(fresh).groupBy("booking_number").agg(F.count(F.lit(1)).alias("bookings"))
    return counts.filter(F.col("bookings") > 1)


def replace_associations(links: DataFrame, chosen: DataFrame, edited: DataFrame) -> DataFrame:
    """Links of edited tours (tour_id) are replaced by the chosen ones; an edited tour without a choice
    keeps none."""
    kept = links.join(edited.select("tour_id").distinct(), "tour_id", "left_anti")
    new = chosen.join(edited.select("tour_id").distinct(), "tour_id", "left_semi")
    return kept.unionByName(new.select(*links.columns).distinct())


def append_images(images: DataFrame, uploads: DataFrame, new_tours: bool = False) -> DataFrame:
    """Add uploaded images (id, tour_id, image_url): the display order goes on from the tour's number of
    images, and none of them is the main image. For ``new_tours`` the very first image is the main one."""
    counts = images.groupBy("tour_id").agg(F.count(F.lit(1)).alias("_old"))
    numbered = running_number(uploads, ["tour_id"], "id", "_n")
    order = (F.coalesce("_old", F.lit(0)) + F.col("_n") - 1).cast("int")
    new = join_hot(numbered, counts, ["tour_id"], "left").select(
        *uploads.columns, (F.lit(new_tours) & (order == 0)).alias("is_main"), order.alias("display_order")
    )
    return images.unionByName(new, allowMissingColumns=True)


def delete_rows(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(F.col(key)).distinct(), key, "left_anti").select(*table.columns)


def _booked(t: Tables) -> DataFrame:
    """Tours with a booking, once each: a tour that holds most bookings is one row."""
    return t.bookings.select(F.col("tour_id").alias("id")).distinct()


def deletable(t: Tables, gone: DataFrame) -> DataFrame:
    """Tours (id) that no booking refers to. Write the result to hand it to ``guarded_delete``."""
    return gone.select("id").distinct().join(_booked(t), "id", "left_anti")


def refused_deletes(t: Tables, gone: DataFrame) -> DataFrame:
    """Tours that may not be deleted because a booking refers to them."""
    return gone.select("id").distinct().join(_booked(t), "id", "left_semi")


# The tables whose rows go with a tour.
TOUR_CHILDREN = ("tour_images", "tour_categories", "tour_amenities", "favorites")


def guarded_delete(t: Tables, gone: DataFrame, free: DataFrame | None = None) -> Tables:
    """Delete the tours no booking refers to, with their images, links and favourites. Each of the five tables needs to
    know which these are; ``free`` is the written result of ``deletable``, which is written here where none is given, so that the bookings are
    folded only once."""
    free = written(deletable(t, gone), "deletable") if free is None else free
    as_child = free.select(F.col("id").alias("tour_id"))
    frames = {
        name: join_hot(getattr(t, name), as_child, ["tour_id"], "left_anti").select(*getattr(t, name).columns)
        for name in TOUR_CHILDREN
    }
    return t.replace(tours=delete_rows(t.tours, free), **frames)


def soft_delete_users(users: DataFrame, gone: DataFrame, now: datetime, free_email: bool = False) -> DataFrame:
    """Deactivate users; ``free_email`` also renames the address so that it can be used again."""
    keys = gone.select(F.col("id").alias("_key")).distinct()
    joined = users.join(keys, F.col("_key") == F.col("id"), "left")
    hit = F.col("_key").isNotNull()
    updated = {
        "is_active": F.when(hit, False).otherwise(F.col("is_active")),
        "updated_at": F.when(hit, dates.ts(now)).otherwise(F.col("updated_at")),
    }
    if free_email:
        seconds = int((now - datetime(1970, 1, 1)).total_seconds())
        renamed = F.concat(F.col("email"), F.lit(f"_deleted_{seconds}"))
        updated["email"] = F.when(hit, renamed).otherwise(F.col("email"))
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in users.columns])


def mark_notifications_read(
    notifications: DataFrame, users: DataFrame | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Mark the notifications of some users (user_id) or some single ones (id) as read."""
    rows = notifications
    for keys, column in ((users, "user_id"), (ids, "id")):
        if keys is None:
            continue
        wanted = keys.select(column).distinct().withColumn("_hit", F.lit(True))
        # A user may have any number of notifications, an id has one row.
        joined = join_hot(rows, wanted, [column], "left") if column == "user_id" else rows.join(wanted, column, "left")
        rows = joined.withColumn("is_read", F.col("is_read") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return rows.select(*notifications.columns)


def apply_payments(bookings: DataFrame, payments: DataFrame, method: str = "payfast") -> DataFrame:
    """Mark bookings paid by completed payment events (booking_number, payment_status). Other events
    change nothing, and a repeated event changes nothing more."""
    paid = (
        payments.filter(F.col("payment_status") == "COMPLETE")
        .select(F.col("booking_number").alias("_key"))
        .distinct()
    )
    # Bookings without a number all have the null key, which is spread.
    paid = paid.select(F.col("_key").alias("booking_number"), F.lit(True).alias("_paid"))
    joined = join_hot(bookings, paid, ["booking_number"], "left")
    hit = F.col("_paid").isNotNull()
    updated = {
        "payment_status": F.when(hit, F.lit("paid")).otherwise(F.col("payment_status")),
        "payment_method": F.when(hit, F.lit(method)).otherwise(F.col("payment_method")),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in bookings.columns])


def slugify_tours(tours: DataFrame) -> DataFrame:
    """Slug of every title and how many tours share it."""
    slugs = tours.select("id", "title", text.slugify("title").alias("slug"))
    shared = slugs.groupBy("slug").agg(F.count(F.lit(1)).alias("tours"))
    # Titles without Latin letters all have one slug.
    return join_hot(slugs, shared, ["slug"]).select("id", "title", "slug", "tours")
