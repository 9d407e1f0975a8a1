"""Change sets: rules, rejects, and what may be applied twice."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from sojourn.operators import changes, quality
from sojourn.schemas import ROLES
from sojourn.sources.seeds import AMENITIES, seed_dimensions
from tests.frames import booking, frame, rows, tables

NOW = datetime(2001, 8, 1, 9)
T1, T2, T3 = (datetime(2001, 7, d) for d in (1, 2, 3))


def test_insert_with_defaults(spark):
    old = frame(spark, "bookings", booking(1, payment_status="paid"))
    new = spark.createDataFrame([(2, "confirmed"), (3, None)], "id long, status string")
    got = changes.insert_rows(old, new, {"status": F.lit("pending"), "payment_status": F.lit("pending")})
    assert got.schema == old.schema
    assert rows(got, "id", "status", "payment_status") == [(1, "confirmed", "paid"), (2, "confirmed", "pending"), (3, "pending", "pending")]


def test_insert_ignore_twice(spark):
    old = frame(spark, "favorites", {"user_id": 1, "tour_id": 1, "created_at": T1})
    new = frame(spark, "favorites", {"user_id": 1, "tour_id": 1, "created_at": T2}, {"user_id": 1, "tour_id": 2, "created_at": T3},
                {"user_id": 1, "tour_id": 2, "created_at": T2})
    once = changes.insert_ignore(old, new, ["user_id", "tour_id"])
    want = [(1, 1, T1), (1, 2, T2)]
    assert rows(once, *old.columns) == want
    assert rows(changes.insert_ignore(once, new, ["user_id", "tour_id"]), *old.columns) == want
    links = frame(spark, "tour_categories", {"tour_id": 1, "category_id": "a"})
    twice = changes.insert_ignore(links, links.unionByName(links), ["tour_id", "category_id"])
    assert twice.count() == 1


def test_toggles_by_parity(spark):
    old = frame(spark, "favorites", {"user_id": 1, "tour_id": 1, "created_at": T1}, {"user_id": 1, "tour_id": 2, "created_at": T1})
    flips = frame(spark, "favorites", *[{"user_id": 1, "tour_id": t, "created_at": at} for t, at in ((1, T2), (2, T2), (2, T3), (3, T2), (4, T2), (4, T3))])
    got = changes.toggle_pairs(old, flips, ["user_id", "tour_id"], "created_at")
    assert rows(got, *old.columns) == [(1, 2, T1), (1, 3, T2)]


def test_partial_update_keeps_what_is_not_supplied(spark):
    old = frame(spark, "users", {"id": 1, "name": "Ann", "phone": "1"}, {"id": 2, "name": "Bo", "phone": "2"}, {"id": 3, "name": "Cy"})
    made = spark.createDataFrame(
        [(1, "Anna", None, T1), (1, " ", "11", T2), (2, "", None, T1), (9, "x", "y", T1)],
        "id long, name string, phone string, at timestamp_ntz",
    )
    got = changes.partial_update(old, made, ["name", "phone"], NOW, ["at"])
    assert rows(got, "id", "name", "phone", "updated_at") == [(1, "Anna", "11", NOW), (2, "Bo", "2", None), (3, "Cy", None, None)]


def test_full_update_takes_the_last_row_nulls_included(spark):
    old = frame(spark, "users", {"id": 1, "name": "Ann", "phone": "1"}, {"id": 2, "name": "Bo"})
    made = spark.createDataFrame([(1, "x", "9", T1), (1, "y", None, T2)], "id long, name string, phone string, at timestamp_ntz")
    got = changes.full_update(old, made, ["name", "phone"], NOW, ["at"])
    assert rows(got, "id", "name", "phone", "updated_at") == [(1, "y", None, NOW), (2, "Bo", None, None)]


def test_status_transitions_and_counter(spark):
    old = frame(spark, "bookings", booking(1, status="pending", people=2), booking(2, people=3), booking(3, status="cancelled", people=4))
    made = spark.createDataFrame(
        [(1, "confirmed", T1, 1, None), (2, "cancelled", T1, 2, "ill"), (2, "cancelled", T2, 3, "late"), (3, "gone", T1, 4, None),
         (1, "completed", T3, 5, None)],
        "id long, new_status string, changed_at timestamp_ntz, seq long, reason string",
    )
    new = changes.status_transition(old, made)
    columns = ("id", "status", "confirmed_at", "cancelled_at", "cancellation_reason", "updated_at")
    want = [(1, "completed", T1, None, None, T3), (2, "cancelled", None, T2, "late", T2), (3, "cancelled", None, None, None, None)]
    assert rows(new, *columns) == want
    assert rows(changes.status_transition(new, made), *columns) == want
    assert [r.id for r in changes.rejected_status(made).collect()] == [3]
    t = tables(spark, tours=[{"id": 1, "booked_count": 5}]).replace(bookings=new)
    folded = changes.booked_count_fold(t.tours, changes.transition_deltas(old, new))
    assert rows(folded, "id", "booked_count") == [(1, 2)]
    assert rows(changes.counter_drift(t), "id", "booked_count", "people") == [(1, 5, 2)]
    assert changes.counter_drift(t.replace(tours=folded)).count() == 0


def test_roles_from_a_whitelist(spark):
    old = frame(spark, "users", {"id": 1, "role": "user"}, {"id": 2, "role": "admin"})
    made = spark.createDataFrame([(1, "manager", 1), (1, "owner", 2), (2, None, 1)], "id long, role string, seq long")
    got = changes.set_checked(old, made, "role", ROLES, ["seq"], NOW)
    assert rows(got, "id", "role", "updated_at") == [(1, "manager", NOW), (2, "admin", None)]


def test_unknown_contacts_become_users(spark):
    old = frame(spark, "users", {"id": 7, "email": "a@x.org", "role": "admin"})
    made = spark.createDataFrame(
        [(1, "a@x.org", "A", None, T1), (5, "b@x.org", "B2", None, T2), (3, "b@x.org", "B1", "1", T1), (4, "c@x.org", "C", None, T1)],
        "contact_id long, email string, name string, phone string, arrived_at timestamp_ntz",
    )
    got = changes.find_or_create_user(old, made)
    assert rows(got, "id", "email", "name", "role") == [(7, "a@x.org", None, "admin"), (8, "b@x.org", "B1", "user"), (9, "c@x.org", "C", "user")]
    assert changes.find_or_create_user(got, made).count() == 3


def test_booking_numbers(spark):
    old = frame(spark, "bookings", booking(1, booking_number="CT-010615-00041"), booking(2, booking_number="CT-010615-AB12CD"),
                booking(3, booking_number="CT-010616-99999"), booking(4))
    new = frame(spark, "bookings", booking(12), booking(11), booking(13, at="2001-06-16"), booking(14, at="2001-06-17")).select("id", "booked_at")
    got = changes.next_booking_number(old, new)
    assert rows(got, "id", "booking_number") == [
        (11, "CT-010615-00042"), (12, "CT-010615-00043"), (13, "CT-010616-100000"), (14, "CT-010617-00001"),
    ]
    random = [r.booking_number for r in changes.random_booking_number(new).collect()]
    assert all(len(n) == 16 and n.startswith("CT-0106") for n in random)
    assert changes.number_collisions(new).count() == 0
    assert changes.number_collisions(new.unionByName(new)).count() == 4


def test_links_and_images(spark):
    t = tables(
        spark,
        tour_categories=[{"tour_id": a, "category_id": c} for a, c in ((1, "a"), (1, "b"), (2, "a"), (3, "a"))],
        tour_images=[{"id": 1, "tour_id": 1, "is_main": True, "display_order": 0}, {"id": 2, "tour_id": 1, "display_order": 1, "is_main": False}],
    )
    chosen = spark.createDataFrame([(1, "c"), (1, "c"), (9, "z")], "tour_id long, category_id string")
    edited = spark.createDataFrame([(1,), (2,)], "tour_id long")
    assert rows(changes.replace_associations(t.tour_categories, chosen, edited), "tour_id", "category_id") == [(1, "c"), (3, "a")]
    uploads = spark.createDataFrame([(8, 1, "x"), (6, 1, "y"), (7, 5, "z")], "id long, tour_id long, image_url string")
    got = changes.append_images(t.tour_images, uploads)
    assert rows(got, "id", "display_order", "is_main") == [(1, 0, True), (2, 1, False), (6, 2, False), (7, 0, False), (8, 3, False)]
    first = changes.append_images(t.tour_images, uploads, new_tours=True)
    assert rows(first.filter("is_main"), "id") == [(1,), (7,)]


def test_deletes(spark):
    t = tables(
        spark, tours=[{"id": 1}, {"id": 2}, {"id": 3}], bookings=[booking(1, tour_id=1, status="cancelled")],
        tour_images=[{"id": i, "tour_id": i} for i in (1, 2, 3)], favorites=[{"user_id": 1, "tour_id": 2}],
        users=[{"id": 1, "email": "a@x.org", "is_active": True}, {"id": 2, "email": "b@x.org", "is_active": True}],
    )
    gone = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    after = changes.guarded_delete(t, gone)
    # A cancelled booking still refers to tour 1.
    assert rows(after.tours, "id") == [(1,), (3,)]
    assert rows(after.tour_images, "id") == [(1,), (3,)] and after.favorites.count() == 0
    assert rows(changes.refused_deletes(t, gone), "id") == [(1,)]
    left = changes.soft_delete_users(t.users, gone.limit(1), NOW, free_email=True)
    assert rows(left, "id", "email", "is_active") == [(1, "a@x.org_deleted_996656400", False), (2, "b@x.org", True)]


def test_payments_twice(spark):
    old = frame(spark, "bookings", booking(1, booking_number="a", payment_status="pending"), booking(2, booking_number="b"))
    made = spark.createDataFrame([("a", "COMPLETE"), ("a", "COMPLETE"), ("b", "FAILED"), ("z", "COMPLETE")], "booking_number string, payment_status string")
    once = changes.apply_payments(old, made)
    want = [(1, "paid", "payfast"), (2, None, None)]
    assert rows(once, "id", "payment_status", "payment_method") == want
    assert rows(changes.apply_payments(once, made), "id", "payment_status", "payment_method") == want


def test_notifications(spark):
    old = frame(spark, "notifications", *[{"id": i, "user_id": i % 2, "is_read": False} for i in range(4)])
    of_user = spark.createDataFrame([(1,)], "user_id long")
    single = spark.createDataFrame([(0,)], "id long")
    got = changes.mark_notifications_read(old, users=of_user, ids=single)
    assert rows(got, "id", "is_read") == [(0, True), (1, True), (2, False), (3, True)]


def test_seeds_only_when_absent(spark):
    t = tables(spark, amenities=[{"id": "1", "name": "WiFi", "icon": "mine"}])
    after = seed_dimensions(t)
    assert after.amenities.count() == len(AMENITIES) and after.categories.count() == 6
    assert rows(after.amenities.filter("name = 'WiFi'"), "icon") == [("mine",)]
    assert seed_dimensions(after).amenities.count() == len(AMENITIES)


def test_quality_reports(spark):
    t = tables(
        spark,
        users=[{"id": 1, "name": "A", "email": "no", "role": "boss", "phone": "12"}, {"id": 1, "name": "Bo", "email": "b@x.org", "phone": "+27 11 222 3333"}],
        tours=[{"id": 1, "title": " ", "price": Decimal(-1), "capacity": 0, "duration_days": 1, "status": "odd",
                "start_date": datetime(2001, 1, 2).date(), "end_date": datetime(2001, 1, 2).date()}],
        bookings=[booking(1, people=0, status="odd", payment_status="paid"), booking(2, user_id=9, tour_id=None)],
        reviews=[{"id": 1, "rating": 6}, {"id": 2, "rating": 5}],
    )

    def broken(report):
        return {r.rule: r.violations for r in report.collect() if r.violations}

    assert broken(quality.dq_domain(t)) == {"users.role": 1, "tours.status": 1, "bookings.status": 1, "bookings.people_count": 1, "reviews.rating": 1}
    assert broken(quality.dq_unique(t)) == {"users.id": 1}
    assert broken(quality.dq_foreign_keys(t)) == {"bookings.user_id -> users": 1}
    assert broken(quality.dq_user_rules(t)) == {"name has two characters": 1, "email is valid": 1, "phone is valid": 1}
    rules = broken(quality.dq_tour_rules(t))
    assert rules == {f"{c} is given": 1 for c in ("title", "short_description", "full_description", "location")} | {
        "price >= 0": 1, "capacity >= 1": 1, "end_date > start_date": 1}
    assert broken(quality.dq_not_null(t))["bookings.tour_id"] == 1
