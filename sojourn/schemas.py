"""Fixed schemas of the booking tables.

Times are zone-less, money is decimal. A test source may use its own id types
(category and amenity ids are strings there).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
ROLES = ("admin", "manager", "user")
TOUR_STATUSES = ("upcoming", "available", "fully_booked", "cancelled", "completed")
BOOKABLE = ("upcoming", "available")
BOOKING_STATUSES = ("pending", "confirmed", "cancelled", "completed")
PAYMENT_STATUSES = ("pending", "paid", "refunded", "failed")

_long, _int, _str = T.LongType(), T.IntegerType(), T.StringType()
_bool, _date, _ts = T.BooleanType(), T.DateType(), T.TimestampNTZType()
_price, _money = T.DecimalType(10, 2), T.DecimalType(18, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        id=_long, name=_str, email=_str, phone=_str, role=_str, is_active=_bool,
        created_at=_ts, updated_at=_ts, utm_source=_str, last_login_at=_ts,
    ),
    "tours": _struct(
        id=_long, title=_str, slug=_str, short_description=_str, full_description=_str,
        location=_str, price=_price, discount_price=_price, start_date=_date, end_date=_date,
        duration_days=_int, capacity=_int, booked_count=_long, status=_str, featured=_bool,
        created_by=_long, created_at=_ts, updated_at=_ts,
    ),
    "bookings": _struct(
        id=_long, booking_number=_str, user_id=_long, tour_id=_long, people_count=_int,
        total_price=_money, special_requests=_str, status=_str, payment_status=_str,
        payment_method=_str, booked_at=_ts, confirmed_at=_ts, cancelled_at=_ts,
        cancellation_reason=_str, updated_at=_ts, departure_airport=_str,
        room_configuration=_str, child_ages=_str, vip_upgrades=T.ArrayType(_str),
        trip_vibe=_str, occasion=_str, travel_insurance=_str,
    ),
    "categories": _struct(id=_str, name=_str, description=_str, icon=_str, color=_str),
    "amenities": _struct(id=_str, name=_str, description=_str, icon=_str),
    "tour_categories": _struct(tour_id=_long, category_id=_str),
    "tour_amenities": _struct(tour_id=_long, amenity_id=_str),
    "tour_images": _struct(
        id=_long, tour_id=_long, image_url=_str, is_main=_bool, alt_text=_str, display_order=_int
    ),
    "favorites": _struct(user_id=_long, tour_id=_long, created_at=_ts),
    "reviews": _struct(
        id=_long, user_id=_long, tour_id=_long, booking_id=_long, rating=_int, comment=_str,
        is_approved=_bool, created_at=_ts,
    ),
    "notifications": _struct(
        id=_long, user_id=_long, title=_str, message=_str, type=_str, is_read=_bool, created_at=_ts
    ),
    "bot_knowledge": _struct(
        conv_id=_long, turn=_long, topic=_str, question=_str, answer=_str, created_at=_ts
    ),
    "contact_messages": _struct(name=_str, email=_str, subject=_str, message=_str),
}

# One row per rule: table -> key columns that may not repeat.
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "users": [("id",), ("email",)],
    "tours": [("id",), ("slug",)],
    "bookings": [("id",), ("booking_number",)],
    "categories": [("name",)],
    "amenities": [("name",)],
    "tour_categories": [("tour_id", "category_id")],
    "tour_amenities": [("tour_id", "amenity_id")],
    "favorites": [("user_id", "tour_id")],
    "reviews": [("user_id", "tour_id", "booking_id")],
}

# child table, child column, parent table (parent column is id).
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("tours", "created_by", "users"),
    ("tour_images", "tour_id", "tours"),
    ("tour_categories", "tour_id", "tours"),
    ("tour_categories", "category_id", "categories"),
    ("tour_amenities", "tour_id", "tours"),
    ("tour_amenities", "amenity_id", "amenities"),
    ("bookings", "user_id", "users"),
    ("bookings", "tour_id", "tours"),
    ("favorites", "user_id", "users"),
    ("favorites", "tour_id", "tours"),
    ("reviews", "user_id", "users"),
    ("reviews", "tour_id", "tours"),
    ("reviews", "booking_id", "bookings"),
]

# table -> its whole-number key columns, and the table whose rows each names.
KEY_COLUMNS: dict[str, dict[str, str]] = {
    name: {
        **{c: parent for child, c, parent in FOREIGN_KEYS if child == name and schema[c].dataType == _long},
        **({"user_id": "users"} if "user_id" in schema.names else {}),
        **({"id": name} if "id" in schema.names and schema["id"].dataType == _long else {}),
    }
    for name, schema in SCHEMAS.items()
}

NOT_NULL: dict[str, tuple[str, ...]] = {
    "users": ("name", "email"),
    "tours": (
        "title", "slug", "short_description", "full_description", "location", "price",
        "start_date", "end_date", "duration_days", "capacity",
    ),
    "bookings": ("booking_number", "user_id", "tour_id", "people_count", "total_price"),
    "categories": ("name",),
    "amenities": ("name",),
    "tour_images": ("image_url",),
}
