"""Small hand-made booking tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from sojourn.schemas import SCHEMAS
from sojourn.tables import Tables


def frame(spark: SparkSession, table: str, *rows: dict) -> DataFrame:
    """Rows of a table; columns that are left out are null."""
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def tables(spark: SparkSession, **rows: list[dict]) -> Tables:
    return Tables.of(spark, **{name: frame(spark, name, *rows.get(name, [])) for name in SCHEMAS})


def booking(id, user_id=1, tour_id=1, price=100, status="confirmed", at="2001-06-15", people=1, **more) -> dict:
    return {
        "id": id, "user_id": user_id, "tour_id": tour_id, "total_price": Decimal(price), "status": status,
        "booked_at": datetime.fromisoformat(at), "people_count": people, **more,
    }


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
