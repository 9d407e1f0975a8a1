"""Tables written to cut lineage, in the folder that the cluster shares, and their removal."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sojourn.functions import shared
from sojourn.functions.shared import fresh_folder, shared_folder

__all__ = ["fresh_folder", "shared_folder", "small_batches", "staged", "written"]

# Folders written for the result that is being made, where someone will clear them.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read back. A lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return shared.written_to(df, path)


def staged(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that ``make`` returns, written; what was written on the way to them is deleted then, also when it fails."""
    made: list[str] = []
    token = _MADE.set(made)
    path = fresh_folder(spark, name)
    try:
        result = shared.written_to(make(), path)
    finally:
        _MADE.reset(token)
        shared.deleted(spark, made)
    if (outer := _MADE.get()) is not None:
        outer.append(path)
    return result


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts reach Python in batches of so many rows; a smaller number set by the user stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(setting, str(rows))
