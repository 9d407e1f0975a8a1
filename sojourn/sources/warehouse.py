"""Booking tables on a data lake or in a database, and versioned writes.

The fact table is partitioned by booked month, so a window over ``booked_month`` prunes folders;
within a month Parquet statistics on ``booked_at`` skip row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.functions import dates
from sojourn.operators import changes
from sojourn.schemas import KEY_COLUMNS, NOT_NULL, SCHEMAS, UNIQUE_KEYS
from sojourn.sources.commits import CommitLog
from sojourn.tables import Tables

MONTH = dates.MONTH


def _schema(name: str) -> T.StructType:
    """Columns of a table as published: bookings have their month, too."""
    schema = SCHEMAS[name]
    return T.StructType([*schema.fields, T.StructField(MONTH, T.DateType())]) if name == "bookings" else schema


def load_tables(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """Tables under ``root/<table>`` (or one published version of each) with fixed schemas."""

    def reader(name: str) -> Callable[[], DataFrame]:
        def read() -> DataFrame:
            path = f"{root}/{name}" if version is None else f"{root}/{name}/v{version}"
            return spark.read.schema(_schema(name)).parquet(path)

        return read

    return Tables(spark, {name: reader(name) for name in SCHEMAS})


# Tables that grow with the business, and the column whose ranges are read side by side. Ids may be UUIDs, so facts go by time.
PARTITION_COLUMNS = {
    "bookings": "booked_at",
    "users": "created_at",
    "favorites": "created_at",
    "reviews": "created_at",
    "notifications": "created_at",
}


# The key that a table's UUID ranges are read by side by side, where it is not read by time.
UUID_COLUMNS = {
    **{name: "id" for name in ("users", "tours", "bookings", "tour_images", "reviews", "notifications", "categories", "amenities")},
    **{name: "tour_id" for name in ("tour_categories", "tour_amenities")},
    "favorites": "user_id",
}


def uuid_ranges(column: str, tasks: int) -> list[str]:
    """Conditions that cut the UUIDs into ranges of equal width; random ones fill them evenly. Rows without one are in the first."""
    edges = [f"{i * 2**32 // tasks:08x}-0000-0000-0000-000000000000" for i in range(1, tasks)]
    lows, highs = [None, *edges], [*edges, None]
    ranges = []
    for low, high in zip(lows, highs, strict=True):
        parts = ([f"{column} >= '{low}'"] if low else []) + ([f"{column} < '{high}'"] if high else [])
        inside = " and ".join(parts) or "true"
        ranges.append(inside if low else f"({inside}) or {column} is null")
    return ranges


def conformed(rows: DataFrame, name: str, keys_as_text: bool = False) -> DataFrame:
    """Rows under the fixed schema of a table. Columns that the source lacks are null, but for keys and others that may not be null: without those
    the rows are refused here, and not somewhere far away. ``keys_as_text`` leaves whole-number keys as the texts that UUIDs are."""
    missing = [f.name for f in SCHEMAS[name] if f.name not in rows.columns]
    needed = {*NOT_NULL.get(name, ()), *KEY_COLUMNS.get(name, ()), *(c for key in UNIQUE_KEYS.get(name, []) for c in key)}
    if refused := sorted(needed.intersection(missing)):
        raise ValueError(f"{name} lacks {', '.join(refused)}")
    columns = []
    for f in SCHEMAS[name]:
        kind = T.StringType() if keys_as_text and f.name in KEY_COLUMNS.get(name, ()) else f.dataType
        columns.append((F.lit(None) if f.name in missing else F.col(f.name)).cast(kind).alias(f.name))
    return rows.select(*columns)


def load_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    tasks: int = 32,
    bounds: dict[str, tuple] | None = None,
    reader_of: Callable[[SparkSession], DataFrameReader] = lambda spark: spark.read,
    uuid_keys: bool = False,
) -> Tables:
    """The same tables from a relational store, cast to the fixed schemas; times without a zone stay without one.

    A table is read by ``tasks`` range queries side by side: those with ``bounds`` (the lowest and highest value) by their
    partition column (``PARTITION_COLUMNS``), and where keys are UUIDs all others by ranges of a key. Facts with neither are refused, since one task would
    read all of them; dimensions may go without. With ``uuid_keys`` the keys are texts, for ``keys.with_whole_numbers``.
    """

    def reader(name: str) -> Callable[[], DataFrame]:
        def read() -> DataFrame:
            source = reader_of(spark).format("jdbc").options(url=url, dbtable=name, preferTimestampNTZ="true", **properties)
            column = PARTITION_COLUMNS.get(name)
            if bounds and name in bounds:
                low, high = bounds[name]
                source = source.options(
                    partitionColumn=column or "id", lowerBound=str(low), upperBound=str(high), numPartitions=str(tasks)
                )
            elif uuid_keys and name in UUID_COLUMNS:
                options = {**properties, "preferTimestampNTZ": "true"}
                ranges = uuid_ranges(UUID_COLUMNS[name], tasks)
                return conformed(reader_of(spark).jdbc(url, name, predicates=ranges, properties=options), name, keys_as_text=True)
            elif column:
                raise ValueError(f"{name} needs bounds of its column {column}, or one task would read the whole table")
            return conformed(source.load(), name, uuid_keys)

        return read

    return Tables(spark, {name: reader(name) for name in SCHEMAS})


def publish(
    df: DataFrame, root: str, table: str, version: int | None = None, replace: bool = False
) -> str:
    """Write a snapshot (a new version when one is named) and return its path. A version that exists is
    refused, so a reader of it is not disturbed; ``replace`` is for a write that is repeated after a failure."""
    path = f"{root}/{table}" if version is None else f"{root}/{table}/v{version}"
    _write(df, table, path, "overwrite" if replace else "errorifexists")
    return path


def _write(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    if table == "bookings":
        # Rebalancing gives every task about the advisory size: a busy month is written by many tasks, and a
        # quiet one does not become many small files. Sorted times make row groups skippable.
        monthly = df.withColumn(MONTH, F.trunc(F.to_date("booked_at"), "month")).hint("rebalance", MONTH)
        writer = monthly.sortWithinPartitions(MONTH, "booked_at").write.mode(mode).partitionBy(MONTH)
    else:
        writer = df.write.mode(mode)
    writer.parquet(path)


def _commits(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/_commits")


def publish_set(frames: dict[str, DataFrame], root: str, after: int | None = None) -> int:
    """Publish snapshots of several tables as one commit and return its number.

    All tables are written first, to folders that no reader knows; the commit then names them, together with the tables that stay as they
    were. A failure on the way leaves readers on the commit before. ``after`` is the commit that the snapshots were derived
    from (0: none): if another one came since, the write is refused with FileExistsError and nothing is lost of either.
    """
    spark = next(iter(frames.values())).sparkSession
    log = _commits(spark, root)
    number, tables = log.latest() or (0, {})
    if after is not None and after != number:
        raise FileExistsError(f"commit {number} came after {after}")
    attempt = uuid.uuid4().hex
    folders = {name: f"{root}/{name}/c{number + 1}-{attempt}" for name in frames}
    for name, df in frames.items():
        _write(df, name, folders[name])
    log.add(number + 1, {**tables, **folders})
    return number + 1


def load_set(spark: SparkSession, root: str, number: int | None = None) -> Tables:
    """The tables of the latest commit, or of an earlier one. The reader keeps the folders it began with, whatever is committed later."""
    log = _commits(spark, root)
    found = log.latest() if number is None else (number, log.read(number))
    if found is None:
        raise FileNotFoundError(f"nothing is committed under {root}")

    def reader(name: str, path: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(_schema(name)).parquet(path)

    return Tables(spark, {name: reader(name, path) for name, path in found[1].items()})


def commit_number(spark: SparkSession, root: str) -> int:
    """The latest commit, 0 if there is none."""
    return (_commits(spark, root).latest() or (0, {}))[0]


def publish_deletes(spark: SparkSession, root: str, gone: DataFrame) -> int:
    """Delete tours (id) that no booking refers to, with all that hangs on them, as one commit over the five tables."""
    number = commit_number(spark, root)
    after = changes.guarded_delete(load_set(spark, root, number), gone)
    return publish_set({name: getattr(after, name) for name in ("tours", *changes.TOUR_CHILDREN)}, root, after=number)


def in_months(bookings: DataFrame, start, end) -> DataFrame:
    """Restrict a partitioned fact table to the months of a window, which prunes its folders."""
    first, last = dates.floor_day(start, "month"), dates.floor_day(end, "month")
    return bookings.filter(F.col(MONTH).between(F.lit(first), F.lit(last)))
