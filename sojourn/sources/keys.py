"""Whole-number keys for tables whose ids are UUIDs.

A dictionary gives each UUID of a table one whole number for good. ``learn`` finds the UUIDs that are new, in the tables' own ids and in all
references to them (a reference to a row that is not there keeps a number of its own and stays dangling), numbers them after the largest
number so far by one range sort, and commits them at once. A load that fails commits nothing, and a UUID never gets a second number.
New rows of a table are numbered by the time they were made, as a sequence would have done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions.numbering import running_number
from sojourn.functions.skew import join_hot
from sojourn.schemas import KEY_COLUMNS, SCHEMAS
from sojourn.streaming.batchlog import BatchLog
from sojourn.tables import Tables

KEYS = "entity string, uuid string, key long"
_MADE = ("created_at", "booked_at")


class KeyDictionary:
    """UUIDs and their whole numbers, per table, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._log = BatchLog(spark, folder, KEYS)

    def keys(self, entity: str | None = None) -> DataFrame:
        """``entity, uuid, key`` of all UUIDs known, or those of one table."""
        known = self._log.rows()
        return known if entity is None else known.filter(F.col("entity") == entity)

    def learn(self, tables: Tables) -> int:
        """Number what is new in these tables; the number of the commit."""
        seen = []
        for name, columns in KEY_COLUMNS.items():
            if name not in tables or not columns:
                continue
            rows = getattr(tables, name)
            made = next((c for c in _MADE if c in rows.columns), None)
            none = F.lit(None).cast("timestamp_ntz")
            found = []
            for column, entity in columns.items():
                when = F.col(made).cast("timestamp_ntz") if made and column == "id" else none
                named = F.lit(int(column != "id"))
                found.append(F.struct(F.lit(entity).alias("entity"), F.lower(F.col(column)).alias("uuid"), when.alias("made"), named.alias("only_named")))
            # All key columns of a table are taken in one reading of it.
            seen.append(rows.select(F.inline(F.array(*found))).filter("uuid is not null"))
        # Folded before they are shuffled.
        everything = reduce(DataFrame.unionByName, seen).groupBy("entity", "uuid")
        folded = everything.agg(F.min("made").alias("made"), F.min("only_named").alias("only_named"))
        new = folded.join(self.keys(), ["entity", "uuid"], "left_anti")
        numbered = running_number(new, ["entity"], ["only_named", "made", "uuid"], "n")
        # One row for each table of the schema, which bounds the broadcast.
        last = F.broadcast(self.keys().groupBy("entity").agg(F.max("key").alias("last")))
        rows = numbered.join(last, "entity", "left").select("entity", "uuid", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("key"))
        return self._log.append(rows)

    def replaced(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """The rows with the numbers of the UUIDs in these columns (column -> table); a UUID that was not learnt gives null."""
        names = rows.columns
        for column, entity in columns.items():
            known = self.keys(entity).select(F.col("uuid").alias("_uuid"), F.col("key").alias("_key"))
            asked = rows.withColumn("_uuid", F.lower(F.col(column)))
            # A user may have any number of bookings, an id is there once.
            met = asked.join(known, "_uuid", "left") if column == "id" else join_hot(asked, known, ["_uuid"], "left")
            rows = met.withColumn(column, F.col("_key")).select(*names)
        return rows

    def named(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """The reverse of ``replaced``."""
        names = rows.columns
        for column, entity in columns.items():
            known = self.keys(entity).select(F.col("uuid").alias("_uuid"), F.col("key").alias("_key"))
            met = join_hot(rows.withColumn("_key", F.col(column)), known, ["_key"], "left")
            rows = met.withColumn(column, F.col("_uuid")).select(*names)
        return rows


def with_whole_numbers(tables: Tables, dictionary: KeyDictionary) -> Tables:
    """Tables with UUID keys under the fixed schemas, once the dictionary has learnt them."""

    def build(name: str):
        kinds = SCHEMAS[name]
        return lambda: dictionary.replaced(getattr(tables, name), KEY_COLUMNS.get(name, {})).select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds if f.name in getattr(tables, name).columns]
        )

    return Tables(tables.spark, {name: build(name) for name in SCHEMAS if name in tables})
