"""A lazy bag of named DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables by attribute (``t.bookings``); each is built on first use only."""

    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> "Tables":
        return cls(spark, {name: (lambda df=df: df) for name, df in frames.items()})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def names(self) -> list[str]:
        return sorted(self._builders)

    def replace(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables swapped, e.g. a new snapshot after a change set."""
        builders = dict(self._builders)
        builders.update({name: (lambda df=df: df) for name, df in frames.items()})
        return Tables(self.spark, builders)
