"""Named queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from sojourn.plans.oracle_tables import with_tables
from sojourn.sources.testdata import load_testdata
from sojourn.tables import Tables

# One lazy set of table definitions per session and folder; it holds plans, no rows.
_TABLES: WeakKeyDictionary[SparkSession, dict[str, Tables]] = WeakKeyDictionary()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The same queries on any tables.
BUILDS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = _TABLES.setdefault(spark, {})
        if sf_dir not in known:
            known[sf_dir] = load_testdata(spark, sf_dir)
        return build(known[sf_dir])

    run.__name__, run.__module__ = name, build.__module__
    QUERIES[name], BUILDS[name] = run, build
    if sql is not None:
        ORACLES[name] = with_tables(sql)
