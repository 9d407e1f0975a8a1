import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from sojourn.functions import shared
from sojourn.llm import scratch


def folders(spark, name):
    root = scratch.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    return {f for f in os.listdir(root) if f.startswith(name)}


def test_what_a_stage_wrote_goes_when_its_result_is_there(spark):
    def make():
        first = scratch.written(spark.range(10), "clear-a")
        inner = scratch.staged(spark, lambda: scratch.written(first, "clear-b").filter("id > 2"), "clear-c")
        assert folders(spark, "clear-b") == set() and len(folders(spark, "clear-c")) == 1
        return inner.filter("id < 8")

    result = scratch.staged(spark, make, "clear-result")
    assert sorted(r["id"] for r in result.collect()) == [3, 4, 5, 6, 7]
    assert folders(spark, "clear-a") == folders(spark, "clear-c") == set() and len(folders(spark, "clear-result")) == 1


def test_what_a_failed_stage_wrote_goes_too(spark):
    def make():
        scratch.written(spark.range(10), "clear-failed")
        raise OSError("away")

    with pytest.raises(OSError):
        scratch.staged(spark, make, "clear-failed-result")
    assert folders(spark, "clear-failed") == set()


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        return set(glob.glob("/tmp/blockmgr-*/*/shuffle_*"))

    before, setting = files(), spark.conf.get(shared.CLEANUP)
    table = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")), "shuffled")
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(shared.CLEANUP) == setting and table.count() == 7
