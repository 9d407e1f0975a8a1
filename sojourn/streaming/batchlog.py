"""A table that a stream writes batch by batch, each batch exactly once.

``commit`` is for ``foreachBatch``: the rows of a batch go to a folder of their own, and the batch's number is the key of the commit. A batch that
is run again after its commit changes nothing, and one that failed before it is written anew. ``compact`` folds all committed batches
to one folder, so readers do not open ever more files; the batches before it are then read from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sojourn.sources.commits import CommitLog


class BatchLog:
    """Rows of one schema under a folder. ``fold`` brings the rows of all batches to what readers see (and what compaction keeps); it must give
    the same whether it runs over all rows at once or over some of its own results."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, fold: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.fold = fold or (lambda rows: rows)
        self._batches = CommitLog(spark, f"{self.folder}/commits")
        self._bases = CommitLog(spark, f"{self.folder}/bases")

    def commit(self, batch: DataFrame, number: int) -> None:
        """Write a batch unless it is committed already. Then it is only run, so that the stream's state moves on as it did."""
        if number in self._batches.numbers():
            batch.write.format("noop").mode("overwrite").save()
            return
        path = f"{self.folder}/data/{number}-{uuid.uuid4().hex}"
        batch.write.parquet(path)
        self._batches.add(number, {"path": path})

    def append(self, rows: DataFrame) -> int:
        """Commit rows under the next number, outside of a stream, and return it. Of two writers at a time the second is refused."""
        number = max(self._batches.numbers(), default=-1) + 1
        path = f"{self.folder}/data/{number}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._batches.add(number, {"path": path})
        return number

    def _paths(self, upto: int | None = None) -> list[str]:
        base = self._bases.latest(upto)
        numbers = [n for n in self._batches.numbers() if (base is None or n > base[0]) and (upto is None or n <= upto)]
        return ([base[1]["path"]] if base else []) + [self._batches.read(n)["path"] for n in numbers]

    def rows(self, upto: int | None = None) -> DataFrame:
        """The folded rows of all committed batches, or of those up to a number."""
        paths = self._paths(upto)
        if not paths:
            return self.fold(self.spark.createDataFrame([], self.schema))
        return self.fold(self.spark.read.schema(self.schema).parquet(*paths))

    def compact(self) -> None:
        """Fold all batches committed so far to one folder. Readers see the same rows before and after."""
        numbers = self._batches.numbers()
        base = self._bases.latest()
        if not numbers or base and base[0] >= numbers[-1]:
            return
        path = f"{self.folder}/data/base-{numbers[-1]}-{uuid.uuid4().hex}"
        self.rows(numbers[-1]).write.parquet(path)
        self._bases.add(numbers[-1], {"path": path})
