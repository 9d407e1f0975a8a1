"""Whitened embeddings: leading principal components of unit variance.

Each entry ``c`` of a vector becomes the whole number ``floor(256 * c)``, and the model is fitted on each distinct vector once, so copies have no weight.
Sums are exact whole numbers, covariances are sums of products of centred values, made per task and added row by row. The matrix
has as many rows as a vector has entries whatever the table's size; the driver splits it into eigenvectors by ``spectral`` (polar decompositions of
shifted matrices), and the tasks get the mean and the few components they project on.

Rows whose vector is null, or holds a null, a number that is not finite or one beyond the whole numbers of 53 bits, are left out, and so are vectors of
another length than most have (of lengths that are as frequent, the longest). Empty vectors and empty tables give no rows. Repeated rows
all come back, a null id stays null. A component without variance (as of one vector, or of equal entries) is 0 on all rows, explains 0
and is not part of the error. ``deviation`` is null where the whole number does not fit a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import spectral
from sojourn.llm.scratch import small_batches, written

STEPS_PER_ONE = 256
COMPONENTS = 4
# Whole numbers up to this size are doubles, too.
LARGEST = 2**53
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Model:
    """``n`` vectors with these ``sums`` per entry; ``components`` (columns) with their ``values`` (variances, falling)."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)

    @property
    def scales(self) -> np.ndarray:
        """What projections are multiplied by."""
        return np.divide(1.0, np.sqrt(self.values), out=np.zeros(len(self.values)), where=self.values > 0)


def whole(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors of a batch count, their lengths, and their whole numbers end to end."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    # Numbers that are not finite get past the bound as well.
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(STEPS_PER_ONE * entries)
        fits = np.abs(x) <= LARGEST
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.bincount(row[~fits], minlength=len(lengths)) == 0
    good &= ~np.asarray(column.is_null()) & (lengths > 0)
    kept = good[row]
    return good, lengths[good], x[kept].astype(np.int64)


def _list_column(batch: pa.RecordBatch, name: str) -> pa.ListArray:
    column = batch.column(name)
    return column if pa.types.is_list(column.type) else column.cast(pa.list_(column.type.value_type))


def whole_numbers(vectors: DataFrame, column: str) -> DataFrame:
    """``x``: the whole numbers of every vector that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, x = whole(_list_column(batch, column))
            offsets = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], ["x"])

    return vectors.select(F.col(column).cast("array<double>").alias(column)).mapInArrow(run, "x array<bigint>")


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.asarray(_list_column(batch, "x").flatten()).reshape(-1, length)


def _sums(listed: DataFrame, length: int) -> tuple[int, ...]:
    """Exact sums per entry: the upper and lower 32 bits are added apart, which no task can overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        high, low = np.zeros(length, np.int64), np.zeros(length, np.int64)
        for x in _matrices(batches, length):
            high += (x >> 32).sum(0)
            low += (x & _LOW).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    parts = listed.mapInArrow(run, "i long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("i").agg(*exact).collect()
    return tuple(int(r["high"]) * 2**32 + int(r["low"]) for r in sorted(rows, key=lambda r: r["i"]))


def _products(listed: DataFrame, length: int, centred) -> np.ndarray:
    """Sum over all vectors of the products of ``centred(x)``'s columns, with a last row of the columns' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, length):
            y = centred(x)
            part = np.vstack([y.T @ y, y.sum(0)])
            total = part if total is None else total + part
        if total is not None:
            rows = pa.array(total.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), rows], ["i", "row"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(np.stack(frame["row"].to_numpy()), axis=0)]})

    # One row per task and row of the matrix; they are added where the matrix rows are dealt to.
    added = listed.mapInArrow(run, "i long, row array<double>").groupBy("i").applyInPandas(add, "i long, row array<double>")
    return np.array([r["row"] for r in sorted(added.collect(), key=lambda r: r["i"])])


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all distinct vectors; none if there are no vectors."""
    small_batches(vectors.sparkSession)
    # Copies meet as keys of an aggregation, which each task folds before anything is shuffled.
    listed = written(whole_numbers(vectors, column).distinct(), "fit-list")
    top = listed.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if top is None:
        return None
    length, n = top["length"], top["count"]
    listed = listed.filter(F.size("x") == length)
    sums = _sums(listed, length)
    mean = np.array([s / n for s in sums], float)
    covariance = _products(listed, length, lambda x: x - mean)[:-1] / n
    values, found = spectral.eigen(covariance)
    # What rounding leaves of a component without variance is none.
    values = np.where(values > 4 * length * spectral.EPS * max(values[0], 0.0), values, 0.0)
    k = min(components, length)
    model = Model(n, sums, found[:, :k], values[:k], float(np.trace(covariance)), 0.0)
    axes = model.components * model.scales
    products = _products(listed, length, lambda x: (x - mean) @ axes) / n
    # The projections are centred but for rounding; what is left of their mean is taken off.
    off = products[:-1] - np.outer(products[-1], products[-1]) - np.diag((model.values > 0).astype(float))
    error = float(np.abs(off).max(initial=0.0))
    return Model(n, sums, model.components, model.values, model.trace, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n * x - sums)^2 of each row, exactly, or nothing where it is beyond a long."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest**2 * len(sums) < 2**63:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    return [d if d < 2**63 else None for d in (away * away).sum(1)] if len(x) else []


def whiten(vectors: DataFrame, model: Model | None, column: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector that counts and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    small_batches(vectors.sparkSession)
    wanted = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        length, k = model.components.shape
        axes = model.components * model.scales
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for batch in batches:
            good, lengths, flat = whole(_list_column(batch, "vector"))
            if not len(lengths):
                continue
            fits = lengths == length
            x = flat[np.repeat(fits, lengths)].reshape(-1, length)
            ids = batch.column("vec_id").filter(pa.array(good)).filter(pa.array(fits))
            m = len(x)
            y = (x - model.mean) @ axes
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                names,
            )

    return wanted.mapInArrow(run, schema)
