"""Vectors of a table as matrices of integers, in tasks, and sums over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bounded


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The length of the longest vector; shorter ones count as filled up with zeros."""
    return vectors.agg(F.max(F.size(F.col(column)))).first()[0] or 0


def whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors without null and non-finite entries, and their matrix (doubles)."""
    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat = column.flatten()
    value = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan))
    filled = np.maximum(length, 0)
    row = np.repeat(np.arange(len(column)), filled)
    good = length >= 0
    good[row[~np.isfinite(value)]] = False
    out = np.zeros((len(column), d))
    out[row, np.arange(len(value)) - np.repeat(np.cumsum(filled) - filled, filled)] = value
    return good, out[good]


def floored(matrix: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * c) of each entry, within -most .. most."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * matrix), -float(most), float(most)).astype(np.int64)


def summed(table: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], kind: str = "double") -> dict[int, float]:
    """Adds up arrays of one fixed size over all batches, first in each task, then by Spark: {place: sum}.
    The driver gets a row for each place that isn't zero."""

    def run(batches):
        total = None
        for batch in batches:
            made = add(batch)
            total = made if total is None else total + made
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["place", "v"])

    rows = bounded(table).mapInArrow(run, f"place long, v {kind}")
    if kind == "long":
        rows = rows.withColumn("v", F.col("v").cast("decimal(20,0)"))
    return {r["place"]: r["v"] for r in rows.groupBy("place").agg(F.sum("v").alias("v")).collect()}


def in_steps(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
