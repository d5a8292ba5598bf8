"""Vectors as whole numbers: ``floor(64 c)`` of every component c, taken as a double.

A vector takes part if it is not null and all its components are there, finite, and below
2^56 in size (so that their 64-fold fits a long).  Vectors shorter than others have zeros
in the missing places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64.0
_LIMIT = 2.0 ** 62


def vector_rows(table: DataFrame) -> DataFrame:
    """(``vec_id``, ``vector``) of the table alone."""
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))


def whole_numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that take part, their components as an int64 matrix)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    fine = np.isfinite(flat) & (np.abs(flat) < _LIMIT)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.asarray(column.is_valid()) & (np.bincount(row[~fine], minlength=len(sizes)) == 0)
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(fine, flat, 0).astype(np.int64)
    at = np.flatnonzero(good)
    return at, matrix[at]


def padded(matrix: np.ndarray, dims: int) -> np.ndarray:
    """``matrix`` with ``dims`` columns, zeros added."""
    return matrix if matrix.shape[1] == dims else np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def whole_batches(batches: Iterator[pa.RecordBatch], max_rows: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(``vec_id``, matrix) of the rows of ``vector_rows`` that take part, at most ``max_rows`` at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            part = batch.slice(at, max_rows)
            rows, matrix = whole_numbers(part.column(1))
            yield part.column(0).take(pa.array(rows)), matrix
