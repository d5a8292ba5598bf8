"""Embedding whitening from exact, bit-sliced scatter matrices.

Every component c becomes the whole number ``floor(64 c) + 1000000``.  A task takes each
dimension less its minimum, packs the bits of a rank over all its rows into words (a bit
plane), and the AND of two planes has as many bits set as rows have both; weighted by the
planes' ranks these counts are the exact cross-products.  They are summed as whole numbers,
centred as whole numbers (n XX - S S'), and only then divided: the covariance is correctly
rounded, whatever the offset, before its eigenvectors are taken on the driver (one matrix
of dimensions x dimensions).

Results for odd input: vectors that are null or hold null or non-finite components
(``vectors``) are dropped; a shorter vector has zeros in the missing places; a null
``vec_id`` and repeated rows stay and count; components without variance (constant
dimensions, fewer rows than dimensions) are not returned; an empty table gives no rows; a
``deviation`` beyond a long is null in the query and whole in the operator's decimal; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.session import materialize

from .vectors import padded, vector_rows, whole_batches

#: Fixed value: what is added to ``floor(64 c)``.
OFFSET = 1_000_000
#: Rows of a bit plane that are counted at once: planes stay in the processor's cache.
PLANE_ROWS = 8192
_WORD = 1 << 64


@dataclass(frozen=True)
class Whitener:
    """``n`` vectors, their sums per dimension (of the numbers with the offset), eigenvalues
    by falling size, their vectors as columns, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    span: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def profile(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vectors, least and greatest number) of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, m in whole_batches(batches, PLANE_ROWS):
            dims = max(m.shape[1], len(low))
            if len(m):
                m = padded(m, dims)
                fill = np.zeros(dims - len(low), np.int64)
                low, high = np.append(low, fill), np.append(high, fill)
                # before the first vectors there is nothing to compare with; after, missing places are zeros
                low, high = (m.min(0), m.max(0)) if not n else (np.minimum(low, m.min(0)), np.maximum(high, m.max(0)))
                n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(low))), pa.array(np.full(len(low) + 1, n)), pa.array(np.append(0, low)),
                                              pa.array(np.append(0, high))], ["dim", "n", "low", "high"])
    found = (rows.mapInArrow(run, "dim long, n long, low long, high long").groupBy("dim")
             .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect())
    total = found[0].n if found else 0
    return [(total, r.low, r.high) if r.n == total else (total, min(r.low, 0), max(r.high, 0)) for r in found[1:]]


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of the columns of ``y`` (whole numbers, none negative), one row of words a
    plane: the bits of column 0 from the least, then those of column 1, and so on."""
    rows = -(-len(y) // 64) * 64
    out = np.zeros((sum(bits), rows // 8), np.uint8)
    starts = np.cumsum([0, *bits])
    for b in range(max(bits, default=0)):
        have = [d for d, k in enumerate(bits) if k > b]
        packed = np.packbits((y[:, have] >> b & 1).astype(np.uint8), axis=0)
        out[starts[have] + b, :packed.shape[0]] = packed.T
    return out.view(np.uint64)


def joint_counts(words: np.ndarray) -> np.ndarray:
    """Rows that have both bits set, for every two planes (upper triangle)."""
    out = np.zeros((len(words), len(words)), np.int64)
    for i in range(len(words)):
        out[i, i:] = np.bitwise_count(words[i] & words[i:]).sum(1, dtype=np.int64)
    return out


def weighted(counts: np.ndarray, bits: list[int]) -> list[tuple[int, int, int]]:
    """(dimension, dimension, exact sum of products) from the planes' joint counts, and
    (dimension, -1, exact sum)."""
    starts, out = np.cumsum([0, *bits]).tolist(), []
    full = counts + np.triu(counts, 1).T
    weights = [np.array([1 << b for b in range(k)], object) for k in bits]
    small = len(bits) == 0 or 2 * max(bits) + int(counts.max(initial=0)).bit_length() + 2 * max(bits).bit_length() < 62
    kind = np.int64 if small else object
    for d, k in enumerate(bits):
        w = weights[d].astype(kind)
        own = full[starts[d]:starts[d + 1]].astype(kind)
        out.append((d, -1, int((w * np.diag(own[:, starts[d]:starts[d + 1]])).sum()) if k else 0))
        rows = (w[:, None] * own).sum(0) if k else np.zeros(full.shape[0], kind)
        out += [(d, e, int((rows[starts[e]:starts[e + 1]] * weights[e].astype(kind)).sum()) if bits[e] else 0) for e in range(d, len(bits))]
    return out


def scatter(rows: DataFrame, lows: list[int], bits: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums (dimension, -1) and sums of products (dimension, dimension) of the numbers less ``lows``."""
    dims = len(lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((sum(bits), sum(bits)), np.int64)
        for _, m in whole_batches(batches, PLANE_ROWS):
            if len(m):
                counts += joint_counts(planes(padded(m, dims) - np.array(lows, np.int64), bits))
        found = weighted(counts, bits)
        # halves of 64 bits, so that no sum of any size leaves a decimal's 38 digits
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                                          pa.array([f[2] // _WORD for f in found], pa.decimal128(38, 0)), pa.array([f[2] % _WORD for f in found], pa.decimal128(38, 0))],
                                         ["d", "e", "high", "low"])
    summed = rows.mapInArrow(run, "d int, e int, high decimal(38,0), low decimal(38,0)").groupBy("d", "e").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r.d, r.e): int(r.high) * _WORD + int(r.low) for r in summed.collect()}


def fit(table: DataFrame, components: int) -> Whitener | None:
    """The whitening of all vectors of the table; None without vectors or without variance."""
    rows = vector_rows(table)
    found = profile(rows)
    if not found:
        return None
    n, lows = found[0][0], [f[1] for f in found]
    spans = [f[2] - f[1] for f in found]
    sums = scatter(rows, lows, [s.bit_length() for s in spans])
    dims = len(lows)
    covariance = np.zeros((dims, dims))
    for d in range(dims):
        for e in range(d, dims):
            # whole numbers until this division, which rounds once
            covariance[d, e] = covariance[e, d] = (n * sums[d, e] - sums[d, -1] * sums[e, -1]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0) * dims * np.finfo(float).eps
    keep = min(components, int(real.sum()))
    if not keep:
        return None
    offset = [int(s) + n * (low + OFFSET) for s, low in zip((sums[d, -1] for d in range(dims)), lows)]
    return Whitener(n, tuple(offset), values[:keep], np.ascontiguousarray(vectors[:, :keep]), float(np.trace(covariance)), max(spans))


def whiten(table: DataFrame, model: Whitener) -> DataFrame:
    """(``vec_id``, ``deviation`` decimal, ``whitened`` array of doubles) of every vector:
    ``deviation`` is the sum over dimensions of (n x - S)^2."""
    dims = len(model.sums)
    within = model.n * max(model.span, 1)            # n x - S is no larger
    narrow = dims * within * within < 1 << 62        # the squares' sum fits a long
    fits = max(model.n * (OFFSET + model.span), *map(abs, model.sums)) < 1 << 61
    sums = np.array(model.sums, np.int64 if fits else object)
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in whole_batches(batches, PLANE_ROWS):
            if not len(m):
                continue
            m = padded(m, dims)
            x = (m if fits else m.astype(object)) + OFFSET
            centred = x * model.n - sums
            deviation = ((centred if narrow else centred.astype(object)) ** 2).sum(1)
            out = (centred / model.n).astype(np.float64) @ scaled
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([int(v) for v in deviation.tolist()], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))],
                ["vec_id", "deviation", "whitened"])
    return vector_rows(table).mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (centred, divisor ``n``) less the identity."""
    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy().reshape(-1, components)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(components)
        for batch in batches:
            total += rows(batch).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(components)), pa.array(total)], ["i", "s"])

    only = whitened.select("whitened")
    mean = np.zeros(components)
    for r in only.mapInArrow(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r.i] = r.s / n

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components, components))
        for batch in batches:
            centred = rows(batch) - mean
            total += centred.T @ centred
        i, j = np.triu_indices(components)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])
    error = F.abs(F.sum("s") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return float(only.mapInArrow(multiply, "i long, j long, s double").groupBy("i", "j").agg(error.alias("error")).agg(F.max("error")).first()[0])


def whitened_rows(table: DataFrame, components: int = 32) -> DataFrame:
    """(``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``): a
    row for every vector and component, numbered from 1 by falling eigenvalue."""
    model = fit(table, components)
    if model is None:
        return table.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = materialize(whiten(table, model), "whitened")
    error = identity_error(found, model.n, len(model.values))
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return (found.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
