"""Embedding whitening by cyclic Jacobi.

Vectors are quantised to whole numbers, each distinct one counts once, and their centred scatter is added up over the
cluster: a task adds the outer products of its rows, and the tasks' matrices, of a size that depends on the dimensions alone,
are added entry by entry.  The driver turns that one matrix by symmetric rotations, sweep after sweep, until no off-diagonal
entry is left.  Each rotation is chosen to be small, so small eigenvalues keep their relative accuracy.  The whitening matrix
(dimensions times components) goes to the tasks with the code.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are left out; so are vectors whose length
is not that of most rows (of two lengths that are equally frequent the greater holds).  Repeated rows each get their result and
equal vectors fit once.  A direction without variance cannot be whitened and has no component, so a table with fewer than two
distinct vectors, or an empty one, gives no rows.  An entry or a deviation that does not fit a long is an error.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.storage import stored

SCALE = 256
LARGEST = 2.0**62


class Whitening(NamedTuple):
    """n and per-dimension sums of the fit list; eigenvalues by size and the unit eigenvectors as rows; the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix.

    A sweep visits every pair (p, q) and rotates its plane by the smaller of the two angles that clear the entry.  It ends
    when every entry is lost beside the two diagonal ones that it stands between.
    """
    a = np.array(matrix, np.float64)
    size = len(a)
    v = np.eye(size)
    tiny = np.finfo(np.float64).eps / 64
    for _ in range(sweeps):
        turned = False
        for p in range(size - 1):
            for q in range(p + 1, size):
                entry = a[p, q]
                if abs(entry) <= tiny * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])) or entry == 0:
                    a[p, q] = a[q, p] = 0.0
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * entry)
                t = 1 / (abs(theta) + np.hypot(theta, 1)) * (1 if theta >= 0 else -1)
                c = 1 / np.hypot(t, 1)
                s = t * c
                row_p, row_q = a[p].copy(), a[q].copy()
                new_p, new_q = c * row_p - s * row_q, s * row_p + c * row_q
                new_p[p], new_q[q] = row_p[p] - t * entry, row_q[q] + t * entry
                new_p[q] = new_q[p] = 0.0
                a[p], a[q] = new_p, new_q
                a[:, p], a[:, q] = new_p, new_q
                v_p = v[p].copy()
                v[p], v[q] = c * v_p - s * v[q], s * v_p + c * v[q]
        if not turned:
            break
    else:
        raise ArithmeticError("the rotations did not come to rest")
    values = np.diagonal(a).copy()
    order = np.argsort(-values, kind="stable")
    vectors = v[order]
    return values[order], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """_key and x, an array of longs, of the rows that can be used."""
    c = F.col(vector).cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    usable = vectors.select(F.col(key).alias("_key"), c.alias("_c")).filter(F.col("_c").isNotNull() & (F.size("_c") > 0)).filter(F.forall("_c", finite))
    lengths = usable.groupBy(F.size("_c").alias("length")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("length")).limit(1).collect()
    return usable.filter(F.size("_c") == (lengths[0].length if lengths else 0)).select("_key", F.transform("_c", _whole).alias("x"))


def _whole(c: Column) -> Column:
    scaled = c * SCALE
    return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(F.raise_error(F.lit("an entry does not fit a long"))).cast("long")


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sums_of(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact per-dimension sums: a task adds up its rows, then the tasks' sums are added by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = matrix_of(batch["x"])
            if len(x):
                if n and abs(total).max() + float(abs(x).max()) * len(x) >= LARGEST or float(abs(x).max()) * len(x) >= LARGEST:
                    raise OverflowError("a sum does not fit a long")
                n, total = n + len(x), x.sum(0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), pa.array(total)], ["i", "n", "total"])

    found = fit.select("x").mapInArrow(run, "i long, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    return (found[0].n if found else 0), np.array([r.total for r in found], np.int64)


def scatter_of(fit: DataFrame, n: int, sums: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance of x, or of its image under ``turn``, centred before multiplying; one matrix leaves each task."""
    mean = sums / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = matrix_of(batch["x"]) - mean
                y = y if turn is None else y @ turn
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            size = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size)), pa.array(np.tile(np.arange(size), size)), pa.array(total.reshape(-1))], ["i", "j", "total"])

    found = fit.select("x").mapInArrow(run, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    size = len(mean) if turn is None else turn.shape[1]
    out = np.zeros((size, size))
    for r in found:
        out[r.i, r.j] = r.total / n
    return (out + out.T) / 2


def fit(rows: DataFrame) -> Whitening | None:
    """``rows`` has each distinct x once; nothing is fitted on no rows."""
    n, sums = sums_of(rows)
    if not n:
        return None
    covariance = scatter_of(rows, n, sums)
    values, vectors = jacobi(covariance)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    fields = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(vectors, key, vector)
    distinct = stored(rows.select("x").distinct(), "whitening-fit")
    found = fit(distinct)
    least = found.values[0] * len(found.values) * 64 * np.finfo(np.float64).eps if found else 0.0
    used = int((found.values[:components] > max(least, 0.0)).sum()) if found else 0
    if not used:
        return spark.createDataFrame([], fields)
    n, sums, values, directions, trace = found
    turn = (directions[:used] / np.sqrt(values[:used, None])).T
    error = float(abs(scatter_of(distinct, n, sums, turn) - np.eye(used)).max())
    mean = sums / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch["x"])
            bound = float(abs(x).max()) * n + float(abs(sums).max())
            if bound * bound * x.shape[1] >= LARGEST and max(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x) >= 1 << 63:
                raise OverflowError("a deviation does not fit a long")
            away = n * x - sums
            deviation = (away * away).sum(1)
            projected = (x - mean) @ turn
            size = len(x)
            keys = batch["_key"].take(pa.array(np.repeat(np.arange(size), used)))
            columns = [np.tile(np.arange(1, used + 1, dtype=np.int32), size), np.full(size * used, n), np.repeat(deviation, used), projected.reshape(-1), np.tile(values[:used] / trace, size), np.full(size * used, error)]
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, fields)
