"""Whitening of vectors by MLlib's singular value decomposition.

A component c becomes the whole number floor(scale * c) + shift. All sums over rows are exact: of numbers, by dimension
(high and low 32 bits apart, so no partial sum overflows), and of squared deviations. Rows are centred exactly, as
n * x - S over n, and only then multiplied: RowMatrix.computeSVD of the centred rows A, which never leave the JVM, gives the
right singular vectors, the components, and singular values s; e = s**2 / n are the eigenvalues of the covariance, divisor
n. All d components are asked for, since MLlib then decomposes the d x d Gramian in full double precision (Lanczos
iteration, for a few of many, stops at a tolerance), and the first `components` are kept. The trace comes not from the
singular values but from the exact deviations, sum / n**3.

What is held at once: a d x d matrix by each task and the driver, a block of rows by a projecting task. MLlib adds the
Gramians in a tree. The covariance of the whitened rows is added by entry, from one matrix a task.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; repeated rows and null ids count and are
returned each; eigenvalues of less than 8 * d * 2**-52 of the largest are rounding of none (a component without variance
can't be whitened), so equal rows, a single row, empty vectors or an empty table give no rows; equal eigenvalues have any
orthonormal components, the same for all rows. Vectors of different lengths, numbers beyond 53 bits of magnitude and
deviations beyond a long raise an error, as they have no right result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.shared import materialize

LOW = (1 << 32) - 1
ROWS = 4096


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, x array<long>): floor(scale * c) + shift of every vector that is whole."""
    v = F.col("v")
    whole = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))  # NaN is larger than all
    number = lambda c: F.floor(c * F.lit(float(scale)))
    fits = F.forall(v, lambda c: F.abs(c) * F.lit(float(scale)) < F.lit(float(1 << 53)))
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & whole)
    return kept.select("id", F.when(fits, F.transform(v, lambda c: number(c).cast("long") + F.lit(shift))).otherwise(F.raise_error(F.lit("a component is beyond 53 bits"))).alias("x"))


def _blocks(batches: Iterable[pa.RecordBatch]):
    """(ids, numbers) of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column("x")
            yield part.column("id"), np.asarray(x.flatten(), np.int64).reshape(part.num_rows, -1)


def _sums(batches: Iterable[pa.RecordBatch]):
    n, low, high = 0, 0, 0
    for _, x in _blocks(batches):
        n, low, high = n + len(x), low + (x & LOW).sum(axis=0), high + (x >> 32).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "low": [low.tolist()], "high": [high.tolist()]})


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows(id, x), all of one length, and the exact sum of each dimension."""
    length = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if length[0] != length[1]:
        raise ValueError(f"vectors have from {length[0]} to {length[1]} components")
    parts = rows.mapInArrow(_sums, "n long, low array<long>, high array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = parts.select("n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), exact("s.low").alias("low"), exact("s.high").alias("high")).collect()  # d rows
    if not found:
        return 0, []
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return found[0]["n"], [sums[i] for i in range(len(sums))]


def components(rows: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, of the covariance (divisor n) of rows(id, x), and their unit vectors as columns."""
    whole, rest = F.lit([s // n for s in sums]), F.lit([(s % n) / n for s in sums])
    centred = F.zip_with(F.zip_with("x", whole, lambda x, q: (x - q).cast("double")), rest, lambda x, r: x - r)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    found = RowMatrix(vectors).computeSVD(len(sums))
    return np.asarray(found.s.toArray()) ** 2 / n, np.asarray(found.V.toArray())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(n * x - S) / n as doubles, and for each row the exact sum of squares of n * x - S."""
    near = x - np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    if len(sums) * most**2 < 1 << 63:
        apart = near * n - rest
        return near - rest / n, (apart * apart).sum(axis=1)
    apart = near.astype(object) * n - rest.astype(object)
    squares = (apart * apart).sum(axis=1).tolist()
    if max(squares) >= 1 << 63:
        raise ValueError("a deviation doesn't fit a long")
    return near - rest / n, np.array(squares, np.int64)


def _project(n: int, sums: list[int], axes: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]):
        for ids, x in _blocks(batches):
            centred, deviation = _deviations(x, n, sums)
            whitened = np.ascontiguousarray(centred @ axes)
            ends = np.arange(0, whitened.size + 1, axes.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviation), pa.ListArray.from_arrays(pa.array(ends), pa.array(whitened.ravel()))], names=["id", "deviation", "whitened"])

    return run


def _moments(k: int):
    def run(batches: Iterable[pa.RecordBatch]):
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = np.asarray(batch.column("whitened").flatten()).reshape(-1, k)
            total += w.sum(axis=0)
            product += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(-1, k), k).astype(np.int32), "j": np.tile(np.arange(k), k + 1).astype(np.int32), "value": np.concatenate([total, product.ravel()])})

    return run


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of rows(whitened array of k), n of them, less the identity. The rows are
    centred already; what rounding leaves of their mean is taken off."""
    found = np.zeros((k + 1, k))
    for r in rows.select("whitened").mapInArrow(_moments(k), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # k * (k + 1) rows
        found[r["i"] + 1, r["j"]] = r["value"] / n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())


def whiten(df: DataFrame, components_kept: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id_col, n, deviation, whitened array<double>, explained array<double>, identity_error), a row for each whole vector;
    the arrays are in the order of the components. No column but id_col is kept."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = materialize(whole_rows(df, id_col, vector_col, scale, shift), "whole-rows")
    n, sums = dimension_sums(rows)
    values, vectors = components(rows, n, sums) if sums else (np.zeros(0), np.zeros((0, 0)))
    k = min(components_kept, int((values > 8 * len(values) * 2.0**-52 * values.max(initial=0)).sum()))
    if not k:
        return spark.createDataFrame([], f"{id_col} {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    axes = vectors[:, :k] / np.sqrt(values[:k])
    done = materialize(rows.mapInArrow(_project(n, sums, axes), f"id {kind}, deviation long, whitened array<double>"), "whitened")
    trace = done.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0] / Decimal(n) ** 3
    explained = [float(e / float(trace)) for e in values[:k]]
    return done.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(explained).cast("array<double>").alias("explained"), F.lit(identity_error(done, n, k)).alias("identity_error"))


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """whiten()'s rows as (id_col, component from 1, n, deviation, whitened, explained, identity_error)."""
    pair = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own")
    spread = whitened.select(id_col, "n", "deviation", "identity_error", pair)
    return spread.select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "own.whitened", "own.explained", "identity_error")
