"""Whitening of embeddings from a compensated covariance.

The sums of the integer vectors are exact, so the centre is the exact rational S / n. A task centres each vector in double-double, multiplies
with error-free transformations and keeps the outer products as high and low parts; these are merged the same way, first over groups of tasks and then
over the groups, one row of the matrix per group. The driver only sees the matrix, dimension by dimension, and solves it: LAPACK's ``syevd``
(behind ``numpy.linalg.eigh``) reduces it to a tridiagonal one and divides and conquers. Two steps of Newton's kind in extended precision
then take the rounding of the solver, and of the high part alone, out of the eigenvectors.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; so are those with an entry of 2^45 or more in magnitude, which has no exact
integer in a double, empty vectors, and vectors of another length than most have (ties: the longer), as those have no common covariance. Repeated rows count
each time. An empty table gives no rows. Components without variance, that is with an eigenvalue within rounding of zero, have a null
``whitened`` and are left out of ``identity_error``, which is null if none has variance. Null ids stay null; other columns are left out.
A deviation that does not fit a long is null.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 45)
#: Products that one numpy step holds, and tasks merged in one group.
PRODUCTS, FAN = 1 << 16, 64
#: Eigenvalues below this part of the largest are rounding.
NOTHING = 1e-13
PARTS = "row int, part long, high array<double>, low array<double>"
SPLITTER = float((1 << 27) + 1)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and the exact rest."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a as a sum of two numbers of at most 26 bits each."""
    c = SPLITTER * a
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b rounded, and the exact rest."""
    p = a * b
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the first axis, in pairs."""
    while len(high) > 1:
        half = len(high) // 2
        s = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate((part, rest[2 * half :])) for part, rest in zip(s, (high, low), strict=True))
    return high[0], low[0]


class Moments(NamedTuple):
    """Number of vectors of the fit list and the exact sum of each dimension."""

    n: int
    sums: list[int]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as high and low parts."""
        high = [float(Fraction(s, self.n)) for s in self.sums]
        return np.array(high), np.array([float(Fraction(s, self.n) - Fraction(h)) for s, h in zip(self.sums, high, strict=True)])

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they hold it and its squares' sum, else Python's."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if reach < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            if len(self.sums) * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
                return d
        return self.n * x.astype(object) - np.array(self.sums, object)


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of the usable rows of any length but zero."""
    def integer(c: Column) -> Column:
        c = c.cast("double")
        return F.when(~F.isnan(c) & (F.abs(c) < LARGEST), F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT).cast("long"))

    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), integer).alias("x"))
    return rows.filter((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull()))


def moments(rows: DataFrame) -> Moments:
    """Count and sums over the most frequent length. The sums are kept in two parts, so that no long overflows."""
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return Moments(0, [])
    each = rows.filter(F.size("x") == lengths[0]["size"]).select(F.posexplode("x").alias("i", "c"))
    sums = each.groupBy("i").agg(F.sum(F.shiftright("c", 24)).alias("high"), F.sum(F.col("c").bitwiseAND(F.lit((1 << 24) - 1))).alias("low")).orderBy("i").collect()
    return Moments(lengths[0]["count"], [(r.high << 24) + r.low for r in sums])


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def covariance(rows: DataFrame, vector_col: str, n: int, centre: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of outer products of the centred vectors, over n."""
    size = len(centre[0])
    left, right = np.triu_indices(size)

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros(len(left)), np.zeros(len(left))
        step = max(1, PRODUCTS // len(left))
        for batch in it:
            x = matrix_of(batch.column(0)).astype(float)
            for at in range(0, len(x), step):
                high, low = two_sum(x[at : at + step], -centre[0])
                high, low = two_sum(high, low - centre[1])
                p, e = two_product(high[:, left], high[:, right])
                e += high[:, left] * low[:, right] + low[:, left] * high[:, right]
                sums = add(sums, total(*two_sum(p, e)))
        part = TaskContext.get().partitionId()
        full = [np.zeros((size, size)) for _ in range(2)]
        for matrix, values in zip(full, sums, strict=True):
            matrix[left, right] = values
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int64()), *(pa.array(list(m), pa.list_(pa.float64())) for m in full)], ["row", "part", "high", "low"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = total(*(matrix_of(table.column(name).combine_chunks()) for name in ("high", "low")))
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), **{name: pa.array([list(p)], pa.list_(pa.float64())) for name, p in zip(("high", "low"), parts, strict=True)}})

    parts = rows.select(vector_col).mapInArrow(products, PARTS)
    for fan in (FAN, None):
        parts = parts.withColumn("part", F.col("part") % F.lit(fan) if fan else F.lit(0).cast("long")).groupBy("row", "part").applyInArrow(merge, PARTS)
    found = parts.select("row", "high", "low").orderBy("row").collect()
    sums = (np.array([r[name] for r in found]).reshape(-1, size) for name in ("high", "low"))
    high, low = (np.triu(s) + np.triu(s, 1).T for s in sums)
    # (high + low) / n: the quotient and what its product leaves over.
    q = high / n
    p, e = two_product(q, np.full_like(q, float(n)))
    return two_sum(q, ((high - p) - e + low) / n)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, to double precision."""
    values, vectors = np.linalg.eigh(high)
    values, vectors = values[::-1], vectors[:, ::-1]
    if not np.isfinite(values).all() or values[0] <= 0:
        return values, vectors
    exact, x = high.astype(np.longdouble) + low, vectors.astype(np.longdouble)
    for _ in range(2):
        # The turn of each pair of vectors towards each other is its residual over the gap of their values; where those are equal, only the angle is set right.
        off, inner = x.T @ exact @ x, np.eye(len(x)) - x.T @ x
        off, inner = (off + off.T) / 2, (inner + inner.T) / 2
        value = np.diag(off) / (1 - np.diag(inner))
        gap = value[None, :] - value[:, None]
        close = np.abs(gap) <= 1e-12 * value[0]
        x = x + x @ (inner / 2 + np.where(close, 0, (off + (value[None, :] + value[:, None]) / 2 * inner) / np.where(close, 1, gap)))
    x /= np.sqrt((x * x).sum(axis=0))
    return np.diag(x.T @ exact @ x).astype(float), x.astype(float)


class Whitening(NamedTuple):
    """A fitted whitening: ``vectors`` has a unit eigenvector per column; ``identity_error`` is null where no component has variance."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S of integer vectors, and their whitened components, NaN without variance."""
        d = self.moments.shifted(x)
        e = np.where(self.varied(), self.values, np.nan)
        return d, (d / self.moments.n).astype(float) @ self.vectors / np.sqrt(e)

    def varied(self) -> np.ndarray:
        return self.values > NOTHING * max(self.values[0], 0)


def fit(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None where there is none."""
    rows = integers(vectors, id_col, vector_col)
    found = moments(rows)
    if not found.n:
        return None
    rows = rows.filter(F.size("x") == len(found.sums))
    high, low = covariance(rows, "x", found.n, found.centre())
    values, axes = eigen(high, low)
    whole = np.trace(high)
    explained = values / whole if whole > 0 else np.zeros(len(values))
    fitted = Whitening(found, values[:components], axes[:, :components], np.maximum(explained, 0)[:components], None)
    keep = np.flatnonzero(fitted.varied())
    if not len(keep):
        return fitted

    def whitened(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array(list(fitted.project(matrix_of(batch.column(0)))[1][:, keep]), pa.list_(pa.float64()))], ["w"])

    made = rows.select("x").mapInArrow(whitened, "w array<double>")
    means = made.select(F.posexplode("w").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).orderBy("i").collect()
    centre = np.array([r.m for r in means]), np.zeros(len(keep))
    return fitted._replace(identity_error=float(np.abs(covariance(made, "w", found.n, centre)[0] - np.eye(len(keep))).max()))


def transform(vectors: DataFrame, fitted: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, n, error = len(fitted.values), fitted.moments.n, fitted.identity_error

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            d, w = fitted.project(matrix_of(batch.column(1)))
            rows = len(w)
            deviation = [int(s) if s < 1 << 63 else None for s in (d * d).sum(axis=1)]
            each = np.repeat(np.arange(rows), k)
            columns = {
                "id": batch.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), "n": pa.array(np.full(rows * k, n)),
                "deviation": pa.array(deviation, pa.int64()).take(pa.array(each)), "whitened": pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                "explained": pa.array(np.tile(fitted.explained, rows)), "identity_error": pa.array([error] * (rows * k), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = integers(vectors, id_col, vector_col)
    return rows.filter(F.size("x") == len(fitted.moments.sums)).mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return transform(vectors, fit(vectors)).withColumnRenamed("id", "vec_id")
