"""Embedding whitening from a covariance by polarisation.

Components are integers x = floor(64 * c) + 1000000, centred as y = n * x - S (S: the
sum of their dimension), which is exact.  Tasks add up y_i^2 of each dimension
and (y_i + y_j)^2 of each pair of dimensions; as (y_i + y_j)^2 = y_i^2 + 2 y_i y_j +
y_j^2, differences of these variances give every cross-covariance.  All sums are
integers of any size, so the covariance matrix is exact up to one rounding per entry.

The driver holds the D(D+1)/2 sums and the D x D matrix, whose size follows the
vectors' length and not the number of rows; no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.vectors import complete_rows, matrix, scaled
from parley.plans.stages import materialize

SCALE, SHIFT = 64.0, 1_000_000
#: Bytes of the largest work array of a task.
BLOCK_BYTES = 8 << 20
_EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """A fitted map: y -> (y / n) . components / sqrt(eigenvalues)."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    eigenvalues: np.ndarray     # falling
    components: np.ndarray      # a unit eigenvector in each column
    spread: int                 # largest range of a dimension

    @property
    def dims(self) -> int:
        return len(self.sums)

    def kept(self, most: int) -> int:
        """Components up to ``most`` that have a variance: the others cannot be scaled to one."""
        least = max(self.eigenvalues.max(initial=0.0), 0.0) * self.dims * np.finfo(float).eps
        return int((self.eigenvalues[:most] > least).sum())


def integers(column: pa.Array, dims: int) -> np.ndarray:
    return scaled(matrix(column, dims), SCALE) + SHIFT


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S in int64; the products may wrap around, their difference does not (``fit`` has checked the range)."""
    low = np.array([s & ((1 << 64) - 1) for s in sums], np.uint64)
    return (x.astype(np.uint64) * np.uint64(n & ((1 << 64) - 1)) - low).astype(np.int64)


def _add(value: np.ndarray) -> list[int]:
    """Exact sums over rows of non-negative int64 values."""
    high, low = (value >> 32).sum(axis=0), (value & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(l) for h, l in zip(high, low, strict=True)]


def _square_sums(z: np.ndarray) -> list[int]:
    """Exact sums over rows of z^2, |z| < 2^62."""
    if not len(z):
        return [0] * z.shape[1]
    if max(abs(int(z.min())), abs(int(z.max()))) < 1 << 31:
        return _add(z * z)
    z = np.abs(z)
    high, low = z >> 31, z & 0x7FFFFFFF
    return [(a << 62) + (b << 32) + c for a, b, c in zip(_add(high * high), _add(high * low), _add(low * low), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def fit(vectors: DataFrame, dims: int) -> Whitening:
    """Fit on every row of ``vectors`` (id, vector as array<double>, all of length ``dims``).

    ``vectors`` should be a written table: it is read twice.  An empty table gives
    zeros.  Numbers whose centred form would leave 62 bits are an error.
    """
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, [0] * dims, None, None
        for batch in _blocks(batches, dims):
            x = integers(batch.column("vector"), dims)
            n += len(x)
            # |x| is at most 2^53 + SHIFT: the halves cannot overflow
            total = [t + (int(h) << 32) + int(l) for t, h, l in zip(
                total, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(t) for t in total], _EXACT),
                 pa.array(least, pa.int64()), pa.array(most, pa.int64())], names=["i", "n", "total", "least", "most"])

    found = vectors.select("vector").mapInArrow(add_up, "i int, n long, total decimal(38,0), least long, most long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    rows = sorted(found.collect())    # a row per dimension
    if not rows:
        return Whitening(0, (0,) * dims, np.zeros((dims, dims)), np.zeros(dims), np.eye(dims), 0)
    n, sums = rows[0].n, tuple(int(r.total) for r in rows)
    spread = max(r.most - r.least for r in rows)
    if n * spread >= 1 << 61:
        raise OverflowError(f"{n} rows that range over {spread} cannot be centred within 62 bits")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims - i) for i in range(dims)]
        seen = False
        for batch in _blocks(batches, dims):
            seen = True
            y = np.ascontiguousarray(_centred(integers(batch.column("vector"), dims), n, sums))
            for i in range(dims):
                z = y[:, i:] + y[:, i: i + 1]
                z[:, 0] = y[:, i]     # the dimension itself, then its sums with each later one
                total[i] = [a + b for a, b in zip(total[i], _square_sums(z), strict=True)]
        for i in range(dims if seen else 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (dims - i), pa.int32()), pa.array(range(i, dims), pa.int32()),
                 pa.array([Decimal(t) for t in total[i]], _EXACT)], names=["i", "j", "squares"])

    pairs = vectors.select("vector").mapInArrow(squares, "i int, j int, squares decimal(38,0)").groupBy("i", "j").agg(
        F.sum("squares").alias("squares"))
    got = {(r.i, r.j): int(r.squares) for r in pairs.collect()}    # dims * (dims + 1) / 2 rows
    covariance = np.empty((dims, dims))
    for i in range(dims):
        covariance[i, i] = got[i, i] / n ** 3       # division of integers: one rounding
        for j in range(i + 1, dims):
            covariance[i, j] = covariance[j, i] = (got[i, j] - got[i, i] - got[j, j]) / (2 * n ** 3)
    values, columns = np.linalg.eigh(covariance)
    return Whitening(n, sums, covariance, np.ascontiguousarray(values[::-1]), np.ascontiguousarray(columns[:, ::-1]), spread)


def _projected(model: Whitening, y: np.ndarray, kept: int) -> np.ndarray:
    return (y / model.n) @ (model.components[:, :kept] / np.sqrt(model.eigenvalues[:kept]))


def identity_error(vectors: DataFrame, model: Whitening, most: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    dims, kept = model.dims, model.kept(most)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((kept + 1, kept + 1)), False
        for batch in _blocks(batches, dims):
            seen = True
            w = np.ones((len(batch), kept + 1))     # the last column counts, and gives the means
            w[:, :kept] = _projected(model, _centred(integers(batch.column("vector"), dims), model.n, model.sums), kept)
            total += w.T @ w
        if seen:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                                             names=["i", "j", "total"])

    if not kept:
        return 0.0
    got = np.zeros((kept + 1, kept + 1))
    sums = vectors.select("vector").mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    for r in sums.collect():    # (kept + 1)^2 rows
        got[r.i, r.j] = r.total
    mean = got[:kept, kept] / got[kept, kept]
    return float(np.abs(got[:kept, :kept] / got[kept, kept] - np.outer(mean, mean) - np.eye(kept)).max())


def whiten(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each complete vector and component up to ``most``.

    Rows whose vector is null or holds null or non-finite entries are dropped.  Null
    and repeated ids stay, a row each; other columns do not matter, whatever their
    names.  Where vectors differ in length, those of the most frequent length (ties: the
    longer) span the space; the others have no place in it and are dropped too.  An
    empty table, or vectors without components, give no rows.  A component without variance
    (equal rows, repeated dimensions) has null as ``whitened`` and takes no part in the
    identity error.  ``deviation`` is decimal(38,0).
    """
    spark = table.sparkSession
    vectors = materialize(complete_rows(table, id_col, vector_col), "whitening-rows")
    sizes = vectors.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes.dims if sizes else 0
    schema = (f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    if not dims:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("vector") == dims)
    model = fit(vectors, dims)
    error, kept, shown = identity_error(vectors, model, most), model.kept(most), min(most, dims)
    trace = float(np.trace(model.covariance))
    explained = model.eigenvalues[:shown] / trace if trace > 0 else np.zeros(shown)
    small = dims * (model.n * model.spread) ** 2 < 1 << 62

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, dims):
            y = _centred(integers(batch.column("vector"), dims), model.n, model.sums)
            k = len(y)
            if small:
                deviation = pa.array((y * y).sum(axis=1)).cast(_EXACT)
            else:
                deviation = pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in y], _EXACT)
            values = np.full((k, shown), np.nan)
            values[:, :kept] = _projected(model, y, kept)
            row = pa.array(np.repeat(np.arange(k), shown))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(row), pa.array(np.tile(np.arange(1, shown + 1), k), pa.int32()),
                 pa.array(np.full(k * shown, model.n), pa.int64()), deviation.take(row), pa.array(values.ravel(), from_pandas=True),
                 pa.array(np.tile(explained, k)), pa.array(np.full(k * shown, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, schema)
