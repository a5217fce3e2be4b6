"""Vector columns as numpy matrices (used inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vectors: Column) -> Column:
    """Whether a vector is there and holds finite numbers only (an empty one does)."""
    return vectors.isNotNull() & F.coalesce(F.forall(
        vectors, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def complete_rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as array<double>) of the rows whose vector is complete; other columns are left behind."""
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.where(complete(F.col("vector")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of ``dims`` doubles; every vector must have that length."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def scaled(values: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * value) as int64; a value beyond 2^53 could not be exact and is an error."""
    out = np.floor(factor * values)
    if len(out) and np.abs(out).max() > 2.0 ** 53:
        raise OverflowError(f"a component times {factor:g} is beyond 2^53")
    return out.astype(np.int64)
