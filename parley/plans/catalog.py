"""Named queries: each reads the driver's tables from ``sf_dir`` and returns a DataFrame.

``register`` keeps the Spark plan and, where one exists, the DuckDB SQL that
computes the same rows, side by side.  Doubles are rounded (ratios to 6
digits, milliseconds to 3) because summation order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RATIO_DIGITS = 6
MS_DIGITS = 3


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_measures(df: DataFrame) -> DataFrame:
    """Round the double measure columns that are present."""
    digits = {"conversations_per_user_avg": RATIO_DIGITS,
              "session_length_avg": MS_DIGITS,
              "steps_per_user_avg": RATIO_DIGITS}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


def _load_all() -> None:
    # importing the modules runs their ``register`` decorators
    from parley.plans import (  # noqa: F401
        queries_codec, queries_generate, queries_measures, queries_streaming, queries_trends,
    )
