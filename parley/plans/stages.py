"""Materialised stages: cut lineage by writing to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parley.session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Used where a stage is consumed by several branches: the expensive input
    is computed once, later branches read files with filter and column
    pushdown, and a lost executor costs a re-read rather than a recompute of
    the whole lineage.  Each call writes to a fresh folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
