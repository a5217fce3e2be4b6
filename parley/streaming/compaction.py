"""Compaction of the per-batch slice logs (hour partials, visitor records).

Each micro-batch writes its own slice (``sources.folders``), and readers merge
every slice; the merges are mergeable aggregates.  With one-minute batches that
is about half a million small folders a year.  ``compact`` merges a run's newest
snapshot and the slices after it, up to batch ``through``, into
``run=<id>/_snapshots/through=N``; ``read_log`` returns every run's newest
complete snapshot and only the slices written after it, each by name.  Results
are identical with or without compaction; ``folders.expire`` deletes what a
snapshot covers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from parley.sources import folders


def _run_log(spark: SparkSession, log_path: str, run: str, through: int | None = None) -> list[DataFrame]:
    snap = folders.snapshot(spark, log_path, run)
    later = folders.slices(spark, log_path, run, after=snap[0] if snap else None, through=through)
    parts = [spark.read.parquet(snap[1])] if snap else []
    return parts + ([spark.read.parquet(*[p for _, p in later])] if later else [])


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """Unmerged rows of a slice log, all runs: newest snapshots plus the later slices."""
    parts = [df for run in folders.runs(spark, log_path) for df in _run_log(spark, log_path, run)]
    if not parts:
        raise ValueError(f"{log_path} holds no slices")
    return reduce(DataFrame.unionByName, parts)


def compact(spark: SparkSession, log_path: str, through: int,
            merge: Callable[[DataFrame], DataFrame], run: str | None = None) -> str:
    """Merge a run's log up to batch ``through`` into a new snapshot; return its path.

    ``merge`` must be the log's own mergeable combine, so merging a snapshot again
    with later slices gives the same rows as merging all slices at once.
    ``through`` must be a batch the stream has committed (at most
    ``query.lastProgress["batchId"] - 1`` while it runs): only the newest,
    uncommitted batch can be replayed and rewrite its slice.
    """
    run = folders.one_run(spark, log_path, run)
    snap = folders.snapshot(spark, log_path, run)
    if snap is not None and through <= snap[0]:
        return snap[1]   # already covered; a complete snapshot is never rewritten
    path = f"{folders.run_path(log_path, run)}/_snapshots/through={through}"
    rows = reduce(DataFrame.unionByName, _run_log(spark, log_path, run, through))
    folders.commit_folder(spark, log_path, run, path, lambda attempt: merge(rows).write.parquet(attempt))
    return path      # ours, or that of a compaction that was first
