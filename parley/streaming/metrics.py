"""Incremental measures for a running ingest.

Instead of re-reading every stored message to refresh the measures, each
micro-batch appends its own hour partials (``plans.rollup.hour_partials``) to
a partial log, as a slice of its run (a replayed batch replaces its slice).  Hour partials are mergeable, so the measures are computed from
the log alone: merge slices, then the usual roll-up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.functions.calendar import GRAINS
from parley.operators.measures import measures_from_rows
from parley.plans.rollup import KEYS, hour_partials, merge_partials, rows_from_partial_log
from parley.sources.folders import write_slice
from parley.streaming.compaction import compact, read_log


def partials_sink(log_path: str, time_zone: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends the batch's hour partials to ``log_path``."""

    def write(rows: DataFrame, batch_id: int) -> None:
        write_slice(hour_partials(rows, time_zone), log_path, batch_id)

    return write


def measures_from_log(spark: SparkSession, log_path: str, grains=GRAINS,
                      newest: int | None = 30) -> DataFrame:
    """The ten measures per (grain, bucket) from a partial log."""
    log = read_log(spark, log_path)
    return measures_from_rows(rows_from_partial_log(log, grains, newest))


def compact_partials(spark: SparkSession, log_path: str, through: int, run: str | None = None) -> str:
    """Merge a run's partial log up to batch ``through`` into one snapshot (see ``compaction``)."""
    return compact(spark, log_path, through, lambda log: merge_partials(log, ["bucket", *KEYS]), run)
