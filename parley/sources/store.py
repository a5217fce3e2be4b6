"""Parquet message store: idempotent appends, typed scans, compaction by day.

``path/run=<id>/batch_id=N`` holds what one micro-batch appended (see
``sources.folders``).  ``compact_messages`` moves the slices up to a committed
batch into day folders, ``run=<id>/_days/through=N/write=<id>/day=D``, and commits a manifest
of the live ones as ``_snapshots/through=N``: days that got no new rows keep
their folders.  With each slice a store may keep what was delivered in it: the ranges of
offsets per (source, partition), by which a redelivery -- the same records under a
lost checkpoint, or under a second query -- is known.  They are committed with the rows, in one
step, and merged by compaction.  A scan reads the manifest, the live day folders that ``since``
leaves, and the later slices, each by name, so covered folders are not listed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import schemas as S
from parley.functions.calendar import epoch_ms_to_local
from parley.sources import folders


def _day(ts_ms) -> F.Column:
    return epoch_ms_to_local(ts_ms, "UTC").cast("date")


#: Where a record was delivered from; a file counts as one partition with one offset.
PROVENANCE = ["source", "partition", "offset"]


def append_messages(df: DataFrame, path: str, batch_id: int | None = None, run: str | None = None,
                    single_file: bool = False, delivered: DataFrame | None = None) -> None:
    """Append message rows to the store at ``path``.

    With a ``batch_id`` the rows are that batch's slice of the run (the streaming
    query's id, or ``run``), and a replay of a committed batch changes nothing; without one
    they are appended under ``batch_id=-1``, which no snapshot covers.  ``delivered`` are the
    ranges (see ``delivered_ranges``) that the batch was made from.
    """
    beside = {} if delivered is None else {"delivered": delivered}
    folders.write_slice(df.coalesce(1) if single_file else df, path, batch_id, run, beside)


def delivered_ranges(batch: DataFrame) -> DataFrame:
    """(source, partition, first, last) of a batch's records: a topic partition's offsets of one batch are a range."""
    return batch.groupBy("source", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


def _delivered(spark: SparkSession, path: str, batch: tuple[str, int] | None = None) -> DataFrame:
    """Ranges of all committed slices but that of ``batch`` (run, batch id)."""
    own = folders.slice_path(path, *batch) + "/" if batch else ""
    found = [p for run in folders.runs(spark, path) for p in folders.beside(spark, path, run, "delivered") if not (own and p.startswith(own))]
    schema = "source string, partition int, first bigint, last bigint"
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of one (source, partition) that overlap or touch become one."""
    order = Window.partitionBy("source", "partition").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reached.isNull() | (F.col("first") > reached + 1), 1).otherwise(0)
    island = ranges.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
    return island.groupBy("source", "partition", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def without_redelivered(batch: DataFrame, path: str, batch_id: int, run: str | None = None) -> DataFrame:
    """The batch's records (with ``PROVENANCE`` columns) that no other committed batch of the store has had."""
    spark = batch.sparkSession
    had = _delivered(spark, path, (run or folders.current_run(spark), batch_id)).alias("had")
    same = ((F.col("new.source") == F.col("had.source")) & (F.col("new.partition") == F.col("had.partition"))
            & F.col("new.offset").between(F.col("had.first"), F.col("had.last")))
    return batch.alias("new").join(had, same, "left_anti")


def _live(spark: SparkSession, path: str, run: str, since: dt.date | None = None) -> list[str]:
    """Folders of a run that a scan reads: day folders from ``since`` on, and later slices."""
    snap = folders.snapshot(spark, path, run)
    days = []
    if snap is not None:
        manifest = spark.read.schema("day date, folder string").parquet(snap[1])
        if since is not None:
            manifest = manifest.where(F.col("day").isNull() | (F.col("day") >= F.lit(since)))
        days = [f"{folders.run_path(path, run)}/{r.folder}" for r in manifest.collect()]   # one row per day
    return days + [p for _, p in folders.slices(spark, path, run, after=snap[0] if snap else None)]


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], S.MESSAGE)
    return spark.read.schema(S.MESSAGE).parquet(*paths)


def load_messages(spark: SparkSession, path: str, columns: list[str] | None = None,
                  since: dt.date | str | None = None) -> DataFrame:
    """Typed scan of all runs; only ``columns`` are read from the files.

    ``since`` keeps messages from that UTC day on; compacted days before it are
    not listed.
    """
    day = dt.date.fromisoformat(since) if isinstance(since, str) else since
    df = _read(spark, [p for run in folders.runs(spark, path) for p in _live(spark, path, run, day)])
    if day is not None:
        start_ms = int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp() * 1000)
        df = df.where(F.col("timestamp") >= F.lit(start_ms))
    return df.select(*(columns or S.MESSAGE_COLUMNS))


def compact_messages(spark: SparkSession, path: str, through: int, run: str | None = None,
                     files_per_day: int = 8) -> str:
    """Move a run's batches up to ``through`` into day folders; returns the manifest's folder.

    Only days with new rows are rewritten, as ``files_per_day`` files at most.
    ``through`` must be a batch that the stream has committed (at most
    ``query.lastProgress["batchId"] - 1`` while it runs).  ``run`` may be left out
    if the store has one.
    """
    run = folders.one_run(spark, path, run)
    base = folders.run_path(path, run)
    snap = folders.snapshot(spark, path, run)
    if snap is not None and through <= snap[0]:
        return snap[1]
    live = {}
    if snap is not None:
        live = {r.day: r.folder for r in spark.read.schema("day date, folder string").parquet(snap[1]).collect()}
    new = [p for n, p in folders.slices(spark, path, run, after=snap[0] if snap else None, through=through) if n >= 0]
    fresh = _read(spark, new).withColumn("day", _day(F.col("timestamp")))
    touched = [r.day for r in fresh.select("day").distinct().collect()]   # calendar days
    again = _read(spark, [f"{base}/{live[d]}" for d in touched if d in live]).withColumn("day", _day(F.col("timestamp")))
    days = f"_days/through={through}/write={uuid.uuid4().hex[:12]}"
    salt = F.pmod(F.xxhash64("conversation_id", "timestamp"), F.lit(files_per_day))
    (fresh.unionByName(again).repartition("day", salt).write.partitionBy("day").parquet(f"{base}/{days}"))
    for d in touched:
        live[d] = f"{days}/day={d or '__HIVE_DEFAULT_PARTITION__'}"
    target = f"{base}/_snapshots/through={through}"
    had = [f"{p}/_delivered" for p in ([snap[1]] if snap else []) + new if folders.children(spark, p, "_delivered")]

    def write(attempt: str) -> None:
        if had:
            merge_ranges(spark.read.parquet(*had)).write.parquet(f"{attempt}/_delivered")
        spark.createDataFrame(list(live.items()), "day date, folder string").coalesce(1).write.mode("append").parquet(attempt)

    if not folders.commit_folder(spark, path, run, target, write):
        folders.delete(spark, f"{base}/{days}")       # another compaction of the same batches was first
    return target


def expire_messages(spark: SparkSession, path: str) -> int:
    """Delete covered slices, older manifests and day folders that the newest manifest leaves out."""
    gone = folders.expire(spark, path)
    for run in folders.runs(spark, path):
        snap = folders.snapshot(spark, path, run)
        if snap is None:
            continue
        live = {r.folder for r in spark.read.schema("day date, folder string").parquet(snap[1]).collect()}
        base = folders.run_path(path, run)
        for through in folders.children(spark, f"{base}/_days", "through="):
            for write in folders.children(spark, f"{base}/_days/{through}", "write="):
                for day in folders.children(spark, f"{base}/_days/{through}/{write}", "day="):
                    if f"_days/{through}/{write}/{day}" not in live:
                        folders.delete(spark, f"{base}/_days/{through}/{write}/{day}")
                        gone += 1
    return gone


def multi_sink(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], batch_id: int = 0) -> None:
    """Hand the same rows and their batch id to several writers, computing the rows once."""
    df = df.persist()
    try:
        for sink in sinks:
            sink(df, batch_id)
    finally:
        df.unpersist()
