"""Stream ingest: payload text -> decode -> flatten -> idempotent Parquet append.

Sources are a topic (``sources.topics.read_topic``) or a folder that JSON
files are dropped into (``text_stream``).  Each micro-batch is decoded once;
valid rows are flattened and written as the batch's slice of its run (a replayed
batch replaces its own files), and all other rows, with the reason, to a
quarantine beside the store.  Progress is recorded in the checkpoint only after
the batch's writes succeed.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.flatten import flatten
from parley.sources.codec import ERROR, decode_response
from parley.sources.folders import write_slice
from parley.sources.store import PROVENANCE, append_messages, delivered_ranges, without_redelivered
from parley.sources.topics import keyed
from parley.streaming.sinks import deliver_all

DEFAULT_TRIGGER = {"processingTime": "60 seconds"}


def text_stream(spark: SparkSession, directory: str,
                max_files_per_trigger: int | None = None, provenance: bool = False) -> DataFrame:
    """Each line of each new file in ``directory`` is one payload (column ``value``).

    With ``provenance`` each names its file, by which the store knows a redelivery: a
    file is delivered whole, so it is one partition with one offset.
    """
    reader = spark.readStream.schema("value string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(directory)
    if not provenance:
        return lines
    return lines.select("value", F.col("_metadata.file_path").alias("source"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"))


def quarantine_of(path: str) -> str:
    """Where undecodable rows go unless the caller names a folder: beside the store."""
    return f"{path.rstrip('/')}_quarantine"


class Sinks:
    """Writers of a running ingest, each called with (rows, batch id); any may come or go while it runs.

    A writer that is added sees the batches that begin later.
    """

    def __init__(self, **sinks: Callable[[DataFrame, int], None]):
        self._lock = threading.Lock()
        self._sinks = dict(sinks)

    def add(self, name: str, sink: Callable[[DataFrame, int], None]) -> None:
        with self._lock:
            self._sinks[name] = sink

    def remove(self, name: str) -> None:
        with self._lock:
            self._sinks.pop(name, None)

    def now(self) -> list[Callable[[DataFrame, int], None]]:
        return list(self.named().values())

    def named(self) -> dict[str, Callable[[DataFrame, int], None]]:
        with self._lock:
            return dict(self._sinks)


def batch_writer(store_path: str, quarantine_path: str | None = None, sinks: Sinks | None = None,
                 single_file: bool = False, ledger_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: decode once, write good and bad rows, then the sinks.

    What is kept between the writes is the flat row, and the raw text of bad rows only.
    Records that carry their provenance (``sources.store.PROVENANCE``) are taken once by
    a store: those that another batch or run has committed are left out, of both.  The
    quarantine is written before the commit, so a writer that dies between may repeat bad
    rows there, and loses none.

    With a ``ledger_path`` the sinks have progress of their own (``streaming.sinks``): they are fed
    from the store, one that fails does not fail the batch, and catches up with a later one.
    A sink that is added then gets the batches before it, too.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        delivered = None
        if "topic" in batch.columns and "source" not in batch.columns:
            batch = batch.withColumn("source", F.col("topic"))
        if set(PROVENANCE) <= set(batch.columns):
            delivered = delivered_ranges(batch)
            batch = without_redelivered(batch, store_path, batch_id)
        if "key" in batch.columns:
            batch = keyed(batch)
        decoded = decode_response(batch.select("value"))
        bad = F.col(ERROR).isNotNull()
        flat = flatten(decoded, keep=[ERROR, F.when(bad, F.col("value")).alias("value")]).persist()
        try:
            rows = flat.where(~bad).drop(ERROR, "value")
            write_slice(flat.where(bad).select("value", ERROR), quarantine_path or quarantine_of(store_path), batch_id)
            append_messages(rows, store_path, batch_id, single_file=single_file, delivered=delivered)
            if sinks and ledger_path:
                deliver_all(batch.sparkSession, store_path, ledger_path, sinks.named())
            else:
                for sink in sinks.now() if sinks else []:
                    sink(rows, batch_id)
        finally:
            flat.unpersist()

    return handle


def ingest_responses(stream: DataFrame, store_path: str, checkpoint_path: str,
                     quarantine_path: str | None = None,
                     trigger: dict | None = None, sinks: Sinks | None = None,
                     single_file: bool = False, ledger_path: str | None = None) -> StreamingQuery:
    """Start the ingest query; the default trigger is one micro-batch per 60 seconds.

    Every keyed record ends up in the store or in the quarantine
    (``quarantine_of(store_path)`` unless another is named).
    """
    return (stream.writeStream
            .foreachBatch(batch_writer(store_path, quarantine_path, sinks, single_file, ledger_path))
            .option("checkpointLocation", checkpoint_path)
            .trigger(**(trigger or DEFAULT_TRIGGER))
            .start())


def stop_gracefully(query: StreamingQuery, timeout_s: float = 60.0) -> bool:
    """Let the batch that is running (or the first one) finish, then stop; true if it did.

    A source that never runs dry does not keep it: it waits for one batch to end,
    or for a stream with nothing to do, and at most ``timeout_s`` seconds.  A batch
    cut off by the deadline is replayed on restart.
    """
    deadline = time.monotonic() + timeout_s
    before = query.lastProgress
    ended = False
    while query.isActive and not ended and time.monotonic() < deadline:
        now, status = query.lastProgress, query.status
        moved = now is not None and (before is None or now["batchId"] > before["batchId"])
        idle = now is not None and not status["isTriggerActive"] and not status["isDataAvailable"]
        ended = moved or idle
        if not ended:
            time.sleep(0.05)
    query.stop()
    query.awaitTermination(max(0.1, deadline - time.monotonic()))
    return ended
