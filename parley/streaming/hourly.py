"""Live totals per hour, day and week, with late messages and exact distinct counts.

One query serves all grains: each message becomes a row per (grain, window, kind,
key), where the kind is its user or its conversation.  Two stateful aggregations are
chained: by (window, key), which makes the keys of a window distinct, and by window,
which counts them.  Both run under the one watermark of the messages' time.  A
message counts in each window that is still open when it arrives -- one that is too
late for its hour may be in time for its day -- and a window is written once, when the
watermark has passed its end (append mode).

The state holds a row per key of each open window; both aggregations combine
map-side, so a user or conversation with very many messages is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.dimensions import RESOLUTION_STATUSES, resolution_flag

#: Length and first start (ms) of the windows, in UTC; weeks start on Monday, and the epoch was a Thursday.
_HOUR = 3_600_000
WINDOWS = {"hour": (_HOUR, 0), "day": (24 * _HOUR, 0), "week": (7 * 24 * _HOUR, 4 * 24 * _HOUR)}
GRAINS = tuple(WINDOWS)
TOTALS = ["messages", *RESOLUTION_STATUSES]


def _end(ms: Column, grain: str) -> Column:
    size, start = WINDOWS[grain]
    return F.timestamp_millis(ms - F.pmod(ms - F.lit(start), F.lit(size)) + F.lit(size))


def live_totals(messages: DataFrame, grains=GRAINS, delay: str = "1 hour") -> DataFrame:
    """Stream of message rows -> (grain, bucket, users, conversations, messages, <statuses>) of the closed windows (UTC).

    Messages without a time are in no window; a null user or conversation counts as a blank one.
    """
    rows = messages.where("timestamp IS NOT NULL").select(
        F.timestamp_millis(F.col("timestamp")).alias("at"), "timestamp",
        F.coalesce("user_id", F.lit("")).alias("user"), F.coalesce("conversation_id", F.lit("")).alias("conversation"),
        F.lit(1).cast("bigint").alias("messages"), *[resolution_flag(s).cast("bigint").alias(s) for s in RESOLUTION_STATUSES],
    ).withWatermark("at", delay)
    # a window's end is event time like the column it is made from, so it carries that column's watermark
    event_time = dict(rows.schema["at"].metadata)
    # the totals ride on the user rows: those partition the messages
    placed = F.array(*[F.struct(F.lit(g).alias("grain"), _end(F.col("timestamp"), g).alias("closes"), F.lit(kind == "user").alias("is_user"),
                                F.col(kind).alias("key")) for g in grains for kind in ("user", "conversation")])
    keyed = rows.select(F.explode(placed).alias("w"), *TOTALS).select(
        "w.grain", F.col("w.closes").alias("closes", metadata=event_time), "w.is_user", "w.key",
        *[F.when(F.col("w.is_user"), F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in TOTALS])
    distinct = keyed.groupBy("grain", "closes", "is_user", "key").agg(*[F.sum(c).alias(c) for c in TOTALS])
    totals = distinct.groupBy("grain", "closes").agg(
        F.count_if("is_user").alias("users"), F.count_if(~F.col("is_user")).alias("conversations"), *[F.sum(c).alias(c) for c in TOTALS])
    size = F.coalesce(*[F.when(F.col("grain") == g, F.lit(WINDOWS[g][0])) for g in grains])
    bucket = F.timestamp_millis(F.unix_millis("closes") - size)
    return totals.select("grain", bucket.alias("bucket"), "users", "conversations", *TOTALS)


def ingest_totals(messages: DataFrame, path: str, checkpoint_path: str, delay: str = "1 hour",
                  trigger: dict | None = None) -> StreamingQuery:
    """One query that appends the closed windows of every grain to ``path`` (a folder per grain)."""
    return (live_totals(messages, delay=delay).writeStream.outputMode("append").format("parquet").partitionBy("grain")
            .option("checkpointLocation", checkpoint_path)
            .trigger(**(trigger or {"processingTime": "60 seconds"}))
            .start(path))
