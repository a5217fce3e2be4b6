"""Calendar roll-up of message rows into per-(grain, bucket, user, conversation) partials.

Plan shape (one scan of the message table):

1. ``hour_partials``: ``groupBy(hour, user, conversation)`` with mergeable
   aggregates -- message count, first/last timestamp and the four resolution
   counts.  Spark combines map-side before the shuffle, so a hot user or
   conversation is pre-aggregated per task and spread over hours.
2. The partial table is written once to the shared checkpoint folder; every
   later stage reads it with column pruning instead of re-scanning messages.
3. ``newest_cutoffs``: per grain, the start of the N-th newest *existing*
   bucket.  One small job over the distinct hours (bounded by the calendar,
   not by the data) returns at most one row per grain.
4. ``grain_rows``: each hour partial is expanded into the (grain, bucket)
   pairs whose window holds it, so the hour/day/week grains carry only their
   newest buckets and one aggregation serves all grains.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.calendar import GRAINS, bucket_start, epoch_ms_to_local
from parley.operators.dimensions import RESOLUTION_STATUSES, resolution_flag
from parley.plans.stages import materialize

KEYS = ["user_id", "conversation_id"]
PARTIAL_COLUMNS = ["n", "first_ms", "last_ms", *RESOLUTION_STATUSES]


def session_time_zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone") or "UTC"


def hour_partials(m: DataFrame, time_zone: str | None = None, keys: list[str] = KEYS,
                  columns: list[str] = PARTIAL_COLUMNS) -> DataFrame:
    """Message rows -> ``(bucket=hour, <keys>, <columns>)``.

    A measure that needs no user or no conversation leaves that key out: without
    either, the map-side combine shrinks the messages to a row per hour.
    """
    tz = time_zone or session_time_zone(m)
    hour = bucket_start("hour", epoch_ms_to_local(F.col("timestamp"), tz))
    made = {"n": F.count(F.lit(1)), "first_ms": F.min("timestamp"), "last_ms": F.max("timestamp"),
            **{s: F.sum(s).cast("bigint") for s in RESOLUTION_STATUSES}}
    return (m.select(hour.alias("bucket"), *keys, "timestamp",
                     *[resolution_flag(s).alias(s) for s in RESOLUTION_STATUSES])
             .groupBy("bucket", *keys)
             .agg(*[made[c].alias(c) for c in columns]))


def grain_keys(hours: DataFrame, grains=GRAINS) -> DataFrame:
    """Distinct ``(grain, bucket)`` keys that exist, from a column ``bucket`` of hours."""
    pairs = F.array(*[F.struct(F.lit(g).alias("grain"),
                               bucket_start(g, F.col("bucket")).alias("bucket"))
                      for g in grains])
    return hours.select(F.inline(pairs)).distinct()


def newest_cutoffs(partials: DataFrame, newest: int | None,
                   grains=GRAINS) -> dict[str, dt.datetime | None]:
    """Per grain, the start of the ``newest``-th newest existing bucket (eager, <= 6 rows).

    ``None`` for a grain keeps all of its buckets.
    """
    if newest is None:
        return {g: None for g in grains}
    keys = grain_keys(partials.select("bucket").distinct(), grains)
    rank = F.row_number().over(Window.partitionBy("grain").orderBy(F.col("bucket").desc()))
    rows = (keys.withColumn("rank", rank).where(F.col("rank") <= newest)
                .groupBy("grain").agg(F.min("bucket").alias("cutoff")).collect())
    found = {r["grain"]: r["cutoff"] for r in rows}
    # a grain with no rows at all gets an unreachable cutoff
    return {g: found.get(g, dt.datetime(9999, 12, 31)) for g in grains}


def _ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def grain_rows(partials: DataFrame, cutoffs: dict[str, dt.datetime | None],
               carry: list[str] | None = None) -> DataFrame:
    """Hour partials -> one row per (grain, bucket) window that holds the hour.

    ``carry`` names the columns kept alongside (default: user, conversation
    and the mergeable partial columns).

    ``bucket_start(g, hour) >= cutoff`` is the same test as ``hour >= cutoff``
    because the cutoff is itself a bucket start.
    """
    hour = F.col("bucket")
    pairs = []
    for g, cut in cutoffs.items():
        pair = F.struct(F.lit(g).alias("grain"), bucket_start(g, hour).alias("bucket"))
        pairs.append(pair if cut is None else F.when(hour >= _ntz(cut), pair))
    in_window = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    source = partials
    if all(c is not None for c in cutoffs.values()):
        # the oldest cutoff bounds every grain: pushed to the Parquet scan
        source = partials.where(hour >= _ntz(min(cutoffs.values())))
    cols = carry if carry is not None else [*KEYS, *PARTIAL_COLUMNS]
    return (source.select(F.explode(in_window).alias("g"), *cols)
                  .select("g.grain", "g.bucket", *cols))


def merge_partials(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Re-group partials by ``keys``; every aggregate is mergeable."""
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        *[F.sum(s).alias(s) for s in RESOLUTION_STATUSES])


def grain_partials(m: DataFrame, grains=GRAINS, newest: int | None = 30,
                   time_zone: str | None = None, keys: list[str] = KEYS,
                   columns: list[str] = PARTIAL_COLUMNS) -> DataFrame:
    """Messages -> hour partials expanded to their in-window (grain, bucket) rows.

    The hour partials, of ``keys`` and ``columns`` only, are written to the shared
    checkpoint folder once.
    """
    partials = materialize(hour_partials(m, time_zone, keys, columns), "hour-partials")
    return grain_rows(partials, newest_cutoffs(partials, newest, grains), [*keys, *columns])


def rows_from_partial_log(log: DataFrame, grains=GRAINS, newest: int | None = 30) -> DataFrame:
    """An append-only log of hour partials (one slice per micro-batch) -> in-window rows.

    Slices may repeat an (hour, user, conversation) key; the partials are
    mergeable, so they are combined first.
    """
    partials = materialize(merge_partials(log, ["bucket", *KEYS]), "hour-partials")
    return grain_rows(partials, newest_cutoffs(partials, newest, grains))


def user_conversations(m: DataFrame, grains=GRAINS, newest: int | None = 30,
                       time_zone: str | None = None) -> DataFrame:
    """Messages -> ``(grain, bucket, user_id, conversation_id, n, first_ms, last_ms, <statuses>)``.

    Only the ``newest`` existing buckets of each grain are kept (all when
    ``None``); within a kept bucket every message counts.
    """
    rows = grain_partials(m, grains, newest, time_zone)
    return merge_partials(rows, ["grain", "bucket", *KEYS])
