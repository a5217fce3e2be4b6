"""Shards of nearly equal bytes by longest-processing-time scheduling.

Groups that must stay together, sorted by size, go one by one to the least
loaded shard through a heap.  A group of at least 1/(``grain`` * shards) of all
bytes is scheduled by itself; there are at most ``grain`` * shards of those, at
any input size.  Smaller groups are first packed into that many parcels by their
key, and the parcels are scheduled like groups.  So what the driver sorts is
bounded by the parameters, not by the data, and every row is placed.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.plans.stages import materialize

#: Rows numbered by one task when slots are given out.
ROWS_PER_RANGE = 1_000_000


def longest_first(sizes: list[tuple[int, bytes]], shards: int) -> dict[bytes, int]:
    """Shard of each key: largest size first (ties by key), to the least loaded (ties: the lowest number)."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_groups(rows: DataFrame, *, shards: int, group_col: str, size_col: str, grain: int = 500) -> DataFrame:
    """Table (group key, shard) as a column ``shard`` added to ``rows``.

    ``rows`` should be a written table: it is read for the group sizes and for the
    result.  Only (key, size) is shuffled, after a map-side sum, so one group may
    hold any share of the rows.
    """
    spark = rows.sparkSession
    groups = materialize(rows.groupBy(F.col(group_col).alias("key")).agg(F.sum(size_col).alias("bytes")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    units = grain * shards
    parcel = F.pmod(F.xxhash64("key"), F.lit(units))
    alone = F.col("bytes") * units >= max(total, 1)     # true of at most `units` groups
    big = groups.where(alone).select("bytes", "key").collect()
    small = groups.where(~alone).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = longest_first([(r.bytes, (0, bytes(r.key))) for r in big] + [(r.bytes, (1, r.parcel)) for r in small], shards)
    by_key = pa.table({"key": pa.array([k for (kind, k) in placed if kind == 0], pa.binary()),
                       "own_shard": pa.array([s for (kind, _), s in placed.items() if kind == 0], pa.int32())})
    by_parcel = pa.table({"parcel": pa.array([k for (kind, k) in placed if kind == 1], pa.int64()),
                          "parcel_shard": pa.array([s for (kind, _), s in placed.items() if kind == 1], pa.int32())})
    # both tables have at most `units` rows, whatever the input
    own = F.broadcast(spark.createDataFrame(by_key))
    packed = F.broadcast(spark.createDataFrame(by_parcel))
    out = rows.withColumn("parcel", F.pmod(F.xxhash64(group_col), F.lit(units)))
    out = out.join(own.withColumnRenamed("key", group_col), group_col, "left").join(packed, "parcel", "left")
    return out.withColumn("shard", F.coalesce("own_shard", "parcel_shard")).drop("parcel", "own_shard", "parcel_shard")


def with_slots(rows: DataFrame, *, shard_col: str, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard without gaps.

    Each shard is dealt over ranges of a hash of ``order`` that hold about
    ``ROWS_PER_RANGE`` rows; ranges are numbered apart, then shifted by the rows of
    the ranges before them, so no task orders a whole shard.
    """
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    dealt = rows.withColumn("range", F.pmod(F.hash(*order, F.lit(7)), F.lit(ranges)))
    counts = dealt.groupBy(shard_col, "range").agg(F.count("*").alias("n"))
    before = counts.selectExpr(
        shard_col, "range", f"sum(n) OVER (PARTITION BY {shard_col} ORDER BY range) - n AS base")   # shards * ranges rows
    numbered = dealt.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {shard_col}, range ORDER BY {', '.join(order)}) - 1 AS within")
    out = numbered.join(before, [shard_col, "range"])
    return out.withColumn("slot", (F.col("within") + F.col("base")).cast("long")).drop("range", "within", "base")


def shard_texts(docs: DataFrame, *, shards: int = 24, overhead: int = 8,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place all rows into shards 0 .. ``shards``-1 with nearly equal bytes; equal texts stay together.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32 (unsigned), law
    (``bytes``), shard, slot (0, 1, ... in each shard) and grown_shard (null: this
    law moves rows when the number of shards changes).  A null text counts as an
    empty one: no bytes, CRC 0, one group.  Repeated rows and null ids are placed
    like any other; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).select(
        "id", (F.octet_length("body") + overhead).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"), F.unhex(F.sha2("body", 256)).alias("group_key"))
    rows = materialize(rows, "shard-rows")
    placed = materialize(shard_groups(rows, shards=shards, group_col="group_key", size_col="size"), "shard-placed")
    out = with_slots(placed, shard_col="shard", order=["group_key", "id"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
