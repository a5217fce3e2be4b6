"""The visitor table, hash-bucketed by user and kept up to date from the visitor log.

A bucket is one folder, written anew when a refresh brings it a record; the others stay
as they are.  A numbered manifest names the live folders and the log's slices that are
taken (as in ``streaming.state``): it is committed in one step, so a reader sees a whole
table, and of two refreshes at a time the later one starts over.  A lookup of a user
reads that user's bucket only.

The manifest grows with the number of buckets, not with the users; ``buckets`` is set when the table
is made and may be changed by any later refresh, which then writes all of it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources import folders
from parley.streaming.compaction import read_log
from parley.streaming.state import Manifest, Refresh, new_slices

BUCKETS = 64


@dataclass
class Visitors(Manifest):
    """One committed table: ``live[bucket]`` is a folder, ``taken[run]`` the batches merged, ``schema`` its columns as DDL."""

    live: dict[str, str] = field(default_factory=dict)
    buckets: int = 0
    schema: str = ""


def newest_per_user(log: DataFrame) -> DataFrame:
    """Visitor log rows -> the newest record per user id (a mergeable ``max``)."""
    fields = [c for c in log.columns if c not in ("user_id", "last_seen_ms")]
    newest = F.max(F.struct(F.col("last_seen_ms"), F.struct(*fields).alias("user")))
    return (log.groupBy("user_id").agg(newest.alias("v"))
               .select("user_id", "v.user.*", F.col("v.last_seen_ms").alias("last_seen_ms")))


def _bucket(user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, table_path: str) -> Visitors:
    """The newest committed table; an empty one if there is none."""
    found = [n for n in folders.children(spark, f"{table_path}/_manifest") if n.endswith(".json") and not n.startswith("_")]
    return Visitors(**json.loads(folders.read_text(spark, f"{table_path}/_manifest/{max(found)}"))) if found else Visitors()


def _read(spark: SparkSession, table_path: str, known: Visitors, names: list[str]) -> DataFrame:
    paths = [f"{table_path}/{known.live[b]}" for b in names if b in known.live]
    return spark.read.schema(known.schema).parquet(*paths) if paths else spark.createDataFrame([], known.schema)


def refresh_visitors(spark: SparkSession, log_path: str, table_path: str, buckets: int | None = None, tries: int = 5) -> Refresh:
    """Merge the log's new slices into the buckets that they touch; returns the folders read and the buckets written.

    ``buckets`` is that of the table unless given (``BUCKETS`` for a new one).  A log whose slices were
    compacted and expired before they were taken is read as a whole; a merge keeps the newest record, so
    slices that are read twice change nothing.
    """
    for _ in range(tries):
        known = manifest(spark, table_path)
        batches, paths, lost = new_slices(spark, log_path, known)
        count = buckets or known.buckets or BUCKETS
        again = bool(known.buckets) and count != known.buckets
        if lost:
            for run in folders.runs(spark, log_path):
                snap = folders.snapshot(spark, log_path, run)
                batches += [(run, n) for n in range(snap[0] + 1 if snap else 0)] + [(run, n) for n, _ in folders.slices(spark, log_path, run)]
            log = read_log(spark, log_path)
        elif not batches and not again:
            return Refresh(known.version, [], [])
        else:
            log = spark.read.parquet(*paths) if paths else spark.createDataFrame([], known.schema)
        done = _merge(spark, log, known, known.with_taken(batches), table_path, count, again)
        if done is not None:
            return done
    raise RuntimeError(f"{tries} refreshes of {table_path} were overtaken by others")


def _merge(spark: SparkSession, log: DataFrame, known: Visitors, taken: dict, table_path: str, count: int, again: bool) -> Refresh | None:
    version, write = known.version + 1, uuid.uuid4().hex[:12]
    fresh = newest_per_user(log).withColumn("bucket", _bucket(F.col("user_id"), count))
    if again:        # every record may change its bucket
        touched, old = [str(b) for b in range(count)], list(known.live)
    else:            # at most ``count`` numbers
        touched = sorted(str(r.bucket) for r in fresh.select("bucket").distinct().collect())
        old = [b for b in touched if b in known.live]
    rows = newest_per_user(log)
    if old:
        rows = newest_per_user(rows.unionByName(_read(spark, table_path, known, old)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # rebalance: a bucket's rows meet in few files, and Spark splits a large one
    rows.withColumn("bucket", _bucket(F.col("user_id"), count)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{table_path}/write={write}")
    made = {n.split("=", 1)[1]: f"write={write}/{n}" for n in folders.children(spark, f"{table_path}/write={write}", "bucket=")}
    live = made if again else known.live | made
    text = json.dumps({"version": version, "live": live, "buckets": count, "schema": schema, "taken": taken})
    if not folders.create_text(spark, f"{table_path}/_manifest/{version:012d}.json", text):
        folders.delete(spark, f"{table_path}/write={write}")
        return None
    return Refresh(version, [known.live[b] for b in old], [b for b in touched if b in made])


def _made(spark: SparkSession, table_path: str) -> Visitors:
    known = manifest(spark, table_path)
    if not known.version:
        raise ValueError(f"{table_path} holds no table")
    return known


def visitors_from_buckets(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest record per user as of the last refresh: a plain read, nothing is merged."""
    known = _made(spark, table_path)
    return _read(spark, table_path, known, list(known.live))


def visitor(spark: SparkSession, table_path: str, user_id: str) -> DataFrame:
    """One user's record (no row if unknown); reads one bucket."""
    known = _made(spark, table_path)
    bucket = spark.range(1).select(_bucket(F.lit(user_id), known.buckets).alias("b")).first().b
    return _read(spark, table_path, known, [str(bucket)]).where(F.col("user_id") == user_id)


def expire_visitors(spark: SparkSession, table_path: str) -> int:
    """Delete the bucket folders and manifests that the newest manifest leaves out; returns how many went.

    Run it when no reader or refresh still works with an older table.
    """
    known = manifest(spark, table_path)
    gone = []
    for write in folders.children(spark, table_path, "write="):
        parts = [f"{write}/{n}" for n in folders.children(spark, f"{table_path}/{write}", "bucket=")]
        dead = [p for p in parts if p not in known.live.values()]
        gone += [write] if len(dead) == len(parts) else dead
    gone += [f"_manifest/{n}" for n in folders.children(spark, f"{table_path}/_manifest") if n != f"{known.version:012d}.json"]
    for path in gone:
        folders.delete(spark, f"{table_path}/{path}")
    return len(gone)
