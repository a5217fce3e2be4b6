"""Measures kept up to date from the partial log, bucket by bucket.

The state holds mergeable partials per (user, conversation) on a ladder of three
levels -- hours, days and months -- in a folder per day or month (a day's hours share
one: an hour's rows alone would make very small files), and the finished measures
of the newest buckets of each grain.  ``refresh`` takes the log's slices that it has
not taken yet, merges them into the folders that they touch, and computes the
measures of the touched buckets anew: an hour from its hour, days and weeks from days,
months, quarters and years from months.  Folders that no new slice touches are not
written, and only read where their day or month is part of a touched week, quarter or year.

A manifest names every live folder, the hours that exist and the slices that are taken.  It is
committed by creating the next number in one step, so a reader sees a whole state,
a refresh that dies leaves the last one, and of two at a time the later one starts
over.  The manifest grows with the calendar (some entries per day and month) and not
with the messages.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.calendar import GRAINS, bucket_start
from parley.operators.measures import MEASURES, measures_from_rows
from parley.plans.rollup import KEYS, PARTIAL_COLUMNS, merge_partials
from parley.sources import folders
from parley.streaming.compaction import read_log

#: The level that each grain's measures are computed from.
LEVEL_OF = {"hour": "hour", "day": "day", "week": "day", "month": "month", "qtr": "month", "year": "month"}
LEVELS = ("hour", "day", "month")
#: Schemas are given, so that opening a folder costs no job.
_PARTIALS = (f"bucket timestamp_ntz, {', '.join(f'{k} string' for k in KEYS)}, {', '.join(f'{c} bigint' for c in PARTIAL_COLUMNS)}")
_MEASURES = f"grain string, bucket timestamp_ntz, {', '.join(f'{n} {"bigint" if k == "int" else "double"}' for n, k in MEASURES)}"


@dataclass
class Manifest:
    """One committed state: ``live[level][day or month]`` is a folder, ``hours[day]`` the hours that exist,
    ``taken[run]`` the batches merged (ranges, rising)."""

    version: int = 0
    live: dict[str, dict[str, str]] = field(default_factory=lambda: {level: {} for level in LEVELS})
    hours: dict[str, list[int]] = field(default_factory=dict)
    taken: dict[str, list[list[int]]] = field(default_factory=dict)
    measures: str | None = None

    def has(self, run: str, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.taken.get(run, []))

    def with_taken(self, batches: list[tuple[str, int]]) -> dict[str, list[list[int]]]:
        out = {run: [[*r] for r in ranges] for run, ranges in self.taken.items()}
        for run, batch in batches:
            ranges: list[list[int]] = []
            for a, b in sorted([*out.get(run, []), [batch, batch]]):
                if ranges and a <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(ranges[-1][1], b)
                else:
                    ranges.append([a, b])
            out[run] = ranges
        return out


@dataclass
class Refresh:
    """What a refresh did: its version, and the bucket folders it read and wrote."""

    version: int
    read: list[str]
    written: list[str]


def manifest(spark: SparkSession, state_path: str) -> Manifest:
    """The newest committed state; an empty one if there is none."""
    found = [n for n in folders.children(spark, f"{state_path}/_manifest") if n.endswith(".json") and not n.startswith("_")]
    return Manifest(**json.loads(folders.read_text(spark, f"{state_path}/_manifest/{max(found)}"))) if found else Manifest()


def _start(grain: str, hour: dt.datetime) -> dt.datetime:
    day = hour.replace(hour=0)
    return {"hour": hour, "day": day, "week": day - dt.timedelta(days=day.weekday()), "month": day.replace(day=1),
            "qtr": day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1), "year": day.replace(month=1, day=1)}[grain]


def _name(bucket: dt.datetime) -> str:
    return f"{bucket:%Y-%m-%d-%H}"


def _when(name: str) -> dt.datetime:
    return dt.datetime.strptime(name, "%Y-%m-%d-%H")


def _unit(level: str, hour: dt.datetime) -> str:
    """Name of the folder that holds an hour's rows on a level."""
    return _name(_start("month" if level == "month" else "day", hour))


def _read(spark: SparkSession, state_path: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(_PARTIALS).parquet(*[f"{state_path}/{p}" for p in paths])


def new_slices(spark: SparkSession, log_path: str, known: Manifest) -> tuple[list[tuple[str, int]], list[str], bool]:
    """(batches, their folders, whether the log no longer holds some of them by themselves)."""
    batches, paths = [], []
    for run in folders.runs(spark, log_path):
        found = folders.slices(spark, log_path, run)
        if any(n < 0 for n, _ in found):
            raise ValueError(f"{log_path} holds slices of no batch")
        new = [(n, p) for n, p in found if not known.has(run, n)]
        snap = folders.snapshot(spark, log_path, run)
        if snap is not None:
            there = {n for n, _ in found}
            if any(n not in there and not known.has(run, n) for n in range(snap[0] + 1)):
                return [], [], True       # expired before it was taken: only a snapshot has it
        batches += [(run, n) for n, _ in new]
        paths += [p for _, p in new]
    return batches, paths, False


def refresh(spark: SparkSession, log_path: str, state_path: str, newest: int | None = 30, tries: int = 5) -> Refresh:
    """Bring the state up to date with the log; returns what it touched.

    Only the ``newest`` existing buckets of each grain get measures (all if None): buckets
    are only ever added, so one that has left that window does not come back.  A log
    whose slices were compacted and expired before they were taken is read as a whole.
    """
    for _ in range(tries):
        known = manifest(spark, state_path)
        batches, paths, lost = new_slices(spark, log_path, known)
        if lost:
            known = Manifest(version=known.version)
            log = read_log(spark, log_path)
            for run in folders.runs(spark, log_path):
                snap = folders.snapshot(spark, log_path, run)
                batches += [(run, n) for n in range(snap[0] + 1 if snap else 0)] + [(run, n) for n, _ in folders.slices(spark, log_path, run)]
        elif not batches:
            return Refresh(known.version, [], [])
        else:
            log = spark.read.schema(_PARTIALS).parquet(*paths)
        done = _merge(spark, log, known, known.with_taken(batches), state_path, newest)
        if done is not None:
            return done
    raise RuntimeError(f"{tries} refreshes of {state_path} were overtaken by others")


def _merge(spark: SparkSession, log: DataFrame, known: Manifest, taken: dict, state_path: str, newest: int | None) -> Refresh | None:
    """Write the touched buckets and the next manifest; none if another refresh was first."""
    version, write = known.version + 1, uuid.uuid4().hex[:12]
    hours = [r.bucket for r in log.select("bucket").distinct().collect()]       # bounded by the calendar
    touched = {level: sorted({_unit(level, h) for h in hours}) for level in LEVELS}
    old = {level: [known.live[level][b] for b in touched[level] if b in known.live[level]] for level in LEVELS}

    # the new rows stand once on each level; one shuffle merges them with the old rows of the touched buckets
    ladder = F.array(*[F.struct(F.lit(level).alias("level"), bucket_start(level, F.col("bucket")).alias("bucket")) for level in LEVELS])
    rows = log.select(F.explode(ladder).alias("at"), *KEYS, *PARTIAL_COLUMNS).select("at.level", "at.bucket", *KEYS, *PARTIAL_COLUMNS)
    for level in LEVELS:
        if old[level]:
            rows = rows.unionByName(_read(spark, state_path, old[level]).withColumn("level", F.lit(level)))
    merged = merge_partials(rows, ["level", "bucket", *KEYS]).withColumn("part", F.date_format("bucket", "yyyy-MM-dd-'00'"))
    # rebalance: a folder's rows meet in few files, and Spark splits a large one
    merged.hint("rebalance", "level", "part").write.partitionBy("level", "part").parquet(f"{state_path}/write={write}")
    live = {level: known.live[level] | {b: f"write={write}/level={level}/part={b}" for b in touched[level]} for level in LEVELS}
    read = [p for level in LEVELS for p in old[level]]

    exists = known.hours | {d: sorted({*known.hours.get(d, []), *(h.hour for h in hours if _unit("hour", h) == d)}) for d in touched["hour"]}

    # measures of the touched buckets that are among the newest of their grain
    pieces, wanted = [], []
    for grain in GRAINS:
        buckets: dict[dt.datetime, list[str]] = {}
        for name, folder in live[LEVEL_OF[grain]].items():
            for h in exists[name] if grain == "hour" else [0]:
                buckets.setdefault(_start(grain, _when(name).replace(hour=h)), []).append(folder)
        due = {_start(grain, h) for h in hours} & set(sorted(buckets)[-newest if newest else 0:])
        if due:
            paths = sorted({p for b in due for p in buckets[b]})
            read += [p for p in paths if p not in read and f"write={write}/" not in p]
            wanted += [(grain, b) for b in sorted(due)]
            piece = _read(spark, state_path, paths)
            if grain == "hour":       # its folders hold other hours, too
                piece = piece.where(F.col("bucket").between(*[F.lit(str(x)).cast("timestamp_ntz") for x in (min(due), max(due))]))
            pieces.append(piece.select(F.lit(grain).alias("grain"), bucket_start(grain, F.col("bucket")).alias("bucket"), *KEYS, *PARTIAL_COLUMNS))
    target = known.measures
    if pieces:
        rows = pieces[0]
        for more in pieces[1:]:
            rows = rows.unionByName(more)
        keys = F.broadcast(spark.createDataFrame(wanted, "grain string, bucket timestamp_ntz"))     # calendar buckets
        made = measures_from_rows(rows.join(keys, ["grain", "bucket"], "left_semi"))
        if known.measures:
            made = made.unionByName(spark.read.schema(_MEASURES).parquet(f"{state_path}/{known.measures}").join(keys, ["grain", "bucket"], "left_anti"))
        target = f"measures/write={write}"
        made.coalesce(1).write.parquet(f"{state_path}/{target}")      # a row per bucket
    text = json.dumps({"version": version, "live": live, "hours": exists, "taken": taken, "measures": target})
    if not folders.create_text(spark, f"{state_path}/_manifest/{version:012d}.json", text):
        folders.delete(spark, f"{state_path}/write={write}")
        folders.delete(spark, f"{state_path}/measures/write={write}")
        return None
    return Refresh(version, read, [f"{level}/{b}" for level in LEVELS for b in touched[level]])


def measures_from_state(spark: SparkSession, state_path: str, grains=GRAINS, newest: int | None = 30) -> DataFrame:
    """The ten measures per (grain, bucket) as of the last refresh: a read of finished rows."""
    known = manifest(spark, state_path)
    if known.measures is None:
        raise ValueError(f"{state_path} holds no state")
    rows = spark.read.schema(_MEASURES).parquet(f"{state_path}/{known.measures}").where(F.col("grain").isin(*grains))
    if newest is not None:
        rank = F.row_number().over(Window.partitionBy("grain").orderBy(F.desc("bucket")))     # a row per bucket
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= newest)
    return rows.select("grain", "bucket", *[n for n, _ in MEASURES])


def expire_state(spark: SparkSession, state_path: str) -> int:
    """Delete the bucket folders, measures and manifests that the newest manifest leaves out.

    Run it when no reader or refresh still works with an older state.  Returns how many folders went.
    """
    known = manifest(spark, state_path)
    live = {p for level in LEVELS for p in known.live[level].values()}
    gone = []
    for write in folders.children(spark, state_path, "write="):
        parts = [f"{write}/{level}/{part}" for level in folders.children(spark, f"{state_path}/{write}", "level=")
                 for part in folders.children(spark, f"{state_path}/{write}/{level}", "part=")]
        dead = [p for p in parts if p not in live]
        gone += [write] if len(dead) == len(parts) else dead
    gone += [p for n in folders.children(spark, f"{state_path}/measures") if (p := f"measures/{n}") != known.measures]
    gone += [f"_manifest/{n}" for n in folders.children(spark, f"{state_path}/_manifest") if n != f"{known.version:012d}.json"]
    for path in gone:
        folders.delete(spark, f"{state_path}/{path}")
    return len(gone)
