"""Folders of sliced tables: ``root/run=<id>/batch_id=<n>``.

A run is one streaming query with its checkpoint: Spark keeps the query's id in
the checkpoint, so it is stable over restarts and new when a checkpoint is lost
or a second query writes to the same root.  Batch ids count from 0 in each run;
as every slice names its run, no run can replace or hide another's rows.

Every folder that a reader may see is written elsewhere first (``run=<id>/_attempts``)
and gets its name by one rename, which fails if the name is taken: a slice or a
snapshot is whole or not there, a replay of a committed batch leaves it as it is, and
of two compactions of the same slices one wins.  What a dead writer leaves is an
attempt, which ``expire`` deletes.

PySpark has no public call to list or delete folders on the storage that Spark
writes to, so ``_root`` is the one place that goes through the JVM's file system.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: The run of slices written outside a streaming query.
NO_STREAM = "batch"


def _root(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names in a folder that start with ``prefix``, sorted; none if there is no such folder."""
    fs, place = _root(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(n for n in names if n.startswith(prefix))


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _root(spark, path)
    fs.delete(place, True)


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder to a name that must not exist yet; false (and nothing done) if it does.

    This is the commit of everything here: one rename, atomic where the storage's is
    (HDFS and POSIX; an object store needs a committer or a table format of its own).
    """
    fs, place = _root(spark, target)
    fs.mkdirs(place.getParent())
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark._sc._gateway
    rename = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(hadoop.Path(source), place, options)
    except Py4JJavaError as e:
        if not fs.exists(place):
            raise
        if "AlreadyExists" in e.java_exception.getClass().getName() or "not empty" in str(e.java_exception.getMessage()):
            return False
        raise
    return True


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text`` in one step; false if it is there already."""
    parent, name = path.rsplit("/", 1)
    draft = f"{parent}/_draft-{uuid.uuid4().hex}-{name}"
    fs, place = _root(spark, draft)
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    if move_new(spark, draft, path):
        return True
    delete(spark, draft)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _root(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current_run(spark: SparkSession) -> str:
    """Id of the streaming query whose batch is being written, else ``NO_STREAM``."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or NO_STREAM


def run_path(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/run={run}"


def slice_path(root: str, run: str, batch_id: int) -> str:
    return f"{run_path(root, run)}/batch_id={batch_id}"


def commit_folder(spark: SparkSession, root: str, run: str, target: str, write) -> bool:
    """Let ``write(path)`` fill a fresh folder, then give it the name ``target``; false if that was taken meanwhile."""
    attempt = f"{run_path(root, run)}/_attempts/{uuid.uuid4().hex}"
    write(attempt)
    if move_new(spark, attempt, target):
        return True
    delete(spark, attempt)
    return False


def write_slice(df: DataFrame, root: str, batch_id: int | None, run: str | None = None, beside: dict[str, DataFrame] | None = None) -> bool:
    """Commit one batch's rows; false if the batch has been committed before (a replay), whose slice stays.

    Tables in ``beside`` are committed with the slice, under ``_<name>`` in it.  Without a batch
    id the rows are an append of their own under ``batch_id=-1``.
    """
    spark, run = df.sparkSession, run or current_run(df.sparkSession)
    target = slice_path(root, run, -1 if batch_id is None else batch_id)
    if batch_id is None or batch_id < 0:
        target = f"{target}/write={uuid.uuid4().hex}"
    elif children(spark, target, "_SUCCESS"):
        return False

    def write(path: str) -> None:
        for name, rows in (beside or {}).items():
            rows.write.parquet(f"{path}/_{name}")
        df.write.mode("append").parquet(path)

    return commit_folder(spark, root, run, target, write)


def runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of the runs under ``root``; a root with slices of no named run is refused."""
    if children(spark, root, "batch_id="):
        raise ValueError(f"{root} holds slices that name no run")
    return [n.split("=", 1)[1] for n in children(spark, root, "run=")]


def one_run(spark: SparkSession, root: str, run: str | None) -> str:
    """``run``, or the only run there is."""
    found = runs(spark, root)
    if run is None and len(found) == 1:
        return found[0]
    if run not in found:
        raise ValueError(f"name one of the runs of {root}: {found}")
    return run


def snapshot(spark: SparkSession, root: str, run: str) -> tuple[int, str] | None:
    """``(through, path)`` of a run's newest complete snapshot, if any.

    Spark's listing skips folders that start with ``_``; a snapshot counts once
    its ``_SUCCESS`` marker is there.
    """
    base = f"{run_path(root, run)}/_snapshots"
    found = [int(n.split("=", 1)[1]) for n in children(spark, base, "through=")]
    for through in sorted(found, reverse=True):
        if children(spark, f"{base}/through={through}", "_SUCCESS"):
            return through, f"{base}/through={through}"
    return None


def slices(spark: SparkSession, root: str, run: str, after: int | None = None, through: int | None = None) -> list[tuple[int, str]]:
    """``(batch_id, path)`` of a run's committed slices later than ``after`` and up to ``through``.

    Slices with a negative batch id are appends of no batch; they are always live.  A
    folder without a ``_SUCCESS`` marker (of another writer, still at work) does not count.
    """
    out = []
    for name in children(spark, run_path(root, run), "batch_id="):
        n, path = int(name.split("=", 1)[1]), f"{run_path(root, run)}/{name}"
        if n < 0:
            out += [(n, f"{path}/{write}") for write in children(spark, path, "write=") if children(spark, f"{path}/{write}", "_SUCCESS")]
        elif (after is None or n > after) and (through is None or n <= through) and children(spark, path, "_SUCCESS"):
            out.append((n, path))
    return sorted(out)


def beside(spark: SparkSession, root: str, run: str, name: str) -> list[str]:
    """Folders of a table that was committed with the run's live slices and newest snapshot."""
    snap = snapshot(spark, root, run)
    places = ([snap[1]] if snap else []) + [p for _, p in slices(spark, root, run, after=snap[0] if snap else None)]
    return [f"{p}/_{name}" for p in places if children(spark, p, f"_{name}")]


def expire(spark: SparkSession, root: str) -> int:
    """Delete the slices and snapshots that a newer complete snapshot covers, and attempts; returns how many of the former.

    Run it when no reader still holds a plan over the older folders and no writer is at work.
    """
    gone = 0
    for run in runs(spark, root):
        delete(spark, f"{run_path(root, run)}/_attempts")
        newest = snapshot(spark, root, run)
        if newest is None:
            continue
        base = f"{run_path(root, run)}/_snapshots"
        old = [p for n, p in slices(spark, root, run, through=newest[0]) if n >= 0]
        old += [f"{base}/{n}" for n in children(spark, base, "through=") if int(n.split("=", 1)[1]) < newest[0]]
        for path in old:
            delete(spark, path)
        gone += len(old)
    return gone
