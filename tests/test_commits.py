"""Commits of slices and snapshots, and the ledger of what a store has been delivered."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from parley.session import scratch_path
from parley.sources import folders, store
from parley.sources.fixtures import event_messages, load_table, response_payloads
from parley.sources.topics import drop_repeated
from parley.streaming import ingest


def test_half_written_slices_do_not_count(spark):
    m, path = event_messages(spark, SMALL).limit(200), scratch_path(spark, "store")
    store.append_messages(m, path, batch_id=0)
    other = folders.slice_path(path, "batch", 1)        # another writer, still at work
    m.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(other)
    assert store.load_messages(spark, path).count() == 200
    with pytest.raises(ZeroDivisionError):              # a writer that dies leaves an attempt, which no scan sees
        folders.commit_folder(spark, path, "batch", folders.slice_path(path, "batch", 2),
                              lambda attempt: (m.write.parquet(attempt), 1 // 0))
    assert store.load_messages(spark, path).count() == 200
    assert len(folders.children(spark, folders.run_path(path, "batch"), "_attempts")) == 1
    store.expire_messages(spark, path)
    assert folders.children(spark, folders.run_path(path, "batch"), "_attempts") == []


def test_a_replay_leaves_the_committed_slice_to_its_readers(spark):
    m, path = event_messages(spark, SMALL), scratch_path(spark, "store")
    store.append_messages(m, path, batch_id=0)
    reader = store.load_messages(spark, path)
    files = reader.inputFiles()
    store.append_messages(m, path, batch_id=0)
    assert reader.count() == 1000 and store.load_messages(spark, path).inputFiles() == files
    for _ in range(2):
        store.append_messages(m.limit(5), path)          # of no batch: each is a commit of its own
    assert store.load_messages(spark, path).count() == 1010


def test_two_compactions_of_the_same_batches(spark, monkeypatch):
    m, path = event_messages(spark, SMALL), scratch_path(spark, "store")
    store.append_messages(m.where("timestamp % 2 = 0"), path, batch_id=0)
    store.append_messages(m.where("timestamp % 2 <> 0"), path, batch_id=1)
    real, between = folders.commit_folder, []

    def overtaken(*args):
        if not between:
            between.append(1)
            store.compact_messages(spark, path, 1)         # begins later, ends first
        return real(*args)

    monkeypatch.setattr(folders, "commit_folder", overtaken)
    store.compact_messages(spark, path, 1)
    got = store.load_messages(spark, path)
    assert got.count() == 1000 and got.exceptAll(m.select(*got.columns)).count() == 0
    assert len(folders.children(spark, f"{folders.run_path(path, 'batch')}/_days/through=1")) == 1      # the loser's went
    assert store.expire_messages(spark, path) == 2 and store.load_messages(spark, path).count() == 1000


def test_ledger_of_offsets(spark):
    values = [r.value for r in response_payloads(load_table(spark, SMALL, "events")).select("value").limit(40).collect()]
    values[3] = values[22] = "damaged"
    path = scratch_path(spark, "store")
    writer = ingest.batch_writer(path)

    def deliver(run, batch_id, *offsets):
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", run)
        rows = [("k", values[o + 20 * p], "topic", p, o) for p, o in offsets]
        writer(spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long"), batch_id)

    try:
        first, second = [(0, o) for o in range(10)] + [(1, o) for o in range(5)], [(0, o) for o in range(10, 20)]
        deliver("a", 0, *first)
        deliver("a", 1, *second)
        deliver("a", 1, *second)                           # replay
        store.compact_messages(spark, path, 1, "a")
        store.expire_messages(spark, path)
        deliver("b", 0, *first, *second, (1, 5))           # a lost checkpoint: all again, and one more
        deliver("b", 1, *[(1, o) for o in range(3, 20)])
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert store.load_messages(spark, path).count() == 38
    quarantine = ingest.quarantine_of(path)
    assert sum(spark.read.parquet(p).count() for run in folders.runs(spark, quarantine) for _, p in folders.slices(spark, quarantine, run)) == 2
    had = spark.read.parquet(*folders.beside(spark, path, "a", "delivered"))
    assert sorted(map(tuple, had.collect())) == [("topic", 0, 0, 19), ("topic", 1, 0, 4)]      # merged by the compaction


def test_ranges_merge(spark):
    ranges = spark.createDataFrame([("s", 0, 0, 4), ("s", 0, 5, 9), ("s", 0, 11, 20), ("s", 0, 12, 13), ("s", 0, 20, 25), ("s", 1, 5, 5), ("t", 0, 6, 6)],
                                   "source string, partition int, first long, last long")
    assert sorted(map(tuple, store.merge_ranges(ranges).collect())) == [("s", 0, 0, 9), ("s", 0, 11, 25), ("s", 1, 5, 5), ("t", 0, 6, 6)]


def test_producer_retries_are_dropped(spark):
    drop, out = scratch_path(spark, "drop"), scratch_path(spark, "out")
    rows = [("k1", "v1", 0), ("k1", "v1", 60), ("k1", "v2", 60), ("k2", "v1", 90)]
    df = spark.createDataFrame(rows, "key string, value string, s long").select("key", "value", F.timestamp_seconds("s").alias("timestamp"))
    df.repartition(2).write.parquet(drop)
    stream = spark.readStream.schema("key string, value string, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(drop)
    drop_repeated(stream).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((r.key, r.value) for r in spark.read.parquet(out).collect()) == [("k1", "v1"), ("k1", "v2"), ("k2", "v1")]
