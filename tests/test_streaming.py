"""Streaming ingest equals batch on the same rows; restarts resume from the checkpoint."""

from pyspark.sql import functions as F

from conftest import SMALL
from parley.operators.flatten import flatten
from parley.session import scratch_path
from parley.sources import codec
from parley.sources.fixtures import load_table, response_payloads
from parley.sources.store import load_messages
from parley.streaming.compaction import read_log
from parley.streaming.ingest import ingest_responses, text_stream


def test_restart_processes_only_new_files(spark):
    e = load_table(spark, SMALL, "events")
    payloads = response_payloads(e).select("event_id", "value")
    drop, store, ckpt = (scratch_path(spark, n) for n in ("drop", "store", "ckpt"))
    payloads.where(F.col("event_id") < 500).select("value").write.text(f"{drop}/part1")

    def run():
        q = ingest_responses(text_stream(spark, f"{drop}/*"), store, ckpt,
                             trigger={"availableNow": True})
        q.awaitTermination()

    run()
    assert load_messages(spark, store).count() == 500
    run()                                   # nothing new: no duplicates
    assert load_messages(spark, store).count() == 500
    payloads.where(F.col("event_id") >= 500).select("value").write.text(f"{drop}/part2")
    run()
    stored = load_messages(spark, store)
    batch = flatten(codec.split_valid(codec.decode_response(payloads))[0])
    assert stored.count() == e.count()
    assert stored.exceptAll(batch).count() == 0 and batch.exceptAll(stored).count() == 0


def test_processing_time_trigger_drains_on_graceful_stop(spark):
    from parley.streaming.ingest import stop_gracefully
    e = load_table(spark, SMALL, "events")
    drop, store, ckpt, bad = (scratch_path(spark, n) for n in ("drop", "store", "ckpt", "bad"))
    from parley.sources.fixtures import damaged_payloads
    damaged_payloads(e).select("value").write.text(drop)
    q = ingest_responses(text_stream(spark, drop), store, ckpt, bad,
                         trigger={"processingTime": "1 second"})
    assert stop_gracefully(q) and not q.isActive
    stored = load_messages(spark, store).count()
    quarantined = read_log(spark, bad).count()
    assert stored + quarantined == e.count()
    assert quarantined > 0 and stored > 0


def test_every_record_is_stored_or_quarantined_by_default(spark):
    from parley.sources.fixtures import chat_payloads, damaged_payloads, system_text_payloads, user_message_payloads
    from parley.streaming.ingest import quarantine_of
    from parley.streaming.interactions import ingest_chat_log
    drop, store = scratch_path(spark, "drop"), scratch_path(spark, "store")
    damaged_payloads(load_table(spark, SMALL, "events")).select("value").write.text(drop)
    ingest_responses(text_stream(spark, drop), store, scratch_path(spark, "ckpt"),
                     trigger={"availableNow": True}).awaitTermination()
    bad = read_log(spark, quarantine_of(store))
    assert bad.where("value IS NULL OR decode_error IS NULL").count() == 0 < bad.count()
    assert load_messages(spark, store).count() + bad.count() == 1000
    conv = load_table(spark, SMALL, "conversations")
    drops, keyed = [], 0
    for make in (user_message_payloads, system_text_payloads):
        drops.append(scratch_path(spark, "chat"))
        rows = chat_payloads(conv, make).select("key", "value")
        keyed += rows.where("key IS NOT NULL").count()
        rows.write.json(drops[-1])
    log = scratch_path(spark, "log")
    ingest_chat_log(*[spark.readStream.schema("key string, value string").json(d) for d in drops], log,
                    scratch_path(spark, "vis"), scratch_path(spark, "ckpt"), "acme",
                    trigger={"availableNow": True}).awaitTermination()
    assert read_log(spark, log).count() + read_log(spark, quarantine_of(log)).count() == keyed
    assert read_log(spark, log).where("text IS NULL OR timestamp IS NULL").count() == 0


def test_a_lost_checkpoint_neither_erases_nor_hides_rows(spark):
    from parley.sources import folders
    from parley.sources.store import compact_messages, expire_messages
    payloads = response_payloads(load_table(spark, SMALL, "events")).select("event_id", "value")
    store = scratch_path(spark, "store")
    for part in range(3):
        drop = scratch_path(spark, "drop")
        payloads.where(F.col("event_id") % 3 == part).select("value").write.text(drop)
        ingest_responses(text_stream(spark, drop), store, scratch_path(spark, "ckpt"),
                         trigger={"availableNow": True}).awaitTermination()
        for run in folders.runs(spark, store):
            compact_messages(spark, store, 0, run)
    assert len(folders.runs(spark, store)) == 3
    stored = load_messages(spark, store)
    assert stored.count() == 1000 and stored.select("timestamp", "user_id", "conversation_id").exceptAll(
        flatten(codec.split_valid(codec.decode_response(payloads))[0]).select("timestamp", "user_id", "conversation_id")).count() == 0
    assert expire_messages(spark, store) == 3      # a covered slice in each run
    assert load_messages(spark, store).count() == 1000


def test_stop_within_the_deadline_on_a_live_source(spark):
    import time
    from parley.streaming.ingest import stop_gracefully
    rate = spark.readStream.format("rate").option("rowsPerSecond", 20).load().select(
        F.to_json(F.struct(F.col("value"))).alias("value"))
    store = scratch_path(spark, "store")
    q = ingest_responses(rate, store, scratch_path(spark, "ckpt"), trigger={"processingTime": "0 seconds"})
    while not (q.lastProgress and q.lastProgress["numInputRows"]):
        time.sleep(0.1)
    began = time.monotonic()
    assert stop_gracefully(q, timeout_s=20) and not q.isActive and time.monotonic() - began < 20
    from parley.streaming.ingest import quarantine_of
    from parley.sources import folders
    run, = folders.runs(spark, quarantine_of(store))
    done = {n for n, _ in folders.slices(spark, quarantine_of(store), run)}
    assert set(range(q.lastProgress["batchId"] + 1)) <= done     # every finished batch is stored


def test_a_sink_added_while_running_sees_later_batches(spark):
    from parley.streaming.ingest import Sinks, stop_gracefully
    payloads = response_payloads(load_table(spark, SMALL, "events")).select("event_id", "value")
    drop, seen = scratch_path(spark, "drop"), {"first": [], "late": []}
    sinks = Sinks(first=lambda df, n: seen["first"].append((n, df.count())))
    put = lambda k: payloads.where(F.col("event_id") % 3 == k).select("value").write.text(f"{drop}/part{k}")
    put(0)
    q = ingest_responses(text_stream(spark, f"{drop}/*"), scratch_path(spark, "store"), scratch_path(spark, "ckpt"),
                         trigger={"processingTime": "0 seconds"}, sinks=sinks)
    q.processAllAvailable()
    sinks.add("late", lambda df, n: seen["late"].append((n, df.count())))
    put(1)
    q.processAllAvailable()
    sinks.remove("first")
    put(2)
    q.processAllAvailable()
    stop_gracefully(q)
    total = lambda name: sum(n for _, n in seen[name])
    assert total("first") == payloads.where("event_id % 3 < 2").count()
    assert total("late") == payloads.where("event_id % 3 > 0").count()
    assert min(n for n, _ in seen["late"]) > min(n for n, _ in seen["first"])


def test_chat_log_upserts_visitors_across_batches(spark):
    import os
    from parley.sources.fixtures import system_text_payloads, user_message_payloads
    from parley.streaming.interactions import ingest_chat_log, visitors_table
    conv = load_table(spark, SMALL, "conversations")
    um = user_message_payloads(conv)
    users, texts = scratch_path(spark, "u"), scratch_path(spark, "t")
    # older turns first, newer turns in a later file -> a later micro-batch
    um.where(F.col("turn") < 3).select("value").coalesce(1).write.text(f"{users}/a")
    um.where(F.col("turn") >= 3).select("value").coalesce(1).write.text(f"{users}/b")
    system_text_payloads(conv).select("value").coalesce(1).write.text(texts)
    log, vis, ckpt = (scratch_path(spark, n) for n in ("log", "vis", "ckpt"))
    q = ingest_chat_log(text_stream(spark, f"{users}/*", max_files_per_trigger=1),
                        text_stream(spark, texts, max_files_per_trigger=1),
                        log, vis, ckpt, "acme", trigger={"availableNow": True})
    q.awaitTermination()
    assert len(q.recentProgress) >= 2
    got = {r["user_id"]: r["last_seen_ms"] for r in visitors_table(spark, vis).collect()}
    user_rows = conv.where(F.col("role") == "user")
    newest = (user_rows.groupBy((F.col("conv_id") % 37).alias("k"))
              .agg(F.max(F.lit(1704067200000) + F.col("conv_id") * 3600000
                         + F.col("turn") * 60000).alias("ms")).collect())
    assert got == {f"u{r['k']}": r["ms"] for r in newest}
    assert read_log(spark, log).count() == conv.count()

    off = scratch_path(spark, "off")
    q = ingest_chat_log(text_stream(spark, f"{users}/*"), text_stream(spark, texts), off,
                        scratch_path(spark, "offv"), scratch_path(spark, "offc"), "acme",
                        enabled=False, trigger={"availableNow": True})
    q.awaitTermination()
    assert not os.path.exists(off.replace("file:", ""))


def input_files(df):
    return sorted(f.rsplit("/run=", 1)[1].rsplit("/", 1)[0] for f in df.inputFiles())


def test_scan_lists_live_folders_and_compaction_rewrites_touched_days(spark):
    from parley.sources import folders
    from parley.sources.fixtures import event_messages
    from parley.sources.store import append_messages, compact_messages, expire_messages
    m = event_messages(spark, SMALL)
    checksum = lambda df: df.agg(F.count(F.lit(1)), F.sum("timestamp")).first()
    path, cut = scratch_path(spark, "store"), 1706140800000     # 2024-01-25T00:00Z
    early, late = m.where(F.col("timestamp") < cut), m.where(F.col("timestamp") >= cut)
    append_messages(early, path, batch_id=0)
    append_messages(early, path, batch_id=0)             # replay: the slice is replaced
    append_messages(late.where("timestamp % 2 = 0"), path, batch_id=1)
    append_messages(late.where("timestamp % 2 <> 0").limit(5), path)   # of no batch: always live
    rest = late.where("timestamp % 2 <> 0").exceptAll(late.where("timestamp % 2 <> 0").limit(5))
    compact_messages(spark, path, 1, files_per_day=2)
    append_messages(rest, path, batch_id=2)
    append_messages(late.limit(0), path, batch_id=3)
    assert checksum(load_messages(spark, path)) == checksum(m)
    live = input_files(load_messages(spark, path))
    assert not any("batch_id=0" in f or "batch_id=1" in f for f in live)        # covered: not read
    assert any("batch_id=2" in f for f in live) and any("batch_id=-1" in f for f in live)
    assert max(live.count(f) for f in live if "_days" in f) <= 2                # files per day
    recent = load_messages(spark, path, since="2024-01-25")
    assert checksum(recent) == checksum(late)
    assert all("day=2024-01-2" in f and f >= "batch/_days/through=1/day=2024-01-25" or "day=2024-01-3" in f
               for f in input_files(recent) if "_days" in f)
    compact_messages(spark, path, 3, files_per_day=2)
    days = [f for f in set(input_files(load_messages(spark, path))) if "_days" in f]
    assert all(("through=3" in f) == (f.rsplit("day=", 1)[1] >= "2024-01-25") for f in days)
    assert checksum(load_messages(spark, path)) == checksum(m)
    assert expire_messages(spark, path) > 4
    assert checksum(load_messages(spark, path)) == checksum(m)
    assert [n for n, _ in folders.slices(spark, path, "batch")] == [-1]
    assert load_messages(spark, path, since="2030-01-01").count() == 0


def test_a_store_of_unnamed_runs_is_refused(spark):
    import pytest
    path = scratch_path(spark, "old-store")
    spark.range(1).write.parquet(f"{path}/batch_id=0")
    with pytest.raises(ValueError, match="name no run"):
        load_messages(spark, path)


def test_compaction_keeps_results_exact(spark):
    from parley.sources.fixtures import event_messages
    from parley.sources.folders import expire, snapshot, write_slice
    from parley.streaming.interactions import compact_visitors, visitors_table
    from parley.streaming.metrics import compact_partials, measures_from_log, partials_sink

    def measures(path):
        return sorted(tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r)
                      for r in measures_from_log(spark, path).collect())

    m = event_messages(spark, SMALL)
    slices = [m.where(F.col("timestamp") % 4 == i) for i in range(4)]
    plain, compacted = scratch_path(spark, "plain-log"), scratch_path(spark, "compact-log")
    write_plain, write_compacted = partials_sink(plain, "UTC"), partials_sink(compacted, "UTC")
    for i, s in enumerate(slices):
        write_plain(s, i)
    for i in range(3):
        write_compacted(slices[i], i)
    first = compact_partials(spark, compacted, 1)
    assert compact_partials(spark, compacted, 0) == first        # already covered
    compact_partials(spark, compacted, 2)                        # snapshot 1 + slice 2
    write_compacted(slices[3], 3)                                # stream goes on
    assert snapshot(spark, compacted, "batch")[0] == 2
    assert measures(compacted) == measures(plain)
    assert expire(spark, compacted) == 4                         # slices 0 to 2, snapshot 1
    assert measures(compacted) == measures(plain)

    vis = scratch_path(spark, "visitor-log")
    batches = [[("u1", "a", 10), ("u2", "b", 5)], [("u1", "c", 20)],
               [("u2", "older", 3), ("u3", "d", 1)]]
    for i, rows in enumerate(batches):
        write_slice(spark.createDataFrame(rows, "user_id string, firstName string, last_seen_ms bigint"), vis, i)
        if i == 1:
            compact_visitors(spark, vis, 1)
    got = {r["user_id"]: (r["firstName"], r["last_seen_ms"])
           for r in visitors_table(spark, vis).collect()}
    assert got == {"u1": ("c", 20), "u2": ("b", 5), "u3": ("d", 1)}

    expired = scratch_path(spark, "expired-log")   # only the snapshot is left
    visitors_table(spark, vis).write.parquet(f"{expired}/run=batch/_snapshots/through=2")
    assert {r["user_id"]: (r["firstName"], r["last_seen_ms"])
            for r in visitors_table(spark, expired).collect()} == got


def test_half_written_snapshot_is_ignored(spark):
    from parley.sources.folders import snapshot, write_slice
    from parley.streaming.interactions import visitors_table
    vis = scratch_path(spark, "visitor-log")
    schema = "user_id string, firstName string, last_seen_ms bigint"
    write_slice(spark.createDataFrame([("u1", "a", 10)], schema), vis, 0)
    # a snapshot whose job never committed: files present, no _SUCCESS marker
    (spark.createDataFrame([("u1", "bogus", 99)], schema).write
          .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
          .parquet(f"{vis}/run=batch/_snapshots/through=5"))
    assert snapshot(spark, vis, "batch") is None
    assert [tuple(r) for r in visitors_table(spark, vis).collect()] == [("u1", "a", 10)]
