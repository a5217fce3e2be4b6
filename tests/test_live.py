"""Live totals: distinct users and conversations of closed windows, one query for all grains."""

from conftest import messages
from parley.session import scratch_path
from parley.streaming.hourly import ingest_totals

H = 3_600_000
DAY = 24 * H
MONDAY = 1704067200000     # 2024-01-01T00:00Z


def row(user, conv, at, status=""):
    return user, conv, "chrome", "apple", "linux", status, at


def test_distinct_counts_late_rows_and_a_restart(spark):
    drop, out, ckpt = (scratch_path(spark, n) for n in ("drop", "totals", "ckpt"))
    files = [
        [row("a", "c1", MONDAY, "resolved"), row("a", "c1", MONDAY + 5), row("b", "c1", MONDAY + 10), row("", "c2", MONDAY + 10),
         row(None, "c2", MONDAY + 20), row("a", "c3", MONDAY + H)],
        [row("a", "c1", MONDAY + 5 * H, "escalated")],                   # watermark: 4 h
        [row("late", "c9", MONDAY + 2), row("b", "c1", MONDAY + 4 * H + 1)],   # its hour is written by now; its day is open
        [row("z", "z", MONDAY + 9 * DAY)],
    ]
    for k, rows in enumerate(files):
        messages(spark, rows).coalesce(1).write.parquet(f"{drop}/part{k}")
        stream = spark.readStream.schema(messages(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{drop}/*")
        q = ingest_totals(stream, out, ckpt, trigger={"availableNow": True})     # from the checkpoint each time
        q.awaitTermination()
        assert len(q.lastProgress["sources"]) == 1 and len(q.lastProgress["stateOperators"]) == 2
    got = {(r.grain, r.bucket.isoformat()): (r.users, r.conversations, r.messages, r.resolved, r.escalated)
           for r in spark.read.parquet(out).selectExpr("*", "CAST(bucket AS timestamp_ntz) AS b").drop("bucket").withColumnRenamed("b", "bucket").collect()}
    assert got == {
        ("hour", "2024-01-01T00:00:00"): (3, 2, 5, 1, 0),          # "" and null are one user; the late row is not in it
        ("hour", "2024-01-01T01:00:00"): (1, 1, 1, 0, 0),
        ("hour", "2024-01-01T04:00:00"): (1, 1, 1, 0, 0),
        ("hour", "2024-01-01T05:00:00"): (1, 1, 1, 0, 1),
        ("day", "2024-01-01T00:00:00"): (4, 4, 9, 1, 1),
        ("week", "2024-01-01T00:00:00"): (4, 4, 9, 1, 1),
    }
