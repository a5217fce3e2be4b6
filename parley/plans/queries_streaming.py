"""Registered queries that run Structured Streaming jobs or store writes.

Payload files are produced from ``events`` by Spark into a fresh folder under
the shared checkpoint location, then streamed with ``availableNow`` so the
job drains the folder and stops; the queries return what the sinks wrote.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from parley import schemas as S
from parley.operators import measures as M
from parley.plans.catalog import register, round_measures
from parley.plans.sql_fixtures import EVENT_MESSAGES, measures_sql
from parley.session import scratch_path
from parley.sources.fixtures import chat_payloads, damaged_payloads, event_messages, load_table, messages_from_events, response_payloads
from parley.sources.store import append_messages, compact_messages, expire_messages, load_messages, multi_sink
from parley.streaming.compaction import read_log
from parley.streaming.ingest import Sinks, ingest_responses, quarantine_of, text_stream
from parley.streaming.interactions import ingest_chat_log
from parley.streaming.hourly import ingest_totals
from parley.streaming.metrics import partials_sink
from parley.streaming.sinks import deliver
from parley.streaming.state import measures_from_state, refresh
from parley.streaming.visitors import visitors_from_buckets
from parley.plans.queries_codec import CONV_SQL
from parley.sources.fixtures import system_text_payloads, user_message_payloads

SCALAR_COLUMNS = [c for c in S.MESSAGE_COLUMNS if c not in ("intents", "entities")]

RESPONSE_SQL = f"""
WITH {EVENT_MESSAGES},
sent AS (
  SELECT * REPLACE (CASE WHEN event_id % 29 = 0 THEN '' ELSE dialog_node END AS dialog_node,
                    text || CASE WHEN event_id % 2 = 0 THEN ' again' ELSE '' END AS text)
  FROM event_messages
)"""
VALID_SQL = f"""{RESPONSE_SQL},
valid AS (SELECT * FROM sent WHERE event_id % 13 NOT BETWEEN 1 AND 4)"""


#: Rows of a dropped file: payloads of about 1 KB each, flat messages.
PAYLOAD_ROWS, MESSAGE_ROWS = 50_000, 250_000


def _files_each(rows: int, parts: int, file_rows: int) -> int:
    """Files for each of ``parts`` equal parts of so many rows, so that no file (nor its writer) grows with the input."""
    return max(1, math.ceil(rows / parts / file_rows))


def _run_ingest(spark, sf_dir, with_partials: bool = False, parts: int | None = None):
    """Ingest the damaged payloads, in one micro-batch or dealt over ``parts`` of them."""
    drop = scratch_path(spark, "drop")
    events, files = load_table(spark, sf_dir, "events"), None
    if parts:      # the events are dealt, not the payloads made of them, which are many times their size
        files = _files_each(events.count(), parts, PAYLOAD_ROWS)
        events = events.repartition(parts * files)
    damaged_payloads(events).select("value").write.text(drop)
    store, quarantine = scratch_path(spark, "store"), scratch_path(spark, "quarantine")
    log = scratch_path(spark, "partials")
    sinks = Sinks(partials=partials_sink(log, time_zone="UTC")) if with_partials else None
    q = ingest_responses(text_stream(spark, drop, max_files_per_trigger=files), store,
                         scratch_path(spark, "ckpt"), quarantine,
                         trigger={"availableNow": True}, sinks=sinks)
    q.awaitTermination()
    return store, quarantine, log


@register("ingest_stream", f"""{VALID_SQL}
SELECT {", ".join(SCALAR_COLUMNS)} FROM valid""")
def ingest_stream(spark, sf_dir):
    """JSON payload files -> stream -> decode -> flatten -> Parquet; damaged ones quarantined."""
    store, _, _ = _run_ingest(spark, sf_dir)
    return load_messages(spark, store, SCALAR_COLUMNS)


@register("stream_quarantine", """
SELECT CASE event_id % 13 WHEN 1 THEN 'malformed' WHEN 3 THEN 'malformed'
            WHEN 2 THEN 'missing:response.message.context.conversation_id'
            ELSE 'missing:response.message.intents[]' END AS decode_error,
       count(*) AS rows
FROM events WHERE event_id % 13 BETWEEN 1 AND 4 GROUP BY ALL""")
def stream_quarantine(spark, sf_dir):
    """What the ingest stream set aside, counted by reason."""
    _, quarantine, _ = _run_ingest(spark, sf_dir)
    q = read_log(spark, quarantine)
    return q.groupBy("decode_error").agg(F.count(F.lit(1)).alias("rows"))


@register("stream_measures", f"""{VALID_SQL}, {measures_sql('valid')}
SELECT grain, bucket, {", ".join(n for n, _ in M.MEASURES)} FROM wide""")
def stream_measures(spark, sf_dir):
    """Measures kept per bucket from the hour-partial log that the ingest stream appends to (three micro-batches)."""
    _, _, log = _run_ingest(spark, sf_dir, with_partials=True, parts=3)
    state = scratch_path(spark, "state")
    refresh(spark, log, state)
    return round_measures(measures_from_state(spark, state))


@register("append_parquet", f"""
WITH {EVENT_MESSAGES}
SELECT {", ".join(SCALAR_COLUMNS)} FROM event_messages""")
def append_parquet(spark, sf_dir):
    """Appends keyed by batch id are idempotent: replaying batch 1 leaves one copy."""
    path = scratch_path(spark, "store")
    m = event_messages(spark, sf_dir)
    first, second = m.where(F.col("timestamp") % 2 == 0), m.where(F.col("timestamp") % 2 != 0)
    append_messages(first, path, batch_id=0)
    append_messages(second, path, batch_id=1, single_file=True)
    append_messages(second, path, batch_id=1, single_file=True)  # replay
    return load_messages(spark, path, SCALAR_COLUMNS)


@register("multi_sink", f"""
WITH {EVENT_MESSAGES}
SELECT 'archive' AS sink, conversation_id, timestamp FROM event_messages
UNION ALL
SELECT 'analytics' AS sink, conversation_id, timestamp FROM event_messages""")
def multi_sink_query(spark, sf_dir):
    """One batch handed to two writers; each receives every record."""
    m = event_messages(spark, sf_dir).select("conversation_id", "timestamp")
    paths = {name: scratch_path(spark, name) for name in ("archive", "analytics")}
    multi_sink(m, [lambda df, _, p=p: df.write.parquet(p) for p in paths.values()])
    out = None
    for name, p in paths.items():
        part = spark.read.parquet(p).select(F.lit(name).alias("sink"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _run_chat_log(spark, sf_dir, buckets: str | None = None):
    """Keyed sources with null keys and damaged records, each in two files, over two micro-batches or more."""
    conv = load_table(spark, sf_dir, "conversations")
    drops = []
    for make in (user_message_payloads, system_text_payloads):
        drops.append(scratch_path(spark, "chat-drop"))
        chat_payloads(conv, make).select("key", "value").repartition(2).write.json(drops[-1])
    streams = [spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).json(d) for d in drops]
    log, visitors = scratch_path(spark, "interactions"), scratch_path(spark, "visitors")
    q = ingest_chat_log(*streams, log, visitors, scratch_path(spark, "ckpt"), "acme", trigger={"availableNow": True},
                        buckets_path=buckets)
    q.awaitTermination()
    return log, visitors


@register("stream_interactions", f"""{CONV_SQL}
SELECT 'acme' AS company_id,
       CASE WHEN role = 'user' THEN 'utterance' ELSE 'system_text' END AS kind,
       CASE WHEN role = 'user' THEN uid END AS sender,
       CASE WHEN role <> 'user' THEN uid END AS recipient,
       text,
       CASE WHEN role <> 'user' THEN 'node_' || CAST(turn AS VARCHAR) END AS node,
       ms AS timestamp
FROM conv WHERE (conv_id + turn) % 11 NOT IN (3, 5, 6)""")
def stream_interactions(spark, sf_dir):
    """Two keyed message streams -> one company-scoped interaction log (appended per batch)."""
    log, _ = _run_chat_log(spark, sf_dir)
    return read_log(spark, log).select("company_id", "kind", "sender", "recipient", "text",
                                          "node", "timestamp")


@register("stream_visitors", f"""{CONV_SQL}
SELECT uid AS user_id, 'First' || CAST(conv_id % 37 AS VARCHAR) AS firstName,
       ['en', 'fr', 'de'][turn % 3 + 1] AS locale, ms AS last_seen_ms
FROM conv WHERE role = 'user' AND (conv_id + turn) % 11 NOT IN (3, 5, 6)
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ms DESC) = 1""")
def stream_visitors(spark, sf_dir):
    """Visitor records upserted from the user-message stream (last write wins), in buckets by user."""
    buckets = scratch_path(spark, "visitor-buckets")
    _run_chat_log(spark, sf_dir, buckets)
    return visitors_from_buckets(spark, buckets).select("user_id", "firstName", "locale",
                                                   "last_seen_ms")


@register("stream_chat_quarantine", """
SELECT CASE WHEN role = 'user' THEN 'user_message' ELSE 'system_text' END AS kind,
       CASE (conv_id + turn) % 11 WHEN 5 THEN 'malformed'
            ELSE CASE WHEN role = 'user' THEN 'missing:user' ELSE 'missing:messageType' END END AS decode_error,
       count(*) AS rows
FROM conversations WHERE (conv_id + turn) % 11 IN (5, 6) GROUP BY ALL""")
def stream_chat_quarantine(spark, sf_dir):
    """What the chat-log stream set aside, counted by kind and reason."""
    log, _ = _run_chat_log(spark, sf_dir)
    return read_log(spark, quarantine_of(log)).groupBy("kind", "decode_error").agg(F.count(F.lit(1)).alias("rows"))


@register("append_two_runs", f"""{RESPONSE_SQL}
SELECT {", ".join(SCALAR_COLUMNS)} FROM sent""")
def append_two_runs(spark, sf_dir):
    """Two ingest queries with their own checkpoints write one store, with a compaction and an expiry between."""
    store = scratch_path(spark, "store")
    payloads = response_payloads(load_table(spark, sf_dir, "events"))
    for part in range(2):
        drop = scratch_path(spark, "drop")
        payloads.where(F.pmod(F.col("event_id"), F.lit(2)) == part).select("value").repartition(2).write.text(drop)
        ingest_responses(text_stream(spark, drop, max_files_per_trigger=1), store, scratch_path(spark, "ckpt"),
                         trigger={"availableNow": True}).awaitTermination()
        if part == 0:
            compact_messages(spark, store, 0)
            expire_messages(spark, store)
    return load_messages(spark, store, SCALAR_COLUMNS)


@register("redelivered_files", f"""{VALID_SQL}
SELECT {", ".join(SCALAR_COLUMNS)} FROM valid""")
def redelivered_files(spark, sf_dir):
    """The same files under two checkpoints, with a compaction between and a new file in the second: each record once."""
    store, drop = scratch_path(spark, "store"), scratch_path(spark, "drop")
    events = load_table(spark, sf_dir, "events")
    files = 2 * _files_each(events.count(), 4, PAYLOAD_ROWS)      # of a part, and of a micro-batch
    for part in range(2):
        sent = events.where(F.pmod(F.col("event_id"), F.lit(2)) == part).repartition(files)
        damaged_payloads(sent).select("value").write.mode("append").text(drop)
        ingest_responses(text_stream(spark, drop, max_files_per_trigger=files, provenance=True), store, scratch_path(spark, "ckpt"),
                         trigger={"availableNow": True}).awaitTermination()
        if part == 0:
            compact_messages(spark, store, 0)
            expire_messages(spark, store)
    return load_messages(spark, store, SCALAR_COLUMNS)


# When an event arrives, by batch: 1 of 50 from the first ten days comes last, long after its windows have closed.
# Some of days 15 to 20 come last, too: by then their hour is closed, and their day or week may be open.
ARRIVAL = """CASE WHEN (event_id % 50 = 0 AND day(ts) <= 10) OR (day(ts) BETWEEN 15 AND 20 AND event_id % 40 = 1)
       OR (day(ts) = 20 AND hour(ts) >= 21 AND event_id % 3 = 0) THEN 2
     WHEN day(ts) > 20 THEN 1 ELSE 0 END"""


@register("stream_hourly", f"""
WITH {EVENT_MESSAGES},
arrived AS (SELECT m.*, make_timestamp(m.timestamp * 1000) AS seen, a.batch
            FROM event_messages m JOIN (SELECT event_id, {ARRIVAL} AS batch FROM events) a USING (event_id)),
marks AS (SELECT max(seen) FILTER (WHERE batch = 0) - INTERVAL 1 HOUR AS written, max(seen) - INTERVAL 1 HOUR AS until FROM arrived),
grains AS (SELECT 'hour' AS grain, INTERVAL 1 HOUR AS size UNION ALL SELECT 'day', INTERVAL 1 DAY
           UNION ALL SELECT 'week', INTERVAL 7 DAY),
placed AS (SELECT grain, size, CASE grain WHEN 'hour' THEN date_trunc('hour', seen) WHEN 'day' THEN date_trunc('day', seen)
                                  ELSE date_trunc('week', seen) END AS bucket, m.*
         FROM arrived m, grains),
counted AS (
  SELECT grain, bucket, any_value(size) AS size, count(DISTINCT user_id) AS users, count(DISTINCT conversation_id) AS conversations,
         count(*) AS messages,
         count(*) FILTER (WHERE resolution_status = 'resolved' AND known) AS resolved,
         count(*) FILTER (WHERE resolution_status = 'escalated' AND known) AS escalated
  FROM (SELECT *, browser IN ('', 'chrome', 'firefox', 'ie', 'opera') AND device IN ('', 'apple', 'android')
               AND operating_system IN ('', 'linux', 'windows', 'macos') AS known FROM placed, marks
        WHERE batch < 2 OR bucket + size > written) GROUP BY grain, bucket)
SELECT grain, bucket, users, conversations, messages, resolved, escalated FROM counted, marks WHERE bucket + size <= until""")
def stream_hourly(spark, sf_dir):
    """Closed hours, days and weeks of a stream in three micro-batches, with late rows before and after closing."""
    drop, out = scratch_path(spark, "drop"), scratch_path(spark, "totals")
    events = load_table(spark, sf_dir, "events")
    sizes = {r.batch: r["count"] for r in events.groupBy(F.expr(ARRIVAL).alias("batch")).count().collect()}
    # as many files each, none of them empty; the source takes the older first
    files = max(1, min(_files_each(sum(sizes.values()), 1, MESSAGE_ROWS), *(sizes.get(k, 0) // 1000 for k in range(3))))
    for k in range(3):
        rows = events.where(F.expr(ARRIVAL) == k)
        rows = rows.repartition(files) if files > 1 else rows.coalesce(1)
        messages_from_events(rows).write.parquet(f"{drop}/part{k}")
    stream = spark.readStream.schema(S.MESSAGE).option("maxFilesPerTrigger", files).parquet(f"{drop}/*")
    ingest_totals(stream, out, scratch_path(spark, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select("grain", F.col("bucket").cast("timestamp_ntz").alias("bucket"),
                                          "users", "conversations", "messages", "resolved", "escalated")


@register("sinks_catch_up", f"""{VALID_SQL}
SELECT s.sink, valid.conversation_id, valid.timestamp FROM valid, (VALUES ('archive'), ('analytics'), ('late')) s(sink)""")
def sinks_catch_up(spark, sf_dir):
    """Three batches to a sink that works, one that fails once, and one that comes after the last batch."""
    drop, store, ledger = (scratch_path(spark, n) for n in ("drop", "store", "ledger"))
    damaged_payloads(load_table(spark, sf_dir, "events")).select("value").repartition(3).write.text(drop)
    places = {name: scratch_path(spark, name) for name in ("archive", "analytics", "late")}
    calls = []

    def to(name):
        def write(rows, batch_id):
            calls.append(name)
            if name == "analytics" and calls.count(name) == 1:
                raise ConnectionError("away")
            rows.select("conversation_id", "timestamp").write.parquet(f"{places[name]}/batch_id={batch_id}")
        return write

    q = ingest_responses(text_stream(spark, drop, max_files_per_trigger=1), store, scratch_path(spark, "ckpt"), trigger={"availableNow": True},
                         sinks=Sinks(archive=to("archive"), analytics=to("analytics")), ledger_path=ledger)
    q.awaitTermination()
    deliver(spark, store, ledger, "late", to("late"))
    parts = [spark.read.parquet(p).select(F.lit(name).alias("sink"), "conversation_id", "timestamp") for name, p in places.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
