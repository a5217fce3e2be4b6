"""Registered queries: the multi-grain measures (flagship) and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.calendar import GRAINS, bucket_start, epoch_ms_to_local
from parley.operators import dimensions as D
from parley.operators import measures as M
from parley.plans.catalog import register, round_measures
from parley.plans.rollup import grain_partials, user_conversations
from parley.plans.sql_fixtures import EVENT_MESSAGES, ORDER_MESSAGES, grain_rows, measures_sql
from parley.sources.fixtures import event_messages, order_messages

# The fixture timestamps are UTC wall-clock times, and the oracle SQL buckets in
# UTC, so the registered queries pin the zone instead of using the session's.
TZ = "UTC"

WIDE_COLUMNS = ", ".join(["grain", "bucket", *[n for n, _ in M.MEASURES]])


def _wide_sql(select: str, source: str = "events") -> str:
    cte, name = (EVENT_MESSAGES, "event_messages") if source == "events" else (
        ORDER_MESSAGES, "order_messages")
    return f"WITH {cte}, {measures_sql(name)}\n{select}"


def _rows_sql(select: str, ctes: str = "") -> str:
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {EVENT_MESSAGES}, {grain_rows('event_messages')}{extra}\n{select}"


@register("multi_grain_measures", _wide_sql(f"SELECT {WIDE_COLUMNS} FROM wide"))
def multi_grain_measures(spark, sf_dir):
    """Flagship: ten measures x six grains, newest 30 buckets, from ``events``."""
    return round_measures(M.multi_grain_measures(event_messages(spark, sf_dir), time_zone=TZ))


@register("multi_grain_measures_orders",
          _wide_sql(f"SELECT {WIDE_COLUMNS} FROM wide", "orders"))
def multi_grain_measures_orders(spark, sf_dir):
    """The same measures over ``orders`` (80 months, 27 quarters, 7 years at sf0.01)."""
    return round_measures(M.multi_grain_measures(order_messages(spark, sf_dir), time_zone=TZ))


def _uc(spark, sf_dir):
    return user_conversations(event_messages(spark, sf_dir), time_zone=TZ)


def _rows(spark, sf_dir, keys=(), columns=("n",)):
    """In-window hour partials with only the keys and columns that a measure needs."""
    return grain_partials(event_messages(spark, sf_dir), time_zone=TZ, keys=list(keys), columns=list(columns))


def _single(name: str, fn, column: str, source):
    @register(name, _wide_sql(f"SELECT grain, bucket, {column} FROM wide"))
    def query(spark, sf_dir):
        return round_measures(fn(source(spark, sf_dir)))
    query.__name__ = name
    return query


CONVERSATIONS, USERS = ["conversation_id"], ["user_id"]
_single("message_totals", M.message_totals, "message_totals", _rows)
_single("conversation_totals", M.conversation_totals, "conversation_totals",
        lambda spark, sf_dir: _rows(spark, sf_dir, CONVERSATIONS))
_single("user_totals", M.user_totals, "user_totals", lambda spark, sf_dir: _rows(spark, sf_dir, USERS))
_single("conversations_per_user_avg", M.conversations_per_user_avg, "conversations_per_user_avg", _uc)
_single("session_length_avg", M.session_length_avg, "session_length_avg", _uc)
_single("steps_per_user_avg", M.steps_per_user_avg, "steps_per_user_avg", _uc)
_single("resolution_totals", M.resolution_totals, "resolved, unresolved, abandoned, escalated",
        lambda spark, sf_dir: _rows(spark, sf_dir, columns=D.RESOLUTION_STATUSES))


@register("messages_per_conversation", _rows_sql("""
SELECT grain, bucket, conversation_id, count(*) AS messages
FROM gk GROUP BY ALL"""))
def messages_per_conversation(spark, sf_dir):
    return M.messages_per_conversation(_rows(spark, sf_dir, CONVERSATIONS))


@register("user_conversation_sessions", _rows_sql("""
SELECT grain, bucket, user_id, conversation_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
       max(ts_ms) - min(ts_ms) AS session_ms, count(*) AS messages
FROM gk GROUP BY ALL"""))
def user_conversation_sessions(spark, sf_dir):
    return M.user_conversation_sessions(_uc(spark, sf_dir))


@register("conversation_steps_join", _rows_sql("""
SELECT uc.grain, uc.bucket, uc.user_id, uc.conversation_id, cv.conv_n
FROM uc JOIN cv USING (grain, bucket, conversation_id)""", """
uc AS (SELECT DISTINCT grain, bucket, user_id, conversation_id FROM gk),
cv AS (SELECT grain, bucket, conversation_id, count(*) AS conv_n FROM gk GROUP BY ALL)"""))
def conversation_steps_join(spark, sf_dir):
    """Each user-conversation with its conversation's message count from all users."""
    steps = M.conversation_steps(_uc(spark, sf_dir))
    return steps.select("grain", "bucket", "user_id", "conversation_id", "conv_n")


@register("dimension_cube", _rows_sql("""
SELECT grain, bucket, resolution_status, browser, device, operating_system,
       count(*) AS messages
FROM gk GROUP BY ALL"""))
def dimension_cube(spark, sf_dir):
    """Messages per (grain, bucket, resolution, browser, device, os)."""
    return D.dimension_cube(event_messages(spark, sf_dir), time_zone=TZ)


@register("calendar_buckets", f"""
WITH {EVENT_MESSAGES}
SELECT timestamp,
       date_trunc('year', lt) AS year, date_trunc('quarter', lt) AS qtr,
       date_trunc('month', lt) AS month, date_trunc('week', lt) AS week,
       date_trunc('day', lt) AS day, date_trunc('hour', lt) AS hour
FROM (SELECT timestamp, make_timestamp(timestamp * 1000) AS lt FROM event_messages)""")
def calendar_buckets(spark, sf_dir):
    """Six calendar bucket starts for every message timestamp."""
    m = event_messages(spark, sf_dir)
    local = epoch_ms_to_local(F.col("timestamp"), "UTC")
    return m.select("timestamp", *[bucket_start(g, local).alias(g) for g in GRAINS])


ALLOWED_SQL = """
allowed AS (
  SELECT r.s AS resolution_status, b.s AS browser, d.s AS device, o.s AS operating_system
  FROM (VALUES ('resolved'), ('unresolved'), ('abandoned'), ('escalated')) r(s),
       (VALUES (''), ('chrome'), ('firefox'), ('ie'), ('opera')) b(s),
       (VALUES (''), ('apple'), ('android')) d(s),
       (VALUES (''), ('linux'), ('windows'), ('macos')) o(s)
)"""


@register("dimension_combinations", f"""
WITH {EVENT_MESSAGES}, {ALLOWED_SQL},
seen AS (SELECT resolution_status, browser, device, operating_system, count(*) AS messages
         FROM event_messages GROUP BY ALL)
SELECT a.resolution_status, a.browser, a.device, a.operating_system,
       coalesce(s.messages, 0) AS messages
FROM allowed a LEFT JOIN seen s
  USING (resolution_status, browser, device, operating_system)""")
def dimension_combinations(spark, sf_dir):
    """Every allowed dimension tuple (240) with its message count, zero-filled.

    Messages are kept only when their tuple is allowed (broadcast semi join
    against the 240-row table), then grouped by tuple (map-side combined), so
    both sides of the final outer join hold at most 240 rows whatever values
    the data carries.
    """
    m = event_messages(spark, sf_dir)
    seen = D.keep_allowed(m).groupBy(*D.DIMENSIONS).agg(F.count(F.lit(1)).alias("messages"))
    allowed = D.allowed_combinations(spark)
    return (allowed.join(seen, D.DIMENSIONS, "left")
                   .select(*D.DIMENSIONS, F.coalesce("messages", F.lit(0)).alias("messages")))


@register("allowed_dimension_messages", f"""
WITH {EVENT_MESSAGES}, {ALLOWED_SQL}
SELECT resolution_status, browser, device, operating_system, count(*) AS messages
FROM event_messages SEMI JOIN allowed USING (resolution_status, browser, device, operating_system)
GROUP BY ALL""")
def allowed_dimension_messages(spark, sf_dir):
    """Messages whose dimension tuple is allowed (broadcast semi join), counted per tuple."""
    kept = D.keep_allowed(event_messages(spark, sf_dir))
    return kept.groupBy(*D.DIMENSIONS).agg(F.count(F.lit(1)).alias("messages"))
