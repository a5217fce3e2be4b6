"""DuckDB SQL for the fixture adapters, mirroring ``sources.fixtures`` line by line.

Used only by the oracle queries that cross-check the Spark plans.
"""

EVENT_MESSAGES = """
event_messages AS (
  SELECT
    event_id,
    'bot-' || CAST(user_id % 4 AS VARCHAR) AS bot_id,
    'dlg-' || CAST(user_id % 16 AS VARCHAR) AS dialog_id,
    'c' || CAST(user_id % 64 AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) AS conversation_id,
    'node_' || event_type AS dialog_node,
    '' AS location_type,
    '' AS user_location,
    CASE WHEN event_id % 23 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
    '' AS lp_chat_id,
    CASE event_id % 6 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' WHEN 2 THEN 'ie'
                      WHEN 3 THEN 'opera' WHEN 4 THEN '' ELSE 'safari' END AS browser,
    CASE event_id % 4 WHEN 0 THEN 'apple' WHEN 1 THEN 'android' WHEN 2 THEN ''
                      ELSE 'tablet' END AS device,
    CASE event_id % 5 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'macos'
                      WHEN 3 THEN '' ELSE 'bsd' END AS operating_system,
    'web' AS channel,
    CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'escalated'
                    WHEN 'signup' THEN 'unresolved' WHEN 'view' THEN 'abandoned'
                    ELSE '' END AS resolution_status,
    '' AS sentiment,
    event_type AS text,
    epoch_us(ts) // 1000 AS timestamp
  FROM events
)"""

ORDER_MESSAGES = """
order_messages AS (
  SELECT
    'bot-orders' AS bot_id,
    'dlg-' || o_orderpriority AS dialog_id,
    'o' || CAST(o_custkey % 97 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR)
        || '-' || CAST(month(o_orderdate) AS VARCHAR) AS conversation_id,
    'node_' || o_orderstatus AS dialog_node,
    CAST(o_custkey AS VARCHAR) AS user_id,
    CASE o_orderkey % 6 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' WHEN 2 THEN 'ie'
                        WHEN 3 THEN 'opera' WHEN 4 THEN '' ELSE 'safari' END AS browser,
    CASE o_orderkey % 4 WHEN 0 THEN 'apple' WHEN 1 THEN 'android' WHEN 2 THEN ''
                        ELSE 'tablet' END AS device,
    CASE o_orderkey % 5 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'macos'
                        WHEN 3 THEN '' ELSE 'bsd' END AS operating_system,
    'orders' AS channel,
    CASE WHEN o_orderstatus = 'F' THEN 'resolved'
         WHEN o_orderstatus = 'O' THEN 'unresolved'
         WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'escalated'
         WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN ''
         WHEN o_orderstatus = 'P' THEN 'abandoned'
         ELSE '' END AS resolution_status,
    o_orderpriority AS text,
    epoch_us(o_orderdate) // 1000 AS timestamp
  FROM orders
)"""


def grain_rows(source: str, newest: int | None = 30) -> str:
    """CTEs ``t``, ``g`` (every row once per grain) and ``gk`` (newest buckets only)."""
    grains = [("year", "year"), ("qtr", "quarter"), ("month", "month"),
              ("week", "week"), ("day", "day"), ("hour", "hour")]
    union = "\n  UNION ALL ".join(
        f"SELECT '{name}' AS grain, date_trunc('{part}', lt) AS bucket, * FROM t"
        for name, part in grains)
    keep = "" if newest is None else f"WHERE rn <= {newest}"
    return f"""
t AS (
  SELECT user_id, conversation_id, browser, device, operating_system, resolution_status,
         timestamp AS ts_ms, make_timestamp(timestamp * 1000) AS lt,
         CASE WHEN browser IN ('', 'chrome', 'firefox', 'ie', 'opera')
               AND device IN ('', 'apple', 'android')
               AND operating_system IN ('', 'linux', 'windows', 'macos')
              THEN resolution_status END AS res
  FROM {source}
),
g AS (
  {union}
),
keep AS (
  SELECT grain, bucket FROM (
    SELECT grain, bucket, row_number() OVER (PARTITION BY grain ORDER BY bucket DESC) AS rn
    FROM (SELECT DISTINCT grain, bucket FROM g)) {keep}
),
gk AS (SELECT g.* FROM g JOIN keep USING (grain, bucket))"""


def measures_sql(source: str, newest: int | None = 30) -> str:
    """CTEs ending in ``wide``: the ten measures per (grain, bucket), rounded."""
    return f"""{grain_rows(source, newest)},
uc AS (
  SELECT grain, bucket, user_id, conversation_id, count(*) AS n,
         max(ts_ms) - min(ts_ms) AS dur
  FROM gk GROUP BY ALL
),
cv AS (SELECT grain, bucket, conversation_id, sum(n) AS conv_n FROM uc GROUP BY ALL),
us AS (
  SELECT uc.grain, uc.bucket, uc.user_id, count(*) AS k, avg(dur) AS sess,
         avg(cv.conv_n) AS steps
  FROM uc JOIN cv USING (grain, bucket, conversation_id) GROUP BY ALL
),
bu AS (
  SELECT grain, bucket, count(*) AS user_totals, sum(k) / count(*) AS cpu,
         avg(sess) AS sess, avg(steps) AS steps
  FROM us GROUP BY ALL
),
bm AS (
  SELECT grain, bucket, count(*) AS message_totals,
         count(DISTINCT conversation_id) AS conversation_totals,
         count(*) FILTER (WHERE res = 'resolved') AS resolved,
         count(*) FILTER (WHERE res = 'unresolved') AS unresolved,
         count(*) FILTER (WHERE res = 'abandoned') AS abandoned,
         count(*) FILTER (WHERE res = 'escalated') AS escalated
  FROM gk GROUP BY ALL
),
wide AS (
  SELECT grain, bucket,
         round(cpu, 6) AS conversations_per_user_avg,
         conversation_totals, message_totals,
         round(sess, 3) AS session_length_avg,
         round(steps, 6) AS steps_per_user_avg,
         user_totals, resolved, unresolved, abandoned, escalated
  FROM bm JOIN bu USING (grain, bucket)
)"""
