"""Registered queries: decode, flatten, encode, routing and the interaction log.

Payloads are built from ``events`` / ``conversations`` by Spark (JSON text),
then decoded again; the oracle computes the expected fields straight from the
tables, so each query checks a full round trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.json import json_action_args, json_text, raw_json_map
from parley.operators.flatten import OPTIONAL_CONTEXT, flatten, response_layout
from parley.operators.interactions import interactions, latest_visitors
from parley.plans.catalog import register
from parley.plans.sql_fixtures import EVENT_MESSAGES
from parley.sources import codec
from parley.sources import fixtures as X
from parley.sources import topics as TP
from parley.sources.topics import keyed
from parley.sources.store import append_messages, load_messages
from parley.schemas import MEASURE_COLUMNS


def _events(spark, sf_dir):
    return X.load_table(spark, sf_dir, "events")


def _decoded(spark, sf_dir):
    return codec.decode_response(X.response_payloads(_events(spark, sf_dir)))


def _flat(spark, sf_dir):
    good, _ = codec.split_valid(_decoded(spark, sf_dir))
    return flatten(good, keep=["event_id"])


# event-level expectations shared by the oracle queries below
FLAT_SQL = f"""
WITH {EVENT_MESSAGES},
flat AS (
  SELECT m.* REPLACE (CASE WHEN m.event_id % 29 = 0 THEN '' ELSE m.dialog_node END AS dialog_node,
                      m.text || CASE WHEN m.event_id % 2 = 0 THEN ' again' ELSE '' END AS text),
         e.event_type, e.value AS confidence, e.props
  FROM events e JOIN event_messages m USING (event_id)
)"""


@register("keyed_only", """
SELECT 'k' || CAST(event_id AS VARCHAR) AS key, event_id FROM events WHERE event_id % 17 <> 0""")
def keyed_only(spark, sf_dir):
    """Records without a key are skipped."""
    return TP.keyed(X.response_payloads(_events(spark, sf_dir))).select("key", "event_id")


@register("decode_response", f"""{FLAT_SQL}
SELECT event_id, bot_id, dialog_id, conversation_id, nullif(user_id, '') AS user_id,
       nullif(browser, '') AS browser, nullif(device, '') AS device,
       nullif(operating_system, '') AS operating_system,
       nullif(resolution_status, '') AS resolution_status,
       event_id % 7 + 1 AS dialog_request_counter,
       CAST(CASE WHEN event_id % 29 = 0 THEN 0 ELSE 1 END AS BIGINT) AS stack_size,
       CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS text_lines,
       timestamp
FROM flat""")
def decode_response(spark, sf_dir):
    """Bot-response JSON -> nested columns (optional fields NULL when absent)."""
    d = _decoded(spark, sf_dir).where(F.col(codec.ERROR).isNull())
    r = F.col("response")
    ctx = r["message"]["context"]
    return d.select(
        "event_id", r["bot_id"].alias("bot_id"), r["dialog_id"].alias("dialog_id"),
        ctx["conversation_id"].alias("conversation_id"), ctx["user_id"].alias("user_id"),
        ctx["browser"].alias("browser"), ctx["device"].alias("device"),
        ctx["operating_system"].alias("operating_system"),
        ctx["resolution_status"].alias("resolution_status"),
        ctx["system"]["dialog_request_counter"].cast("bigint").alias("dialog_request_counter"),
        F.size(ctx["system"]["dialog_stack"]).cast("bigint").alias("stack_size"),
        F.size(r["message"]["text"]).cast("bigint").alias("text_lines"),
        "timestamp")


@register("decode_request", f"""{FLAT_SQL}
SELECT event_id, bot_id, dialog_id, event_type AS message, nullif(user_id, '') AS user_id,
       CASE WHEN event_id % 3 = 0 THEN conversation_id END AS conversation_id, timestamp
FROM flat""")
def decode_request(spark, sf_dir):
    """Bot-request JSON -> nested columns."""
    d = codec.decode_request(X.request_payloads(_events(spark, sf_dir)))
    d = d.where(F.col(codec.ERROR).isNull())
    msg = F.col("message")
    return d.select("event_id", "bot_id", "dialog_id", msg["message"].alias("message"),
                    msg["userID"].alias("user_id"),
                    msg["context"]["conversation_id"].alias("conversation_id"), "timestamp")


CONV_SQL = """
WITH conv AS (
  SELECT *, 'u' || CAST(conv_id % 37 AS VARCHAR) AS uid,
         CAST(1704067200000 + conv_id * 3600000 + turn * 60000 AS BIGINT) AS ms,
         strftime(make_timestamp((1704067200000 + conv_id * 3600000 + turn * 60000) * 1000),
                  '%Y-%m-%dT%H:%M:%S') AS time
  FROM conversations
)"""


@register("decode_user_message", f"""{CONV_SQL}
SELECT conv_id, turn, uid AS user_id, 'First' || CAST(conv_id % 37 AS VARCHAR) AS first_name,
       ['en', 'fr', 'de'][turn % 3 + 1] AS locale,
       CAST(conv_id % 24 - 12 AS BIGINT) AS timezone,
       uid AS sender, text, 'turn' || CAST(turn AS VARCHAR) AS intent_name,
       round(0.5 + turn / 100, 6) AS intent_confidence, ms AS timestamp, time
FROM conv WHERE role = 'user'""")
def decode_user_message(spark, sf_dir):
    """User-message JSON -> user and utterance columns."""
    conv = X.load_table(spark, sf_dir, "conversations")
    d = codec.decode_user_message(X.user_message_payloads(conv))
    d = d.where(F.col(codec.ERROR).isNull())
    u, t = F.col("user"), F.col("utterance")
    return d.select("conv_id", "turn", u["id"].alias("user_id"),
                    u["firstName"].alias("first_name"), u["locale"].alias("locale"),
                    u["timezone"].cast("bigint").alias("timezone"),
                    t["sender"].alias("sender"), t["text"].alias("text"),
                    t["intent"]["name"].alias("intent_name"),
                    F.round(t["intent"]["confidence"], 6).alias("intent_confidence"),
                    t["timestamp"].alias("timestamp"), t["time"].alias("time"))


@register("decode_system_text", f"""{CONV_SQL}
SELECT conv_id, turn, uid AS recipient, text, 'node_' || CAST(turn AS VARCHAR) AS node,
       CASE WHEN role = 'system' THEN 'system' END AS node_type,
       CASE WHEN turn > 0 THEN 'node_' || CAST(turn - 1 AS VARCHAR) END AS parent,
       'main' AS flow, 'main>node_' || CAST(turn AS VARCHAR) AS path,
       ms AS timestamp, time
FROM conv WHERE role IN ('assistant', 'system')""")
def decode_system_text(spark, sf_dir):
    """System-text JSON -> columns."""
    conv = X.load_table(spark, sf_dir, "conversations")
    d = codec.decode_system_text(X.system_text_payloads(conv))
    d = d.where(F.col(codec.ERROR).isNull())
    return d.select("conv_id", "turn", "recipient", "text", "node",
                    F.col("nodeType").alias("node_type"), "parent", "flow",
                    F.array_join("path", ">").alias("path"), "timestamp", "time")


@register("either_text", """
SELECT event_id,
       CASE event_id % 3 WHEN 0 THEN event_type || '|out' WHEN 1 THEN event_type END AS output_text,
       CAST(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS BIGINT) AS output_lines
FROM events""")
def either_text(spark, sf_dir):
    """``output.text`` given as an array or as one string -> array of lines."""
    d = _decoded(spark, sf_dir)
    lines = json_text(F.col("response.message.output.text"))
    return d.select("event_id", F.array_join(lines, "|").alias("output_text"),
                    F.when(lines.isNotNull(), F.size(lines)).cast("bigint").alias("output_lines"))


@register("either_action_args", """
SELECT event_id,
       CASE event_id % 4 WHEN 2 THEN 'noop' WHEN 3 THEN NULL ELSE 'lookup' END AS action_name,
       CASE WHEN event_id % 4 = 0 THEN event_type || '|k' END AS variables,
       CASE WHEN event_id % 4 = 1 THEN 'event=' || event_type END AS named
FROM events""")
def either_action_args(spark, sf_dir):
    """Action args given as ``{"variables": [..]}`` or as a string map."""
    d = _decoded(spark, sf_dir)
    action = F.col("response.message.action")
    args = json_action_args(action["args"])
    named = F.array_join(F.transform(F.array_sort(F.map_entries(args["named"])),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("event_id", action["name"].alias("action_name"),
                    F.array_join(args["variables"], "|").alias("variables"), named.alias("named"))


@register("decode_quarantine", """
SELECT event_id,
       CASE event_id % 13 WHEN 2 THEN 'missing:response.message.context.conversation_id'
            WHEN 4 THEN 'missing:response.message.intents[]' ELSE 'malformed' END AS decode_error
FROM events WHERE event_id % 13 BETWEEN 1 AND 10""")
def decode_quarantine(spark, sf_dir):
    """Malformed and mistyped payloads and payloads missing required fields, with the reason."""
    d = codec.decode_response(X.mistyped_payloads(_events(spark, sf_dir)))
    _, bad = codec.split_valid(d)
    return bad.select("event_id", codec.ERROR)


@register("json_props", """
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events""")
def json_props(spark, sf_dir):
    """A free-form JSON object -> string map, exploded to (key, value)."""
    e = _events(spark, sf_dir)
    return e.select("event_id", F.explode(raw_json_map(F.col("props"))).alias("key", "value"))


@register("encode_json", f"""
WITH {EVENT_MESSAGES}
SELECT conversation_id, user_id <> '' AS has_user_id, nullif(browser, '') AS browser,
       CAST(timestamp AS VARCHAR) AS timestamp
FROM event_messages""")
def encode_json(spark, sf_dir):
    """Records -> JSON with absent optionals left out; fields read back from the text."""
    m = X.event_messages(spark, sf_dir)
    rec = m.select("conversation_id",
                   F.when(F.col("user_id") != "", F.col("user_id")).alias("user_id"),
                   F.when(F.col("browser") != "", F.col("browser")).alias("browser"),
                   "timestamp")
    js = codec.encode(rec)
    v = F.col("value")
    return js.select(F.get_json_object(v, "$.conversation_id").alias("conversation_id"),
                     F.instr(v, '"user_id"').__gt__(0).alias("has_user_id"),
                     F.get_json_object(v, "$.browser").alias("browser"),
                     F.get_json_object(v, "$.timestamp").alias("timestamp"))


@register("topic_fanout", """
SELECT 'wvaSystemMessages' AS topic, event_id FROM events
UNION ALL SELECT 'archive' AS topic, event_id FROM events""")
def topic_fanout(spark, sf_dir):
    """Each payload published once per topic in the list."""
    p = X.response_payloads(_events(spark, sf_dir))
    return TP.fan_out(p, [TP.BOT_RESPONSES, "archive"]).select("topic", "event_id")


@register("route_topic", """
SELECT 'wvaSystemMessages' AS topic, 'response' AS kind, event_id FROM events
UNION ALL SELECT 'wvaUserMessages' AS topic, 'request' AS kind, event_id FROM events""")
def route_topic(spark, sf_dir):
    """Requests and responses routed to their own topics by payload kind (one scan)."""
    e = _events(spark, sf_dir)
    kinds = F.array(
        F.struct(F.lit("response").alias("kind"), X.response_value().alias("value")),
        F.struct(F.lit("request").alias("kind"), X.request_value().alias("value")))
    rows = e.select("event_id", F.inline(kinds))
    return rows.select(TP.route(F.col("kind")).alias("topic"), "kind", "event_id")


@register("scan_messages", f"""
WITH {EVENT_MESSAGES}
SELECT {", ".join(MEASURE_COLUMNS)} FROM event_messages""")
def scan_messages(spark, sf_dir):
    """Messages appended to the store, read back with only the measure columns."""
    from parley.session import scratch_path
    path = scratch_path(spark, "store")
    append_messages(X.event_messages(spark, sf_dir), path, batch_id=0)
    return load_messages(spark, path, MEASURE_COLUMNS)


@register("flatten_messages", f"""{FLAT_SQL}
SELECT event_id, bot_id, dialog_id, conversation_id, dialog_node, location_type,
       user_location, user_id, lp_chat_id, browser, device, operating_system, channel,
       resolution_status, sentiment, text, timestamp
FROM flat""")
def flatten_messages(spark, sf_dir):
    """Decoded responses -> the flat message row (scalar columns)."""
    f = _flat(spark, sf_dir)
    return f.drop("intents", "entities")


@register("default_blank", f"""{FLAT_SQL}
SELECT field, count(*) FILTER (WHERE value = '') AS blanks FROM (
  UNPIVOT (SELECT {", ".join(OPTIONAL_CONTEXT.values())} FROM flat)
  ON {", ".join(OPTIONAL_CONTEXT.values())} INTO NAME field VALUE value)
GROUP BY field""")
def default_blank(spark, sf_dir):
    """How many rows each optional field defaulted to the blank string."""
    f = _flat(spark, sf_dir)
    cols = list(OPTIONAL_CONTEXT.values())
    long = f.select(*cols).unpivot([], cols, "field", "value")
    return long.groupBy("field").agg(F.count_if(F.col("value") == "").alias("blanks"))


@register("head_dialog_node", f"""{FLAT_SQL}
SELECT event_id, dialog_node FROM flat""")
def head_dialog_node(spark, sf_dir):
    """Head of the dialog stack ("" when empty; bare-string items accepted)."""
    return _flat(spark, sf_dir).select("event_id", "dialog_node")


@register("text_join", f"""{FLAT_SQL}
SELECT event_id, text FROM flat""")
def text_join(spark, sf_dir):
    """Text lines joined with one space."""
    return _flat(spark, sf_dir).select("event_id", "text")


@register("map_intents", f"""{FLAT_SQL}
SELECT event_id, CAST(1 AS BIGINT) AS position, event_type AS name, confidence
FROM flat WHERE event_id % 10 <> 0""")
def map_intents(spark, sf_dir):
    """Received intents reshaped to (name, confidence); absent lists are empty."""
    f = _flat(spark, sf_dir)
    return (f.select("event_id", F.posexplode("intents"))
             .select("event_id", (F.col("pos") + 1).cast("bigint").alias("position"),
                     F.col("col.name").alias("name"), F.col("col.confidence").alias("confidence")))


@register("map_entities", f"""{FLAT_SQL}
SELECT event_id, CAST(1 AS BIGINT) AS position, 'k' AS name,
       json_extract_string(props, '$.k') AS value
FROM flat WHERE event_id % 10 <> 5""")
def map_entities(spark, sf_dir):
    """Received entities reshaped to (name, value); locations dropped."""
    f = _flat(spark, sf_dir)
    return (f.select("event_id", F.posexplode("entities"))
             .select("event_id", (F.col("pos") + 1).cast("bigint").alias("position"),
                     F.col("col.name").alias("name"), F.col("col.value").alias("value")))


@register("layout_name", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'form' ELSE 'none' END AS layout_name
FROM events""")
def layout_name(spark, sf_dir):
    """The widget name of each response, "none" without a layout."""
    return response_layout(_decoded(spark, sf_dir), keep=["event_id"]).drop("timestamp")


@register("interactions_union", f"""{CONV_SQL}
SELECT 'acme' AS company_id,
       CASE WHEN role = 'user' THEN 'utterance' ELSE 'system_text' END AS kind,
       'text' AS messageType,
       CASE WHEN role = 'user' THEN uid END AS sender,
       CASE WHEN role <> 'user' THEN uid END AS recipient,
       text,
       CASE WHEN role <> 'user' THEN 'node_' || CAST(turn AS VARCHAR) END AS node,
       CASE WHEN role = 'system' THEN 'system' END AS nodeType,
       CASE WHEN role <> 'user' AND turn > 0 THEN 'node_' || CAST(turn - 1 AS VARCHAR) END AS parent,
       CASE WHEN role <> 'user' THEN 'main' END AS flow,
       CASE WHEN role = 'user' THEN 'turn' || CAST(turn AS VARCHAR) END AS intent_name,
       ms AS timestamp, time
FROM conv WHERE (conv_id + turn) % 11 NOT IN (3, 5, 6)""")
def interactions_union(spark, sf_dir):
    """Keyed, well-formed utterances and system texts in one company-scoped log (union by name)."""
    conv = X.load_table(spark, sf_dir, "conversations")
    um, _ = codec.split_valid(codec.decode_user_message(keyed(X.chat_payloads(conv, X.user_message_payloads))))
    st, _ = codec.split_valid(codec.decode_system_text(keyed(X.chat_payloads(conv, X.system_text_payloads))))
    log = interactions(um, st, "acme")
    return log.select("company_id", "kind", "messageType", "sender", "recipient", "text",
                      "node", "nodeType", "parent", "flow",
                      F.col("intent.name").alias("intent_name"), "timestamp", "time")


@register("visitors_latest", f"""{CONV_SQL}
SELECT uid AS user_id, uid AS id, 'First' || CAST(conv_id % 37 AS VARCHAR) AS firstName,
       'Last' || CAST(conv_id % 37 AS VARCHAR) AS lastName,
       'https://img.example/' || CAST(conv_id % 37 AS VARCHAR) AS picture,
       ['en', 'fr', 'de'][turn % 3 + 1] AS locale,
       CAST(conv_id % 24 - 12 AS INTEGER) AS timezone,
       CASE WHEN conv_id % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
       ms AS last_seen_ms
FROM conv WHERE role = 'user'
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ms DESC) = 1""")
def visitors_latest(spark, sf_dir):
    """Per user id, the user record from that user's newest message (last write wins)."""
    conv = X.load_table(spark, sf_dir, "conversations")
    um = codec.decode_user_message(X.user_message_payloads(conv))
    return latest_visitors(codec.split_valid(um)[0])
