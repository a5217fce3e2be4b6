"""Registered queries: deterministic weighted draws and declared-rule validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import sampling as R
from parley.operators import validation as V
from parley.operators.carried_rules import broken_rules, carried_rules, rules_in_force
from parley.plans.catalog import register
from parley.sources import codec
from parley.sources import fixtures as X
from parley.sources.fixtures import load_table

DRAWS = [("browser", 0, R.BROWSER_WEIGHTS), ("device", 1, R.DEVICE_WEIGHTS),
         ("operating_system", 2, R.OS_WEIGHTS), ("resolution_status", 3, R.RESOLUTION_WEIGHTS)]
STATUS_STREAM = 3
PRESENCE_STREAM = 4


# The numbers below are written out, so that the SQL does not share the code's constants.
_U = "(CAST((CAST(event_id AS HUGEINT) * {}) % 4294967296 AS DOUBLE) / 4294967296.0)"
_U0, _U1, _U2, _U3, _U4 = (_U.format(n) for n in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
_STATUS_SQL = (f"CASE WHEN {_U3} < 0.5 THEN 'resolved' WHEN {_U3} < 0.75 THEN 'unresolved' "
               f"WHEN {_U3} < 0.92 THEN 'abandoned' ELSE 'escalated' END")


@register("weighted_category", f"""
SELECT field, category, count(*) AS rows FROM (
  SELECT 'browser' AS field, CASE WHEN {_U0} < 0.25 THEN 'chrome' WHEN {_U0} < 0.5 THEN 'firefox'
                                  WHEN {_U0} < 0.75 THEN 'ie' ELSE 'opera' END AS category FROM events
  UNION ALL SELECT 'device', CASE WHEN {_U1} < 0.5 THEN 'apple' ELSE 'android' END FROM events
  UNION ALL SELECT 'operating_system', CASE WHEN {_U2} < 0.33 THEN 'linux' WHEN {_U2} < 0.67 THEN 'windows'
                                            ELSE 'macos' END FROM events
  UNION ALL SELECT 'resolution_status', {_STATUS_SQL} FROM events) GROUP BY ALL""")
def weighted_category(spark, sf_dir):
    """Each event draws browser, device, OS and status by the generator's weights; counts."""
    e = load_table(spark, sf_dir, "events")
    draws = F.array(*[F.struct(F.lit(field).alias("field"),
                               R.weighted_category(R.uniform(F.col("event_id"), s), w)
                               .alias("category"))
                      for field, s, w in DRAWS])
    return (e.select(F.inline(draws)).groupBy("field", "category")
             .agg(F.count(F.lit(1)).alias("rows")))


@register("probability_filter", f"""
SELECT CASE WHEN {_U4} > 0.75 THEN {_STATUS_SQL} ELSE '' END AS resolution_status, count(*) AS rows
FROM events GROUP BY ALL""")
def probability_filter(spark, sf_dir):
    """A status is present on about a quarter of rows, drawn by weight; counts per status."""
    e = load_table(spark, sf_dir, "events")
    present = R.keep_with_probability(R.uniform(F.col("event_id"), PRESENCE_STREAM))
    status = R.weighted_category(R.uniform(F.col("event_id"), STATUS_STREAM),
                                 R.RESOLUTION_WEIGHTS)
    return (e.select(F.when(present, status).otherwise(F.lit("")).alias("resolution_status"))
             .groupBy("resolution_status").agg(F.count(F.lit(1)).alias("rows")))


EVENT_TYPES = ("click", "view", "purchase", "signup")
LABELS = ("click", "view", "purchase", "signup", "error", "low")
PROPS_PATTERN = r'\{"k": [0-9]+\}'
RULES = [
    V.one_of("event_type", EVENT_TYPES, "unknown event type"),
    V.in_range("value", 0.0, 100.0, "value out of range"),
    V.matches("props", "^" + PROPS_PATTERN + "$", "props must look like {\"k\": n}"),
    V.required("user_id", "user id is required"),
    V.some_of("labels", LABELS, "unexpected label"),
]


@register("validate_rows", f"""
SELECT event_id, 'event_type_one_of' AS rule, 'event_type' AS field, 'unknown event type' AS message
FROM events WHERE event_type NOT IN {EVENT_TYPES!r}
UNION ALL
SELECT event_id, 'value_range', 'value', 'value out of range' FROM events
WHERE NOT (value BETWEEN 0.0 AND 100.0)
UNION ALL
SELECT event_id, 'props_regex', 'props', 'props must look like {{"k": n}}' FROM events
WHERE NOT regexp_full_match(props, '{PROPS_PATTERN}')
UNION ALL
SELECT event_id, 'user_id_required', 'user_id', 'user id is required' FROM events
WHERE user_id IS NULL
UNION ALL
SELECT event_id, 'labels_some_of', 'labels', 'unexpected label' FROM events
WHERE event_type NOT IN {LABELS!r} OR value > 50""")
def validate_rows(spark, sf_dir):
    """Events checked against declared rules -> one row per violation."""
    e = load_table(spark, sf_dir, "events").withColumn(
        "labels", F.array("event_type", F.when(F.col("value") > 50, "high").otherwise("low")))
    return V.violations(e, RULES, ["event_id"])


_CONVERSATION = "'c' || CAST(user_id % 64 AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR)"


@register("message_rule_violations", f"""
WITH said AS (
  SELECT {_CONVERSATION} AS conversation, epoch_us(ts) // 1000 AS ts, max(event_id) AS rule_id FROM events GROUP BY 1, 2),
asked AS (
  SELECT event_id, {_CONVERSATION} AS conversation, epoch_us(ts) // 1000 AS ts, event_type AS value, json_extract_string(props, '$.k') AS k
  FROM events WHERE event_id % 3 = 0),
held AS (SELECT a.event_id, a.value, a.k, s.rule_id FROM asked a ASOF JOIN said s ON a.conversation = s.conversation AND a.ts > s.ts)
SELECT event_id, 'message' AS place, CAST(NULL AS VARCHAR) AS field, 'one_of' AS kind, CAST(NULL AS VARCHAR) AS message
FROM held WHERE rule_id % 8 = 1 AND value NOT IN ('click', 'view', 'error')
UNION ALL
SELECT event_id, 'message', NULL, 'range', NULL FROM held
WHERE rule_id % 8 = 5 AND NOT coalesce(TRY_CAST(value AS DOUBLE) BETWEEN 1 AND 10, false)
UNION ALL
SELECT event_id, 'output', NULL, 'some_of', NULL FROM held WHERE rule_id % 6 = 0 AND value NOT IN ('purchase', 'view', 'signup')
UNION ALL
SELECT event_id, 'form', 'k', 'required', 'K' FROM held WHERE rule_id % 6 = 3 AND coalesce(trim(k), '') = ''
UNION ALL
SELECT event_id, 'form', 'k', 'unreadable', 'no pattern' FROM held WHERE rule_id % 18 = 3
UNION ALL
SELECT event_id, 'form', 'k', 'regex', 'starts too high' FROM held
WHERE rule_id % 6 = 3 AND rule_id % 18 <> 3 AND trim(k) <> '' AND NOT regexp_matches(k, '^[0-4]')
UNION ALL
SELECT event_id, 'form', 'note', 'required', 'Note' FROM held WHERE rule_id % 12 = 3""")
def message_rule_violations(spark, sf_dir):
    """User inputs against the rules that the newest earlier response of their conversation carries."""
    events = load_table(spark, sf_dir, "events")
    good, _ = codec.split_valid(codec.decode_response(X.ruled_payloads(events)))
    message = F.col("response.message")
    responses = good.select("event_id", "timestamp", message["context"]["conversation_id"].alias("conversation_id"),
                            carried_rules(message).alias("rules"))
    # the form's fields are not sent back with a request: they come from the event's props
    form = F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("fields")
    asked, _ = codec.split_valid(codec.decode_request(X.request_payloads(events.where("event_id % 3 = 0"))))
    inputs = asked.select("event_id", "timestamp", F.col("message.context.conversation_id").alias("conversation_id"), F.col("message.message").alias("text"))
    inputs = inputs.join(events.select("event_id", form), "event_id")
    held = rules_in_force(responses, inputs, order="event_id")
    return broken_rules(held, ["event_id"], value=F.col("text"), fields=F.col("fields"), rules=F.col("rules"))


@register("decode_parts", """
SELECT event_id,
       CASE WHEN event_id % 7 = 0 THEN 'w1' END AS workspace, CASE WHEN event_id % 7 = 0 THEN event_type END AS top_intent,
       CASE WHEN event_id % 7 = 0 THEN event_type || '@0' END AS log_entity, CASE WHEN event_id % 7 = 0 THEN event_type END AS log_intent,
       CASE WHEN event_id % 7 = 0 THEN 'node_start>node_' || event_type END AS visited,
       CASE WHEN event_id % 8 = 1 THEN 'click,view,error' END AS one_of, CASE WHEN event_id % 8 = 5 THEN CAST(10 AS DOUBLE) END AS highest,
       CASE WHEN event_id % 6 = 0 THEN 'purchase,view,signup' END AS some_of,
       CASE WHEN event_id % 18 = 3 THEN 'k:([0-4' WHEN event_id % 6 = 3 THEN 'k:^[0-4]' END AS pattern,
       CASE WHEN event_id % 6 = 3 THEN event_id % 12 = 3 END AS note_required,
       'node_' || event_type || '=' || event_type || ',0' AS node_output
FROM events""")
def decode_parts(spark, sf_dir):
    """The nested parts of a response: log data, visited nodes, input rules, form fields, node output."""
    good, _ = codec.split_valid(codec.decode_response(X.ruled_payloads(load_table(spark, sf_dir, "events"))))
    m = F.col("response.message")
    log, out, nodes = m["log_data"], m["output"], m["context"]["system"]["_node_output_map"]
    first = F.get(log["entities"], F.lit(0))
    field = lambda i: F.get(out["store"], F.lit(i))
    return good.select(
        "event_id", log["workspace_id"].alias("workspace"), log["wva_top_intent"]["intent"].alias("top_intent"),
        F.concat(first["value"], F.lit("@"), F.get(first["location"], F.lit(0))).alias("log_entity"),
        F.get(log["intents"], F.lit(0))["intent"].alias("log_intent"), F.array_join(m["nodes_visited"], ">").alias("visited"),
        F.array_join(m["inputvalidation"]["oneOf"], ",").alias("one_of"),
        F.array_max(m["inputvalidation"]["range"]).cast("double").alias("highest"),
        F.array_join(out["inputvalidation"]["someOf"], ",").alias("some_of"),
        F.concat(field(0)["name"], F.lit(":"), F.get(field(0)["validations"], F.lit(0))["regex"]).alias("pattern"),
        field(1)["required"].alias("note_required"),
        F.concat(F.get(F.map_keys(nodes), F.lit(0)), F.lit("="), F.array_join(F.get(F.map_values(nodes), F.lit(0)), ",")).alias("node_output"))
