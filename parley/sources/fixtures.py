"""Adapters that derive message tables and payloads from the driver's tables.

The driver's parquet tables carry no chat messages, so these deterministic
mappings turn ``events``, ``orders`` and ``conversations`` rows into the
pipeline's record shapes.  Each mapping is a plain projection, so its cost
grows with the input and it runs fully distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.calendar import ntz_to_epoch_ms

# Fixed values of the adapters (see FIXTURES.md section 4); "" is a blank
# dimension, safari / tablet / bsd are deliberately unknown values.
BROWSER_CYCLE = ("chrome", "firefox", "ie", "opera", "", "safari")
DEVICE_CYCLE = ("apple", "android", "", "tablet")
OS_CYCLE = ("linux", "windows", "macos", "", "bsd")
EVENT_RESOLUTION = {"purchase": "resolved", "error": "escalated",
                    "signup": "unresolved", "view": "abandoned", "click": ""}
# conversations get synthetic arrival times: one hour per conversation id,
# one minute per turn, from 2024-01-01T00:00:00Z
CONVERSATION_EPOCH_MS = 1704067200000


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    """``values[key % len(values)]`` as a CASE expression."""
    idx = F.pmod(key, F.lit(len(values)))
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(idx == F.lit(i), F.lit(values[i])).otherwise(out)
    return out


def _event_resolution(event_type: Column) -> Column:
    out = F.lit("")
    for k, v in EVENT_RESOLUTION.items():
        out = F.when(event_type == F.lit(k), F.lit(v)).otherwise(out)
    return out


def event_columns() -> dict[str, Column]:
    """Message fields as expressions over an ``events`` row."""
    uid, eid = F.col("user_id"), F.col("event_id")
    return {
        "bot_id": F.concat(F.lit("bot-"), F.pmod(uid, F.lit(4)).cast("string")),
        "dialog_id": F.concat(F.lit("dlg-"), F.pmod(uid, F.lit(16)).cast("string")),
        "conversation_id": F.concat(F.lit("c"), F.pmod(uid, F.lit(64)).cast("string"),
                                    F.lit("-"), F.dayofmonth("ts").cast("string")),
        "dialog_node": F.concat(F.lit("node_"), F.col("event_type")),
        "location_type": F.lit(""),
        "user_location": F.lit(""),
        "user_id": F.when(F.pmod(eid, F.lit(23)) == 0, F.lit("")).otherwise(uid.cast("string")),
        "lp_chat_id": F.lit(""),
        "browser": _pick(eid, BROWSER_CYCLE),
        "device": _pick(eid, DEVICE_CYCLE),
        "operating_system": _pick(eid, OS_CYCLE),
        "channel": F.lit("web"),
        "resolution_status": _event_resolution(F.col("event_type")),
        "sentiment": F.lit(""),
        "text": F.col("event_type"),
        "intents": F.array(F.struct(F.col("event_type").alias("name"),
                                    F.col("value").alias("confidence"))),
        "entities": F.array(F.struct(F.lit("k").alias("name"),
                                     F.get_json_object("props", "$.k").alias("value"))),
        "timestamp": ntz_to_epoch_ms(F.col("ts")),
    }


def messages_from_events(events: DataFrame) -> DataFrame:
    """``events`` -> flat message rows (one bot response per event)."""
    return events.select(*[e.alias(n) for n, e in event_columns().items()])


def _order_resolution() -> Column:
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (F.when(status == "F", "resolved")
            .when(status == "O", "unresolved")
            .when((status == "P") & (prio == "1-URGENT"), "escalated")
            .when((status == "P") & (prio == "5-LOW"), "")
            .when(status == "P", "abandoned")
            .otherwise(""))


def messages_from_orders(orders: DataFrame) -> DataFrame:
    """``orders`` -> flat message rows spanning years (for month/qtr/year series)."""
    cust, key, date = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    return orders.select(
        F.lit("bot-orders").alias("bot_id"),
        F.concat(F.lit("dlg-"), F.col("o_orderpriority")).alias("dialog_id"),
        F.concat(F.lit("o"), F.pmod(cust, F.lit(97)).cast("string"), F.lit("-"),
                 F.year(date).cast("string"), F.lit("-"),
                 F.month(date).cast("string")).alias("conversation_id"),
        F.concat(F.lit("node_"), F.col("o_orderstatus")).alias("dialog_node"),
        F.lit("").alias("location_type"),
        F.lit("").alias("user_location"),
        cust.cast("string").alias("user_id"),
        F.lit("").alias("lp_chat_id"),
        _pick(key, BROWSER_CYCLE).alias("browser"),
        _pick(key, DEVICE_CYCLE).alias("device"),
        _pick(key, OS_CYCLE).alias("operating_system"),
        F.lit("orders").alias("channel"),
        _order_resolution().alias("resolution_status"),
        F.lit("").alias("sentiment"),
        F.col("o_orderpriority").alias("text"),
        F.array().cast("array<struct<name: string, confidence: double>>").alias("intents"),
        F.array().cast("array<struct<name: string, value: string>>").alias("entities"),
        ntz_to_epoch_ms(date).alias("timestamp"),
    )


def load_table(spark, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables.

    ``spark.parley.inputPartitions``, if a caller sets it, deals the rows over
    that many partitions (the benchmark does, as its files are one row group
    each); otherwise the scan's own splits stay, whatever their number.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get("spark.parley.inputPartitions", None)
    return df.repartition(int(partitions)) if partitions else df


def event_messages(spark, sf_dir: str) -> DataFrame:
    return messages_from_events(load_table(spark, sf_dir, "events"))


def order_messages(spark, sf_dir: str) -> DataFrame:
    return messages_from_orders(load_table(spark, sf_dir, "orders"))


# --- payload builders (JSON records derived from the driver's tables) -------

def _variant_string(s: Column) -> Column:
    """A string value as a variant."""
    return s.cast("variant")


def _opt(value: Column) -> Column:
    """Blank -> NULL, so the field is left out of the JSON."""
    return F.when(value != F.lit(""), value)


def response_columns() -> dict[str, Column]:
    """``key``, ``response`` and ``timestamp`` of a bot-response record, over an ``events`` row.

    Variations keyed on ``event_id`` exercise every decode path: no key on
    every 17th; text of one or two lines; ``output.text`` as array, string or
    absent; action args as ``{"variables": [..]}``, as a string map, or
    absent; an empty dialog stack (every 29th) and bare-string stack items
    (every 31st); absent optional context fields; a layout on every 5th; no
    intents on every 10th, no entities on every 10th+5; a free-form ``data``.
    """
    c = event_columns()
    eid, et = F.col("event_id"), F.col("event_type")
    stack = (F.when(F.pmod(eid, F.lit(29)) == 0, F.array().cast("array<variant>"))
              .when(F.pmod(eid, F.lit(31)) == 0, F.array(_variant_string(c["dialog_node"])))
              .otherwise(F.array(F.to_variant_object(
                  F.struct(c["dialog_node"].alias("dialog_node"))))))
    context = F.struct(
        c["conversation_id"].alias("conversation_id"),
        F.struct((F.pmod(eid, F.lit(7)) + 1).cast("int").alias("dialog_request_counter"),
                 stack.alias("dialog_stack"),
                 F.lit(1).alias("dialog_turn_counter")).alias("system"),
        _opt(c["user_id"]).alias("user_id"),
        _opt(c["browser"]).alias("browser"),
        _opt(c["device"]).alias("device"),
        _opt(c["operating_system"]).alias("operating_system"),
        c["channel"].alias("channel"),
        _opt(c["resolution_status"]).alias("resolution_status"),
    )
    k3, k4 = F.pmod(eid, F.lit(3)), F.pmod(eid, F.lit(4))
    output_text = (F.when(k3 == 0, F.to_variant_object(F.array(et, F.lit("out"))))
                    .when(k3 == 1, _variant_string(et)))
    args = (F.when(k4 == 0, F.to_variant_object(
                F.struct(F.array(et, F.lit("k")).alias("variables"))))
             .when(k4 == 1, F.to_variant_object(F.create_map(F.lit("event"), et))))
    action = F.when(k4 != 3, F.struct(
        F.when(k4 == 2, F.lit("noop")).otherwise(F.lit("lookup")).alias("name"),
        args.alias("args")))
    message = F.struct(
        context.alias("context"),
        F.array(F.create_map(F.lit("props"), F.col("props"))).alias("data"),
        action.alias("action"),
        F.when(F.pmod(eid, F.lit(10)) != 5, F.array(F.struct(
            F.lit("k").alias("entity"), F.array(F.lit("0"), F.lit("1")).alias("location"),
            F.get_json_object("props", "$.k").alias("value")))).alias("entities"),
        F.when(F.pmod(eid, F.lit(10)) != 0, F.array(F.struct(
            F.col("value").alias("confidence"), et.alias("intent")))).alias("intents"),
        F.when(F.pmod(eid, F.lit(5)) == 0, F.struct(
            F.lit("form").alias("name"), F.lit("0").alias("index"))).alias("layout"),
        F.when(k3 != 2, F.struct(output_text.alias("text"))).alias("output"),
        F.when(F.pmod(eid, F.lit(2)) == 0, F.array(et, F.lit("again")))
         .otherwise(F.array(et)).alias("text"),
    )
    return {
        "key": F.when(F.pmod(eid, F.lit(17)) != 0, F.concat(F.lit("k"), eid.cast("string"))),
        "response": F.struct(c["bot_id"].alias("bot_id"), c["dialog_id"].alias("dialog_id"),
                             message.alias("message")),
        "timestamp": c["timestamp"],
    }


def response_records(events: DataFrame) -> DataFrame:
    """``events`` -> typed ``(event_id, key, response, timestamp)`` bot-response records."""
    return events.select("event_id", *[e.alias(n) for n, e in response_columns().items()])


def response_value() -> Column:
    """The JSON text ``{response, timestamp}`` of an ``events`` row's bot response."""
    c = response_columns()
    return F.to_json(F.struct(c["response"].alias("response"), c["timestamp"].alias("timestamp")))


def response_payloads(events: DataFrame) -> DataFrame:
    """``events`` -> ``(event_id, key, value)`` JSON bot-response payloads ``{response, timestamp}``."""
    return events.select("event_id", response_columns()["key"].alias("key"),
                         response_value().alias("value"))


def ruled_payloads(events: DataFrame) -> DataFrame:
    """Bot-response payloads with the parts that ``response_payloads`` leaves out.

    By ``event_id``: rules on the next input (on the message every 4th + 1, on the output every
    6th), a form (every 6th + 3; every 18th + 3 with a pattern that is none), log data and
    visited nodes on every 7th, and the texts of each node.
    """
    rec = events.select("event_id", "event_type", "value", *[e.alias(n) for n, e in response_columns().items()])
    eid, et = F.col("event_id"), F.col("event_type")
    at = lambda n, k: F.pmod(eid, F.lit(n)) == k
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    kinds = "struct<oneOf: array<string>, someOf: array<string>, range: array<decimal(38,18)>>"
    rules = lambda one, some, span: F.struct(one.alias("oneOf"), some.alias("someOf"), span.alias("range")).cast(kinds)
    none = F.lit(None)
    on_message = F.when(at(8, 1), rules(words("click", "view", "error"), none, none)).when(
        at(8, 5), rules(none, none, F.array(F.lit(1), F.lit(10))))
    on_output = F.when(at(6, 0), rules(none, words("purchase", "view", "signup"), none))
    check = lambda pattern, message: F.struct(F.lit(pattern).alias("regex"), F.lit(message).alias("message"))
    form = F.when(at(6, 3), F.array(
        F.struct(F.lit("k").alias("name"), F.lit("K").alias("label"), F.lit(True).alias("required"),
                 F.array(F.when(at(18, 3), check("([0-4", "no pattern")).otherwise(check("^[0-4]", "starts too high"))).alias("validations")),
        F.struct(F.lit("note").alias("name"), F.lit("Note").alias("label"), at(12, 3).alias("required"),
                 F.lit(None).cast("array<struct<regex: string, message: string>>").alias("validations"))))
    log = F.when(at(7, 0), F.struct(
        F.array(F.struct(F.lit("k").alias("entity"), words("0").alias("location"), et.alias("value"))).alias("entities"),
        F.array(F.struct(F.col("value").alias("confidence"), et.alias("intent"))).alias("intents"),
        F.lit("w1").alias("workspace_id"), F.struct(F.col("value").alias("confidence"), et.alias("intent")).alias("wva_top_intent")))
    visited = F.when(at(7, 0), F.array(F.lit("node_start"), F.concat(F.lit("node_"), et)))
    msg = F.col("response.message")
    system = msg["context"]["system"].withField("_node_output_map", F.create_map(F.concat(F.lit("node_"), et), F.array(et, F.lit("0"))))
    msg = (msg.withField("inputvalidation", on_message).withField("log_data", log).withField("nodes_visited", visited)
              .withField("context", msg["context"].withField("system", system))
              .withField("output", F.struct(on_output.alias("inputvalidation"), form.alias("store"))))
    response = F.col("response").withField("message", msg).alias("response")
    return rec.select("event_id", "key", F.to_json(F.struct(response, F.col("timestamp"))).alias("value"))


def damaged_payloads(events: DataFrame) -> DataFrame:
    """Bot-response payloads of which some are damaged, by ``event_id % 13``.

    1 -> text cut short (not JSON); 2 -> no ``conversation_id``;
    3 -> ``timestamp`` is a string; 4 -> an intent without ``confidence``;
    any other value -> intact.
    """
    rec = response_records(events)
    k = F.pmod(F.col("event_id"), F.lit(13))
    msg = F.col("response.message")
    ctx = msg["context"]
    msg = (msg.withField("context", ctx.withField(
                "conversation_id", F.when(k != 2, ctx["conversation_id"])))
              .withField("intents", F.when(k == 4, F.array(F.struct(
                  F.lit(None).cast("double").alias("confidence"),
                  F.lit("lost").alias("intent")))).otherwise(msg["intents"])))
    resp = F.col("response").withField("message", msg).alias("response")
    text = F.when(k == 3, F.to_json(F.struct(
                resp, F.concat(F.lit("t"), F.col("timestamp").cast("string")).alias("timestamp"))))
    text = text.otherwise(F.to_json(F.struct(resp, F.col("timestamp"))))
    out = rec.select("event_id", "key", k.alias("k"), text.alias("text"))
    t = F.col("text")
    value = F.when(F.col("k") == 1, F.left(t, F.length(t) - F.lit(7))).otherwise(t)
    return out.select("event_id", "key", value.alias("value"))


#: By ``event_id % 13``: replacements in the JSON text that put a number where the record format has a string.
MISTYPED = {
    5: [('"text":[', '"text":[5,')],
    6: [('"intents":[', '"was":['), ('"message":{', '"message":{"intents":[{"confidence":1.5,"intent":5}],')],
    7: [('"entities":[', '"was":['), ('"message":{', '"message":{"entities":[{"entity":"e","location":[],"value":7}],')],
    8: [('"entities":[', '"was":['), ('"message":{', '"message":{"entities":[{"entity":"e","location":[1,2],"value":"v"}],')],
    9: [('"layout":{', '"was":{'), ('"message":{', '"message":{"layout":{"name":5},')],
    10: [('"browser":"', '"was":"'), ('"context":{', '"context":{"browser":5,')],
}


def mistyped_payloads(events: DataFrame) -> DataFrame:
    """``damaged_payloads`` with more damage: 5 to 10 hold a number for a string (see ``MISTYPED``)."""
    value = F.col("value")
    cases = []
    for k, swaps in MISTYPED.items():
        text = value
        for old, new in swaps:
            text = F.replace(text, F.lit(old), F.lit(new))
        cases.append(F.when(F.pmod(F.col("event_id"), F.lit(13)) == k, text))
    return damaged_payloads(events).withColumn("value", F.coalesce(*cases, value))


def _conversation_time() -> tuple[Column, Column]:
    ms = (F.lit(CONVERSATION_EPOCH_MS) + F.col("conv_id") * F.lit(3600000)
          + F.col("turn") * F.lit(60000)).cast("bigint")
    time = F.date_format(F.timestamp_add("MILLISECOND", ms,
                                         F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
                         "yyyy-MM-dd'T'HH:mm:ss")
    return ms, time


def conversation_user_id() -> Column:
    return F.concat(F.lit("u"), F.pmod(F.col("conv_id"), F.lit(37)).cast("string"))


def user_message_records(conversations: DataFrame) -> DataFrame:
    """``conversations`` rows with role ``user`` -> typed ``(conv_id, turn, user, utterance)``."""
    ms, time = _conversation_time()
    uid = conversation_user_id()
    k = F.pmod(F.col("conv_id"), F.lit(37)).cast("string")
    locale = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")),
                          (F.pmod(F.col("turn"), F.lit(3)) + 1).cast("int"))
    user = F.struct(uid.alias("id"), F.concat(F.lit("First"), k).alias("firstName"),
                    F.concat(F.lit("Last"), k).alias("lastName"),
                    F.concat(F.lit("https://img.example/"), k).alias("picture"),
                    locale.alias("locale"),
                    (F.pmod(F.col("conv_id"), F.lit(24)) - 12).cast("int").alias("timezone"),
                    F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, "f").otherwise("m")
                     .alias("gender"))
    utterance = F.struct(
        F.lit("text").alias("messageType"), uid.alias("sender"), F.col("text").alias("text"),
        F.struct(F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("name"),
                 (F.lit(0.5) + F.col("turn") / F.lit(100)).alias("confidence")).alias("intent"),
        F.array(F.struct(F.lit("role").alias("name"), F.col("role").alias("value")))
         .alias("entities"),
        ms.alias("timestamp"), time.alias("time"))
    return (conversations.where(F.col("role") == "user")
            .select("conv_id", "turn", user.alias("user"), utterance.alias("utterance")))


def system_text_records(conversations: DataFrame) -> DataFrame:
    """``conversations`` rows with role ``assistant``/``system`` -> system text messages."""
    ms, time = _conversation_time()
    node = F.concat(F.lit("node_"), F.col("turn").cast("string"))
    return (conversations.where(F.col("role").isin("assistant", "system"))
            .select("conv_id", "turn",
                    F.lit("text").alias("messageType"),
                    conversation_user_id().alias("recipient"),
                    F.col("text"), node.alias("node"),
                    F.when(F.col("role") == "system", F.lit("system")).alias("nodeType"),
                    F.when(F.col("turn") > 0, F.concat(F.lit("node_"),
                           (F.col("turn") - 1).cast("string"))).alias("parent"),
                    F.lit("main").alias("flow"),
                    F.array(F.lit("main"), node).alias("path"),
                    ms.alias("timestamp"), time.alias("time")))


def user_message_payloads(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, key, value)`` JSON user messages."""
    rec = user_message_records(conversations)
    return rec.select("conv_id", "turn",
                      F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"),
                               F.col("turn").cast("string")).alias("key"),
                      F.to_json(F.struct("user", "utterance")).alias("value"))


def system_text_payloads(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, key, value)`` JSON system text messages."""
    rec = system_text_records(conversations)
    fields = [c for c in rec.columns if c not in ("conv_id", "turn")]
    return rec.select("conv_id", "turn",
                      F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("-"),
                               F.col("turn").cast("string")).alias("key"),
                      F.to_json(F.struct(*fields)).alias("value"))


def chat_payloads(conversations: DataFrame, make) -> DataFrame:
    """Payloads of ``make`` with null keys and damaged records, by class of ``conv_id + turn``.

    Of 11: class 3 has no key, class 5 is cut off, class 6 is an empty object.
    """
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11))
    return make(conversations).select(
        "conv_id", "turn", F.when(k != 3, F.col("key")).alias("key"),
        F.when(k == 5, F.lit("{bad")).when(k == 6, F.lit("{}")).otherwise(F.col("value")).alias("value"))


def request_value() -> Column:
    """The JSON text of an ``events`` row's bot request.

    ``message.userID`` is left out for anonymous rows; ``message.context`` is
    sent on every 3rd event.
    """
    c = event_columns()
    eid = F.col("event_id")
    context = F.when(F.pmod(eid, F.lit(3)) == 0, F.struct(
        c["conversation_id"].alias("conversation_id"),
        F.struct(F.lit(1).alias("dialog_request_counter"),
                 F.array().cast("array<variant>").alias("dialog_stack"),
                 F.lit(1).alias("dialog_turn_counter")).alias("system")))
    message = F.struct(F.col("event_type").alias("message"),
                       _opt(c["user_id"]).alias("userID"), context.alias("context"))
    body = F.struct(c["bot_id"].alias("bot_id"), c["dialog_id"].alias("dialog_id"),
                    message.alias("message"), c["timestamp"].alias("timestamp"))
    return F.to_json(body)


def request_payloads(events: DataFrame) -> DataFrame:
    """``events`` -> ``(event_id, key, value)`` JSON bot-request payloads."""
    eid = F.col("event_id")
    return events.select(eid.alias("event_id"),
                         F.concat(F.lit("q"), eid.cast("string")).alias("key"),
                         request_value().alias("value"))
