"""Decoding edge cases: required fields, either-typed fields, dialog stacks."""

import json

from pyspark.sql import functions as F

from parley.functions.json import json_action_args, json_text
from parley.operators.flatten import flatten
from parley.sources import codec


def payload(**over):
    ctx = {"conversation_id": "c1",
           "system": {"dialog_request_counter": 1, "dialog_turn_counter": 1,
                      "dialog_stack": [{"dialog_node": "n1"}]}}
    msg = {"context": ctx, "text": ["Hello"]}
    msg.update(over.pop("message", {}))
    body = {"response": {"bot_id": "b1", "dialog_id": "d1", "message": msg},
            "timestamp": 1704067207179}
    body.update(over)
    return json.dumps(body)


def decode(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return codec.decode_response(df)


def test_minimal_payload_flattens_with_blanks(spark):
    rows = flatten(decode(spark, [payload()])).collect()
    r = rows[0]
    assert r["conversation_id"] == "c1" and r["dialog_node"] == "n1"
    assert r["user_id"] == "" and r["browser"] == "" and r["text"] == "Hello"
    assert r["intents"] == [] and r["entities"] == []


def test_text_lines_joined_and_intents_reshaped(spark):
    p = payload(message={"text": ["a", "b"],
                         "intents": [{"confidence": 0.9, "intent": "greet"}],
                         "entities": [{"entity": "e", "location": ["1"], "value": "v"}]})
    r = flatten(decode(spark, [p])).collect()[0]
    assert r["text"] == "a b"
    assert [tuple(i) for i in r["intents"]] == [("greet", 0.9)]
    assert [tuple(e) for e in r["entities"]] == [("e", "v")]


def test_empty_dialog_stack_is_blank_not_failure(spark):
    # D16
    p = json.loads(payload())
    p["response"]["message"]["context"]["system"]["dialog_stack"] = []
    d = decode(spark, [json.dumps(p)])
    assert d.collect()[0][codec.ERROR] is None
    assert flatten(d).collect()[0]["dialog_node"] == ""


def test_dialog_stack_items_may_be_strings(spark):
    p = json.loads(payload())
    p["response"]["message"]["context"]["system"]["dialog_stack"] = ["n7", {"dialog_node": "x"}]
    assert flatten(decode(spark, [json.dumps(p)])).collect()[0]["dialog_node"] == "n7"


def test_malformed_and_missing_fields_are_quarantined(spark):
    p_missing = json.loads(payload())
    del p_missing["response"]["message"]["context"]["conversation_id"]
    p_intent = payload(message={"intents": [{"intent": "x"}]})
    bare = json.loads(payload())["response"]   # D17/D20: a bare response is not a payload
    d = decode(spark, ["{not json", json.dumps(p_missing), p_intent, json.dumps(bare),
                       payload(timestamp="soon"), payload()])
    good, bad = codec.split_valid(d)
    errors = sorted(r[codec.ERROR] for r in bad.collect())
    assert errors == ["malformed", "malformed",
                      "missing:response",
                      "missing:response.message.context.conversation_id",
                      "missing:response.message.intents[]"]
    assert good.count() == 1


def test_unknown_fields_are_ignored(spark):
    p = json.loads(payload())
    p["response"]["message"]["surprise"] = {"deep": [1, 2]}
    p["response"]["message"]["data"] = [{"obj": {"nested": True}}]
    d = decode(spark, [json.dumps(p)])
    r = d.collect()[0]
    assert r[codec.ERROR] is None
    assert r["response"]["message"]["data"][0]["obj"] == '{"nested":true}'


def test_array_or_string_text(spark):
    vals = [payload(message={"output": {"text": ["x", "y"]}}),
            payload(message={"output": {"text": "plain"}}),
            payload(message={"output": {}}),
            payload(message={"output": {"text": 5}})]
    d = decode(spark, vals)
    got = [r["t"] for r in d.select(json_text(F.col("response.message.output.text")).alias("t"))
           .collect()]
    assert got == [["x", "y"], ["plain"], None, None]


def test_action_args_either_shape(spark):
    vals = [payload(message={"action": {"name": "a", "args": {"variables": ["v1", "v2"]}}}),
            payload(message={"action": {"name": "a", "args": {"k": "v"}}}),
            payload(message={"action": {"name": "a"}})]
    d = decode(spark, vals)
    got = d.select(json_action_args(F.col("response.message.action.args")).alias("a")).collect()
    assert got[0]["a"]["variables"] == ["v1", "v2"] and got[0]["a"]["named"] is None
    assert got[1]["a"]["variables"] is None and got[1]["a"]["named"] == {"k": "v"}
    assert got[2]["a"] is None


def test_encode_omits_absent_optionals(spark):
    df = spark.createDataFrame([("c1", None, 5)], "conversation_id string, user_id string, ts bigint")
    assert codec.encode(df).collect()[0]["value"] == '{"conversation_id":"c1","ts":5}'


GOOD = {"response": {"bot_id": "b1", "dialog_id": "d1", "message": {
    "context": {"conversation_id": "c1", "system": {"dialog_request_counter": 1, "dialog_turn_counter": 1,
                                                    "dialog_stack": [{"dialog_node": "n1"}, "older"]}},
    "text": ["Hello"], "output": {"text": "Hello"}}}, "timestamp": 1704067207179}


def _with(path, value):
    """GOOD with one value replaced (``None`` at the end of the path deletes)."""
    import copy
    out = copy.deepcopy(GOOD)
    at = out
    *parents, last = path.split(".")
    for part in parents:
        at = at.setdefault(part, {})
    at[last] = value
    return out


M = "response.message."
REFUSED = [
    (_with(M + "layout", {"index": "0"}), "missing:response.message.layout.name"),
    (_with(M + "action", {"args": {"a": "b"}}), "missing:response.message.action.name"),
    (_with(M + "context.request", {}), "missing:response.message.context.request.name"),
    (_with(M + "context.system.dialog_stack", [{"other": 1}]), "missing:response.message.context.system.dialog_stack[].dialog_node"),
    (_with(M + "output.store", [{"name": "f"}]), "missing:response.message.output.store[]"),
    (_with(M + "output.store", [{"name": "f", "label": "l", "validations": [{"regex": "x"}]}]),
     "missing:response.message.output.store[].validations[]"),
    (_with(M + "log_data", {"intents": [{"intent": "x"}]}), "missing:response.message.log_data.intents[]"),
    (_with(M + "output.log_data", {"wva_top_intent": {"intent": "x"}}), "missing:response.message.output.log_data.wva_top_intent.confidence"),
    (_with(M + "text", [None]), "missing:response.message.text[]"),
    (_with(M + "output.text", 5), "malformed"),
    (_with(M + "context.conversation_id", {"a": 1}), "malformed"),
    (_with("response.bot_id", 5), "malformed"),
    (_with("timestamp", "1704067207179x"), "malformed"),
]


def test_nested_and_typed_fields_are_required(spark):
    import json
    from parley.sources import codec
    text = json.dumps(GOOD)
    cases = [(json.dumps(r), e) for r, e in REFUSED]
    cases += [(text + " xyz", "malformed"), (text + text, "malformed"), (text + "," + text, "malformed"), (text + "] x", "malformed"),
              ("", "malformed"), ("[]", "malformed"), ("5", "malformed"), (None, "malformed")]
    cases += [(x, None) for x in (text, f"  {text} \n", json.dumps(_with(M + "output.text", ["a", "b"])), json.dumps(_with(M + "layout", None)),
                                  json.dumps(_with(M + "data", [{"k": {"deep": [1, 2]}}])), json.dumps(_with("response.extra", 1)))]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, value string")
    got = {r.i: r.decode_error for r in codec.decode_response(df).select("i", codec.ERROR).collect()}
    assert [(v, got[i]) for i, (v, _) in enumerate(cases)] == cases
    good = {"bot_id": "b", "dialog_id": "d", "message": {"message": "hi"}, "timestamp": 1}
    requests = [(good, None), (good | {"message": {"context": {}}}, "missing:message.context.conversation_id"),
                (good | {"dialog_id": ["d"]}, "malformed")]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(requests)], "i int, value string")
    got = {r.i: r.decode_error for r in codec.decode_request(df).select("i", codec.ERROR).collect()}
    assert [got[i] for i in range(len(requests))] == [e for _, e in requests]


def test_every_declared_string_is_strict(spark):
    item = {"entity": "e", "location": ["1"], "value": "v"}
    mistyped = [
        _with(M + "text", ["a", 5]), _with(M + "intents", [{"confidence": 1.0, "intent": 5}]), _with(M + "entities", [item | {"value": 7}]),
        _with(M + "entities", [item | {"location": [1, 2]}]), _with(M + "layout", {"name": 5}), _with(M + "context.browser", 5),
        _with(M + "output.log_messages", [True]), _with(M + "output.node_position", {}), _with(M + "context.system._node_output_map", {"n": [1]}),
        _with(M + "output.store", [{"name": "f", "label": "l", "validations": [{"regex": "x", "message": 1}]}]),
        _with(M + "output.inputvalidation", {"oneOf": [1]}), _with(M + "log_data", {"workspace_id": 3}), _with(M + "layout", 5),
        _with(M + "layout", {"name": "n", "disable_input": "yes"}), _with(M + "text", "Hello"),
    ]
    fine = [_with(M + "context.browser", None), _with(M + "context.system._node_output_map", {"n": ["x"], "m": []}),
            _with(M + "data", [{"free": 5}]), _with(M + "output.log_messages", ["x"])]
    text = json.dumps(GOOD)
    broken = [text.replace('"', "'"), text + "]", text + "} {" + text, text + '],"end":true} {"record":[' + text, text[:-1], text[:-1] + ",}"]
    values = [json.dumps(r) for r in mistyped] + broken + [json.dumps(r) for r in fine]
    df = spark.createDataFrame(list(enumerate(values)), "i int, value string")
    got = {r.i: r.decode_error for r in codec.decode_response(df).select("i", codec.ERROR).collect()}
    assert [got[i] for i in range(len(values))] == ["malformed"] * (len(mistyped) + len(broken)) + [None] * len(fine)
    node_map = codec.decode_response(df).where(f"i = {len(mistyped) + len(broken) + 1}").select("response.message.context.system._node_output_map").first()[0]
    assert node_map == {"n": ["x"], "m": []}


def test_one_parse_per_record(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    good, _ = codec.split_valid(codec.decode_response(df))
    plan = flatten(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json(") == 1 and "parse_json" not in plan


def test_free_form_is_what_the_schema_says():
    from pyspark.sql.types import _parse_datatype_string
    from parley import schemas as S
    assert codec._FREE_FORM == _parse_datatype_string(S.FREE_FORM)
