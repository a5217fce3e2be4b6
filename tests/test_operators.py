"""Interactions, visitors, sampling, validation, topics."""

from pyspark.sql import functions as F

from parley.operators import sampling as R
from parley.operators import validation as V
from parley.operators.interactions import interactions, latest_visitors
from parley.sources import topics as TP


def _user_msgs(spark, rows):
    return spark.createDataFrame(
        [({"id": uid, "firstName": fn, "lastName": "L", "picture": "", "locale": "en",
           "timezone": 0, "gender": "f"},
          {"messageType": "text", "sender": uid, "text": "hi",
           "intent": {"name": "i", "confidence": 1.0}, "entities": [], "timestamp": ts,
           "time": ""}) for uid, fn, ts in rows],
        "user struct<id string, firstName string, lastName string, picture string, "
        "locale string, timezone int, gender string>, utterance struct<messageType string, "
        "sender string, text string, intent struct<name string, confidence double>, "
        "entities array<struct<name string, value string>>, timestamp bigint, time string>")


def test_latest_visitor_last_write_wins(spark):
    um = _user_msgs(spark, [("u1", "old", 1), ("u1", "new", 5), ("u2", "x", 3),
                            ("u1", "mid", 4)])
    got = {r["user_id"]: r["firstName"] for r in latest_visitors(um).collect()}
    assert got == {"u1": "new", "u2": "x"}


def test_interactions_flag_and_union(spark):
    um = _user_msgs(spark, [("u1", "a", 1)])
    st = spark.createDataFrame([("text", "u1", "hello", "n1", None, None, "main", ["main"], 2, "")],
                               "messageType string, recipient string, text string, node string, "
                               "nodeType string, parent string, flow string, path array<string>, "
                               "timestamp bigint, time string")
    on = interactions(um, st, "co")
    assert sorted(r["kind"] for r in on.collect()) == ["system_text", "utterance"]
    assert interactions(um, st, "co", enabled=False).count() == 0
    assert set(on.columns) >= {"company_id", "sender", "recipient", "node", "intent"}


def test_weighted_category_clamps_to_last(spark):
    df = spark.createDataFrame([(0.1,), (0.55,), (0.95,)], "u double")
    short = (("a", .5), ("b", .3))   # sums to .8: .95 falls past the end
    got = [r[0] for r in df.select(R.weighted_category(F.col("u"), short)).collect()]
    assert got == ["a", "b", "b"]


def test_uniform_is_deterministic_and_in_range(spark):
    df = spark.range(0, 5000).select(R.uniform(F.col("id")).alias("u"),
                                     R.uniform(F.col("id"), 1).alias("v"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v")).collect()[0]
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.02 and abs(r[3]) < 0.1


def test_validation_rules(spark):
    df = spark.createDataFrame([(1, "a", 5.0, ["x"], "ab1"), (2, "z", 50.0, ["x", "q"], None)],
                               "id int, kind string, v double, tags array<string>, code string")
    rules = [V.one_of("kind", ["a", "b"], "bad kind"), V.in_range("v", 0, 10),
             V.some_of("tags", ["x", "y"]), V.matches("code", "^[a-z]+[0-9]$"),
             V.required("code")]
    got = sorted((r["id"], r["rule"]) for r in V.violations(df, rules, ["id"]).collect())
    assert got == [(2, "code_required"), (2, "kind_one_of"), (2, "tags_some_of"), (2, "v_range")]


def test_fan_out_and_route(spark):
    df = spark.createDataFrame([("v1", "response"), ("v2", "request")], "value string, kind string")
    out = TP.fan_out(df, ["t1", "t2"])
    assert out.count() == 4
    keys = {r["key"] for r in out.collect()}
    assert all(len(k) == 3 for k in keys)
    routed = {r["kind"]: r["topic"] for r in df.select("kind", TP.route(F.col("kind")).alias("topic")).collect()}
    assert routed == {"response": TP.BOT_RESPONSES, "request": TP.BOT_REQUESTS}
    keyed = spark.createDataFrame([(None, "a"), ("k", "b")], "key string, value string")
    assert [r["value"] for r in TP.keyed(keyed).collect()] == ["b"]
