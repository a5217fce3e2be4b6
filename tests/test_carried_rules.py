"""Rules carried by messages: which are in force, and what breaks them."""

from pyspark.sql import functions as F

from parley.operators.carried_rules import RULE, broken_rules, rules_in_force


def _rule(kind, field=None, allowed=None, low=None, high=None, pattern=None, message=None):
    return ("message", field, kind, allowed, low, high, pattern, message)


def _broken(spark, rules, value, fields=None):
    rows = spark.createDataFrame([(1, value, fields, rules)], f"id int, v string, f map<string, string>, rules array<{RULE}>")
    found = broken_rules(rows, ["id"], value=F.col("v"), fields=F.col("f"), rules=F.col("rules"))
    return [(r["kind"], r["field"]) for r in found.collect()]


def test_input_rules(spark):
    one, some = _rule("one_of", allowed=["a", "b"]), _rule("some_of", allowed=["a", "b"])
    assert _broken(spark, [one, some], "a") == []
    assert _broken(spark, [one, some], "a, b") == [("one_of", None)]
    assert _broken(spark, [one, some], "a,c") == [("one_of", None), ("some_of", None)]
    assert _broken(spark, [one, some], None) == []


def test_range_takes_numbers_only(spark):
    from decimal import Decimal
    span = _rule("range", low=Decimal(1), high=Decimal(10))
    assert _broken(spark, [span], "10") == _broken(spark, [span], "1.0") == _broken(spark, [span], None) == []
    assert _broken(spark, [span], "10.5") == _broken(spark, [span], "ten") == [("range", None)]


def test_form_fields(spark):
    rules = [_rule("required", "k"), _rule("regex", "k", pattern="^[0-9]+$", message="digits"), _rule("regex", "k", pattern="([", message="?")]
    assert _broken(spark, rules, "x", {"k": "12"}) == [("unreadable", "k")]
    assert _broken(spark, rules, "x", {"k": "1a"}) == [("regex", "k"), ("unreadable", "k")]
    assert _broken(spark, rules, "x", {"k": " "}) == _broken(spark, rules, "x", {}) == _broken(spark, rules, "x", None) == [
        ("required", "k"), ("unreadable", "k")]


def _force(spark, said, asked, **more):
    responses = spark.createDataFrame([(c, t, n, [_rule("one_of", allowed=[w])] if w else []) for c, t, n, w in said],
                                      f"conversation_id string, timestamp bigint, nth int, rules array<{RULE}>")
    inputs = spark.createDataFrame(asked, "conversation_id string, timestamp bigint, row int")
    found = rules_in_force(responses, inputs, order="nth", **more)
    assert found.columns == ["conversation_id", "timestamp", "row", "rules"]
    return {r["row"]: r["rules"][0]["allowed"][0] if r["rules"] else None for r in found.collect()}


def test_newest_earlier_response_counts(spark):
    said = [("c", 10, 1, "a"), ("c", 20, 2, "b"), ("c", 20, 3, "b2"), ("c", 30, 4, None), ("d", 5, 5, "d"), (None, 1, 6, "x")]
    asked = [("c", 10, 0), ("c", 11, 1), ("c", 20, 2), ("c", 21, 3), ("c", 31, 4), ("d", 999, 5), ("e", 9, 6), (None, 9, 7), ("c", None, 8), ("c", 21, 9)]
    want = {0: None, 1: "a", 2: "a", 3: "b2", 4: None, 5: "d", 6: None, 7: None, 8: None, 9: "b2"}
    for block in (1, 7, 10, 1000):
        assert _force(spark, said, asked, block_ms=block) == want


def test_empty_tables(spark):
    assert _force(spark, [], [("c", 1, 1)]) == {1: None}
    assert _force(spark, [("c", 1, 1, "a")], []) == {}


def test_a_hot_conversation_is_cut_into_blocks(spark):
    responses = spark.range(1000).select(F.lit("c").alias("conversation_id"), (F.col("id") * 100).alias("timestamp"), F.col("id").cast("int").alias("nth"),
                                         F.array(F.lit(None)).cast(f"array<{RULE}>").alias("rules"))
    inputs = spark.range(1000).select(F.lit("c").alias("conversation_id"), (F.col("id") * 100 + 50).alias("timestamp"), F.col("id").alias("row"))
    plan = rules_in_force(responses, inputs, order="nth", block_ms=1000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key#" in plan and "__block#" in plan.split("Window")[1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
