"""Plan shape: column pruning at the scan, no cartesian joins, no Python UDFs."""

import pytest

from conftest import SMALL
from parley.plans.rollup import hour_partials
from parley.sources import codec
from parley.sources.fixtures import event_messages, load_table, response_payloads

import __spark_entry__ as E

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_message_scan_reads_only_needed_columns(spark):
    text = plan_text(hour_partials(event_messages(spark, SMALL)))
    schema = text[text.index("ReadSchema: "):].split("\n")[0]
    assert "value" not in schema and "props" not in schema
    for col in ("event_id", "ts", "user_id", "event_type"):
        assert col in schema


def test_json_parsed_once_per_record(spark):
    d = codec.decode_response(response_payloads(load_table(spark, SMALL, "events")))
    good, _ = codec.split_valid(d)
    assert plan_text(good).count("from_json(") == 1


@pytest.mark.parametrize("name", ["multi_grain_measures", "dimension_cube",
                                  "dimension_combinations", "allowed_dimension_messages",
                                  "conversation_steps_join", "topic_fanout", "visitors_latest",
                                  "weighted_category", "validate_rows", "measure_bundle",
                                  "interactions_union", "flatten_messages"])
def test_no_cartesian_or_python(spark, name):
    text = plan_text(E.queries()[name](spark, SMALL))
    for op in FORBIDDEN:
        assert op not in text, f"{name} plan contains {op}"


def test_flagship_shuffle_stages_are_bounded(spark):
    """One scan of the messages; the per-grain work reads the materialised partials."""
    m = event_messages(spark, SMALL)
    df = E.queries()["multi_grain_measures"](spark, SMALL)
    text = plan_text(df)
    assert "events.parquet" not in text   # only the hour-partial files are read here
    assert text.count("Exchange hashpartitioning") <= 8
    assert m is not None


@pytest.mark.parametrize(("keys", "columns"), [([], ["n"]), ([], ["resolved", "escalated"]), (["conversation_id"], ["n"]),
                                              (["user_id"], ["n"])])
def test_single_measures_shuffle_only_their_own_keys(spark, keys, columns):
    text = plan_text(hour_partials(event_messages(spark, SMALL), "UTC", keys, columns))
    exchange = text[text.index("Exchange hashpartitioning"):].split("\n")[0]
    for key in ("user_id", "conversation_id"):
        assert (key in exchange) == (key in keys)
    assert "first_ms" not in text


@pytest.mark.parametrize("name", ["message_totals", "resolution_totals"])
def test_totals_read_neither_users_nor_conversations(spark, name):
    text = plan_text(E.queries()[name](spark, SMALL))
    assert "user_id" not in text and "conversation_id" not in text


def test_no_size_test_before_a_shuffle(spark):
    """The scan keeps its splits unless the caller asks for a number of partitions."""
    assert "RoundRobin" not in plan_text(load_table(spark, SMALL, "events"))


def test_latest_visitor_combines_before_the_shuffle(spark):
    """A user with a third of the messages is reduced per task, not shipped whole."""
    text = plan_text(E.queries()["visitors_latest"](spark, SMALL))
    exchange = text.index("Exchange hashpartitioning")
    assert "partial_max" in text[exchange:]   # the partial step sits below the exchange
    assert "Window" not in text
