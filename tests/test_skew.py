"""A hot conversation (a third of all rows, thousands of users) and a hot anonymous user."""

import datetime as dt

import pytest

from conftest import messages
from parley.operators import measures as M
from parley.plans.rollup import user_conversations

T0 = 1_704_067_200_000

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "64",
}


def _rows():
    hot = [(f"u{i}", "hot", "", "", "", "resolved", T0 + i) for i in range(3000)]
    anon = [("", f"a{i % 50}", "", "", "", "", T0 + 5_000 + i) for i in range(3000)]
    rest = [(f"v{i}", f"c{i}", "chrome", "apple", "linux", "", T0 + 9_000 + i)
            for i in range(3000)]
    return hot + anon + rest


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("query", [M.conversation_steps, M.steps_per_user_avg])
def test_single_measures_split_a_hot_conversation(skewed, query):
    df = query(user_conversations(messages(skewed, _rows())))
    assert df.count() > 0
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "skew=true" in plan, plan


def test_hot_keys_give_exact_measures_and_split_join(skewed):
    df = M.multi_grain_measures(messages(skewed, _rows()))
    got = {(r["grain"], r["bucket"]): r for r in df.collect()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    d = got[("day", dt.datetime(2024, 1, 1))]
    assert d["message_totals"] == 9000
    assert d["user_totals"] == 3000 + 1 + 3000
    assert d["conversation_totals"] == 1 + 50 + 3000
    assert d["resolved"] == 3000
    # hot: 3000 users x 1 conversation of 3000 messages; "": 50 conversations of 60;
    # rest: 3000 users x 1 conversation of 1 -> mean over 6001 users
    assert abs(d["steps_per_user_avg"] - (3000 * 3000 + 60 + 3000 * 1) / 6001) < 1e-9
    assert abs(d["conversations_per_user_avg"] - (3000 + 50 + 3000) / 6001) < 1e-12
    assert "SortAggregate" not in plan
    assert "SortMergeJoin" in plan and "skew=true" in plan, plan
