"""The bucketed visitor table, and sinks with progress of their own."""

import warnings

import pytest

from parley import schemas as S
from parley.session import scratch_path
from parley.sources import folders
from parley.sources.store import append_messages
from parley.streaming import sinks as K
from parley.streaming import visitors as V


def _slice(spark, log, batch, rows):
    folders.write_slice(spark.createDataFrame(rows, "user_id string, firstName string, last_seen_ms bigint"), log, batch)


def _table(spark, table):
    return {r["user_id"]: (r["firstName"], r["last_seen_ms"]) for r in V.visitors_from_buckets(spark, table).collect()}


def test_a_refresh_writes_only_the_buckets_it_touches(spark):
    log, table = scratch_path(spark, "log"), scratch_path(spark, "buckets")
    _slice(spark, log, 0, [(f"u{i}", "a", i) for i in range(200)])
    first = V.refresh_visitors(spark, log, table, buckets=16)
    assert first.read == [] and len(first.written) == 16
    before = V.manifest(spark, table).live
    _slice(spark, log, 1, [("u7", "b", 1000), ("new", "n", 5), ("u8", "old", 1)])
    second = V.refresh_visitors(spark, log, table)
    after = V.manifest(spark, table).live
    assert {b for b in after if after[b] != before.get(b)} == set(second.written) and 1 <= len(second.written) <= 3
    assert sorted(second.read) == sorted(before[b] for b in second.written)
    got = _table(spark, table)
    assert len(got) == 201 and got["u7"] == ("b", 1000) and got["u8"] == ("a", 8) and got["new"] == ("n", 5)
    assert V.refresh_visitors(spark, log, table).written == []        # nothing new
    one = V.visitor(spark, table, "u7")
    assert [r["firstName"] for r in one.collect()] == ["b"] and len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1
    assert V.visitor(spark, table, "nobody").count() == 0
    assert V.expire_visitors(spark, table) > 0 and _table(spark, table) == got
    V.refresh_visitors(spark, log, table, buckets=4)
    assert _table(spark, table) == got and V.manifest(spark, table).buckets == 4
    assert [r["firstName"] for r in V.visitor(spark, table, "u7").collect()] == ["b"]


def test_an_overtaken_refresh_starts_over(spark, monkeypatch):
    log, table = scratch_path(spark, "log"), scratch_path(spark, "buckets")
    _slice(spark, log, 0, [("u", "a", 1)])
    merge, calls = V._merge, []

    def slow(*args):
        calls.append(1)
        if len(calls) == 1:      # another refresh commits first
            V.refresh_visitors(spark, log, table)
        return merge(*args)

    monkeypatch.setattr(V, "_merge", slow)
    V.refresh_visitors(spark, log, table)
    assert V.manifest(spark, table).version == 1 and _table(spark, table) == {"u": ("a", 1)}
    assert len(folders.children(spark, table, "write=")) == 1


def test_no_table_is_an_error(spark):
    with pytest.raises(ValueError, match="no table"):
        V.visitors_from_buckets(spark, scratch_path(spark, "none"))


def _store(spark, batches):
    store = scratch_path(spark, "store")
    for n in range(batches):
        _append(spark, store, n)
    return store


def _append(spark, store, n):
    row = ("b", "d", f"c{n}", "n", "", "", "u", "", "", "", "", "web", "", "", "t", [], [], n)
    append_messages(spark.createDataFrame([row], S.MESSAGE), store, n, run="r")


def test_a_sink_that_fails_catches_up_alone(spark):
    store, ledger = _store(spark, 2), scratch_path(spark, "ledger")
    calls = {"good": [], "bad": []}

    def good(rows, n):
        calls["good"].append((n, rows.count()))

    def bad(rows, n):
        calls["bad"].append(n)
        if calls["bad"] == [0, 1]:
            raise OSError("away")

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert list(K.deliver_all(spark, store, ledger, {"bad": bad, "good": good})) == ["bad"]
    assert any("bad failed" in str(w.message) for w in said)
    assert K.had_by_all(spark, ledger, "r", ["good", "bad"]) == 0
    _append(spark, store, 2)
    assert K.deliver_all(spark, store, ledger, {"bad": bad, "good": good}) == {}
    assert calls == {"good": [(0, 1), (1, 1), (2, 1)], "bad": [0, 1, 1, 2]}
    assert K.had_by_all(spark, ledger, "r", ["good", "bad"]) == 2 and K.had_by_all(spark, ledger, "r", ["good", "never"]) == -1
    assert K.deliver(spark, store, ledger, "good", good) == 0


def test_expired_batches_are_told(spark):
    store, ledger = _store(spark, 2), scratch_path(spark, "ledger")
    from parley.sources.store import compact_messages, expire_messages
    K.deliver(spark, store, ledger, "had", lambda rows, n: None)
    compact_messages(spark, store, 1)
    assert K.deliver(spark, store, ledger, "slow", lambda rows, n: None) == 2      # compacted, not expired
    expire_messages(spark, store)
    assert K.deliver(spark, store, ledger, "had", lambda rows, n: None) == 0
    with pytest.raises(ValueError, match="expired before"):
        K.deliver(spark, store, ledger, "late", lambda rows, n: None)
