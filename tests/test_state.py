"""Per-bucket measure state: same measures as the whole log, touched buckets only, one committed state at a time."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, messages
from parley.session import scratch_path
from parley.sources import folders
from parley.sources.fixtures import event_messages, order_messages
from parley.streaming import state as st
from parley.streaming.metrics import compact_partials, measures_from_log, partials_sink

H, DAY, JAN1 = 3_600_000, 86_400_000, 1704067200000


def rows(df):
    return sorted(tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r) for r in df.collect())


def test_equals_the_whole_log_through_refreshes_expiry_and_late_rows(spark):
    m = order_messages(spark, SMALL)        # seven years
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    write = partials_sink(log, "UTC")
    cut = m.agg(F.percentile_approx("timestamp", 0.9)).first()[0]
    for i, part in enumerate([m.where(f"timestamp < {cut}"), m.where(f"timestamp >= {cut} AND timestamp % 3 <> 0"), m.where(f"timestamp >= {cut} AND timestamp % 3 = 0")]):
        write(part, i)
        if i != 1:                          # the second refresh takes two slices
            st.refresh(spark, log, state)
            assert rows(st.measures_from_state(spark, state)) == rows(measures_from_log(spark, log))
    assert st.manifest(spark, state).taken == {"batch": [[0, 2]]}
    assert st.expire_state(spark, state) > 0
    assert rows(st.measures_from_state(spark, state)) == rows(measures_from_log(spark, log))
    assert st.refresh(spark, log, state) == st.Refresh(2, [], [])      # nothing new: nothing done


def test_a_refresh_touches_only_the_buckets_of_its_slices(spark):
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    write = partials_sink(log, "UTC")
    day = lambda d, h, user="a", conv="c": (user, f"{conv}{d}", "chrome", "apple", "linux", "resolved", JAN1 + d * DAY + h * H)
    write(messages(spark, [day(d, h) for d in range(70) for h in (1, 2)]), 0)     # Jan 1 to Mar 10
    first = st.refresh(spark, log, state)
    assert first.read == [] and len(first.written) == 70 + 70 + 3
    before = st.manifest(spark, state)
    write(messages(spark, [day(68, 2, "b"), day(68, 9)]), 1)                       # Mar 9
    second = st.refresh(spark, log, state)
    assert second.written == ["hour/2024-03-09-00", "day/2024-03-09-00", "month/2024-03-01-00"]
    after = st.manifest(spark, state)
    for level in st.LEVELS:
        changed = {b for b in after.live[level] if after.live[level][b] != before.live[level].get(b)}
        assert changed == {w.split("/")[1] for w in second.written if w.startswith(level)}
    # read: the touched buckets, the other days of their week, the other months of their year -- and no other hours
    parts = sorted(p.split("/", 1)[1].replace("/part=", "/").removeprefix("level=") for p in second.read)
    assert parts == ["day/2024-03-04-00", "day/2024-03-05-00", "day/2024-03-06-00", "day/2024-03-07-00", "day/2024-03-08-00",
                     "day/2024-03-09-00", "day/2024-03-10-00", "hour/2024-03-09-00", "month/2024-01-01-00", "month/2024-02-01-00", "month/2024-03-01-00"]
    assert rows(st.measures_from_state(spark, state)) == rows(measures_from_log(spark, log))
    # a late row in a day long out of the newest 30: its month and year change, its hour and day get no measures
    write(messages(spark, [day(0, 5, "late")]), 2)
    third = st.refresh(spark, log, state)
    assert third.written == ["hour/2024-01-01-00", "day/2024-01-01-00", "month/2024-01-01-00"]
    assert rows(st.measures_from_state(spark, state)) == rows(measures_from_log(spark, log))


def test_a_refresh_overtaken_by_another_starts_over(spark, monkeypatch):
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    write = partials_sink(log, "UTC")
    m = event_messages(spark, SMALL)
    write(m.where("timestamp % 2 = 0"), 0)
    write(m.where("timestamp % 2 <> 0"), 1)
    real, overtaken = st._merge, []

    def merge(*args):
        if not overtaken:
            overtaken.append(1)
            monkeypatch.setattr(st, "_merge", real)
            st.refresh(spark, log, state)               # another one commits first
        return real(*args)

    monkeypatch.setattr(st, "_merge", merge)
    st.refresh(spark, log, state)
    assert st.manifest(spark, state).version == 1 and st.manifest(spark, state).taken == {"batch": [[0, 1]]}
    assert rows(st.measures_from_state(spark, state)) == rows(measures_from_log(spark, log))
    assert not folders.create_text(spark, f"{state}/_manifest/{1:012d}.json", "{}")       # never replaced
    assert [n for n in folders.children(spark, f"{state}/_manifest") if n.startswith("_draft")] == []


def test_slices_expired_before_they_were_taken(spark):
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    write = partials_sink(log, "UTC")
    m = event_messages(spark, SMALL)
    write(m.where("timestamp % 3 = 0"), 0)
    st.refresh(spark, log, state)
    write(m.where("timestamp % 3 = 1"), 1)
    compact_partials(spark, log, 1)
    folders.expire(spark, log)
    write(m.where("timestamp % 3 = 2"), 2)
    st.refresh(spark, log, state)
    assert rows(st.measures_from_state(spark, state)) == rows(measures_from_log(spark, log))
    assert st.manifest(spark, state).taken == {"batch": [[0, 2]]}


def test_no_state(spark):
    with pytest.raises(ValueError):
        st.measures_from_state(spark, scratch_path(spark, "none"))
