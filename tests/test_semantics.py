"""Hand-made rows for each semantic decision."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import messages
from parley.operators import measures as M
from parley.operators import trends as T

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC, a Monday


def wide(spark, rows, newest=30):
    df = M.multi_grain_measures(messages(spark, rows), newest=newest)
    return {(r["grain"], r["bucket"]): r.asDict() for r in df.collect()}


def day(rows_by_key, d):
    return rows_by_key[("day", dt.datetime(2024, 1, d))]


def test_equal_dimension_counts_are_summed_not_collapsed(spark):
    # D10: two tuples with the same count must both count
    rows = [("a", "c1", "chrome", "apple", "linux", "resolved", T0 + i) for i in range(2)]
    rows += [("a", "c1", "firefox", "apple", "linux", "resolved", T0 + 10 + i) for i in range(2)]
    assert day(wide(spark, rows), 1)["resolved"] == 4


def test_unknown_dimension_excluded_from_resolution_only(spark):
    # D12: safari is unknown -> not a resolution, still a message
    rows = [("a", "c1", "safari", "apple", "linux", "resolved", T0),
            ("a", "c1", "", "", "", "resolved", T0 + 1)]
    d = day(wide(spark, rows), 1)
    assert d["resolved"] == 1 and d["message_totals"] == 2


def test_resolution_totals_zero_filled(spark):
    # D13
    d = day(wide(spark, [("a", "c1", "", "", "", "", T0)]), 1)
    assert (d["resolved"], d["unresolved"], d["abandoned"], d["escalated"]) == (0, 0, 0, 0)


def test_blank_user_is_one_user(spark):
    # D15
    rows = [("", "c1", "", "", "", "", T0), ("", "c2", "", "", "", "", T0 + 1),
            ("a", "c3", "", "", "", "", T0 + 2)]
    assert day(wide(spark, rows), 1)["user_totals"] == 2


def test_conversation_measures(spark):
    # A2, A4, A5, A6 on a conversation shared by two users
    rows = [("a", "c1", "", "", "", "", T0), ("a", "c1", "", "", "", "", T0 + 1000),
            ("a", "c1", "", "", "", "", T0 + 4000), ("a", "c2", "", "", "", "", T0 + 10000),
            ("b", "c1", "", "", "", "", T0 + 2000)]
    d = day(wide(spark, rows), 1)
    assert d["conversation_totals"] == 2
    assert d["message_totals"] == 5
    # a: 2 conversations, b: 1 -> (2 + 1) / 2
    assert d["conversations_per_user_avg"] == 1.5
    # a: mean(4000, 0) = 2000; b: 0 -> 1000
    assert d["session_length_avg"] == 1000.0
    # c1 has 4 messages from all users, c2 has 1: a -> 2.5, b -> 4 -> 3.25
    assert d["steps_per_user_avg"] == 3.25


def test_session_length_is_within_the_bucket(spark):
    # A5: a conversation crossing midnight is two sessions, one per day
    rows = [("a", "c1", "", "", "", "", T0 + DAY - 1000), ("a", "c1", "", "", "", "", T0 + DAY + 500)]
    w = wide(spark, rows)
    assert day(w, 1)["session_length_avg"] == 0.0
    assert day(w, 2)["session_length_avg"] == 0.0
    assert w[("week", dt.datetime(2024, 1, 1))]["session_length_avg"] == 1500.0


def test_newest_buckets_are_existing_keys(spark):
    # D4 / W1: 35 days with gaps; the newest 30 existing days are kept
    days = [d for d in range(40) if d % 8 != 3]          # 35 days with gaps
    rows = [("a", f"c{d}", "", "", "", "", T0 + d * DAY) for d in days]
    w = wide(spark, rows)
    kept = sorted(b for g, b in w if g == "day")
    assert len(kept) == 30
    assert kept[0] == dt.datetime(2024, 1, 1) + dt.timedelta(days=days[-30])
    assert len([1 for g, _ in w if g == "hour"]) == 30


def test_trend_single_bucket_and_zero_last(spark):
    # D7: one bucket -> no last period; D8: last 0 -> change 1.0 (also 0 -> 0)
    rows = [("a", "c1", "", "", "", "", T0), ("a", "c2", "", "", "", "resolved", T0 + DAY)]
    tr = T.trends(M.multi_grain_measures(messages(spark, rows)))
    got = {(r["grain"], r["measure"]): r for r in tr.collect()}
    assert got[("year", "message_totals")]["last_period"] is None
    assert got[("year", "message_totals")]["change"] is None
    assert got[("day", "resolved")]["last_period"] == 0.0
    assert got[("day", "resolved")]["change"] == 1.0
    assert got[("day", "escalated")]["change"] == 1.0
    assert got[("day", "message_totals")]["change"] == 0.0


def test_sparkline_newest_first(spark):
    # D9: five newest values, newest first
    rows = [("a", f"c{d}", "", "", "", "", T0 + d * DAY + k)
            for d in range(7) for k in range(d + 1)]
    tr = T.trends(M.multi_grain_measures(messages(spark, rows)), ["message_totals"])
    r = [x for x in tr.collect() if x["grain"] == "day"][0]
    assert r["data"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert r["sparkline"] == [7.0, 6.0, 5.0, 4.0, 3.0]
    assert r["this_period"] == 7.0 and r["last_period"] == 6.0
    assert abs(r["change"] - 1 / 6) < 1e-12


def test_week_starts_monday_and_quarters(spark):
    # D3: Sunday 2024-01-07 belongs to the week of Monday 2024-01-01
    from parley.functions.calendar import bucket_start, epoch_ms_to_local
    sunday = T0 + 6 * DAY + 3_600_000
    may = 1_715_000_000_000  # 2024-05-06
    df = spark.createDataFrame([(sunday,), (may,)], "ts bigint")
    local = epoch_ms_to_local(F.col("ts"))
    r = df.select(bucket_start("week", local).alias("w"), bucket_start("qtr", local).alias("q"),
                  bucket_start("hour", local).alias("h")).collect()
    assert r[0]["w"] == dt.datetime(2024, 1, 1)
    assert r[0]["h"] == dt.datetime(2024, 1, 7, 1)
    assert r[1]["q"] == dt.datetime(2024, 4, 1)


def test_buckets_follow_a_named_time_zone(spark):
    from parley.functions.calendar import bucket_start, epoch_ms_to_local
    df = spark.createDataFrame([(T0 + 3_600_000,)], "ts bigint")  # 01:00 UTC
    local = epoch_ms_to_local(F.col("ts"), "America/New_York")
    r = df.select(bucket_start("day", local).alias("d")).collect()[0]
    assert r["d"] == dt.datetime(2023, 12, 31)


def test_all_buckets_when_newest_is_none(spark):
    rows = [("a", f"c{d}", "", "", "", "", T0 + d * DAY) for d in range(35)]
    w = wide(spark, rows, newest=None)
    assert len([1 for g, _ in w if g == "day"]) == 35
