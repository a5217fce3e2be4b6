"""Invariants across grains, and the roll-up against a brute-force GROUPING SETS plan."""

from pyspark.sql import functions as F

from conftest import SMALL
from parley.operators import measures as M
from parley.sources.fixtures import event_messages, order_messages


def _all_buckets(spark, fn):
    return M.multi_grain_measures(fn(spark, SMALL), newest=None)


def test_finer_grains_sum_to_coarser(spark):
    w = _all_buckets(spark, order_messages).select("grain", "bucket", "message_totals",
                                                   "resolved")
    pairs = [("day", "month", "month"), ("month", "qtr", "quarter"), ("month", "year", "year"),
             ("day", "week", "week")]
    for fine, coarse, part in pairs:
        f = (w.where(F.col("grain") == fine)
              .groupBy(F.date_trunc(part, "bucket").cast("timestamp_ntz").alias("bucket"))
              .agg(F.sum("message_totals").alias("m"), F.sum("resolved").alias("r")))
        c = w.where(F.col("grain") == coarse).select("bucket", F.col("message_totals").alias("m"),
                                                      F.col("resolved").alias("r"))
        assert f.exceptAll(c).count() == 0 and c.exceptAll(f).count() == 0, (fine, coarse)


def test_resolution_totals_bounded_by_messages(spark):
    w = _all_buckets(spark, event_messages)
    over = w.where(F.col("resolved") + F.col("unresolved") + F.col("abandoned")
                   + F.col("escalated") > F.col("message_totals"))
    assert over.count() == 0


def test_rollup_equals_grouping_sets(spark):
    """The expanded hour partials give what GROUPING SETS over raw rows gives."""
    m = order_messages(spark, SMALL)
    m.createOrReplaceTempView("gs_messages")
    brute = spark.sql("""
      WITH t AS (SELECT *, timestamp_millis(timestamp) AS lt FROM gs_messages),
      b AS (SELECT *, date_trunc('year', lt) AS y, date_trunc('quarter', lt) AS q,
                   date_trunc('month', lt) AS mo, date_trunc('week', lt) AS w,
                   date_trunc('day', lt) AS d, date_trunc('hour', lt) AS h FROM t)
      SELECT CASE WHEN grouping(y) = 0 THEN 'year' WHEN grouping(q) = 0 THEN 'qtr'
                  WHEN grouping(mo) = 0 THEN 'month' WHEN grouping(w) = 0 THEN 'week'
                  WHEN grouping(d) = 0 THEN 'day' ELSE 'hour' END AS grain,
             CAST(coalesce(y, q, mo, w, d, h) AS timestamp_ntz) AS bucket,
             count(*) AS message_totals,
             count(DISTINCT conversation_id) AS conversation_totals,
             count(DISTINCT user_id) AS user_totals
      FROM b GROUP BY GROUPING SETS ((y), (q), (mo), (w), (d), (h))""")
    ours = _all_buckets(spark, order_messages).select(
        "grain", "bucket", "message_totals", "conversation_totals", "user_totals")
    assert brute.exceptAll(ours).count() == 0 and ours.exceptAll(brute).count() == 0
