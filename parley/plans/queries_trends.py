"""Registered queries: newest buckets, series, sparklines, period change, bundle.

They run on the ``orders`` adapter, whose 7 years give month/qtr/year series
longer than one bucket.  Arrays are exploded to rows (position, value) so the
results compare as plain rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import measures as M
from parley.operators import trends as T
from parley.plans.catalog import RATIO_DIGITS, register, round_measures
from parley.functions.calendar import bucket_start, epoch_ms_to_local
from parley.plans.rollup import grain_keys
from parley.plans.sql_fixtures import ORDER_MESSAGES, grain_rows, measures_sql
from parley.sources.fixtures import order_messages

MEASURE_NAMES = [n for n, _ in M.MEASURES]


def _orders_wide(spark, sf_dir):
    return round_measures(M.multi_grain_measures(order_messages(spark, sf_dir), time_zone="UTC"))


def _tidy_sql(select: str, ctes: str = "") -> str:
    cols = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in MEASURE_NAMES)
    extra = f",\n{ctes}" if ctes else ""
    return f"""WITH {ORDER_MESSAGES}, {measures_sql('order_messages')},
tidy AS (
  UNPIVOT (SELECT grain, bucket, {cols} FROM wide)
  ON {", ".join(MEASURE_NAMES)} INTO NAME measure VALUE value
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grain, measure ORDER BY bucket DESC) AS back,
         count(*) OVER (PARTITION BY grain, measure) AS points
  FROM tidy
){extra}
{select}"""


@register("latest_buckets", f"""
WITH {ORDER_MESSAGES}, {grain_rows('order_messages')}
SELECT grain, bucket, {30} + 1 - rn AS position
FROM (SELECT grain, bucket, row_number() OVER (PARTITION BY grain ORDER BY bucket DESC) AS rn
      FROM (SELECT DISTINCT grain, bucket FROM g))
WHERE rn <= 30""")
def latest_buckets(spark, sf_dir):
    """Top-k per group: the newest 30 existing buckets of each grain with their position."""
    m = order_messages(spark, sf_dir)
    hours = m.select(bucket_start("hour", epoch_ms_to_local(F.col("timestamp"), "UTC"))
                     .alias("bucket")).distinct()
    return T.latest_buckets(grain_keys(hours), 30)


@register("measure_series", _tidy_sql("""
SELECT grain, measure, points + 1 - back AS position, bucket, value FROM ranked"""))
def measure_series(spark, sf_dir):
    """Each (grain, measure) series, ascending: (position, bucket, value) rows."""
    s = T.measure_series(T.tidy(_orders_wide(spark, sf_dir)))
    return (s.select("grain", "measure", F.posexplode(F.arrays_zip("buckets", "data")))
             .select("grain", "measure", (F.col("pos") + 1).alias("position"),
                     F.col("col.buckets").alias("bucket"), F.col("col.data").alias("value")))


@register("sparkline", _tidy_sql("""
SELECT grain, measure, back AS position, value FROM ranked WHERE back <= 5"""))
def sparkline(spark, sf_dir):
    """The newest five values of each series, newest first."""
    t = T.trends(_orders_wide(spark, sf_dir))
    return (t.select("grain", "measure", F.posexplode("sparkline"))
             .select("grain", "measure", (F.col("pos") + 1).alias("position"),
                     F.col("col").alias("value")))


def _change_sql(kind: str) -> str:
    names = M.INT_MEASURES if kind == "int" else M.DOUBLE_MEASURES
    cast = "BIGINT" if kind == "int" else "DOUBLE"
    inlist = ", ".join(f"'{n}'" for n in names)
    return _tidy_sql(f"""
SELECT t.grain, t.measure, CAST(t.value AS {cast}) AS this_period,
       CAST(l.value AS {cast}) AS last_period,
       round(CASE WHEN l.value IS NULL THEN NULL WHEN l.value = 0 THEN 1.0
                  ELSE (t.value - l.value) / l.value END, {RATIO_DIGITS}) AS change
FROM ranked t LEFT JOIN ranked l
  ON l.grain = t.grain AND l.measure = t.measure AND l.back = 2
WHERE t.back = 1 AND t.measure IN ({inlist})""")


@register("period_change_int", _change_sql("int"))
def period_change_int(spark, sf_dir):
    """This/last period and change of the integer measures (lag over buckets)."""
    out = T.int_period_change(_orders_wide(spark, sf_dir))
    return out.withColumn("change", F.round("change", RATIO_DIGITS))


@register("period_change_double", _change_sql("double"))
def period_change_double(spark, sf_dir):
    """This/last period and change of the average measures (lag over buckets)."""
    out = T.double_period_change(_orders_wide(spark, sf_dir))
    return out.withColumn("change", F.round("change", RATIO_DIGITS))


@register("measure_bundle", _tidy_sql("""
SELECT t.grain, t.measure, t.value AS this_period, l.value AS last_period,
       round(CASE WHEN l.value IS NULL THEN NULL WHEN l.value = 0 THEN 1.0
                  ELSE (t.value - l.value) / l.value END, 6) AS change,
       t.points AS data_points, least(t.points, 5) AS sparkline_points,
       round(d.data_weighted, 3) AS data_weighted, round(d.sparkline_weighted, 3) AS sparkline_weighted
FROM ranked t LEFT JOIN ranked l
  ON l.grain = t.grain AND l.measure = t.measure AND l.back = 2
JOIN (SELECT grain, measure, sum((points - back + 1) * value) AS data_weighted,
             sum(back * value) FILTER (WHERE back <= 5) AS sparkline_weighted
      FROM ranked GROUP BY ALL) d ON d.grain = t.grain AND d.measure = t.measure
WHERE t.back = 1"""))
def measure_bundle(spark, sf_dir):
    """Per grain a map measure -> series record, read back as one row per entry.

    The weighted sums (position times value) tell values and their order.
    """
    weighted = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    b = T.measure_bundle(_orders_wide(spark, sf_dir))
    e = b.select("grain", F.explode("measures").alias("measure", "r"))
    return e.select("grain", "measure", F.col("r.this_period").alias("this_period"),
                    F.col("r.last_period").alias("last_period"),
                    F.round("r.change", RATIO_DIGITS).alias("change"),
                    F.size("r.data").cast("bigint").alias("data_points"),
                    F.size("r.sparkline").cast("bigint").alias("sparkline_points"),
                    F.round(weighted("r.data"), 3).alias("data_weighted"),
                    F.round(weighted("r.sparkline"), 3).alias("sparkline_weighted"))
