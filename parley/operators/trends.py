"""Series, sparklines and period-over-period change for each (grain, measure).

Input is the wide measure table (one row per grain and bucket, already cut to
the newest N buckets per grain), so every series holds at most N points and
collecting one is bounded by N, never by the data.  Buckets are the keys that
exist: "last period" is the previous existing bucket, with no gap filling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.measures import DOUBLE_MEASURES, INT_MEASURES, MEASURES

SPARKLINE = 5


def latest_buckets(keys: DataFrame, newest: int = 30) -> DataFrame:
    """Top-k per group: the ``newest`` latest existing buckets of each grain, ascending."""
    rank = F.row_number().over(Window.partitionBy("grain").orderBy(F.col("bucket").desc()))
    return (keys.select("grain", "bucket").distinct()
                .withColumn("rank", rank).where(F.col("rank") <= newest)
                .select("grain", "bucket", (F.lit(newest) + 1 - F.col("rank")).alias("position")))


def tidy(wide: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Wide measures -> ``(grain, bucket, measure, value double)`` rows."""
    names = measures or [n for n, _ in MEASURES]
    return (wide.select("grain", "bucket", *[F.col(n).cast("double").alias(n) for n in names])
                .unpivot(["grain", "bucket"], names, "measure", "value"))


def measure_series(long: DataFrame) -> DataFrame:
    """``(grain, measure) -> buckets, data`` ascending by bucket."""
    points = F.sort_array(F.collect_list(F.struct("bucket", "value")))
    return (long.groupBy("grain", "measure").agg(points.alias("points"))
                .select("grain", "measure",
                        F.transform("points", lambda p: p["bucket"]).alias("buckets"),
                        F.transform("points", lambda p: p["value"]).alias("data")))


def change(this: Column, last: Column) -> Column:
    """(this - last) / last; 1.0 when last is 0 (also 0 -> 0); NULL without a last period."""
    return (F.when(last.isNull(), F.lit(None).cast("double"))
             .when(last == 0, F.lit(1.0))
             .otherwise((this - last).cast("double") / last.cast("double")))


def with_trend(series: DataFrame, sparkline: int = SPARKLINE) -> DataFrame:
    """Add sparkline (newest first), this/last period and change to each series."""
    data = F.col("data")
    this = F.element_at(data, -1)
    last = F.when(F.size(data) >= 2, F.element_at(data, -2))
    return series.select(
        "*",
        F.slice(F.reverse(data), 1, sparkline).alias("sparkline"),
        this.alias("this_period"),
        last.alias("last_period"),
        change(this, last).alias("change"),
    )


def trends(wide: DataFrame, measures: list[str] | None = None,
           sparkline: int = SPARKLINE) -> DataFrame:
    """``(grain, measure, buckets, data, sparkline, this_period, last_period, change)``."""
    return with_trend(measure_series(tidy(wide, measures)), sparkline)


def period_change(wide: DataFrame, measures: list[str], value_type: str) -> DataFrame:
    """This/last period and change per (grain, measure), values typed ``value_type``.

    Uses ``lag`` over the buckets of each grain rather than collecting series.
    """
    w = Window.partitionBy("grain", "measure").orderBy("bucket")
    newest = Window.partitionBy("grain", "measure").orderBy(F.col("bucket").desc())
    long = (wide.select("grain", "bucket", *[F.col(n).cast(value_type).alias(n) for n in measures])
                .unpivot(["grain", "bucket"], measures, "measure", "value"))
    return (long.select("grain", "measure", "bucket",
                        F.col("value").alias("this_period"),
                        F.lag("value").over(w).alias("last_period"),
                        F.row_number().over(newest).alias("rn"))
                .where(F.col("rn") == 1)
                .select("grain", "measure", "this_period", "last_period",
                        change(F.col("this_period"), F.col("last_period")).alias("change")))


def int_period_change(wide: DataFrame) -> DataFrame:
    return period_change(wide, INT_MEASURES, "bigint")


def double_period_change(wide: DataFrame) -> DataFrame:
    return period_change(wide, DOUBLE_MEASURES, "double")


def measure_bundle(wide: DataFrame, sparkline: int = SPARKLINE) -> DataFrame:
    """Per grain, a map ``measure -> {data, sparkline, this_period, last_period, change}``."""
    t = trends(wide, sparkline=sparkline)
    record = F.struct("data", "sparkline", "this_period", "last_period", "change")
    return (t.groupBy("grain")
             .agg(F.map_from_entries(F.collect_list(F.struct("measure", record)))
                  .alias("measures")))
