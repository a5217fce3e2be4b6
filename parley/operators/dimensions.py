"""Known dimension domains and the allowed-tuple rule for resolution totals.

A message counts towards a resolution total only when each of its browser,
device and operating system is blank or a known value; unknown values are
still counted in the message totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference's lists, in its order).
BROWSERS = ("chrome", "firefox", "ie", "opera")
DEVICES = ("apple", "android")
OPERATING_SYSTEMS = ("linux", "windows", "macos")
RESOLUTION_STATUSES = ("resolved", "unresolved", "abandoned", "escalated")

_BLANK = ""


def allowed_dimensions(browser: Column, device: Column, operating_system: Column) -> Column:
    """True when all three dimensions are blank or known (constant-folded ``IN`` lists)."""
    return (browser.isin(_BLANK, *BROWSERS) & device.isin(_BLANK, *DEVICES)
            & operating_system.isin(_BLANK, *OPERATING_SYSTEMS))


def resolution_flag(status: str, m_cols: dict[str, Column] | None = None) -> Column:
    """1 when the row has resolution ``status`` and allowed dimensions, else 0."""
    c = m_cols or {}
    res = c.get("resolution_status", F.col("resolution_status"))
    cond = (res == F.lit(status)) & allowed_dimensions(
        c.get("browser", F.col("browser")), c.get("device", F.col("device")),
        c.get("operating_system", F.col("operating_system")))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def allowed_combinations(spark) -> DataFrame:
    """Every allowed (resolution, browser, device, os) tuple: 4 x 5 x 3 x 4 = 240 rows.

    Built by generators over literal lists, so its size is fixed and it is safe
    to broadcast.
    """
    def options(values):
        return F.array(*[F.lit(v) for v in (_BLANK, *values)])

    return (spark.range(1)
            .select(F.explode(F.array(*[F.lit(s) for s in RESOLUTION_STATUSES]))
                    .alias("resolution_status"))
            .select("*", F.explode(options(BROWSERS)).alias("browser"))
            .select("*", F.explode(options(DEVICES)).alias("device"))
            .select("*", F.explode(options(OPERATING_SYSTEMS)).alias("operating_system")))


def keep_allowed(m: DataFrame) -> DataFrame:
    """Rows whose dimension tuple is an allowed combination (broadcast semi join)."""
    allowed = allowed_combinations(m.sparkSession)
    return m.join(F.broadcast(allowed),
                  ["resolution_status", "browser", "device", "operating_system"],
                  "left_semi")


DIMENSIONS = ["resolution_status", "browser", "device", "operating_system"]


def dimension_cube(m: DataFrame, grains=None, newest: int | None = 30,
                   time_zone: str | None = None) -> DataFrame:
    """Messages per (grain, bucket, resolution, browser, device, os), newest buckets only.

    Hour-level counts per dimension tuple are combined map-side first and
    written once (their size is bounded by hours x dimension tuples, not by
    messages); the cut-offs and the expansion to the in-window buckets of
    each grain both read that small table, so the messages are scanned once.
    """
    from parley.functions.calendar import GRAINS, bucket_start, epoch_ms_to_local
    from parley.plans.rollup import grain_rows, newest_cutoffs, session_time_zone
    from parley.plans.stages import materialize
    grains = grains or GRAINS
    tz = time_zone or session_time_zone(m)
    hour = bucket_start("hour", epoch_ms_to_local(F.col("timestamp"), tz))
    hourly = materialize(m.groupBy(hour.alias("bucket"), *DIMENSIONS)
                          .agg(F.count(F.lit(1)).alias("messages")), "hourly-cube")
    rows = grain_rows(hourly, newest_cutoffs(hourly, newest, grains), [*DIMENSIONS, "messages"])
    return (rows.groupBy("grain", "bucket", *DIMENSIONS)
                .agg(F.sum("messages").alias("messages")))
