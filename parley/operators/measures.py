"""Engagement measures per (grain, bucket).

``multi_grain_measures`` runs the whole chain from message rows; the
building blocks take either in-window hour partials
(``plans.rollup.grain_partials``) or the per-(grain, bucket, user,
conversation) table (``plans.rollup.user_conversations``).  Every measure is
a chain of ordinary fixed-width aggregations; distinct counts are "group,
then count groups", so every step combines map-side and no group is ever
collected into one task.

=============================  ==============================================
measure                        definition within one bucket
=============================  ==============================================
message_totals                 messages
conversation_totals            distinct conversations
user_totals                    distinct users ("" is one user)
conversations_per_user_avg     sum over users of their conversations / users
session_length_avg             mean over users of the mean over their
                               conversations of (last - first) ms
steps_per_user_avg             mean over users of the mean over their
                               conversations of the conversation's messages
                               from all users
resolved .. escalated          messages with that status and allowed
                               browser/device/os (zero when none)
=============================  ==============================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.calendar import GRAINS
from parley.functions.columns import safe_ratio
from parley.operators.dimensions import RESOLUTION_STATUSES
from parley.plans.rollup import KEYS, grain_partials, merge_partials
from parley.plans.stages import materialize

BUCKET = ["grain", "bucket"]

# (name, kind): kind "int" measures are bigint in the wide table.
MEASURES = [
    ("conversations_per_user_avg", "double"),
    ("conversation_totals", "int"),
    ("message_totals", "int"),
    ("session_length_avg", "double"),
    ("steps_per_user_avg", "double"),
    ("user_totals", "int"),
    ("resolved", "int"),
    ("unresolved", "int"),
    ("abandoned", "int"),
    ("escalated", "int"),
]
INT_MEASURES = [n for n, k in MEASURES if k == "int"]
DOUBLE_MEASURES = [n for n, k in MEASURES if k == "double"]


def per_conversation(rows: DataFrame) -> DataFrame:
    """``(grain, bucket, conversation_id) -> conv_n``: the conversation's messages from all users.

    ``rows`` may be (user, conversation) partials or finer (hour) partials;
    the sum is the same.  Only fixed-width aggregates, so Spark keeps a hash
    aggregate with a map-side combine.
    """
    return rows.groupBy(*BUCKET, "conversation_id").agg(F.sum("n").alias("conv_n"))


def conversation_steps(uc: DataFrame, conv: DataFrame | None = None) -> DataFrame:
    """Each (user, conversation) row with its conversation's message count from all users.

    An equi-join on (grain, bucket, conversation).  Spark broadcasts the
    conversation side only when its measured size is under the broadcast
    threshold; otherwise both sides shuffle on the key and AQE splits a
    conversation shared by very many users across tasks (skew join).  For that
    the totals must be read from files, with a plain shuffle above; they are
    written here unless the caller has written them.
    """
    conv = materialize(per_conversation(uc), "conversation-totals") if conv is None else conv
    return (uc.select(*BUCKET, "user_id", "conversation_id", "n",
                      *[c for c in RESOLUTION_STATUSES if c in uc.columns],
                      (F.col("last_ms") - F.col("first_ms")).alias("duration_ms"))
              .join(conv.select(*BUCKET, "conversation_id", "conv_n"),
                    [*BUCKET, "conversation_id"]))


def per_user(steps: DataFrame) -> DataFrame:
    """``(grain, bucket, user_id)`` -> conversations, mean session ms, mean steps,
    and the user's own message and resolution counts (exact sums)."""
    return (steps.groupBy(*BUCKET, "user_id")
                 .agg(F.count(F.lit(1)).alias("conversations"),
                      F.avg("duration_ms").alias("session_ms"),
                      F.avg("conv_n").alias("steps"),
                      F.sum("n").alias("messages"),
                      *[F.sum(s).alias(s) for s in RESOLUTION_STATUSES if s in steps.columns]))


def user_measures(users: DataFrame) -> DataFrame:
    """Per (grain, bucket): the user-based measures and the message/resolution totals."""
    return (users.groupBy(*BUCKET)
                 .agg(F.count(F.lit(1)).alias("user_totals"),
                      safe_ratio(F.sum("conversations"), F.count(F.lit(1)))
                      .alias("conversations_per_user_avg"),
                      F.avg("session_ms").alias("session_length_avg"),
                      F.avg("steps").alias("steps_per_user_avg"),
                      F.sum("messages").alias("message_totals"),
                      *[F.sum(s).alias(s) for s in RESOLUTION_STATUSES if s in users.columns]))


def conversation_counts(conv: DataFrame) -> DataFrame:
    """Per (grain, bucket): distinct conversations = conversation rows."""
    return conv.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("conversation_totals"))


def _assemble(uc: DataFrame, conv: DataFrame) -> DataFrame:
    users = per_user(conversation_steps(uc, conv))
    wide = user_measures(users).join(conversation_counts(conv), BUCKET)
    return wide.select(*BUCKET, *[n for n, _ in MEASURES])


def measures_from_rows(rows: DataFrame) -> DataFrame:
    """All ten measures from in-window hour partials (see ``plans.rollup.grain_rows``).

    The conversation totals are grouped from the partials (users collapse
    map-side) and written once to the shared checkpoint folder; the
    (user, conversation) table is grouped from the same partials and joined
    to them.  Reading the totals from files puts a plain shuffle under both
    join inputs, which is what lets AQE split a conversation shared by very
    many users across tasks (or broadcast the totals when they are small).
    Per-user and per-bucket steps are partial aggregates; message and
    resolution totals are exact sums over the (user, conversation) rows,
    which partition the messages.
    """
    conv = materialize(per_conversation(rows), "conversation-totals")
    return _assemble(merge_partials(rows, [*BUCKET, *KEYS]), conv)


def multi_grain_measures(m: DataFrame, grains=GRAINS, newest: int | None = 30,
                         time_zone: str | None = None) -> DataFrame:
    """Messages -> the ten measures for the newest ``newest`` buckets of every grain."""
    return measures_from_rows(grain_partials(m, grains, newest, time_zone))


# --- single measures: of any rows that carry the keys and columns they name --

def message_totals(rows: DataFrame) -> DataFrame:
    """From ``n``; rows need no user and no conversation."""
    return rows.groupBy(*BUCKET).agg(F.sum("n").alias("message_totals"))


def conversation_totals(rows: DataFrame) -> DataFrame:
    """From ``conversation_id`` alone."""
    return (rows.select(*BUCKET, "conversation_id").distinct()
              .groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("conversation_totals")))


def user_totals(rows: DataFrame) -> DataFrame:
    """From ``user_id`` alone."""
    return (rows.select(*BUCKET, "user_id").distinct()
              .groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("user_totals")))


def conversations_per_user_avg(uc: DataFrame) -> DataFrame:
    users = uc.groupBy(*BUCKET, "user_id").agg(F.count(F.lit(1)).alias("conversations"))
    return users.groupBy(*BUCKET).agg(
        safe_ratio(F.sum("conversations"), F.count(F.lit(1))).alias("conversations_per_user_avg"))


def session_length_avg(uc: DataFrame) -> DataFrame:
    users = (uc.groupBy(*BUCKET, "user_id")
               .agg(F.avg(F.col("last_ms") - F.col("first_ms")).alias("session_ms")))
    return users.groupBy(*BUCKET).agg(F.avg("session_ms").alias("session_length_avg"))


def steps_per_user_avg(uc: DataFrame) -> DataFrame:
    users = per_user(conversation_steps(uc))
    return users.groupBy(*BUCKET).agg(F.avg("steps").alias("steps_per_user_avg"))


def resolution_totals(rows: DataFrame) -> DataFrame:
    """The four resolution totals, without keys; a bucket with no match reports 0."""
    return rows.groupBy(*BUCKET).agg(*[F.sum(s).alias(s) for s in RESOLUTION_STATUSES])


def messages_per_conversation(rows: DataFrame) -> DataFrame:
    return per_conversation(rows).withColumnRenamed("conv_n", "messages")


def user_conversation_sessions(uc: DataFrame) -> DataFrame:
    """Per (grain, bucket, user, conversation): first/last timestamp, span and messages."""
    return uc.select(*BUCKET, "user_id", "conversation_id",
                     F.col("first_ms"), F.col("last_ms"),
                     (F.col("last_ms") - F.col("first_ms")).alias("session_ms"),
                     F.col("n").alias("messages"))

