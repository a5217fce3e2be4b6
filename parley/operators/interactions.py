"""Interaction log and latest-visitor table from decoded user and system messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UTTERANCE_FIELDS = ["messageType", "sender", "text", "intent", "entities", "timestamp", "time"]
SYSTEM_TEXT_FIELDS = ["messageType", "recipient", "text", "node", "nodeType", "parent",
                      "flow", "path", "timestamp", "time"]


def interactions(user_messages: DataFrame, system_texts: DataFrame,
                 company_id: str, enabled: bool = True) -> DataFrame:
    """Every utterance and every system text as one company-scoped log (bag union).

    The two shapes are aligned by name; fields one side lacks are NULL.  When
    ``enabled`` is off the log is empty (same schema).  Decoder output must be
    divided first (``codec.split_valid``): a record that could not be decoded
    would become a row of NULLs.
    """
    for side in (user_messages, system_texts):
        if "decode_error" in side.columns:
            raise ValueError("divide decoder output with split_valid before the union")
    utt = user_messages.select(F.lit("utterance").alias("kind"),
                               *[F.col("utterance")[f].alias(f) for f in UTTERANCE_FIELDS])
    sys_ = system_texts.select(F.lit("system_text").alias("kind"),
                               *[F.col(f) for f in SYSTEM_TEXT_FIELDS])
    log = utt.unionByName(sys_, allowMissingColumns=True)
    log = log.select(F.lit(company_id).alias("company_id"), *log.columns)
    return log if enabled else log.where(F.lit(False))


def latest_visitors(user_messages: DataFrame) -> DataFrame:
    """One row per user id: the user record of that user's newest message.

    ``max`` over ``struct(timestamp, user)`` is a mergeable aggregate, so a
    user with a huge share of the messages is reduced map-side; ties on the
    timestamp resolve to the larger record, deterministically.
    """
    newest = F.max(F.struct(F.col("utterance")["timestamp"].alias("ts"), F.col("user")))
    return (user_messages.groupBy(F.col("user")["id"].alias("user_id"))
                         .agg(newest.alias("latest"))
                         .select("user_id", "latest.user.*",
                                 F.col("latest.ts").alias("last_seen_ms")))
