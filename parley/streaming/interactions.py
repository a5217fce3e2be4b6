"""Stream the chat log: user messages and system texts -> interaction log + visitors.

Both topics feed one query (a union of the two raw streams tagged by kind).
Records without a key are skipped where a topic has keys; each of the others is
decoded once and ends up in one of two places:

* the company-scoped interaction log, as the batch's slice of its run (a replayed
  batch replaces its slice), with each batch's newest record per user in a
  visitor log; the visitor table is the newest record per user over that log
  (last write wins), merged at each read or, with ``buckets_path``, kept in buckets by
  user of which a batch rewrites those it touches (``streaming.visitors``);
* the quarantine beside the log, with its kind and the reason.

The on/off flag skips all writes while still committing progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.interactions import interactions, latest_visitors
from parley.sources.codec import ERROR, decode_system_text, decode_user_message, split_valid
from parley.sources.folders import write_slice
from parley.streaming.compaction import compact, read_log
from parley.streaming.ingest import DEFAULT_TRIGGER, quarantine_of
from parley.streaming.visitors import newest_per_user, refresh_visitors

USER_KIND = "user_message"
SYSTEM_KIND = "system_text"


def tagged(stream: DataFrame, kind: str) -> DataFrame:
    """A raw stream as (kind, value, keyed); a source without keys has only keyed records."""
    keyed = F.col("key").isNotNull() if "key" in stream.columns else F.lit(True)
    return stream.select(F.lit(kind).alias("kind"), "value", keyed.alias("keyed"))


def chat_log_writer(log_path: str, visitors_path: str, company_id: str, enabled: bool = True,
                    quarantine_path: str | None = None, buckets_path: str | None = None) -> Callable[[DataFrame, int], None]:
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not enabled:
            return
        batch = batch.where("keyed")
        users, texts = (decode(batch.where(F.col("kind") == kind).select("value")).persist()
                        for decode, kind in ((decode_user_message, USER_KIND), (decode_system_text, SYSTEM_KIND)))
        try:
            (good_users, bad_users), (good_texts, bad_texts) = split_valid(users), split_valid(texts)
            write_slice(interactions(good_users, good_texts, company_id), log_path, batch_id)
            write_slice(latest_visitors(good_users), visitors_path, batch_id)
            if buckets_path:
                refresh_visitors(batch.sparkSession, visitors_path, buckets_path)
            bad = [d.select(F.lit(kind).alias("kind"), "value", ERROR) for d, kind in ((bad_users, USER_KIND), (bad_texts, SYSTEM_KIND))]
            write_slice(bad[0].unionByName(bad[1]), quarantine_path or quarantine_of(log_path), batch_id)
        finally:
            users.unpersist()
            texts.unpersist()

    return handle


def ingest_chat_log(user_stream: DataFrame, system_stream: DataFrame, log_path: str,
                    visitors_path: str, checkpoint_path: str, company_id: str,
                    enabled: bool = True, trigger: dict | None = None,
                    quarantine_path: str | None = None, buckets_path: str | None = None) -> StreamingQuery:
    """Start the chat-log query over the two message streams."""
    both = tagged(user_stream, USER_KIND).unionByName(tagged(system_stream, SYSTEM_KIND))
    return (both.writeStream
            .foreachBatch(chat_log_writer(log_path, visitors_path, company_id, enabled, quarantine_path, buckets_path))
            .option("checkpointLocation", checkpoint_path)
            .trigger(**(trigger or DEFAULT_TRIGGER))
            .start())


def visitors_table(spark: SparkSession, visitors_path: str) -> DataFrame:
    """The newest visitor record per user id over the visitor log."""
    return newest_per_user(read_log(spark, visitors_path))


def compact_visitors(spark: SparkSession, visitors_path: str, through: int, run: str | None = None) -> str:
    """Merge a run's visitor log up to batch ``through`` into one snapshot (see ``compaction``)."""
    return compact(spark, visitors_path, through, newest_per_user, run)
