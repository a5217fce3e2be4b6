"""Topic sources and sinks (Kafka) plus the record-level routing helpers.

The Kafka connector is not bundled with PySpark; ``read_topic`` and
``write_topic`` need ``org.apache.spark:spark-sql-kafka-0-10`` on the
classpath.  Everything else here is plain DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic names.
USER_MESSAGES = "userMessages"
SYSTEM_TEXT_MESSAGES = "systemTextMessages"
BOT_REQUESTS = "wvaUserMessages"
BOT_RESPONSES = "wvaSystemMessages"


def read_topic(spark: SparkSession, topics: list[str], bootstrap_servers: str,
               starting: str = "latest", **options: str) -> DataFrame:
    """Stream of ``(key, value, topic, partition, offset, timestamp)`` strings from topics.

    Offsets are tracked in the query's checkpoint, so a restarted query
    resumes where the last committed batch ended (the at-least-once redelivery
    the broker client provided before).  At scale pass
    ``maxOffsetsPerTrigger`` so a backlog is consumed in bounded batches, and
    ``minPartitions`` to split large topic partitions over more tasks.
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", ",".join(topics))
              .option("startingOffsets", starting))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("key").cast("string").alias("key"),
                                F.col("value").cast("string").alias("value"),
                                "topic", "partition", "offset", "timestamp")


def keyed(df: DataFrame) -> DataFrame:
    """Keep keyed records only; records without a key are skipped."""
    return df.where(F.col("key").isNotNull())


def drop_repeated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop what a producer's retry sent again: records of one key and value within ``delay`` of each other.

    For streams of keyed records with a ``timestamp``.  A retry gets an offset of its own, so
    the store's ledger of offsets cannot know it; the state holds the records of the last ``delay``.
    """
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["key", "value"])


def record_key(value: Column, length: int = 3) -> Column:
    """A short key derived from the record (stable across retries, unlike a random one)."""
    return F.substring(F.lower(F.hex(F.xxhash64(value))), 1, length)


def fan_out(df: DataFrame, topics: list[str], value_col: str = "value") -> DataFrame:
    """One output record per (record, topic) with a short derived key.

    ``explode`` over a literal topic list: the output is exactly
    ``len(topics)`` times the input, no join.
    """
    return df.select(F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"),
                     record_key(F.col(value_col)).alias("key"), "*")


def route(kind: Column) -> Column:
    """Topic for a payload kind: responses and requests go to their own topics."""
    return (F.when(kind == "response", F.lit(BOT_RESPONSES))
             .when(kind == "request", F.lit(BOT_REQUESTS)))


def write_topic(df: DataFrame, bootstrap_servers: str) -> None:
    """Batch-publish ``(topic, key, value)`` rows."""
    (df.select("topic", "key", "value").write.format("kafka")
       .option("kafka.bootstrap.servers", bootstrap_servers).save())
