"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.byte_bpe import Vocabulary, read_ranks, token_digests
from parley.llm.decontamination import build_index, decontaminate, read_items
from parley.llm.near_duplicates import near_duplicates
from parley.llm.pseudonyms import pseudonymize
from parley.llm.queries import PSEUDONYM_KEY, table
from parley.llm.toxicity import score_toxicity, train_toxicity
from parley.plans.stages import materialize
from parley.session import scratch_path

#: Bytes of rows that go to a Python worker at once: a task holds them several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` at most from now on in this session, unless it asks for smaller ones; rows stay the same."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _by_text(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a digest of the text, and its name; for verdicts that rest on the text alone."""
    key = _fresh(docs, "__text_key")
    return docs.withColumn(key, F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))), key


def _without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``rejected`` and without that column; rows with a null key stay."""
    gone = rejected.select(F.col(key).alias("__gone")).where("__gone IS NOT NULL").distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti").drop(key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text the model calls toxic, whatever their id."""
    _bound_batches(spark)
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    # the verdict comes with the row: no text is shuffled
    return score_toxicity(docs, model, row_col="row").where("predicted = 0").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group (five-word shingles, similarity of 0.8 or more): the smallest id, rows without one last.

    Rows of one id with different texts are different documents.  Texts without
    words are in no group; of those that stand repeatedly under one id one stays.
    Among equal ids the order is that of digests of the text, then of the whole row.
    """
    _bound_batches(spark)
    key = _fresh(docs, "__row")
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    found = near_duplicates(rows.select(F.col(key).alias("row"), "text"), k=5, percent=80, id_col="row")
    order = rows.select(F.col(key).alias("row"), F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_digest"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_digest"), F.col(key).alias("row")).alias("place"))
    placed = materialize(found.join(order, "row"), "pipeline-places")
    worded = placed.where("n_shingles > 0").groupBy("component_id").agg(F.min("place").alias("first")).select("first.row")
    # without words only rows of one id and text are the same
    empty = placed.where("n_shingles = 0 AND NOT place.unnamed")
    empty = empty.groupBy("place.doc_id", "place.text_digest").agg(F.min("place").alias("first")).select("first.row")
    stay = worded.unionByName(empty).unionByName(placed.where("n_shingles = 0 AND place.unnamed").select("row"))
    return _without(rows, placed.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", key), key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows of whose words a twentieth or more stands in benchmark passages, whatever their id."""
    rows, key = _by_text(docs)
    found = decontaminate(build_index(rows, id_col=key), read_items(table(spark, sf_dir, "benchmark")), id_col=key)
    return _without(rows, found.where("contaminated"), key)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; ``n_chars``, if there, follows the text."""
    found = _fresh(docs, "__found")
    out = pseudonymize(docs, PSEUDONYM_KEY, found_col=found)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and the digest of what they decode to."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digests(docs, Vocabulary(ranks, public_tokenizers.PATTERN))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("decontamination", decontamination),
          ("pii", pii), ("byte_bpe", byte_bpe)]
#: SQL cannot express the stages; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the rows are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
