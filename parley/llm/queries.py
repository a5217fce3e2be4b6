"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op1_warc", oracles.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.warc import archive_pages
    return archive_pages(table(spark, sf_dir, "pages"))


@register("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.sharding import shard_texts
    return shard_texts(table(spark, sf_dir, "documents"), shards=24)


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.learning import fold_of
    from parley.llm.toxicity import score_toxicity, train_toxicity
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", "predicted",
                         F.size("offending").cast("long").alias("n_offending"))


@register("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.quality import quality_rules, train_quality
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train_quality(docs, table(spark, sf_dir, "labels")))


@register("op6_decontamination", oracles.DECONTAMINATION)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.decontamination import build_index, decontaminate, read_items
    index = build_index(table(spark, sf_dir, "documents"))
    found = decontaminate(index, read_items(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@register("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.near_duplicates import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.suffix_index import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: A deployment passes its own secret; the registered query needs a stable one.
PSEUDONYM_KEY = "corpus-pseudonyms-v1"


@register("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.pseudonyms import pseudonymize
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


@register("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.byte_bpe import Vocabulary, read_ranks, token_digests
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digests(table(spark, sf_dir, "documents"), Vocabulary(ranks, public_tokenizers.PATTERN))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.whitening import whiten
    found = whiten(table(spark, sf_dir, "embeddings"), most=32)
    # null where a long cannot hold the sum (some 10^9 rows)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@register("op12_top_products", oracles.TOP_PRODUCTS)
def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.norm_search import top_products
    return top_products(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0, k=10)


@register("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.spelling import variants, word_counts
    return variants(word_counts(table(spark, sf_dir, "documents")), times=5)
