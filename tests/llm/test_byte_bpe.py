import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from parley.llm import byte_bpe
from parley.llm.byte_bpe import Vocabulary, encode_texts, merge_by_heap, read_ranks, token_digests

RANKS = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def strange(n):
    rnd = random.Random(9)
    bits = ["a", "the ", " the", "\n", "  ", "\t", "é", "ß", "中文", "<|endoftext|>", "'s", "'ll", "9", "12 3", "!?", " ", "　",
            "\x1c", "😀", "\x85", " ", "Word", "zzzz", "\r\n", "é", "ungeheit", "\x00", " ", "réeux", "-", "ñ", "​", "١٢"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 200, 1 << 20])
def test_equals_the_library(spark, library, monkeypatch, chunk):
    monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
    rows = [(i, t, "x") for i, t in enumerate(strange(400))]
    rows += [(-1, None, "x"), (-2, "", "x"), (None, "one two", "x"), (7, rows[7][1], "x"), (-3, "q" * 300, "x"), (-4, "thnt é " * 3000, "x"), (-5, "漢字" * 4000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    got = [tuple(r) for r in token_digests(df, Vocabulary(RANKS, P.PATTERN)).collect()]
    assert sorted(got, key=str) == sorted([(i, *expected(library, t)) for i, t, _ in rows], key=str)


def test_empty_and_round_trip(spark):
    vocabulary = Vocabulary(RANKS, P.PATTERN)
    df = spark.createDataFrame([(1, "Grüße, 世界!\n"), (2, None)], "doc_id long, text string")
    assert token_digests(df.limit(0), vocabulary).collect() == []
    out = encode_texts(df, vocabulary).withColumn("back", vocabulary.decode(F.col("ids")).cast("string"))
    assert {r.doc_id: r.back for r in out.collect()} == {1: "Grüße, 世界!\n", 2: ""}


def test_query(spark, library):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = [tuple(r) for r in E.queries()["op8_byte_bpe"](spark, sf).collect()]
    assert sorted(got) == sorted((r.doc_id, *expected(library, r.text)) for r in docs)


def test_heap_and_fold_agree(spark, library, monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeäöü中 ") for _ in range(rnd.randint(1, 40))) for _ in range(300)] + ["a" * 64, "ab" * 31]
    vocabulary = Vocabulary(RANKS, P.PATTERN)
    pairs = spark.createDataFrame([(len(w) % 7, c, w) for w in words for c in range(3)], "bucket int, chunk long, word string")
    folded = byte_bpe._folded(pairs, vocabulary)
    assert folded.count() == 3 * len(words)
    folded = folded.withColumn("back", vocabulary.decode(F.col("ids"))).collect()
    assert {r.word: r.ids for r in folded} == {w: ",".join(map(str, merge_by_heap(w.encode(), RANKS))) for w in words}
    assert all(bytes(r.back) == r.word.encode() for r in folded)


def test_numbers_pack():
    numbers = [0, 1, 255, 256, 70_000, (1 << 24) - 1] * 7
    assert byte_bpe._unpacked(byte_bpe._packed(numbers)) == numbers and byte_bpe._unpacked(byte_bpe._packed([])) == []


def test_a_very_long_word(library):
    import time
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))
    began = time.monotonic()
    assert merge_by_heap(word.encode(), RANKS) == library.encode_ordinary(word)
    assert time.monotonic() - began < 20


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "old", [1, 2], None), (2, None, "old", None, 2.5)], "number int, text string, ids string, word array<int>, chunk double")
    got = {r.number: r for r in encode_texts(df, Vocabulary(RANKS, P.PATTERN)).collect()}
    assert got[1].word == [1, 2] and got[2].chunk == 2.5 and got[2].ids == "" and got[1].ids != "old" and got[1].text == "a b"


def test_texts_stay_where_they_are_written(spark):
    """Only words and their ids are shuffled; the texts' side of the cogroup is read in buckets by chunk."""
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    plan = token_digests(df, Vocabulary(RANKS, P.PATTERN))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(exchanges) == 2 and not any("__codes" in line for line in exchanges)
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(chunk" in plan and "hashpartitioning(__chunk" not in plan


def test_texts_of_a_chunk_are_packed_together(spark):
    rows = [(i, f"some words {i % 5} and more of them") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    coded = byte_bpe._coded(df, Vocabulary(RANKS, P.PATTERN), "text", ["id"])
    texts = coded.where("__bucket IS NULL")
    assert texts.count() == 200 and texts.where("__codes IS NOT NULL").count() < 20


def test_the_vocabulary_is_not_in_the_plan(spark):
    """Ranks come by a subquery: no text of the plan holds them, and no row carries them."""
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    made = token_digests(df, Vocabulary(RANKS, P.PATTERN))._jdf.queryExecution()
    assert len(made.toString()) < 200_000
    plan = made.executedPlan().toString()
    assert "Subquery" in plan
    carried = [line for line in plan.splitlines() if "__maps#" in line or " AS maps#" in line]
    assert all("LocalTableScan" in line for line in carried)


def test_the_fold_copies_no_arrays(spark):
    """A step cuts and joins strings: Spark's slices and concatenations of arrays take twice its time."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = token_digests(df, Vocabulary(RANKS, P.PATTERN))._jdf.queryExecution().analyzed().toString()
    assert "overlay(" in plan and "slice(" not in plan


@pytest.mark.parametrize("pattern", [P.PATTERN, r"[^\p{N}\p{L}\s]+|\S", r"\p{Lu}\p{Ll}*|\s+(?=\p{Nd})", r"(?i)ß|\w+", r"\d+|[[a-z]--[b]]"])
def test_words_are_cut_as_by_regex(pattern):
    import regex
    blanks = byte_bpe._with_blanks(pattern)
    cut, texts = byte_bpe._cutter(blanks), strange(200) + ["", "a😀b", "𝐀1 𝟘x"]
    texts += ["".join(map(chr, range(a, a + 64))) + "x 1" for a in [*range(0, 0xD800, 64), *range(0xE000, 0x11000, 64), *range(0x1D400, 0x1D800, 64)]]
    for text in texts:
        assert cut(text) == regex.findall(blanks, text)


def test_texts_without_words_beside_others(spark, library):
    """Empty texts first, last and alone, and more texts in a chunk than are put together at a time."""
    rows = [(i, None if i % 3 == 0 else f"{i} word" * (i % 7)) for i in range(200)] + [(200, "")]
    for some in (rows, rows[:1]):
        df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        got = [tuple(r) for r in token_digests(df, Vocabulary(RANKS, P.PATTERN)).collect()]
        assert sorted(got) == [(i, *expected(library, t)) for i, t in some]
