import os
import random

import public_tokenizers as P
from tokenizers import Tokenizer

from parley.llm import token_counts as token_counts_module
from parley.llm.token_counts import TokenCounter, read_merges, token_counts

PATH = P.path("byte_bpe_50k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def strange(n):
    rnd = random.Random(3)
    bits = ["a", "the ", " the", "\n", "  ", "\t", "é", "ß", "中文", "<|endoftext|>", "'s", "'ll", "9", "12 3", "!?", " ",
            " ", "\x1c", "😀", "\x85", " ", "Word", "zzzz", "\r\n", "é", "<|endof", "\x00"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_counter_equals_the_library():
    counter = TokenCounter(*read_merges(PATH))
    texts = [*strange(4000), "", "x" * 20000, "ab " * 9000, "thnt " + "q" * 3000]
    assert [counter.count(t) for t in texts] == expected(texts)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "the cat", None), (4, "the cat", "z"), (4, "the cat", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(df, PATH, limit=1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 7, 2, True), (4, 7, 2, True), (4, 7, 2, True)], key=str)
    assert token_counts(df.limit(0), PATH).collect() == []


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in E.queries()["op10_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, expected([d.text for d in docs]), strict=True):
        assert tuple(got[d.doc_id]) == (d.doc_id, len((d.text or "").encode()), n, n > 1024)


def test_what_a_worker_remembers_is_bounded():
    counter = TokenCounter(*read_merges(PATH))
    texts = [chr(0x4E00 + i) * 5000 for i in range(40)]      # no blanks: each a single piece
    assert [counter.count(t) for t in texts] == expected(texts)
    assert not counter.plain and not counter.spaced
    memory = token_counts_module._Memory(len)
    for i in range(300_000):
        memory[f"{i:060d}"]
    assert 60 * len(memory) == memory.chars <= token_counts_module.MEMORY_CHARS
