import collections
import random
import re

import numpy as np
import pyarrow as pa

from parley.llm import quality
from parley.llm.quality import QualityModel, base_counts, quality_rules, read_texts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_brute_force():
    rnd = random.Random(5)
    bits = ["a", "b", " ", " ", "\n", "\n", "é", "\t", "##", " a b a b a ", "\x0b", "\x1c", "\x85", "line\n", "😀 "]
    texts = [None, "", "\n", " ", "x\n\nx\n", "a b c d e\na b c d e"] + [
        "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["same words here and again " * 5000]
    for k in range(0, len(texts), 700):
        part = texts[k:k + 700]
        got = base_counts(read_texts(pa.array(part, pa.string())))
        rows = list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert rows == [brute(t) for t in part]


def test_rows(spark):
    model = QualityModel(np.zeros(4 << 14), 0.0, 0.0, 40.0, 14)
    rows = [(1, None, True), (2, "", True), (None, " ".join(f"w{i}" for i in range(10)), True), (4, "a " * 10, True), (4, "a " * 10, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = sorted(((r.doc_id, r.base_failed, r.kept) for r in quality_rules(df, model).collect()), key=str)
    assert got == sorted([(1, True, False), (2, True, False), (None, False, True), (4, True, False), (4, True, False)], key=str)
    assert quality_rules(df.limit(0), model).collect() == []


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in E.queries()["op5_quality"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i in list(docs)[::37]:
        r = got[i]
        n = brute(docs[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    judged = [(got[i].kept, y) for i, y in labels if not got[i].base_failed]
    assert sum(k == bool(y) for k, y in judged) / len(judged) > 0.98
    assert sum(k for k, y in judged if y == 1) / sum(y for _, y in judged) > 0.99


def test_character_grams_are_code_points():
    texts = ["añb中😀c", "", "中文", "añb", "xyz中😀c"]
    t = quality.read_texts(pa.array(texts))
    points, at = quality.code_points(t)
    assert np.diff(at).tolist() == [len(x) for x in texts]
    for n in (3, 5):
        hashes, first = quality.char_grams(points, at, n)
        want = [x[i: i + n] for x in texts for i in range(len(x) - n + 1)]
        assert np.diff(first).tolist() == [max(0, len(x) - n + 1) for x in texts] and len(hashes) == len(want)
        for i, x in enumerate(want):
            assert [h == hashes[i] for h in hashes] == [y == x for y in want]
