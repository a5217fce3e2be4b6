import collections
import random
import re
import zlib

import pytest

from parley.llm.spelling import neighbours, variants, word_counts


def brute_counts(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 199 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1:]
            n[low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_near(words):
    """{word: near words} by the words' one-deletion forms, which all near words share one of or are one of."""
    by = collections.defaultdict(set)
    for w in words:
        by[w].add(w)
        for k in range(len(w)):
            by[w[:k] + w[k + 1:]].add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    return near


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return (a[p + 1:] if len(a) == len(b) else a[p:]) == b[p + 1:] and a != b


def brute(n):
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    import __spark_entry__ as E
    sf = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(brute_counts(docs))
    assert rows(E.queries()["op11_spelling"](spark, sf)) == want and any(w[3] for w in want)


def test_counts(spark):
    docs = [(i, f"Running, RUNNING runningÉx cafésÀ {'long' * 3000} short") for i in range(450)]
    docs += [(7, "Running")] * 3 + [(None, "running"), (None, None), (451, ""), (452, None)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, run string, n int")
    got = {r.word: r.n for r in word_counts(table).collect()}
    assert got == brute_counts(docs) and got["running"] > 890 and "long" * 3000 in got
    assert word_counts(table.where("false")).count() == 0


def test_frontier_finds_every_pair(spark):
    random.seed(4)
    words = set()
    for alphabet, length in (("ab", 7), ("abc", 6), ("aéÿØ", 5)):
        for _ in range(150):
            words.add("".join(random.choice(alphabet) for _ in range(random.randint(1, length))))
    words |= {"a" * k for k in range(6, 40)} | {"z" * 2000, "z" * 2001, "z" * 1000 + "y" + "z" * 1000, "y" + "z" * 2000}
    got = neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    pairs = collections.Counter(frozenset((r.a, r.b)) for r in got)
    assert set(pairs) == {frozenset((a, b)) for a, near in brute_near(words).items() for b in near}
    assert set(pairs.values()) == {1}


def test_ties_chains_and_few_words(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "cccccc": 5, "cccccd": 30, "ccccce": 30, "single": 9, "singleé": 10}
    got = rows(variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][5] == "aabbbb" and by["cccccc"][3] == "cccccd" and by["single"][3] is None
    one = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert rows(variants(one)) == [("lonely", 9, 0, None, None, "lonely")]
    assert rows(variants(one.where("false"))) == []
    with pytest.raises(ValueError):
        variants(one, times=1)
