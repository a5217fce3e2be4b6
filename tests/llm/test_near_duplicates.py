import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from parley.llm.components import components
from parley.llm.near_duplicates import estimate, near_duplicates, registers, shingle_sets


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)   # pairs that share a shingle
    for n, (i, s) in enumerate(sets):
        for g in s if i is not None else ():
            by[g].append(n)
    seen = set()
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                (i, s), (j, t) = sets[a], sets[b]
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]


def check(spark, docs, k, percent, **schema):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, signature string").repartition(5)
    got = [tuple(r) for r in near_duplicates(df, k=k, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, k, percent), key=str)
    return got


def test_near_copies_chains_and_edges(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    docs, n = [], 0
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([2, 4, 9, 30, 120, 400]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.5:
                base = copy   # chains of copies of copies
            docs.append((n, rnd.choice([" ", "\n"]).join(copy)))
            n += 1
    line = "the same line that stands in a great many of these documents here"
    docs += [(n + i, line + " " + " ".join(word() for _ in range(6))) for i in range(150)]
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "one two"), (None, docs[0][1]), (None, ""),
             (5006, "z " * 30000), (5007, "z " * 4), (5008, "z z"), (7, docs[7][1])]
    rnd.shuffle(docs)
    check(spark, docs, 3, 85)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(200)]
    docs = []
    for i in range(400):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(200)] = f"x{rnd.randrange(10 ** 6)}"
        docs.append((i, " ".join(copy)))
    got = check(spark, docs, 3, 85)
    assert sum(r[3] for r in got) < 100


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)] + [(500, 501), (501, 501), (None, 3), (199, 0)]])
def test_components(spark, edges):
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {x: 0 for e in edges for x in e if x is not None and x < 500} | ({500: 500, 501: 500} if edges[-1][0] == 199 else {})
    assert got == want


def test_registers_and_estimate():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (6000, 2000, 2000))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    rows = registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    value, n = estimate(rows[:1], rows[1:])
    assert n[0] == 128 and abs(value[0] - 0.6) < 0.18
    unrelated = registers(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert estimate(unrelated[:1], unrelated[1:])[0][0] < 0.05
    assert registers(np.zeros(0, np.uint64), np.array([0, 0])).sum() == 0


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in E.queries()["op9_near_duplicates"](spark, sf).collect()]
    assert sorted(got) == sorted(brute(docs, 3, 85))


def test_copies_off_their_head_still_meet(spark):
    """Families inside one large group: their heads are off the group's head, their members near each other."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for family in range(12):
        root = list(base)
        for at in rnd.sample(range(160), 7):
            root[at] = f"f{family}_{at}"
        for i in range(20):
            copy = list(root)
            copy[rnd.randrange(160)] = f"x{family}_{i}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + i, " ".join(base[:i] + base[i + rnd.randint(3, 9):])) for i in range(0, 150, 3)]
    rnd.shuffle(docs)
    check(spark, docs, 3, 85)
    check(spark, docs, 5, 80)


@pytest.mark.parametrize("k", [1, 2, 5, 8, 13])
def test_shingles_of_a_slice_with_few_words(k):
    for counts in itertools.product([0, 1, 2, 3, 4, 7], repeat=2):
        texts = [" ".join(f"w{i}" for i in range(n)) for n in counts]
        for column in (texts, texts[:1]):
            assert np.diff(shingle_sets(pa.array(column), k)[1]).tolist() == [len(shingles(t, k)) for t in column]


def test_tasks_of_few_words(spark):
    texts = [None, "", "a", "a b", "a b c", "c b a", "A  b c", "a b c d", "a b c d e", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(len(texts), "doc_id")
    got = sorted(tuple(r) for r in near_duplicates(docs, k=5, percent=80).collect())
    assert got == sorted(brute(list(enumerate(texts)), 5, 80))
