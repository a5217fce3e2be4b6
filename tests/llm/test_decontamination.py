import hashlib
import random
import re

import numpy as np
import pytest

from parley.llm import decontamination
from parley.llm.decontamination import build_index, decontaminate, proximity_matches, read_items


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            grams.setdefault((n, tuple(w[a:a + n])), set()).add("" if i is None else str(i))
    sizes = {n for n, _ in grams}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if g := grams.get((n, tuple(w[a:a + n]))):
                    hit |= set(range(a, a + n))
                    found |= g
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [2000, 7])
def test_equals_brute_force(spark, block):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 5, 8, 20]))) for i in range(30)] + [(31, None), (32, " . "), (None, "A b"), (3, "c-c d")]
    docs = [(i, text(rnd.randint(0, 60)) + ".\n" + rnd.choice(items)[1].upper() if i % 3 == 0 and i % 2 else text(rnd.randint(0, 90)))
            for i in range(60) if i != 9]
    docs += [(100, None), (101, ""), (None, "a B"), (102, "é中 x"), (102, "é中 x"), (103, "a b " * 20000)]
    docs = [(i, t) for i, t in docs]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = build_index(df, shard_bytes=500)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)
           for r in decontaminate(index, read_items(bench), window=5, block=block).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, 5), key=str)
    assert decontaminate(build_index(df.limit(0)), read_items(bench)).collect() == []
    clean = decontaminate(index, read_items(bench.limit(0))).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)


def test_proximity(spark):
    docs = [(1, "red one two blue red"), (2, "blue x x x x x red"), (3, "red"), (4, "blue. Red"), (5, None)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted(map(tuple, proximity_matches(index, ["red", "blue"], span=4).collect()))
    assert got == [(1, 0, 4), (1, 3, 5), (4, 0, 2)]


def test_stretches():
    pairs = lambda *x: np.array(x, np.int64).reshape(-1, 2)
    assert decontamination.stretches([]).tolist() == decontamination.stretches([pairs()]).tolist() == []
    got = decontamination.stretches([pairs((5, 9), (1, 3)), pairs((2, 4), (4, 5), (20, 33), (21, 22))])
    assert got.tolist() == [[1, 9], [20, 33]]


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
                   for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), c) for i, n, h, f, c in brute(docs, items)]
    got = [tuple(r) for r in E.queries()["op6_decontamination"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(r[-1] for r in got)
