import hashlib
import random

import pytest

from parley.llm import suffix_index
from parley.llm.suffix_index import SuffixFamily, remove_repeats


def brute(docs, length):
    """Strings are looked up in the order (id, start); rows that repeat an id count once."""
    seen, cover = {}, {}
    for i, t in sorted({(i, t or "") for i, t in docs if i is not None}):
        data = t.encode()
        for a in range(len(data) - length + 1):
            s = data[a:a + length]
            if seen.setdefault(s, (i, a)) != (i, a):
                cover.setdefault(i, set()).update(range(a, a + length))
    out = []
    for i, t in docs:
        data, gone = (t or "").encode(), cover.get(i, set()) if i is not None else set()
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(data), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdé fg") for _ in range(n))
    passages = [word(n) for n in (60, 99, 100, 101, 130, 250, 400)]
    docs = [(3 * i, word(rnd.randint(0, 90)).join(rnd.choices(passages, k=rnd.randint(0, 4))) + word(rnd.randint(0, 300))) for i in range(120)]
    docs += [(3 * i + 1, docs[rnd.randrange(120)][1]) for i in range(40)]
    edited = [list(docs[rnd.randrange(120)][1]) for _ in range(60)]
    for e in edited:
        for _ in range(rnd.randint(0, 3)):
            if e:
                e[rnd.randrange(len(e))] = "Z"
    docs += [(3 * i + 2, "".join(e)) for i, e in enumerate(edited)]
    docs += [(1000, None), (1001, ""), (1002, "x" * 700), (1003, "x" * 99), (1004, "ab " * 3000), (-5, "ab " * 40), (None, passages[5]), (None, None)]
    docs += [docs[5], docs[5]]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize(("batches", "many"), [(1, 50_000), (2, 0), (5, 3)])
def test_equals_brute_force(spark, monkeypatch, batches, many):
    monkeypatch.setattr(suffix_index, "MANY", many)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, head string").repartition(6)
    got = [tuple(r)[:5] for r in remove_repeats(df, batches=batches).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, 100), key=str)


def test_levels_merge_geometrically(spark):
    df = spark.createDataFrame([(i, f"{i % 3} some text {i}" * 30) for i in range(70)], "id long, text string")
    family = SuffixFamily(100)
    ranks = []
    for i in range(7):
        family.add(df.where(f"id >= {10 * i} AND id < {10 * i + 10}"))
        ranks.append([r for r, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in E.queries()["op4_suffix_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(brute(docs, 100))
