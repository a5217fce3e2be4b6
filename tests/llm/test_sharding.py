import collections
import zlib

import pytest

from parley.llm import sharding
from parley.llm.sharding import longest_first, shard_texts


def check(got, docs, shards, spread):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs if i is not None)
    assert len(got) == len(docs) and {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    slots, loads, homes = collections.defaultdict(list), collections.Counter(dict.fromkeys(range(shards), 0)), collections.defaultdict(set)
    texts = dict(docs)
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        homes[texts[r.doc_id] or ""].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values()) and set(loads) == set(range(shards))
    assert max(loads.values()) - min(loads.values()) <= spread


def test_longest_first():
    assert longest_first([(3, b"a"), (5, b"b"), (3, b"c"), (2, b"d"), (2, b"e")], 2) == {b"b": 0, b"a": 1, b"c": 1, b"d": 0, b"e": 1}


@pytest.mark.parametrize("per_range", [1_000_000, 50])
def test_query(spark, monkeypatch, per_range):
    import __spark_entry__ as E
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", per_range)
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = E.queries()["op3_sharding"](spark, sf).collect()
    check(got, docs, 24, max(len(t.encode()) for _, t in docs))


def test_one_group_of_a_third_and_many_small_groups(spark):
    docs = [(i, "same" * 30 if i % 3 == 0 else f"{i:05d}" * 5) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = shard_texts(df, shards=4).collect()
    loads = collections.Counter()
    for r in got:
        loads[r.shard] += r.size
    hot = 2000 * 128
    assert sorted(loads.values())[-1] == hot                     # the group alone fills its shard
    rest = sorted(loads.values())[:-1]
    assert rest[-1] - rest[0] <= 0.01 * sum(rest)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "é", 6), (4, "x" * 50000, 7), (4, "x" * 50000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_texts(df, shards=3).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].shard == by[2].shard and (by[1].size, by[1].text_crc32) == (8, 0)
    assert by[None].size == 10 and len({r.shard for r in got if r.doc_id == 4}) == 1
    assert shard_texts(df.limit(0), shards=3).collect() == []
