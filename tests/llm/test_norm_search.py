import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import norm_search
from parley.llm.norm_search import search, top_products


def brute(rows, k=10, step=100):
    """{query id: [(score, id)]} from (id, vector); an id's best product counts."""
    ok = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows
          if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for q, a in ok:
        if q % step == 0:
            best = out.setdefault(q, {})
            for p, b in ok:
                if p != q:
                    s = sum(x * y for x, y in zip(a, b, strict=False))
                    best[p] = max(best.get(p, s), s)
    return {q: sorted(((s, p) for p, s in best.items()), key=lambda x: (-x[0], x[1]))[:k] for q, best in out.items() if best}


def lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


SCHEMA = "vec_id long, embedding array<double>, id string, norm int"


def run(spark, rows, step=100, **sizes):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return lists(top_products(table, F.pmod("id", F.lit(step)) == 0, **sizes).collect())


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = E.queries()["op12_top_products"](spark, sf)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert lists(out.collect()) == brute(rows)


def test_many_buckets_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(20, 6))
    rows = [(i, ((base[i % 20] + 0.05 * rng.normal(size=6)) * rng.lognormal(sigma=1.5)).tolist()) for i in range(900)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)]       # one vector under very many ids
    pruned = []
    real = norm_search._pairs

    def counted(q, v, plan, k):
        pruned.append((plan.count(), q.select("block").distinct().count() * v.select("range", "part").distinct().count()))
        return real(q, v, plan, k)

    monkeypatch.setattr(norm_search, "_pairs", counted)
    assert run(spark, rows, step=10, bucket_bytes=4000, block_bytes=1000) == brute(rows, step=10)
    made, all_pairs = pruned[1]
    assert all_pairs > 60 and made < 0.8 * all_pairs       # the others were never made


def test_nulls_lengths_repeated_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -3.0]), (2, [0.5, -3.0]), (3, [0.5]), (4, []), (None, [9.0, 9.0]),
            (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("-inf"), 1.0]), (100, [-1.0, 2.0]), (100, [2.0, 2.0]), (200, [])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == {} and run(spark, []) == {} and run(spark, [(1, [1.0]), (2, [2.0])]) == {}


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, size=3)]) for i in range(0, 300, 3)]
    assert run(spark, rows, step=10) == brute(rows, step=10)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 8), st.integers(1, 60), st.sampled_from([0.02, 0.5, 3.0]), st.integers(1, 5))
def test_search_keeps_all_that_reach_the_bound(seed, dims, n, noise, k):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims) * 1000
    p = np.floor((centre + noise * 1000 * rng.normal(size=(n, dims))) * rng.choice([0.0, 0.1, 1.0, 4.0], size=(n, 1))).astype(np.int64)
    q = np.floor(centre + noise * 500 * rng.normal(size=(4, dims))).astype(np.int64)
    p_ids = rng.integers(0, n, size=n)
    q_ids = np.array([0, 1, 2, -5])
    exact = q @ p.T
    bounds = np.array([-np.inf, *[float(np.sort(row)[rng.integers(0, n)]) for row in exact[1:]]])
    norms = np.sqrt((p.astype(float) ** 2).sum(axis=1))
    got = {i: list(zip(scores.tolist(), ids.tolist(), strict=True)) for i, ids, scores in search(q_ids, q, bounds, p_ids, p, norms, k)}
    for i in range(4):
        best = {}
        for s, v in zip(exact[i].tolist(), p_ids.tolist(), strict=True):
            if v != q_ids[i] and s >= bounds[i]:
                best[v] = max(best.get(v, s), s)
        assert got.get(i, []) == sorted(((s, v) for v, s in best.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_products_refuse_to_overflow():
    big = np.full((1, 4), 1 << 40, np.int64)
    with pytest.raises(OverflowError):
        norm_search.products(big, big)
