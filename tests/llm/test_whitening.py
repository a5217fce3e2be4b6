import math
from fractions import Fraction

import numpy as np
import pytest

from parley.llm import whitening
from parley.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def brute(rows, most=32):
    """{id: (deviation, y / n)}, n, exact covariance as fractions, from (id, vector)."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(ok)
    sums = [sum(col) for col in zip(*[v for _, v in ok], strict=True)]
    y = [(i, [n * x - s for x, s in zip(v, sums, strict=True)]) for i, v in ok]
    d = len(sums)
    cov = [[Fraction(sum(v[a] * v[b] for _, v in y), n ** 3) for b in range(d)] for a in range(d)]
    return y, n, cov


def check(got, rows, dims, most=32):
    y, n, cov = brute(rows)
    v = np.array([[float(c) for c in row] for row in cov])
    values, columns = np.linalg.eigh(v)
    values = values[::-1]
    assert len(got) == n * min(most, dims) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    w = np.array([[by[i][c].whitened for c in range(1, min(most, dims) + 1)] for i, _ in y])
    assert {i: next(iter(by[i].values())).deviation for i, _ in y} == {i: sum(c * c for c in r) for i, r in y}
    for c in range(1, min(most, dims) + 1):
        assert by[y[0][0]][c].explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
    centred = np.array([[c / n for c in r] for _, r in y])
    # unit eigenvectors of V: back from the whitened rows by least squares
    axes = np.linalg.lstsq(centred, w * np.sqrt(values[: w.shape[1]]), rcond=None)[0]
    assert np.allclose(v @ axes, axes * values[: w.shape[1]], atol=1e-7 * values[0])
    assert np.allclose((axes ** 2).sum(axis=0), 1, atol=1e-9)
    error = np.abs(np.cov(w.T, bias=True).reshape(w.shape[1], -1) - np.eye(w.shape[1])).max()
    assert error < 1e-9 and abs(got[0].identity_error - error) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = E.queries()["op13_whitening"](spark, sf)
    assert dict(out.dtypes)["deviation"] == "bigint"
    check(out.collect(), rows, 64)


def test_small_dims_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(a + b), float(c) * 9]) for i, (a, b, c) in enumerate(rng.normal(size=(200, 3)))]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 0.0, 0.0]), (904, [1.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + bad], SCHEMA)
    check(whiten(table).collect(), rows, 3)
    check(whiten(table, most=2).collect(), rows, 3, most=2)


def test_repeated_rows_and_null_ids(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -2.0]), (4, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = whiten(table).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1"] * 4 + ["4"] * 2 + ["None"] * 2 and {r.n for r in got} == {4}


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = whiten(same).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and got[0].identity_error < 1e-9 and len(got) == 18
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, 0.0)] * 2
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0


def test_large_numbers_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 64)
    rows = [(i, [float((i * 7919) % 1013) * 1e9, float((i * 104729) % 997) * 3e8]) for i in range(300)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert dict(got.dtypes)["deviation"] == "decimal(38,0)"
    check(got.collect(), rows, 2)


def test_square_sums_are_exact():
    rng = np.random.default_rng(5)
    for high in (1 << 20, 1 << 31, 1 << 45, (1 << 62) - 1):
        z = rng.integers(-high, high, size=(500, 3))
        assert whitening._square_sums(z) == [sum(int(v) ** 2 for v in z[:, k]) for k in range(3)]
