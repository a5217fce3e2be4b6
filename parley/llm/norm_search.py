"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm): quantiles cut the norms into ranges, and a
range is dealt by hash into buckets of some ``bucket_rows`` rows, so one norm, or
one vector, may hold any share of the rows.  Queries stand in blocks of some
``block_rows``.  A first pass searches each block against one bucket of the longest
vectors; a query's k-th score there is a lower bound of its k-th score over all.
The bounds over a query's length order the blocks, and a pair of a block and a
bucket whose longest vector cannot reach the block's smallest bound is never made.

Inside a pair, each query has a local cosine threshold: its bound over its own
length and the bucket's greatest.  Where it is high, coordinates prune: a vector's
share in each of the query's largest coordinates must lie in the interval that
the threshold allows.  Elsewhere length prunes: only vectors long enough count.
Products of what is left are integers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.vectors import complete_rows, scaled
from parley.plans.stages import materialize

SCALE = 1024.0
#: Norm ranges at most; more rows make more buckets in each.
RANGES = 128
#: Local cosine from which coordinates prune, and how many of a query's coordinates are looked at.
COSINE, FOCUS = 0.6, 4
#: Products held at once by a task.
PRODUCTS = 1 << 22
#: Relative slack of the bounds, which are doubles; the products decide.
SLACK = 1e-9


def _pack(table: DataFrame) -> DataFrame:
    """(id, v: little-endian int64 components, norm) of distinct rows (id, vector)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat = scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), SCALE)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            exact = flat.astype(np.float64)
            squares = np.concatenate([[0.0], np.cumsum(exact * exact)]) if len(flat) and np.abs(flat).max() < 1 << 20 else None
            norms = (np.sqrt(squares[at[1:]] - squares[at[:-1]]) if squares is not None and squares[-1] < 2.0 ** 53 else
                     np.array([math.sqrt(math.fsum(x * x for x in exact[a:b])) for a, b in zip(at, at[1:], strict=False)], float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), pa.array(norms)],
                names=["id", "v", "norm"])

    return table.mapInArrow(pack, "id long, v binary, norm double").distinct()


def unpack(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; shorter ones are padded by zeros."""
    parts = column.to_pylist()
    sizes = np.array([len(v) // 8 for v in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), "<i8")
    dims = int(sizes.max(initial=0))
    if len(flat) == dims * len(parts):
        return flat.reshape(len(parts), dims)
    out = np.zeros((len(parts), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q and p (one is a function of doubles where those are exact)."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(p).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q @ p.T
    raise OverflowError("inner products leave 63 bits")


def _highest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids of highest score, an id's best score counting; ties to the smaller id."""
    take = k
    while True:
        if take < len(scores):
            floor = np.partition(scores, len(scores) - take)[len(scores) - take]
            near = np.flatnonzero(scores >= floor)
        else:
            near = np.arange(len(scores))
        order = near[np.lexsort((ids[near], -scores[near]))]
        first = np.sort(np.unique(ids[order], return_index=True)[1])
        if len(first) >= k or take >= len(scores):
            return ids[order[first[:k]]], scores[order[first[:k]]]
        take *= 4      # repeated ids: look further down


def search(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, p_ids: np.ndarray, p: np.ndarray, p_norms: np.ndarray,
           k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores): the k best vectors of one bucket that reach the query's bound, if any.

    ``bounds`` holds a lower bound of each query's k-th score, or -inf.  No vector
    of the query's own id counts.
    """
    order = np.argsort(-p_norms, kind="stable")
    p_ids, p, p_norms = p_ids[order], p[order], p_norms[order]
    longest = p_norms[0] if len(p_norms) else 0.0
    q_norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = p / np.where(p_norms > 0, p_norms, 1.0)[:, None]     # directions
        cosines = np.where(q_norms * longest > 0, bounds / (q_norms * longest), -np.inf)
        least = np.where(q_norms > 0, bounds / q_norms, -np.inf)      # of a vector's length
    # a positive bound asks for a length; of others any length may do
    reach = np.where(least > 0, np.searchsorted(-p_norms, -least * (1 - SLACK), side="right"), len(p))
    reach[(q_norms == 0) & (bounds > 0)] = 0
    by_length = np.flatnonzero(cosines < COSINE)
    step = max(1, PRODUCTS // max(len(p), 1))
    for at in range(0, len(by_length), step):
        some = by_length[at: at + step]
        n = reach[some].max(initial=0)
        for row, i in zip(products(q[some], p[:n]), some, strict=True):
            yield from _kept(i, q_ids, bounds, p_ids[: reach[i]], row[: reach[i]], k)
    for i in np.flatnonzero(cosines >= COSINE):
        if cosines[i] > 1 + SLACK:
            continue
        unit, c = q[i] / q_norms[i], min(cosines[i], 1.0)
        inside = np.arange(reach[i])
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            # cos = u_f s_f + rest, where rest is at most sqrt(1 - u_f^2) sqrt(1 - s_f^2)
            half = math.sqrt(max(0.0, (1 - c * c) * (1 - unit[f] ** 2))) + 1e-7
            lowest = -1.0 if unit[f] <= -c else c * unit[f] - half
            highest = 1.0 if unit[f] >= c else c * unit[f] + half
            s = shares[inside, f]
            inside = inside[(s >= lowest - SLACK) & (s <= highest + SLACK)]
        yield from _kept(i, q_ids, bounds, p_ids[inside], products(q[i: i + 1], p[inside])[0], k)


def _kept(i: int, q_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    use = (ids != q_ids[i]) & (scores >= bounds[i])
    if use.any():
        yield int(i), *_highest(ids[use], scores[use], k)


def _pairs(queries: DataFrame, vectors: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each planned pair (block; range, part), one group a pair.

    A group holds one block's queries and one bucket's vectors, whose bytes are parameters.
    """
    none = F.lit(None).cast("double")
    sides = queries.join(plan, "block").select("block", "range", "part", "id", "v", "bound", none.alias("norm")).unionAll(
        vectors.join(plan, ["range", "part"]).select("block", "range", "part", "id", "v", none.alias("bound"), "norm"))

    def one(group: pa.Table) -> pa.Table:
        asked = group.column("norm").is_null().to_numpy()
        v, ids = unpack(group.column("v")), group.column("id").to_numpy()
        bounds, norms = (group.column(c).to_numpy().astype(float) for c in ("bound", "norm"))
        q_ids, out = ids[asked], ([], [], [])
        for i, near, scores in search(q_ids, v[asked], bounds[asked], ids[~asked], v[~asked], norms[~asked], k):
            for place, x in zip(out, (np.full(len(near), q_ids[i]), near, scores), strict=True):
                place.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], names=["query_id", "vec_id", "score"])

    return sides.groupBy("block", "range", "part").applyInArrow(one, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best distinct vectors of each query."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cut(rows: DataFrame, column: str, ranges: int) -> tuple[Column, int]:
    """(number of the range that ``column`` is in, how many there are): quantiles make the ranges."""
    ranges = min(RANGES, ranges)
    cuts = sorted(set(rows.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    if not cuts:
        return F.lit(0), 1
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column))), len(cuts) + 1


def top_products(table: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                 bucket_bytes: int = 8 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with all other rows.

    Components become floor(1024 * x).  ``is_query`` is a condition on a column ``id``.
    Ties go to the smaller id; a query with fewer than k others gets all of them.  Rows
    whose id is null, or whose vector is null or holds null or non-finite components,
    take no part.  Vectors of different lengths are compared as if padded by zeros.
    An id names one item: repeated rows count once, of several vectors under one id the
    best product counts, and no query meets its own id.  Other columns do not matter,
    whatever their names; an empty table gives no rows.  A bucket takes some ``bucket_bytes``
    of vectors (8 bytes a component), a block some ``block_bytes`` of queries.
    """
    spark = table.sparkSession
    complete = complete_rows(table, id_col, vector_col).where("id IS NOT NULL").withColumn("id", F.col("id").cast("long"))
    rows = materialize(_pack(complete), "norm-rows")
    volume = F.sum(F.octet_length("v") + 8)
    total, asked_for = rows.agg(volume, F.sum(F.when(is_query, F.octet_length("v") + 8))).first()
    if not asked_for:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    number, _ = _cut(rows, "norm", math.ceil(total / bucket_bytes))
    placed = rows.withColumn("range", number)
    # a row per range: (range, parts, greatest length)
    filled = sorted((r.range, math.ceil(r.volume / bucket_bytes), r.longest) for r in placed.groupBy("range").agg(
        volume.alias("volume"), F.max("norm").alias("longest")).collect())
    parts = F.coalesce(*[F.when(F.col("range") == i, F.lit(n)) for i, n, _ in filled])
    vectors = materialize(placed.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts).cast("int")), "norm-buckets")
    blocks = math.ceil(asked_for / block_bytes)
    asked = vectors.where(is_query).select("id", "v", "norm")
    spread = F.xxhash64("v", "id")      # an id of many vectors fills several blocks

    # one bucket of the longest vectors gives each query a bound
    seeded = asked.select("id", "v", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.lit(float("-inf")).alias("bound"))
    plan = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(filled[-1][0]).alias("range"), F.lit(0).alias("part"))
    found = _best(_pairs(seeded, vectors, plan, k), k).where(F.col("rank") == k)
    kth = F.col("kth").cast("double")
    bound = F.coalesce(kth - F.abs(kth) * SLACK, F.lit(float("-inf")))      # a double must not be above the score
    bounded = materialize(asked.join(found.select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "id", "left").select(
        "id", "v", bound.alias("bound"), F.when((bound > 0) & (F.col("norm") > 0), bound / F.col("norm")).otherwise(F.lit(0.0)).alias("ratio")),
        "norm-bounds")

    # blocks of like ratios, so that a whole block can pass a range by
    number, ranges = _cut(bounded, "ratio", blocks)
    deal = math.ceil(blocks / ranges)
    queries = bounded.withColumn("block", number * deal + F.pmod(spread, F.lit(deal)).cast("int"))
    known = F.array(*[F.struct(F.lit(i).alias("range"), F.lit(n).alias("parts"), F.lit(x).alias("longest")) for i, n, x in filled])
    lows = queries.groupBy("block").agg(F.min("ratio").alias("ratio"))
    reach = lows.select("block", F.explode(F.filter(known, lambda r: r["longest"] >= F.col("ratio") * (1 - SLACK))).alias("r"))
    plan = materialize(reach.select("block", "r.range", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part")), "norm-plan")
    return _best(_pairs(queries, vectors, plan, k), k)
