"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.plans.stages import materialize


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """Hang each node's neighbours on the smallest node near it.

    ``large``: the larger neighbours of every node; else the smaller ones (and the
    node itself).  The minimum is aggregated map-side, written and joined back,
    so Spark can split the rows of a node with very many neighbours.
    """
    pairs = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialize(pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m")), "least")
    near = pairs.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(near.select("a", F.col("m").alias("b")))
    return materialize(out.where("a <> b").distinct(), "star")


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (two columns a, b); component is its smallest node.

    Each round is a large-star and a small-star step; a written table between the
    rounds cuts the lineage.  Rounds grow with the logarithm of the longest chain.
    Self-links, repeated and reversed links are allowed; null ends are left out.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(most_rounds):
        edges = _star(_star(edges, large=True), large=False)
        # stars have one edge per leaf: done when nothing has moved
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
