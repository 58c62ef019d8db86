"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame, folder: str) -> DataFrame:
    """Each vertex links its larger neighbours to the least of itself and all its neighbours. Minima are a table in `folder`."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder)
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, folder: str) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them. Edges have a > b, and are a table; minima are one in `folder`."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), folder)
    others = edges.join(least.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(others).distinct()


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(vertex, label) for every vertex of edges (a, b): label is the least vertex that it can reach.

    Vertices are longs. Repeated edges, either direction and self-loops do no harm (a vertex that has only
    self-loops isn't returned). Each round is written to `folder` and starts from what was written, so a lost
    executor costs one round; the number of rounds is logarithmic. Minima are combined before they are
    shuffled, and joined to edges from tables, so that Spark splits the join where a vertex is hot.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), f"{folder}/round-0")
    state, k = None, 0
    while True:
        was, state = state, tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == was or not state[0]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("label")).unionAll(now.select(F.col("b"), F.col("b"))).distinct()
        k += 1
        large = written(_large_star(now, f"{folder}/large-{k}"), f"{folder}/half-{k}")
        now = written(_small_star(large, f"{folder}/small-{k}"), f"{folder}/round-{k}")
