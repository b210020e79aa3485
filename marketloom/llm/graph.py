"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, saved


def _with_least(d: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """d (u, v) with m, the least v of each u; and the table u, m, n."""
    low = saved(d.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    return join_spread(d, low, "u", "n", rows), low


def _stars(pairs: DataFrame, rows: int) -> DataFrame:
    """One large star and one small star; pairs hold (u, v) with u > v."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near, _ = _with_least(both, 2 * rows)
    large = near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()
    near, low = _with_least(saved(large), rows)
    small = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the least node.

    Each round aggregates with map-side combine; the edges of hubs are joined by broadcast, so that no task holds
    all of a hub's; rounds grow with the logarithm of the longest path. Null ends and loops are
    ignored (a node that has only loops is not returned); no edges give an empty table.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = saved(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(pairs)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        pairs = saved(_stars(pairs, seen[0]))
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
