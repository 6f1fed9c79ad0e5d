"""Connected components by alternating large-star and small-star, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MOST_ROUNDS = 100


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reachable.

    edges: two columns of longs; nulls, loops and repeats are ignored. A hub's edges are only joined with the hub's minimum, never
    gathered: minima are partly aggregated before the shuffle and the joins may be split by adaptive execution. Each round is
    written to the shared folder, and the round before it is deleted.
    """
    a, b = edges.columns
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"`{a}` is not null and `{b}` is not null").filter("u > v").distinct()
    now = C.Cut(start, tag)
    mark = _mark(now.df)
    for _ in range(MOST_ROUNDS):
        new = C.Cut(_small_star(_large_star(now.df)), tag)
        now.drop()
        now, before = new, mark
        mark = _mark(now.df)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    side = edges.join(least, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return side.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
