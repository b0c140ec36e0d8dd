"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a bigint, b bigint): nodes share a root if and only if they are linked.

    In each round a node moves to the neighbour (or itself) that comes first in an order drawn anew by hashing; the
    edges between the places so reached, doubles and loops left out, are the next round's. A constant share of the
    nodes vanishes each round, whatever the shape of the graph. All state is in tables; the maps of the rounds are
    joined from the last to the first.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, k=len(maps): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        moved = stored(first.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["v"].alias("to")))
        maps.append(moved)
        step = links.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        links = stored(step.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for moved in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = stored(moved.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return roots
