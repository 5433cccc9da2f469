"""Distributed connected components by alternating star contractions.

Each round first hangs every larger neighbour of a node on the smallest node around it, then every smaller one. Trees
get flat in a logarithmic number of rounds, and no round makes more rows than there are edges. Both halves are a
grouped minimum (combined before the shuffle) and an equi-join in which hubs, nodes of many edges, are broadcast and
their edges dealt over all tasks. Edges lie in the shared folder between rounds and never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.common import cut, hub_join


def _star(ends: DataFrame, rows: int) -> DataFrame:
    """``ends``: (u, v). The smallest of u and its v, as m, beside each v."""
    least = ends.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"), F.count("*").alias("n"))
    return hub_join(ends, least, "u", "w", "n", rows).select("u", "v", F.least("u", "low").alias("m"))


def _sign(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Node values may be of any type that has an order. Edges with a null end and loops are ignored; repeated edges
    count once. No edges: no rows.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x") != F.col("y"))
    now = cut(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _sign(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large.distinct(), before[0])
        now = cut(
            small.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        after = _sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
