"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is a group minimum (with partial aggregation) and an equi-join, so a node with very many
neighbours never has to fit one task; the edges of each round are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_hot, stored

#: Rounds grow with the logarithm of the longest chain; this many never occur.
MAX_ROUNDS = 100


def _signature(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the component's smallest node."""
    e = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _signature(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = F.count_if(F.col("b") > F.col("a")).alias("n")
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), larger).where("n > 0"))
        # a node may be linked with a third of all others
        pairs = join_hot(both.where("b > a"), least, ["a"], "n")
        large = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def name_components(linked: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(node, component): the least ``name`` that ``names`` (node, name) has for a node of the component; ``linked`` is
    (node, root)."""
    linked = stored(linked)
    roots = stored(linked.join(names, "node").groupBy("root").agg(F.min(name).alias("component"), F.count("*").alias("size")))
    return join_hot(linked, roots, ["root"], "size").select("node", "component")
