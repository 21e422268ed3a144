"""Connected components of an edge table by alternating large-star and small-star rounds
(Kiveris et al., 2014): only (id, id) rows are shuffled, and the number of rounds grows with the
logarithm of the longest path. The smallest neighbour of a node is found by an aggregation, which
combines before the shuffle, so a node with very many neighbours is no task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or not larger) neighbours are linked to its smallest one."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.join(both.groupBy("u").agg(F.min("v").alias("low")), "u").withColumn("m", F.least("u", "low"))
    if large:
        out = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(both.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.
    Null ends and loops are ignored; repeated edges count once; no edges give no rows."""
    edges = cut(edges.filter(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).distinct())
    seen = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        state = edges.agg(F.count("*"), F.sum(F.expr("cast(pmod(xxhash64(u, v), 1000000007) as decimal(38,0))"))).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
