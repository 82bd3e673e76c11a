"""Connected components of an edge table by alternating star contraction.

Every step is a grouped minimum and a join; edges are written between rounds,
and only a count and a checksum reach the driver. A round joins the minimum
back from a written table, so the partition of a hot node can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with b <= a: link the larger (large) or
    the smaller (small) neighbours of every node to its least neighbour."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    j = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) -> (node, component): every node that has an edge, with
    the smallest node it can reach. Self-loops and null ends are ignored."""
    cur = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        cur = staged(_star(_star(cur, True), False), name)
        new = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state or new[0] == 0:
            break
        state = new
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
