"""Connected components of a graph of integer nodes, by joins and minima alone.

Each turn points every node's larger neighbours at its smallest one (large star),
then its smaller ones (small star), until all edges lead to a root. The number of
turns grows with the logarithm of the graph's size; nothing is collected. Edges are
read in as many partitions as their number needs, so that those of a small graph,
which fit one, aren't dealt out over all of the session's in each turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common

EDGES = 100_000         # in a partition, with both directions


def components(edges: DataFrame, saved: Callable[[DataFrame, str], DataFrame] = common.saved) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); ``root`` is the smallest node
    of its component, whose own row is included. ``saved`` writes each turn's edges."""
    e = forest(edges, saved)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def forest(edges: DataFrame, saved: Callable[[DataFrame, str], DataFrame] = common.saved) -> DataFrame:
    """(u, v) of every node u of ``edges`` that isn't its component's smallest node v."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = saved(e, "edges")
    parts = 1 + 2 * e.count() // EDGES
    while not _flat(e, parts):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(low.withColumnRenamed("m", "v")).coalesce(parts).distinct(), "edges")
    return e


def _flat(e: DataFrame, parts: int) -> bool:
    """Every node has one edge, to a node that has none."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("out"))).coalesce(parts)
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
    return seen.filter("out > 1 or out = 1 and low = 0").isEmpty()
