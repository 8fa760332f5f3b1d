"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step links nodes to the smallest neighbour they know, until every node is
linked to the smallest of its component and to nothing else. Minima are
aggregated before shuffling, so a node with very many neighbours is no burden;
edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. Edges go from the larger to the smaller node here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node long, component long (its smallest node) of every node of edges (a long, b long); an edge to itself makes a component of one."""
    since = common.mark()
    loops = edges.where("a = b").select("a").distinct()
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = common.written(links, "edges"), None
    while True:
        state = _state(links)
        if state == before or not state[0]:
            break
        before = state
        links = common.written(small_star(large_star(links)), "edges")
        common.sweep(links.sparkSession, since, links)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = nodes.unionByName(roots)
    alone = loops.select(F.col("a").alias("node")).join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
