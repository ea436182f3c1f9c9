"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accordant.sources.workspace import stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours.  A plain aggregate, so a hub's edges are
    combined before the shuffle; the extra grouping column leaves the following join its own
    exchange, whose large partitions can be split."""
    grouped = edges.groupBy("u", F.xxhash64("u").alias("h")).agg(F.min("v").alias("m"))
    return grouped.select("u", F.least("u", "m").alias("m"))


def _unsettled(e: DataFrame) -> int:
    """Nodes with more than one edge to a smaller node, or with edges to both smaller and larger ones: none, if
    the edges are stars around their least nodes."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    places = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return places.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list, root being the least node of its component.

    Alternating star contractions: each node's larger neighbours are hung under its least
    neighbour, then the smaller ones, until every component is a star around its least node.
    The number of rounds grows with the logarithm of the nodes.  Each round is written to the
    shared folder; edges with a null end are left out, a loop makes its node a component, and
    no edges give no rows.
    """
    start = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    # Loops stay in this first table only, for the nodes that have no other edge.
    given = stored(start.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    e = given.filter("u != v")
    for _ in range(rounds):
        if not _unsettled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large, "stars")
        small = large.join(_least(large), "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = stored(hung.filter("u != v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")))
    ends = ends.unionByName(given.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
