"""Connected components of a table of links, by rounds of joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pliego.session import kept

ROUNDS = 60  # a path of n nodes needs about log n rounds


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of bigint ids to one row (node, component) per node that has a link; component is the smallest id.

    Large-star and small-star steps alternate until all components are stars: each node hands its larger neighbours, then its
    smaller ones, on to the smallest. Both are joins on a minimum per node, so a node with very many links is split by
    the adaptive skew join. Links to itself, repeated links and both directions of a link are allowed; links with a null
    end are left out; an empty table gives no rows.
    """
    edges = kept(_tidy(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    for _ in range(ROUNDS):
        if _settled(edges):
            break
        edges = kept(_step(_step(edges, large=True), large=False), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller id."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a node goes to the node's minimum. Small: every neighbour below it does."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("w"))
    if large:
        return _tidy(near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    handed = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return _tidy(handed)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none itself."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    of_node = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return of_node.filter("out > 1 or (out > 0 and into > 0)").isEmpty()
