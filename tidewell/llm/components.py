"""Connected components of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import written


def _least(links: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours, over links in both directions (u, v)."""
    return written(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b) that are not roots; the root is the least node.

    Each round hangs every neighbour on the least one around it, first the larger, then the smaller ones,
    until all links are stars. Rounds grow with the logarithm of the number of nodes. Hubs are split by
    the skew join, as only minima are aggregated.
    """
    own = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    own = written(own, "links")
    while not own.isEmpty():
        both = own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v"), "large")
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        # stars: one link per node, to a node without one
        several = own.groupBy("u").count().where("count > 1").select("u")
        roots = own.select(F.col("v").alias("u")).distinct()
        if several.union(own.join(roots, "u", "left_semi").select("u")).isEmpty():
            break
    return own.select(F.col("u").alias("node"), F.col("v").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with further links (a, b): only what ties different components is looked at."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    ends = written(ends, "ends")
    if ends.isEmpty():
        return roots
    new = components(ends)
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return written(moved.select("node", F.coalesce("to", "root").alias("root")).union(new), "roots")
