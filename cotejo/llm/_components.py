"""Connected components by large-star and small-star steps, as DataFrame joins.

An edge points from the larger to the smaller id. A large-star step hangs every
larger neighbour of a node on the least id of its neighbourhood, a small-star step
every smaller one; after about log(n) rounds each component is one star around its least
id. A neighbourhood is never gathered: its least id comes from an aggregation, and
is joined back to the edges, where Spark can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._session import written


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("at"), F.least("hi", "m").alias("m"))
    # edges that come up twice do no harm before the last step
    large = both.join(least, F.col("hi") == F.col("at")).filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    root = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "at")
    small = large.join(root, F.col("hi") == F.col("at"))
    hung = small.select("hi", F.col("m").alias("lo")).unionByName(small.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return hung.distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and nothing hangs on it then."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id and component_id (the least id reachable) of every id in ``links`` (a, b) but the least ones.

    Ids that are the least of their component, or in no link, have no row.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = written(edges, "component-links")
    while not _are_stars(edges):
        edges = written(_stars(edges), "component-stars")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
