"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b): the smallest node that it reaches.

    Alternating large and small stars: every node hands its larger neighbours, then its smaller ones, to the smallest node around
    it, until each hangs on its component's smallest. Minima are pre-aggregated, so a node of many links loads no single task.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:  # rounds grow with the logarithm of a component's width
        # Large star: u over v. All neighbours of a node, smaller or larger, give its minimum; larger ones are handed to it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_n"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("_n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_n")
        joined = large.join(least, F.col("u") == F.col("_n"))
        small = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = cut(small.filter("u <> v").distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
