"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import stored
from sigloom.operators.skew import salted_join


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node it reaches, for every node of ``links`` (a, b).

    Each step points a node's neighbours at the smallest of them. Minima combine inside tasks before they shuffle and return through a
    salted join, so a node with very many links is no bottleneck; every step is a table in the shared folder. Steps go on until the links
    stay as they are.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: larger neighbours point at the smallest of node and neighbours
        large = salted_join(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        # small star: a node and its smaller neighbours point at the smallest of those
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = salted_join(large, smallest, ["u"], ["v"])
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
        mark = now
