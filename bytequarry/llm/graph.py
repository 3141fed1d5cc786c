"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join with one row a node, so that a node with very many edges is no burden on one
task; between rounds the edges go through the shared folder. The rounds end when the edges stay as they are, which
takes some log(nodes)**2 rounds at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node with an edge but the roots; the root is the component's smallest node."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e"))
        now = materialize(small.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "small-star")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
