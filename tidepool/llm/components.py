"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, written


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in a link.

    ``links``: columns a, b (whole numbers). Rounds of two steps: every node
    points its larger neighbours, then its smaller ones, to the smallest
    neighbour (large star and small star, Kiveris et al. 2014), until nothing
    changes. Each round is written below ``path``, which cuts the lineage, and
    goes once the next is there; only counts reach the driver.
    """
    spark = links.sparkSession
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/0")
    before, state, i = f"{path}/0", None, 0
    while True:
        i += 1
        # large star: each node's larger neighbours point to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{path}/{i}a")
        # small star: each node and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, f"{path}/{i}b")
        remove(spark, before, f"{path}/{i}a")
        before = f"{path}/{i}b"
        # unchanged once every node points straight to a node that points nowhere
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
