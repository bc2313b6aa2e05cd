"""Connected components of a table of links, without gathering a component or a node's links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node with a link; label is the smallest node of its component.

    Nulls in either column link nothing; repeated links and links of a node to itself change nothing; without a link there
    is no row; other columns of links are not read.

    Alternates large-star and small-star: each round links neighbours to a smaller one, until the links form stars. The
    smallest neighbour comes from an aggregation with map-side combining and returns by a join, whose large partitions
    Spark can split, so a node may have any number of links. Each round is stored, so lost executors cost one round.
    Rounds go on until the links stay the same, which takes a number that grows with the logarithm of the nodes, squared.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
