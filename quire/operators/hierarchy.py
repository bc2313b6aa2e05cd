"""Parent-pointer hierarchies: closures, paths and inherited attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import stored

#: A longer shortest path to an ancestor is an error.
BOUND = 1 << 16


def closure(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, depth): every node with itself at depth 0 and all its ancestors; cycles end.

    Doubles the known distance with each join until no new pair appears, so a chain of 64 takes seven joins; a node's
    shortest path to an ancestor counts, which also ends cycles. Each join's pairs are stored as Parquet.
    """
    step = nodes.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    nearest = lambda pairs: stored(pairs.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
    known = nearest(nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth")).union(step))
    pairs, before, reach = known.count(), -1, 1
    while pairs > before:
        if reach > BOUND:
            raise ValueError(f"a hierarchy of more than {BOUND} levels")
        known = nearest(known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")))
        pairs, before, reach = known.count(), pairs, reach * 2
    return known


def nearest(nodes: DataFrame, node: str, parent: str, values: list[str]) -> DataFrame:
    """(node, values): the nearest of each value that is not null, of the node itself or on its chain; cycles end.

    Each join doubles how far a row has looked: it takes what the row it points to has found, and then points to where
    that one does. A row that has all values points nowhere, so there is one row for each node, however long the chains, and
    one of 64 takes six joins. Once a join neither finds nor ends anything, what is left goes round without a value.
    Where a node has several rows, the nearest of all counts. Each join is stored as Parquet.
    """
    key, up = F.col(node), F.col(parent)
    own = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.lit(0).alias("depth"), F.col(v).alias("value"))).alias(v)
    rows = nodes.select(key.alias("node"), F.when(key != up, up).alias("up"), *[own(v) for v in values])
    lacking = F.greatest(*[F.col(v).isNull() for v in values], F.lit(False))
    merged = lambda rows: rows.withColumn("up", F.when(lacking, F.col("up"))).groupBy("node", "up").agg(*[F.min(v).alias(v) for v in values])
    known, reach, before = stored(merged(rows)), 1, None
    while True:
        now = known.agg(F.count("up"), *[F.count(v) for v in values]).first()
        if not now[0] or now == before:
            return known.groupBy(F.col("node").alias(node)).agg(*[F.min(v)["value"].alias(v) for v in values])
        if reach > BOUND:
            raise ValueError(f"a hierarchy of more than {BOUND} levels")
        there = known.select(F.col("node").alias("at"), F.struct("up", *values).alias("there"))
        seen = [F.col("there")[v] for v in values]
        further = [F.coalesce(F.col(v), F.when(x.isNotNull(), F.struct((x["depth"] + reach).alias("depth"), x["value"].alias("value")))).alias(v) for v, x in zip(values, seen, strict=True)]
        known = stored(merged(known.join(there, F.col("up") == F.col("at"), "left").select("node", F.col("there.up").alias("up"), *further)))
        before, reach = now, reach * 2


def inherited(styles: DataFrame, node: str, parent: str, attributes: list[str], flags: list[str]) -> DataFrame:
    """Each style with the nearest non-empty value of each attribute on its chain; flags are true if true anywhere."""
    said = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in attributes] + [F.when(F.col(c), True).alias(c) for c in flags]
    found = nearest(styles.select(node, parent, *said), node, parent, [*attributes, *flags])
    return found.select(node, *attributes, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def paths(nodes: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """(node, depth, path): names from the root down, joined by a slash."""
    chain = closure(nodes, node, parent).join(nodes.select(F.col(node).alias("ancestor"), F.col(name).alias("name")), "ancestor")
    listed = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "name")))), lambda x: x["name"])
    return chain.groupBy(F.col("node").alias(node)).agg(F.max("depth").alias("depth"), F.array_join(listed, "/").alias("path"))
