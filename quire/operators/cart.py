"""Classification trees by aggregation: a level of the tree is one count of (node, feature, value, label) over all samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.tables import stored

DEPTH, LEAST, SIDE, CANDIDATES, BINS = 12, 5, 2, 20, 256
#: Levels that a tree may have; it has fewer than twice as many nodes as 2 to this power, which the driver holds.
DEEPEST = 16


class Node(NamedTuple):
    """A node by its number, 1 at the root, 2 n and 2 n + 1 below n; leaves have no feature."""

    node: int
    depth: int
    samples: int
    feature: int | None
    threshold: float | None
    label: str
    confidence: float


SCHEMA = "node long, depth int, samples long, feature int, threshold double, label string, confidence double"


def at_least(value: Column, cuts: list[float], width: int = 16) -> Column:
    """The first of sorted cuts that is not below the value, else the last: first the group of `width` cuts, then the cut in it."""
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    below = lambda held: F.size(F.filter(held, lambda c: c < value))
    group = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), below(F.array(*[F.lit(g[-1]) for g in groups])))
    return F.coalesce(F.get(group, below(group)), F.lit(cuts[-1]))


def binned(samples: DataFrame, features: int, most: int = BINS) -> DataFrame:
    """samples whose features have at most `most` values each: those with more become the next of that many quantiles.

    Features with few values stay as they are, so trees over them are exact; a null counts as 0.
    """
    value = lambda i: F.coalesce(F.col("features")[i], F.lit(0.0))
    parts = F.array(*[F.lit(k / most) for k in range(1, most + 1)])
    found = samples.agg(*[F.approx_count_distinct(value(i)).alias(f"n{i}") for i in range(features)]).first()
    many = [i for i in range(features) if (found[f"n{i}"] or 0) > most * 0.9]  # the count is out by a few hundredths
    told = samples.agg(*[F.percentile_approx(value(i), parts, 10_000).alias(f"q{i}") for i in many]).first() if many else None

    def cut(i: int) -> Column:
        if i not in many:
            return value(i)
        cuts = sorted(set(told[f"q{i}"]))
        return at_least(value(i), cuts)

    return samples.withColumn("features", F.array(*[cut(i) for i in range(features)]))


def _placed(rows: DataFrame, splits: list[list[Node]]) -> DataFrame:
    """rows with the node that each has come to; splits: those of each level, from the root down."""
    found = rows.withColumn("node", F.lit(1).cast("long"))
    for level in splits:
        table = rows.sparkSession.createDataFrame([(s.node, s.feature, s.threshold) for s in level], "__node long, __feature int, __threshold double")
        below = 2 * F.col("node") + (F.coalesce(F.get("features", F.col("__feature")), F.lit(0.0)) > F.col("__threshold")).cast("long")
        joined = found.join(F.broadcast(table), F.col("node") == F.col("__node"), "left")  # at most 2 to the level's power
        found = joined.select(*rows.columns, F.when(F.col("__node").isNotNull(), below).otherwise(F.col("node")).alias("node"))
    return found


def counted(rows: DataFrame) -> DataFrame:
    """(node, feature, value, label, w, n): the level's one aggregation over samples, combined before it is shuffled.

    rows with a column `copies` stand for so many equal samples.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    each = rows.select("node", "label", (F.col("weight") * copies).alias("weight"), copies.alias("copies"), F.posexplode("features").alias("feature", "value"))
    return each.groupBy("node", "feature", "value", "label").agg(F.sum("weight").alias("w"), F.sum("copies").alias("n"))


def _cuts(samples: DataFrame, features: int, most: int = BINS) -> list[list[float]]:
    """For each feature, values between which about as many samples lie; they only say which values are ranked together."""
    parts = F.array(*[F.lit(k / most) for k in range(1, most)])
    told = samples.agg(*[F.percentile_approx(F.coalesce(F.col("features")[i], F.lit(0.0)), parts, 10_000).alias(f"q{i}") for i in range(features)]).first()
    return [sorted(set(told[f"q{i}"] or [])) for i in range(features)]


def _thresholds(counts: DataFrame, candidates: int, cuts: list[list[float]] | None) -> DataFrame:
    """(node, feature, threshold): of the middles of neighbouring values, every n-th where there are more than `candidates`.

    Values are ranked within the stretch of the feature between two cuts, so no task orders all values of a feature.
    """
    values = counts.select("node", "feature", "value").distinct()
    told = F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<double>") for c in cuts or []]), F.col("feature")) if cuts else F.array().cast("array<double>")
    values = values.withColumn("stretch", F.size(F.filter(told, lambda c: c < F.col("value"))))
    place, stretches = Window.partitionBy("node", "feature", "stretch").orderBy("value"), Window.partitionBy("node", "feature").orderBy("stretch")
    of_stretch = values.groupBy("node", "feature", "stretch").agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(stretches.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_stretch = of_stretch.select("node", "feature", "stretch", before.alias("before"), F.lead("least").over(stretches).alias("after"), (F.sum("n").over(Window.partitionBy("node", "feature")) - 1).alias("m"))
    ranked = values.withColumns({"next": F.lead("value").over(place), "rank": F.row_number().over(place) - 1}).join(of_stretch, ["node", "feature", "stretch"])
    middle = ranked.select("node", "feature", ((F.col("value") + F.coalesce("next", "after")) / 2).alias("threshold"), (F.col("before") + F.col("rank")).alias("k"), "m")
    step = F.when(F.col("m") > candidates, F.floor(F.col("m") / candidates)).otherwise(1)
    return middle.filter("threshold IS NOT NULL").filter(F.col("k") % step == 0).select("node", "feature", "threshold")


def best_splits(counts: DataFrame, candidates: int = CANDIDATES, side: int = SIDE, cuts: list[list[float]] | None = None) -> DataFrame:
    """(node, feature, threshold) of each node's split with the least Gini impurity, then the first feature and threshold.

    Thresholds lie midway between neighbouring values; of more than `candidates` every n-th counts. At least `side` samples
    lie on either side. As all weights are whole numbers, impurities are sums of whole squares, divided once: they are equal
    where they should be. Values are counted between neighbouring thresholds before they are given to each threshold above;
    cuts: see `_cuts`, for features with many values.
    """
    tried = _thresholds(counts, candidates, cuts)
    exact = lambda c: c.cast("decimal(19,0)")
    by_label = counts.filter("feature = 0").groupBy("node", "label").agg(F.sum("w").alias("t"), F.sum("n").alias("tn"))
    whole = by_label.groupBy("node").agg(F.sum("t").alias("weight"), F.sum("tn").alias("samples"), F.sum(exact(F.col("t")) * exact(F.col("t"))).alias("squares"))
    listed = tried.groupBy("node", "feature").agg(F.array_sort(F.collect_list("threshold")).alias("tried"))  # at most twice `candidates`
    slot = F.size(F.filter("tried", lambda h: h < F.col("value"))) + 1
    slots = counts.join(listed, ["node", "feature"]).withColumn("slot", slot).groupBy("node", "feature", "tried", "label", "slot").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    each = slots.select("node", "feature", "label", "w", "n", F.explode(F.slice("tried", F.col("slot"), F.size("tried"))).alias("threshold"))
    left = each.groupBy("node", "feature", "threshold", "label").agg(F.sum("w").alias("l"), F.sum("n").alias("ln"))
    l, t = exact(F.col("l")), exact(F.col("t"))
    sides = left.join(by_label, ["node", "label"]).groupBy("node", "feature", "threshold").agg(F.sum("l").alias("lw"), F.sum("ln").alias("ln"), F.sum(l * l).alias("ll"), F.sum(t * l).alias("tl"))
    both = sides.join(whole, "node").withColumns({"rw": F.col("weight") - F.col("lw"), "rr": F.col("squares") - 2 * F.col("tl") + F.col("ll")})
    fair = both.filter((F.col("ln") >= side) & (F.col("samples") - F.col("ln") >= side))
    purity = F.col("ll").cast("double") / F.col("lw") + F.col("rr").cast("double") / F.col("rw")
    first = F.max(F.struct(purity.alias("purity"), (-F.col("feature")).alias("f"), (-F.col("threshold")).alias("h"))).alias("s")
    return fair.groupBy("node").agg(first).select("node", (-F.col("s.f")).alias("feature"), (-F.col("s.h")).alias("threshold"))


def grow(samples: DataFrame, *, depth: int = DEPTH, least: int = LEAST, bins: int | None = None, candidates: int = CANDIDATES, side: int = SIDE) -> DataFrame:
    """The nodes of a tree, as rows of SCHEMA; samples: label, weight (a whole number; 0 and less count as 1), features (array of double).

    The tree grows level by level: each level reads the samples once, counts what is distinct, and picks a split for each of
    its nodes, so the work of a level does not depend on the number of its nodes. A node with fewer than `least`
    samples, at the last depth, with one label alone or without a fair split is a leaf. A leaf's label has the largest
    weight, then comes first; its confidence is its share. Null labels are left out; samples without rows give no node.
    bins: features with more values become quantiles first (see `binned`), and equal samples one row, so that levels read what is
    distinct; without it all values count.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"a tree has at most {DEEPEST} levels, as the driver holds its nodes")
    known = samples.filter(F.col("label").isNotNull()).select("label", F.when(F.col("weight") > 0, F.col("weight").cast("long")).otherwise(1).alias("weight"), "features")
    first = known.first()
    spark = samples.sparkSession
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    features = len(first["features"])
    if bins:
        held, cuts = stored(binned(known, features, bins).groupBy("label", "weight", "features").agg(F.count(F.lit(1)).alias("copies"))), None
    else:
        held = stored(known.withColumn("features", F.array(*[F.coalesce(F.col("features")[i], F.lit(0.0)) for i in range(features)])))
        cuts = _cuts(held, features)
    found: list[Node] = []
    splits: list[list[Node]] = []
    for level in range(depth + 1):
        rows = _placed(held, splits)
        if splits:
            rows = rows.filter(F.col("node") >= 1 << level)
        counts = stored(counted(rows))
        labels: dict[int, list[tuple]] = {}
        for r in counts.filter("feature = 0").groupBy("node", "label").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():
            labels.setdefault(r["node"], []).append((r["label"], r["w"], r["n"]))
        able = {k for k, v in labels.items() if len(v) > 1 and sum(n for _, _, n in v) >= least} if level < depth else set()
        chosen = {r["node"]: r for r in best_splits(counts, candidates, side, cuts).collect()} if able else {}
        below = []
        for node, told in sorted(labels.items()):
            label, weight, _ = min(told, key=lambda x: (-x[1], x[0]))
            split = chosen.get(node) if node in able else None
            made = Node(node, level, sum(n for _, _, n in told), split and split["feature"], split and split["threshold"], label, weight / sum(w for _, w, _ in told))
            found.append(made)
            if split:
                below.append(made)
        if not below:
            break
        splits.append(below)
    return spark.createDataFrame(found, SCHEMA)


def predict(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """rows with node, predicted and confidence: the leaf that each row's features lead to; null without a tree.

    rows: features (array of double), and any columns but these three. A feature that a row lacks counts as 0.
    """
    nodes = [Node(*r) for r in tree.limit(2 << DEEPEST).collect()]
    levels = [[n for n in nodes if n.depth == d and n.feature is not None] for d in range(max((n.depth for n in nodes), default=0) + 1)]
    placed = _placed(rows, [x for x in levels if x])
    leaves = tree.filter("feature IS NULL").select(F.col("node").alias("__leaf"), F.col("label").alias("predicted"), "confidence")
    return placed.join(F.broadcast(leaves), F.col("node") == F.col("__leaf"), "left").select(*rows.columns, "node", "predicted", "confidence")
