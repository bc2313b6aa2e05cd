"""Format profiles: consensus of samples, differences with tolerances, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.relational import mode_of

#: Attribute, severity and tolerance of each compared attribute of a paragraph format.
ATTRIBUTES = (
    ("font_east_asia", "error", None),
    ("font_ascii", "warning", None),
    ("size_half_pt", "error", 1),
    ("bold", "error", None),
    ("alignment", "error", None),
    ("line", "warning", 20),
    ("space_before", "warning", 20),
    ("space_after", "warning", 20),
    ("first_line_indent", "warning", 40),
)
WEIGHTS = {"font": 0.25, "spacing": 0.20, "structure": 0.25, "compliance": 0.15, "issues": 0.15}
PENALTIES = {"error": 10, "warning": 5, "info": 2}


def _is_set(expected: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lit(True)
    return expected.isNotNull() & (expected != F.lit("" if kind == "string" else 0))


def spec_diff(pairs: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Adds a row per differing attribute: attribute, severity, expected and actual as text.

    pairs holds structs of the attributes; an expected value that is empty, zero or null is not compared, bold always is.
    """
    kinds = dict((f.name, f.dataType.simpleString()) for f in pairs.schema[expected].dataType)
    found = []
    for name, severity, tolerance in ATTRIBUTES:
        e, a = F.col(f"{expected}.{name}"), F.col(f"{actual}.{name}")
        differs = ~e.eqNullSafe(a) if tolerance is None else F.abs(e - F.coalesce(a, F.lit(0))) > tolerance
        row = F.struct(F.lit(name).alias("attribute"), F.lit(severity).alias("severity"), e.cast("string").alias("wanted"), a.cast("string").alias("found"))
        found.append(F.when(_is_set(e, kinds[name]) & differs, row))
    rest = [c for c in pairs.columns if c not in (expected, actual)]
    return pairs.select(*rest, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select(*rest, "d.*")


def consensus(samples: DataFrame, keys: list[str], modes: list[str], means: list[str], flags: list[str]) -> DataFrame:
    """One format per key: modes of attributes, truncated means, and flags by strict majority."""
    n = F.count(F.lit(1))
    out = samples.groupBy(*keys).agg(
        *[F.floor(F.sum(F.coalesce(c, F.lit(0))) / n).cast("long").alias(c) for c in means],
        *[(F.count(F.when(F.col(c), 1)) * 2 > n).alias(c) for c in flags],
    )
    for c in modes:
        out = out.join(mode_of(samples, keys, c, c), keys, "left")
    return out


def modal_share(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the share of the most frequent value, times 100: how consistent fonts or line spacings are."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.round(F.max("__n") / F.sum("__n") * 100, 6).alias(name))


def font_consistency(runs: DataFrame, keys: list[str], font: str, empty: float = 0.0) -> DataFrame:
    """(keys, score): the share of the most frequent font, times 100."""
    counts = runs.groupBy(*keys, font).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.round(F.coalesce(F.max("n") / F.sum("n") * 100, F.lit(empty)), 6).alias("score"))


def structure_score(have: Column, numbered: Column) -> Column:
    """have: how many of title, abstract and references there are; numbered: numbered paragraphs."""
    return (have / 3 * 0.6 + F.least(numbered / 3, F.lit(1.0)) * 0.4) * 100


def issue_score(penalty: Column) -> Column:
    return 100 - F.least(penalty, F.lit(100))


def overall(scores: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + scores[name] * weight
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def percentile_band(score: Column) -> Column:
    return F.when(score >= 95, 95).when(score >= 90, 85).when(score >= 80, 70).when(score >= 70, 50).when(score >= 60, 30).otherwise(10)


def effective(layers: list[DataFrame], key: str, attributes: list[str]) -> DataFrame:
    """Overlaid rules: of each attribute the value of the last layer that sets it."""
    every = None
    for i, layer in enumerate(layers):
        layer = layer.withColumn("__at", F.lit(i))
        every = layer if every is None else every.unionByName(layer, allowMissingColumns=True)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("__at"))).alias(c)
    return every.groupBy(key).agg(*[last(c) for c in attributes])
