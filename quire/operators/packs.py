"""Rule packs as rows: a table of rules becomes one pass of predicates over paragraphs with their effective styles."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.hierarchy import inherited

#: Rules that a pack may hold; they are compiled on the driver.
MOST_RULES = 10_000


class Rule(NamedTuple):
    rule: str
    scope: str
    label: str
    attribute: str
    comparison: str
    value: str | None
    severity: str


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


#: What must hold: (actual, value) to a column. A comparison with a question mark behind it lets nulls pass, all others don't.
COMPARISONS: dict[str, Callable[[Column, str], Column]] = {
    "equals": lambda c, v: c.cast("string") == v,
    "differs": lambda c, v: c.cast("string") != v,
    "at_least": lambda c, v: _number(c) >= float(v),
    "at_most": lambda c, v: _number(c) <= float(v),
    "near": lambda c, v: F.abs(_number(c) - float(v.split("±")[0])) <= float(v.split("±")[1]),
    "one_of": lambda c, v: c.cast("string").isin(*[x.strip() for x in v.split("|")]),
    "matches": lambda c, v: c.cast("string").rlike(v),
    "lacks": lambda c, v: ~F.contains(F.lower(c.cast("string")), F.lit(v.lower())),
    "holds": lambda c, v: F.contains(F.lower(c.cast("string")), F.lit(v.lower())),
    "present": lambda c, v: F.trim(c.cast("string")) != "",
}
NUMBERS = {"at_least", "at_most", "near"}


def faults(rules: list[Rule], columns: dict[str, list[str]]) -> list[str]:
    """What keeps rules from being compiled; columns: those of each scope's rows."""
    found = []
    for r in rules:
        kind = r.comparison.removesuffix("?")
        if r.scope not in columns:
            found.append(f"{r.rule}: no rows of scope {r.scope}")
        elif r.attribute not in columns[r.scope]:
            found.append(f"{r.rule}: {r.scope} has no attribute {r.attribute}")
        if kind not in COMPARISONS:
            found.append(f"{r.rule}: unknown comparison {r.comparison}")
        elif r.value is None and kind != "present":
            found.append(f"{r.rule}: no value")
        elif kind in NUMBERS:
            try:
                COMPARISONS[kind](F.lit("0"), r.value)
            except (ValueError, IndexError):
                found.append(f"{r.rule}: {r.value} is no number for {kind}")
    return found


def read_rules(table: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """The rules of a table with the columns of Rule, by name; more than `most` are an error, as they are compiled on the driver."""
    rows = table.select(*Rule._fields).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pack of more than {most} rules")
    return sorted((Rule(*r) for r in rows), key=lambda r: tuple(str(x) for x in r))


def styled(rows: DataFrame, styles: DataFrame, attributes: list[str], flags: list[str], *, style: str = "style_id", parent: str = "based_on") -> DataFrame:
    """rows with the effective value of each attribute: the row's own (columns own_<attribute>, where there are any), else its style's, by inheritance.

    A row without a style, or with one that is not defined, has its own values alone.
    """
    chain = inherited(styles, style, parent, attributes, flags)
    by_style = chain.select(F.col(style).alias("__style"), *[F.col(a).alias(f"__{a}") for a in (*attributes, *flags)])
    found = rows.join(by_style, F.col(style) == F.col("__style"), "left")
    own = lambda a: F.coalesce(F.col(f"own_{a}"), F.col(f"__{a}")) if f"own_{a}" in rows.columns else F.col(f"__{a}")
    return found.select(*rows.columns, *[own(a).alias(a) for a in (*attributes, *flags)])


def violations(rules: list[Rule], rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, rule, severity, expected, actual) of each rule that a row of its label breaks; rows are read once for any number of rules.

    Rules of a label stand together behind one test of it, so a row is compared with those alone; label * is for all rows.
    """
    by_label: dict[str, list[Column]] = {}
    for r in rules:
        actual, kind = F.col(r.attribute), r.comparison.removesuffix("?")
        holds = F.coalesce(COMPARISONS[kind](actual, r.value or ""), F.lit(False))
        if r.comparison.endswith("?"):
            holds = holds | actual.isNull()
        broken = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.value).cast("string").alias("expected"), actual.cast("string").alias("actual"))
        by_label.setdefault(r.label, []).append(F.when(~holds, broken))
    none = F.array().cast("array<struct<rule:string,severity:string,expected:string,actual:string>>")
    parts = [F.when(F.lit(True) if name == "*" else F.col(label) == name, F.filter(F.array(*tests), lambda x: x.isNotNull())) for name, tests in by_label.items()]
    every = F.concat(none, *[F.coalesce(p, none) for p in parts])
    return rows.select(*keys, F.explode(every).alias("v")).select(*keys, "v.*")


def check(pack: DataFrame, frames: dict[str, DataFrame], keys: list[str], *, label: str = "label") -> DataFrame:
    """(scope, keys, rule, severity, expected, actual): all rules of a pack over the rows of their scopes, one scan a scope.

    frames: for each scope (paragraphs, sections, tables, ...) its rows, with the keys, a label and the attributes that
    rules name. A rule that can't be compiled is an error that names all such rules. Null attributes break a rule unless its
    comparison ends with a question mark. Rows without a label are held against the rules for all rows; an empty pack or
    an empty frame breaks nothing.
    """
    rules = read_rules(pack)
    if wrong := faults(rules, {scope: df.columns for scope, df in frames.items()}):
        raise ValueError("; ".join(wrong))
    out = None
    for scope, df in sorted(frames.items()):
        found = violations([r for r in rules if r.scope == scope], df, keys, label).select(F.lit(scope).alias("scope"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def template_formats(rows: DataFrame, label: str, attributes: list[str]) -> DataFrame:
    """(label, attributes): the most frequent value of each attribute for each label, the smallest of several; nulls don't count."""
    return rows.groupBy(label).agg(*[F.mode(F.col(a), True).alias(a) for a in attributes])


def classified_diff(rows: DataFrame, formats: DataFrame, keys: list[str], label: str, attributes: list[str]) -> DataFrame:
    """(keys, paragraphs, unknown, wrong, <attribute>_wrong, score) of each document against the template's formats by label.

    An attribute is wrong if the template has a value for the label and the paragraph another one or none. `unknown` are
    paragraphs whose label the template lacks; score is the share of compared attributes that agree, null if there is none.
    Labelled rows meet the few formats in one join, and documents are counted in the same plan with map-side combining.
    """
    named = formats.select(F.col(label).alias("__label"), *[F.col(a).alias(f"__{a}") for a in attributes])
    both = rows.join(named, F.col(label) == F.col("__label"), "left")  # few labels: Spark sends them to the rows
    told = {a: F.col(f"__{a}").isNotNull() for a in attributes}
    wrong = {a: (told[a] & ~F.col(a).eqNullSafe(F.col(f"__{a}"))).cast("long") for a in attributes}
    add = lambda cs: sum(cs[1:], cs[0])
    compared, missed = F.sum(add([t.cast("long") for t in told.values()])), F.sum(add(list(wrong.values())))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if(F.col("__label").isNull()).alias("unknown"),
        F.count_if(add(list(wrong.values())) > 0).alias("wrong"),
        *[F.sum(w).alias(f"{a}_wrong") for a, w in wrong.items()],
        F.round((compared - missed) / F.nullif(compared, F.lit(0)), 4).alias("score"),
    )
