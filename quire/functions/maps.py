"""Rule maps as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(base: Column, over: Column) -> Column:
    """base with the entries of over that are neither null nor empty."""
    real = F.map_filter(over, lambda k, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(real, k), F.lit(False))), real)


def whitelisted(rules: Column, allowed: list[str]) -> Column:
    """(kept, score): the allowed entries, and their share of all; null of none."""
    names = F.array(*map(F.lit, allowed))
    kept = F.map_filter(rules, lambda k, v: F.array_contains(names, k))
    return F.struct(kept.alias("kept"), F.when(F.size(rules) > 0, F.size(kept) / F.size(rules)).alias("score"))


def renamed(rules: Column, names: dict[str, str]) -> Column:
    """Keys by their English names; unknown keys stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(rules, lambda k, v: F.coalesce(F.element_at(table, k), k))


def _flat(value, at: str, out: dict[str, str]) -> dict[str, str]:
    if isinstance(value, dict):
        for k, v in value.items():
            _flat(v, f"{at}.{k}" if at else k, out)
    elif value is not None:
        out[at] = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return out


def _flat_map(text: str | None) -> dict[str, str] | None:
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return None
    return _flat(found, "", {}) if isinstance(found, dict) else None


def flattened(text: Column) -> Column:
    """Nested JSON objects as one map with dotted keys, whose keys aren't known beforehand; null for other text."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_flat_map)

    return run(text)


def violations(rules: Column, required: dict[str, str]) -> Column:
    """The required fields that are missing or don't match their pattern as a whole."""
    tests = [F.when(~F.coalesce(rules[name].rlike(f"^(?:{pattern})$"), F.lit(False)), F.lit(name)) for name, pattern in required.items()]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())
