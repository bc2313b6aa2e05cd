"""Relational operators as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_PAGE, LARGEST_PAGE = 10, 100


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key, the first in `order` (descending columns), found by aggregation with map-side combining.

    A struct of the ordering columns is maximised: map tasks each send one row per key, so a hot key's rows never meet in
    one task, as they would in a window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int | None = None) -> DataFrame:
    """A page of ordered rows: numbers under 1 count as 1, sizes outside 1 to 100 as the default."""
    size = size if size and 1 <= size <= LARGEST_PAGE else DEFAULT_PAGE
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def sorted_by(df: DataFrame, allowed: dict[str, str], by: str | None, descending: bool, tie: str, default: str) -> list[Column]:
    """Sort columns of a request: only allowed names, else the default; the tie goes the same way."""
    name = allowed.get(by or "", default)
    return [F.desc(name), F.desc(tie)] if descending else [F.asc(name), F.asc(tie)]


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Counts of all conditions in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()])


def ratio(part: Column, whole: Column, times: float = 100.0, default: float | None = None) -> Column:
    """part / whole * times, and default where whole is 0."""
    return F.when(whole > 0, part / whole * times).otherwise(F.lit(default).cast("double"))


def zero_filled_days(df: DataFrame, day: Column, last: Column, days: int) -> DataFrame:
    """(day, n) of the `days` days up to `last`, days without rows with 0."""
    session = df.sparkSession
    spine = session.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = df.filter((day >= F.date_sub(last, days - 1)) & (day <= last)).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def key_union_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side whose values differ, with both values."""
    left, right = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    return left.join(right, key, "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def mode_of(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """The most frequent non-empty value per key; of equal counts the smallest."""
    counts = df.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min_by(value, F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(alias)
    return counts.groupBy(*keys).agg(best)


def heaviest_label(df: DataFrame, keys: Sequence[str], label: str, weight: str) -> DataFrame:
    """(keys, label, confidence): the label of the greatest weight per key, of equal ones the smallest, and its share of all weight."""
    sums = df.groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    best = F.min_by(F.struct(F.col(label).alias("label"), "w"), F.struct((-F.col("w")).alias("first"), F.col(label).alias("then"))).alias("best")
    return sums.groupBy(*keys).agg(best, F.sum("w").alias("t")).select(*keys, "best.label", F.round(F.col("best.w") / F.col("t"), 6).alias("confidence"))


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def upsert(current: DataFrame, new: DataFrame, key: str, *, update: bool) -> DataFrame:
    """The table after inserting new rows; a key that exists is left alone, or replaced if `update`."""
    if update:
        return current.join(new.select(key), key, "left_anti").unionByName(new)
    return current.unionByName(new.join(current.select(key), key, "left_anti"))


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """The table after a conditional update; null conditions change nothing."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where_in(df: DataFrame, column: str, doomed: DataFrame, key: str) -> DataFrame:
    """The table without rows whose column is among the doomed keys."""
    return df.join(doomed.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def revisions(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Old values that an update replaces, for an append-only history; unchanged rows leave none."""
    return before.alias("b").join(after.alias("a"), key).filter(~F.col(f"b.{value}").eqNullSafe(F.col(f"a.{value}"))).select(key, F.col(f"b.{value}").alias("old_value"))


def data_scope(df: DataFrame, scope: str, user: Column, owner: str, department: str, department_id: Column | None = None, custom: Column | None = None) -> DataFrame:
    """Rows that a user may see; without what the scope needs, none (fails closed)."""
    if scope == "all":
        return df
    if scope == "self":
        return df.filter(F.col(owner) == user)
    if scope == "department" and department_id is not None:
        return df.filter(F.col(department) == department_id)
    if scope == "custom" and custom is not None:
        return df.filter(custom)
    return df.filter(F.lit(False))


def masked(value: Column, kind: str) -> Column:
    """A value with its middle hidden: phone, email and id_card keep their ends, all else becomes four stars."""
    stars = F.lit("****")
    size = F.octet_length(value)
    at = F.instr(value, "@")
    shown = {
        "phone": F.when(size >= 11, F.concat(F.left(value, F.lit(3)), stars, F.right(value, F.lit(4)))),
        "email": F.when(at > 1, F.concat(F.left(value, F.lit(1)), F.lit("***@"), F.substring_index(value, "@", -1))),
        "id_card": F.when(size >= 18, F.concat(F.left(value, F.lit(6)), F.lit("*" * 9), F.right(value, F.lit(4)))),
    }.get(kind)
    return F.when(size < 4, stars).otherwise(stars if shown is None else F.coalesce(shown, stars))


def mask_columns(df: DataFrame, policies: dict[str, tuple[bool, bool, str]]) -> DataFrame:
    """Masks columns by (hidden, masked, kind); only those both hidden and masked change."""
    return df.withColumns({c: masked(F.col(c), kind) for c, (hidden, mask, kind) in policies.items() if hidden and mask})


def entitled(price: Column, free: Column, role: Column, active: Column, allowed: Column, used: Column, quota: Column, paid: Column) -> Column:
    """Whether a user may use a service, as the first rule that holds says; a null user (role) may not."""
    return (
        F.when(role.isNull(), False)
        .when(price <= 0, True)
        .when(free, True)
        .when(role.isin("admin", "free"), True)
        .when(active & allowed & (used < quota), True)
        .when(paid, True)
        .otherwise(False)
    )


def histogram(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each value per key in one pass, as columns."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col(column) == v, 1)).alias(f"n_{v}") for v in values])


def running(df: DataFrame, keys: Sequence[str], order: str) -> Window:
    """Rows of a key up to the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
