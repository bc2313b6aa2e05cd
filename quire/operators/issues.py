"""Issue rows: rules, integrity of packages, comparison of rendered pages, and what follows from issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

FATAL, REPAIRABLE, WARNING = "fatal", "repairable", "warning"


def issues(rows: DataFrame, kind: str, severity: str, keys: list[str], target: Column) -> DataFrame:
    return rows.select(*keys, F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), target.cast("string").alias("target"))


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def checked(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Issues of all rules in one pass over rows; a rule: kind, severity, test, target."""
    found = [F.when(test, F.struct(F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), target.cast("string").alias("target"))) for kind, severity, test, target in rules]
    return rows.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select(*keys, "i.*")


def once_per_kind(found: DataFrame, keys: list[str]) -> DataFrame:
    """One issue per kind, the one with the smallest target, as it is."""
    first = F.min(F.struct("target", "severity")).alias("first")
    return found.groupBy(*keys, "kind").agg(first).select(*keys, "kind", "first.severity", "first.target")


def status(found: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """compliant without fatal and repairable issues, rejected with a fatal one, else review_required."""
    worst = found.groupBy(*keys).agg(F.max((F.col("severity") == FATAL).cast("int")).alias("fatal"), F.max((F.col("severity") == REPAIRABLE).cast("int")).alias("repairable"))
    said = F.when(F.col("fatal") == 1, "rejected").when(F.col("repairable") == 1, "review_required").otherwise("compliant")
    return subjects.select(*keys).distinct().join(worst, keys, "left").select(*keys, said.alias("status"))


def fingerprint(found: DataFrame, keys: list[str]) -> DataFrame:
    """A text that is equal for equal sets of issues."""
    line = F.concat_ws("|", "kind", "target")
    return found.groupBy(*keys).agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("fingerprint"))


def sides(used: DataFrame, defined: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(*keys, used, defined): each distinct reference or definition once, and where it is found; one that lacks a key equals none.

    One pass over both. parts: tasks that rows are dealt over, so that each holds a bounded number; without it as Spark deals them.
    """
    both = used.select(*keys, F.lit(1).alias("side")).union(defined.select(*keys, F.lit(2).alias("side")))
    both = both.withColumn("alone", F.when(F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True), F.col("side")))
    dealt = both.repartition(parts, *keys) if parts else both
    found = dealt.groupBy(*keys, "alone").agg(F.bit_or("side").alias("side"))
    return found.select(*keys, (F.col("side") != 2).alias("used"), (F.col("side") != 1).alias("defined"))


def dangling(used: DataFrame, defined: DataFrame, keys: list[str], kind: str, target: str) -> DataFrame:
    """An issue for each distinct reference without a definition."""
    return issues(sides(used, defined, keys).filter("used AND NOT defined"), kind, REPAIRABLE, ["doc_id"], F.col(target))


def unpaired(starts: DataFrame, ends: DataFrame, keys: list[str], kind: str, target: str) -> DataFrame:
    """An issue for each id that begins or ends but not both."""
    return issues(sides(starts, ends, keys).filter("used != defined"), kind, REPAIRABLE, ["doc_id"], F.col(target))


def keyword_violations(line: Column, least: int, most: int) -> Column:
    """1 for a comma or final period, else 1 if the number of keywords is out of bounds."""
    n = F.size(F.filter(F.split(line, "[；;]"), lambda k: T.uni_trim(k) != ""))
    return F.when(line.rlike("[,，]|[.。]$"), 1).when((n < least) | (n > most), 1).otherwise(0)


def pages_with(pages: DataFrame, landmarks: DataFrame, side: str) -> DataFrame:
    """(doc_id, landmark, side): the first page that holds the landmark, white space aside, 0 if none."""
    held = pages.withColumn("text", T.squeezed(F.col("text"))).join(landmarks, "doc_id").filter(F.contains(F.col("text"), T.squeezed(F.col("landmark"))))
    first = held.groupBy("doc_id", "landmark").agg(F.min("page").alias(side))
    return landmarks.join(first, ["doc_id", "landmark"], "left").select("doc_id", "landmark", F.coalesce(side, F.lit(0)).alias(side))


def golden_drift(golden: DataFrame, candidate: DataFrame, landmarks: DataFrame, most: int = 0) -> DataFrame:
    """Issues of a rendering against its snapshot: page counts, and landmarks missing or on another page."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.max("page").alias(name))
    counts = count(golden, "g").join(count(candidate, "c"), "doc_id", "left").fillna(0, ["c"])
    drift = issues(counts.filter((F.col("g") > 0) & (F.abs(F.col("g") - F.col("c")) > most)), "page_count_drift", "error", ["doc_id"], F.col("c"))
    both = pages_with(golden, landmarks, "g").join(pages_with(candidate, landmarks, "c"), ["doc_id", "landmark"])
    kind = F.when(F.col("g") == 0, "golden_landmark_missing").when(F.col("c") == 0, "candidate_landmark_missing").when(F.col("g") != F.col("c"), "landmark_page_drift")
    moved = both.withColumn("kind", kind).filter("kind IS NOT NULL").select("doc_id", "kind", F.when(F.col("kind") == "golden_landmark_missing", WARNING).otherwise("error").alias("severity"), F.col("landmark").alias("target"))
    return drift.unionByName(moved)


def footer_totals(pages: DataFrame) -> DataFrame:
    """An issue where the footer with the largest page number states another total; pages: doc_id, current, total."""
    last = pages.groupBy("doc_id").agg(F.max("current").alias("current"), F.max_by("total", "current").alias("total"))
    return issues(last.filter("current <> total"), "page_footer_total_mismatch", "error", ["doc_id"], F.col("total"))
