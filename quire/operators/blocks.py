"""Blocks of documents: matching them to slots, finding neighbours, merging rules, and the repair loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ATTEMPTS = 3
LOOK_AHEAD = 8


def bindings(slots: DataFrame, payloads: DataFrame) -> DataFrame:
    """(slot_id, payload_id, state): payloads of a slot's kind that it accepts.

    A repeatable slot takes all of them, a single one takes its only match; more are ambiguous, none leave it unmapped.
    slots: slot_id, kind, accepts (empty: all), repeatable; payloads: payload_id, kind, key.
    """
    fits = (F.col("s.kind") == F.col("p.kind")) & ((F.size("s.accepts") == 0) | F.array_contains(F.col("s.accepts"), F.col("p.key")))
    matched = slots.alias("s").join(payloads.alias("p"), fits, "left").select("s.slot_id", "s.repeatable", "p.payload_id")
    n = F.count("payload_id").over(Window.partitionBy("slot_id"))
    state = F.when(F.col("payload_id").isNull(), "unmapped").when(~F.col("repeatable") & (n > 1), "ambiguous").otherwise("bound")
    return matched.select("slot_id", "payload_id", state.alias("state"))


def within(rows: DataFrame, ranges: DataFrame, key: str, at: str) -> DataFrame:
    """Rows with the ranges (key, name, start, stop) that hold their position: an equal join on the key, then the bounds."""
    inside = (F.col(f"r.{at}") >= F.col("x.start")) & (F.col(f"r.{at}") <= F.col("x.stop"))
    return rows.alias("r").join(ranges.alias("x"), (F.col(f"r.{key}") == F.col(f"x.{key}")) & inside).select(F.col(f"r.{key}"), F.col(f"r.{at}"), "x.name")


def nearest(rows: DataFrame, keys: list[str], order: str, start: Column, goal: Column, counted: Column, most: int = LOOK_AHEAD, *, back: bool = False) -> DataFrame:
    """Rows of `start` with the position of the next (or last) `goal`, null if more than `most` counted rows lie up to it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if back else F.asc(order))
    ranked = rows.withColumns({"__start": start, "__steps": F.sum(counted.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__goal": F.when(goal, F.struct(F.col(order).alias("at"), F.sum(counted.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("steps")))})
    ahead = F.first("__goal", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = ranked.withColumn("__found", ahead).filter("__start")
    return found.select(*keys, order, F.when(F.col("__found.steps") - F.col("__steps") <= most, F.col("__found.at")).alias("nearest"))


def strongest(rules: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Per target the rule of highest priority, then confidence, then first; attributes it lacks come from the next ones.

    rules: key, priority, confidence, seq and the attributes.
    """
    rank = F.struct(-F.col("priority"), -F.col("confidence"), F.col("seq"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    return rules.groupBy(key).agg(F.min_by("seq", rank).alias("winner"), *[first(c) for c in attributes])


def uncontained(source: DataFrame, output: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """Source texts that the output of the same key does not hold, white space aside; at most `most` per key, in order."""
    whole = output.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", text))), lambda x: x[text]), "").alias("__whole"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    missing = source.join(whole, key, "left").filter(~F.contains(bare(F.coalesce("__whole", F.lit(""))), bare(F.col(text))))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("idx"))
    return missing.withColumn("__rank", rank).filter(F.col("__rank") <= most).select(key, "idx", text)


def rule_counts(rows: DataFrame, keys: list[str], text: str, rules: dict[str, str]) -> DataFrame:
    """(keys, rule, n): how often each pattern occurs, in one pass."""
    counts = F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.sum(F.regexp_count(text, F.lit(p))) for p in rules.values()]))
    return rows.groupBy(*keys).agg(counts.alias("m")).select(*keys, F.explode("m").alias("rule", "n")).filter("n > 0")


def repair(frame: DataFrame, verify: Callable[[DataFrame], DataFrame], patch: Callable[[DataFrame, DataFrame], DataFrame] | None, attempts: int = ATTEMPTS) -> tuple[DataFrame, str]:
    """Verifies and patches until a verdict: verified_pass, or manual_review if an issue is fatal, nothing can be patched,
    attempts run out, or a set of issues comes back. verify gives issues with kind, severity and target."""
    seen: set[str] = set()
    for attempt in range(attempts + 1):
        found = verify(frame)
        line = F.concat_ws("|", "kind", "target")
        # An order-free sum of hashes tells sets of issues apart without gathering them.
        row = found.agg(F.count(F.when(F.col("severity") == "fatal", 1)), F.count(F.when(F.col("severity") == "repairable", 1)), F.sum(F.xxhash64(line).cast("decimal(38,0)"))).first()
        fatal, repairable, mark = row[0], row[1], str(row[2])
        if not fatal and not repairable:
            return frame, "verified_pass"
        if fatal or patch is None or attempt >= attempts or mark in seen:
            break
        seen.add(mark)
        frame = patch(frame, found)
    return frame, "manual_review"


def membership_end(end: Column, now: Column, days: Column) -> Column:
    """Renewal extends an active membership from its end, a lapsed one from now."""
    return F.date_add(F.when(end > now, end).otherwise(now), days)


def remaining_checks(active: Column, most: Column, used: Column, free: Column) -> Column:
    return F.when(active, F.greatest(most - used, F.lit(0))).otherwise(free)


def path_pattern(pattern: Column) -> Column:
    """A policy path as a pattern: `:name` stands for one part, `*` for the rest."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(pattern, r":[^/]+", "[^/]+"), F.lit("*"), F.lit(".*")), F.lit("$"))


def allowed(requests: DataFrame, policies: DataFrame, roles: DataFrame) -> DataFrame:
    """(request, allowed) of requests (request, user, path, action): a policy of one of the user's roles fits.

    policies: role, path, action (`*`: any); roles: user, role, with inherited roles already closed over.
    """
    held = requests.join(roles, "user").join(policies.withColumnsRenamed({"path": "policy_path", "action": "policy_action"}), "role")
    fits = held.filter((F.col("policy_action").isin("*") | (F.col("policy_action") == F.col("action"))) & F.expr("path RLIKE policy_path"))
    return requests.join(fits.select("request").distinct().withColumn("allowed", F.lit(True)), "request", "left").select("request", F.coalesce("allowed", F.lit(False)).alias("allowed"))
