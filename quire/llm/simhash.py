"""SimHash near-duplicates, found by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import boxed, small_batches, stored
from quire.llm.components import components

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Costs of making and shuffling one probe, in comparisons of two fingerprints.
PROBE_COST = 12.0


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 values."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)), np.uint64, last)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, last, 1 << 14):
        part = hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last).view(">i8")[0])


def order_of(key: Column) -> Column:
    """Ids in the order that names groups, null ids last."""
    return F.coalesce(key.cast("long"), F.lit((1 << 63) - 1))


def tie_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, *, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, fp) of every row; tie tells rows that share an id apart."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([simhash(t, width) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "tie", "fp"])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), tie_of(docs[text_col]).alias("tie"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, tie long, fp long")


def bit_table(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(n, 64 x 64 counts of fingerprints with both bits set) over all fingerprints; 4096 sums reach the driver."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            n += len(x)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, BITS * BITS), pa.int32()), pa.array([n, *both.ravel().astype(np.int64).tolist()], pa.int64())], ["k", "n"])

    sums = {r["k"]: r["n"] for r in prints.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into `parts` groups of near-equal width, each grown from a seed by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (r[b, sorted(left)].max(), -b))]
        left.discard(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (r[b, group].sum(), -b)))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


@dataclass(frozen=True)
class Plan:
    """Groups of bits with the threshold of each; -1: the group is not probed."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def allocate(n: int, p: np.ndarray, groups: list[list[int]], distance: int = DISTANCE) -> Plan:
    """Thresholds of least estimated cost, by dynamic programming.

    If thresholds add up to distance - parts + 1, two fingerprints within `distance` are within the threshold of one
    group at least. A threshold's cost is its probes, and its candidates: pairs of fingerprints times the probability
    that the differing bits of the group are as few, each bit differing with probability 2p(1-p).
    """
    options = []
    for group in groups:
        few = np.array([1.0])
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            few = np.convolve(few, [1 - q, q])
        options.append([0.0] + [PROBE_COST * n * sum(math.comb(len(group), d) for d in range(t + 1)) + n * n / 2 * few[: t + 1].sum() for t in range(distance + 1)])
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for costs in options:  # spent: the sum of (threshold + 1), distance + 1 in the end
        best = {s: min((best[s - k][0] + costs[k], (*best[s - k][1], k - 1)) for k in range(min(s, distance + 1) + 1) if s - k in best) for s in range(distance + 2) if any(s - k in best for k in range(min(s, distance + 1) + 1))}
    cost, thresholds = best[distance + 1]
    return Plan(tuple(map(tuple, groups)), thresholds, cost)


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> Plan:
    """The cheapest plan among numbers of groups; more fingerprints lead to fewer, wider groups and more probes."""
    p = np.diag(both) / max(n, 1)
    return min((allocate(n, p, correlated_groups(n, both, parts), distance) for parts in range(2, distance + 3)), key=lambda x: x.cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(part: int, own: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("key"))


def _signatures(fp: Column, how: Plan, probe: bool) -> Column:
    """Structs of (group, key); as probes, keys that differ from the own one by up to the threshold too."""
    out = []
    for i, (group, threshold) in enumerate(zip(how.groups, how.thresholds, strict=True)):
        if threshold < 0:
            continue
        flips = [0]
        for _ in range(threshold if probe else 0):
            flips = list(dict.fromkeys([*flips, *(f | 1 << (BITS - 1 - b) for f in flips for b in group)]))
        mask = _signed(sum(1 << (BITS - 1 - b) for b in group))
        out.append(F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), _keyed(i, fp.bitwiseAND(F.lit(mask)))))
    return F.concat(*out)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs a < b of distinct fingerprints within `distance`, perhaps repeated; prints has each fp once.

    The comparison stands in the join itself, so candidates that fail it are never made into rows.
    """
    how = plan(*bit_table(prints), distance)
    probes = prints.select(F.col("fp").alias("a"), F.explode(_signatures(F.col("fp"), how, True)).alias("s")).select("a", "s.part", "s.key")
    index = prints.select(F.col("fp").alias("b"), F.explode(_signatures(F.col("fp"), how, False)).alias("s")).select("b", F.col("s.part").alias("p2"), F.col("s.key").alias("k2"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probes.join(index, (F.col("part") == F.col("p2")) & (F.col("key") == F.col("k2")) & (F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept and tie of every row.

    Equal fingerprints are one node, so copies never meet in pairs; nodes within `distance` bits are linked, and
    component_id is the smallest doc_id that can be reached, and that row is kept. Texts without words have fingerprint zero and are linked
    like any other; fewer words than `width` are one shingle; a null id takes part but never names a component, which
    without any id has null; rows that repeat an id share a component only if their texts do, and one of them is kept
    (both, if id and text are the same: exact deduplication comes first); an empty table gives an empty one.
    """
    every = stored(fingerprints(docs, width=width, id_col=id_col, text_col=text_col))
    return every.join(groups(every, distance), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif("rep.order", order_of(F.lit(None))).alias("component_id"),
        ((order_of(F.col("doc_id")) == F.col("rep.order")) & (F.col("tie") == F.col("rep.tie"))).alias("kept"),
        "tie",
    )


def groups(every: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, rep) of each distinct fingerprint: the order and tie of the first row of its component; every: doc_id, tie, fp."""
    prints = every.groupBy("fp").agg(F.min(F.struct(order_of(F.col("doc_id")).alias("order"), "tie")).alias("first"))
    found = components(links(prints, distance), "a", "b")
    nodes = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    names = nodes.groupBy("label").agg(F.min("first").alias("rep"))
    return nodes.join(names, "label").select("fp", "rep")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs less all rows but one of each group of near-duplicates; options are those of `near_duplicates`, as is what is kept."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select(order_of(F.col("doc_id")).alias("order"), "tie")
    rows = docs.select(boxed(docs).alias("box"), order_of(docs[id_col]).alias("order"), tie_of(docs[text_col]).alias("tie"))
    return rows.join(kept, ["order", "tie"], "left_semi").select("box.*")
