"""One-permutation MinHash fingerprints with optimal densification, in built-in functions only."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import SPACE, with_columns

SHINGLE = 5
BINS = 128
#: Low-order bits kept of each bin's minimum.
KEPT = 8
#: Random bins tried for an empty one before all filled bins are ranked.
TRIES = 8
#: Rows meant for a bucket of neighbouring ids, and buckets at most.
BUCKET_ROWS, BUCKETS = 2_000, 65_536
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """A hash for each `width` consecutive words; fewer words are one shingle, none give an empty array."""
    hashes = F.transform(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.when(F.size(h) == 0, F.slice(h, 1, 0)).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        ),
    )


def minima(hashes: Column, bins: int = BINS) -> Column:
    """The least hash of each bin that has any, in the order of bins; a hash's highest bits name its bin.

    All hashes are binned in one pass: sorted, they lie bin by bin, each bin's least one first.
    """
    shift = 63 - int(math.log2(bins))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))

    return let(F.sort_array(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1))), firsts)


def _tries(bins: int) -> list[int]:
    """For each bin the TRIES bins that it tries in turn: xxhash64(bin, try) modulo bins, as Spark works it out."""

    def chained(j: int, t: int) -> int:
        h = xxhash.xxh64_intdigest(t.to_bytes(4, "little"), xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42))
        return (h - (1 << 64) if h >> 63 else h) % bins

    return [chained(j, t) for j in range(bins) for t in range(TRIES)]


def codes(text: Column, *, width: int = SHINGLE, bins: int = BINS, kept: int = KEPT) -> Column:
    """The low-order bits of every bin's minimum; an empty array for a text without words.

    An empty bin takes the minimum of another by optimal densification: it tries bins in a random order of its own,
    set by a hash of (bin, try), until one is filled; after TRIES the filled bin with the least hash of (bin, filled
    bin) is taken, which ends the order the same way for all texts. The order of tries is a constant of the plan, and
    minima lie in an array of one slot per bin, so a try is an index.
    """
    if bins & (bins - 1) or not 1 <= kept <= 8:
        raise ValueError("bins must be a power of two, and 1 to 8 bits are kept")
    shift = 63 - int(math.log2(bins))
    tries, every = F.lit(_tries(bins)), F.lit(list(range(bins)))

    def fill(slots: Column, filled: Column) -> Column:
        def value(j: Column) -> Column:
            ranked = F.array_min(F.transform(filled, lambda b: F.struct(F.xxhash64(j, b).alias("h"), b.alias("at"))))["at"]
            found = F.coalesce(F.get(slots, j), *[F.get(slots, F.get(tries, j * TRIES + t)) for t in range(TRIES)], F.get(slots, ranked))
            return found.bitwiseAND(F.lit((1 << kept) - 1)).cast("int")

        return F.transform(every, value)

    def dense(m: Column) -> Column:
        slot = lambda f: F.transform(every, lambda j: F.get(m, F.array_position(f, j).cast("int") - 1))
        return let(F.transform(m, lambda x: F.shiftright(x, shift).cast("int")), lambda f: let(slot(f), lambda s: fill(s, f)))

    return let(minima(shingle_hashes(text, width), bins), lambda m: F.when(F.size(m) > 0, dense(m)).otherwise(F.array().cast("array<int>")))


def packed(found: Column, kept: int = KEPT) -> Column:
    """Codes as hex digits, two for each; the empty text for an empty array."""
    return F.array_join(F.transform(found, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def likeness(a: Column, b: Column, *, bins: int = BINS, kept: int = KEPT) -> Column:
    """Estimated Jaccard similarity: the share of equal codes less what low-order bits share by chance, from 0 to 1.

    Two texts without words are alike (1), one without words is unlike any other (0).
    """
    by_chance = 1 / (1 << kept)
    share = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"])) / F.lit(float(bins))
    corrected = F.least(F.greatest((share - by_chance) / (1 - by_chance), F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def _bucket(key: Column, edges: list[int]) -> Column:
    """The number of edges up to key, by binary search."""
    if not edges:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    listed = F.lit(edges)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(edges)) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at))


def _cut(key: Column, tie: Column, quantiles: list[int]) -> Column:
    """A bucket for neighbours in the order of (key, tie), as (number, part): a key that is a quantile m times has m parts by its tie."""
    times = Counter(quantiles)
    hot = {k: m for k, m in times.items() if m > 1}
    edges = sorted({*times, *(k + 1 for k in hot if k < MOST)})
    number = _bucket(key, edges)
    if not hot:
        return F.struct(number.alias("number"), F.lit(0).alias("part"))
    parts = F.get(F.lit([hot.get(k, 1) for k in [LEAST, *edges]]), number)  # of the bucket that begins at an edge; a hot key fills its own
    share = (tie.cast("double") / float(1 << 64) + 0.5) * parts
    return F.struct(number.alias("number"), F.least(F.floor(share), parts - 1).cast("int").alias("part"))


def with_next(docs: DataFrame, key: Column, tie: Column, columns: dict[str, Column], *, rows: int = BUCKET_ROWS, prefix: str = "next_") -> DataFrame:
    """Adds columns of docs and, as prefix + name, of the row that follows in descending (key, tie); after the last, the first.

    Rows are dealt over buckets of neighbouring keys with near-equal counts, also where many rows share a key; each
    bucket also gets a copy of the next bucket's first row, so the order is followed without gathering rows in one task
    and texts are shuffled once. Only rows equal in key and tie can't be parted.
    """
    keyed = docs.withColumn("__key", F.coalesce(key.cast("long"), F.lit(LEAST))).withColumn("__tie", tie)
    buckets = min(BUCKETS, -(-keyed.count() // rows))
    quantiles: list[int] = []
    if buckets > 1:
        cuts = [k / buckets for k in range(1, buckets)]
        quantiles = keyed.agg(F.percentile_approx("__key", cuts, max(10_000, 10 * buckets)).alias("e")).first()["e"]
    keyed = keyed.withColumn("__bucket", _cut(F.col("__key"), F.col("__tie"), quantiles))
    heads = keyed.groupBy("__bucket").agg(F.max(F.struct("__key", "__tie")).alias("__head"))  # one row per bucket
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("__bucket"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("__bucket").alias("__for"), F.coalesce(F.lead("__head").over(order), F.first("__head").over(whole)).alias("__head"))
    heads = heads.select("__for", F.col("__head.__key").alias("__k"), F.col("__head.__tie").alias("__t"))
    met = keyed.join(F.broadcast(heads), (F.col("__key") == F.col("__k")) & (F.col("__tie") == F.col("__t"))).drop("__bucket", "__k", "__t")
    first = met.groupBy("__for").agg(F.first(F.struct(*[c for c in met.columns if c != "__for"])).alias("__row"))
    copies = first.select("__row.*", F.col("__for").alias("__bucket"), F.lit(1).alias("__copy"))
    every = with_columns(keyed.withColumn("__copy", F.lit(0)).unionByName(copies), columns)
    follow = Window.partitionBy("__bucket").orderBy("__copy", F.desc("__key"), F.desc("__tie"))
    for name in columns:
        every = every.withColumn(prefix + name, F.lead(name).over(follow))
    return every.filter("__copy = 0").drop("__copy", "__key", "__tie", "__bucket")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last half (rounded down, in code points) replaced by the first as many code points, or all,
    of the next document by descending id; after the last comes the first, and a lone document follows itself. Null
    text counts as empty; a text without words has an empty fingerprint; a null id comes last in the order; rows that
    repeat an id follow each other by a hash of their text; an empty table gives an empty one; other columns are not
    read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    both = with_next(rows, F.col("doc_id"), F.xxhash64("text"), {"text": F.col("text"), "codes": codes(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    found = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "codes", "next_codes")
    found = found.withColumn("edited_codes", codes(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("codes")).alias("fingerprint"),
        packed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
