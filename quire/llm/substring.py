"""Repeated passages, found in suffix trees over groups of suffixes that share a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import boxed, skew_safe_join, small_batches, spread, stored

WINDOW = 50
#: Words of the prefixes that suffixes are grouped by, each length for the groups that are too large by the one before;
#: what is still too large goes by the longest prefix, a whole window.
PREFIXES = (16, 32)
#: Suffixes that one subtree may hold.
GROUP = 20_000
#: Suffixes whose subtrees are built in one go.
BATCH = 8_000
WORDS_REMEMBERED = 200_000
LAST = (1 << 63) - 1
#: Odd multipliers of the two hashes of a window.
ODD = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(a: np.ndarray, b: np.ndarray, odd: tuple[int, int] = ODD[0]) -> np.ndarray:
    x = (a * np.uint64(odd[0]) + b) * np.uint64(odd[1])
    return x ^ (x >> np.uint64(29))


def _grams(hashes: np.ndarray, n: int, odd: tuple[int, int] = ODD[0]) -> np.ndarray:
    """A hash of the n words from each place on."""
    size = 1
    while size < n:
        step = min(size, n - size)
        hashes, size = _mix(hashes[:-step], hashes[step:], odd), size + step
    return hashes


def sampled_suffixes(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, first window, windows) of each sampled suffix of a document.

    Every window is given to the leftmost of the suffixes in it whose `prefix` words have the least hash. Equal windows
    thus have their suffix at the same place in them, with the same prefix, and a suffix's windows are consecutive.
    """
    if len(hashes) < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    grams = _grams(hashes, prefix)
    least, at = grams, np.arange(len(grams))
    span, size = window - prefix + 1, 1
    while size < span:
        step = min(size, span - size)
        first = least[:-step] <= least[step:]
        least, at, size = np.where(first, least[:-step], least[step:]), np.where(first, at[:-step], at[step:]), size + step
    begin = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return grams[at[begin]].view(np.int64), begin, np.diff(np.concatenate((begin, [len(at)])))


def _find_suffixes(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """(prefix, doc, tie, first, windows) of the sampled suffixes of all texts."""
    names = ["prefix", "doc", "tie", "first", "windows"]

    def run(batches):
        known = _Hashes()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split()
                if len(words) < window:
                    continue
                grams, first, count = sampled_suffixes(known.of(words), window, prefix)
                for part, values in zip(parts, (grams, np.full(len(first), doc), np.full(len(first), tie), first, count), strict=True):
                    part.append(values)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), pa.int64() if i < 3 else pa.int32()) for i, p in enumerate(parts)], names)

    return small_batches(texts).select("doc", "tie", "text").mapInArrow(run, "prefix long, doc long, tie long, first int, windows int")


#: A suffix with the words of its windows; `split`: its group was too large, and the prefix is one of the next length.
SUFFIX = "prefix long, doc long, tie long, first int, windows int, words string, split boolean"


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in SUFFIX.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(column, kinds[k]) for (_, k), column in zip(fields, zip(*held, strict=True), strict=True)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _split(words: list[bytes], doc: int, tie: int, first: int, window: int, prefix: int, known: _Hashes) -> Iterator[tuple]:
    """The suffixes, by a longer prefix, that stand for the windows of one suffix of a group that is too large."""
    grams, begin, count = sampled_suffixes(known.of(words), window, prefix)
    for gram, at, n in zip(grams.tolist(), begin.tolist(), count.tolist(), strict=True):
        yield gram, doc, tie, first + at, n, b" ".join(words[at : at + n - 1 + window]).decode(), True


def _cut_out(found: DataFrame, window: int, group: int, longer: int) -> DataFrame:
    """SUFFIX rows of each document's shared suffixes; found: doc, tie, text, spans of (prefix, n, first, windows)."""

    def suffixes(batches):
        known = _Hashes()
        for batch in batches:
            for doc, tie, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.encode().split()
                for s in spans:
                    own = words[s["first"] : s["first"] + s["windows"] - 1 + window]
                    if s["n"] > group:
                        yield from _split(own, doc, tie, s["first"], window, longer, known)
                    else:
                        yield s["prefix"], doc, tie, s["first"], s["windows"], b" ".join(own).decode(), False

    return found.mapInArrow(lambda batches: _batches(suffixes(batches)), SUFFIX)


def _lengthened(rows: DataFrame, window: int, longer: int) -> DataFrame:
    """SUFFIX rows with a longer prefix for those of groups that are too large."""

    def suffixes(batches):
        known = _Hashes()
        for batch in batches:
            for doc, tie, first, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "first", "words")), strict=True):
                yield from _split(words.encode().split(b" "), doc, tie, first, window, longer, known)

    return rows.select("doc", "tie", "first", "words").mapInArrow(lambda batches: _batches(suffixes(batches)), SUFFIX)


class Subtrees:
    """The suffix trees of groups of suffixes, as one suffix array with the common prefix lengths of neighbours.

    Suffixes are the starts of windows in the groups' texts. They are sorted by group, then by their first 64 words, or
    a window if that is longer, by ranks of 1, 2, 4, ... words; each text ends in a symbol of its own. An internal node is a run of suffixes
    whose neighbours have at least its depth in common.
    """

    def __init__(self, groups: np.ndarray, texts: list[str], window: int):
        split = [t.encode().split(b" ") for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        ids: dict[bytes, int] = {}
        self.begins = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.empty(int(lengths.sum()) + len(split), np.int64)
        ends = self.begins + lengths
        inner = np.ones(len(symbols), bool)
        inner[ends] = False
        symbols[inner] = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, int(lengths.sum()))
        symbols[ends] = len(ids) + np.arange(len(split))
        self.ranks, size = [symbols], 1
        while size < max(window, 64):
            known = self.ranks[-1]
            after = np.zeros(len(known), np.int64)
            after[:-size] = known[size:] + 1
            self.ranks.append(np.unique(known * (int(known.max()) + 2) + after, return_inverse=True)[1])
            size *= 2
        owner = np.repeat(np.arange(len(split)), lengths + 1)
        whole = np.flatnonzero(np.arange(len(symbols)) + window <= ends[owner])
        order = np.lexsort((self.ranks[-1][whole], groups[owner[whole]]))
        self.suffixes, self.owner = whole[order], owner[whole[order]]
        self.common = np.zeros(len(order), np.int64)  # with the suffix before
        a, b = self.suffixes[:-1].copy(), self.suffixes[1:].copy()
        for k in reversed(range(len(self.ranks))):
            same = self.ranks[k][np.minimum(a, len(symbols) - 1)] == self.ranks[k][np.minimum(b, len(symbols) - 1)]
            self.common[1:] += same << k
            a += same << k
            b += same << k
        self.common[1:][groups[self.owner[1:]] != groups[self.owner[:-1]]] = 0
        self.length = len(symbols)

    def deep_nodes(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(node of each suffix, depth of each node) of the nodes nearest the root that are `window` words deep; a lone suffix has depth 0."""
        begins = np.flatnonzero(self.common < window)
        node = np.cumsum(self.common < window) - 1
        depth = np.minimum.reduceat(np.where(self.common < window, LAST, self.common), begins) if len(begins) else np.zeros(0, np.int64)
        return node, np.where(depth == LAST, 0, depth)

    def maximal_repeats(self, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, stop): the longest runs of words that repeat a passage of `window` words or more of a smaller document.

        A node is a passage that all its suffixes begin with; those that are not in its smallest document repeat it, as far
        as the node is deep. Passages that overlap or touch in a text are one.
        """
        node, depth = self.deep_nodes(window)
        own = docs[self.owner]
        least = np.full(len(depth), LAST)
        np.minimum.at(least, node, own)
        late = own > least[node]
        edge = np.zeros(self.length + 1, np.int64)
        np.add.at(edge, self.suffixes[late], 1)
        np.add.at(edge, self.suffixes[late] + depth[node[late]], -1)
        covered = np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]))
        start, stop = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
        text = np.searchsorted(self.begins, start, "right") - 1
        return text, start - self.begins[text], stop - self.begins[text]


def _in_trees(suffixes: DataFrame, window: int) -> DataFrame:
    """(doc, tie, start, stop) of words to remove; whole prefix groups come to a task, and their subtrees are built there."""
    columns = ["prefix", "doc", "tie", "first", "words"]
    names = ["doc", "tie", "start", "stop"]

    def solve(t: pa.Table):
        groups, docs, ties, first = (t.column(c).to_numpy() for c in columns[:4])
        text, start, stop = Subtrees(groups, t.column("words").to_pylist(), window).maximal_repeats(docs, window)
        if len(text):
            yield pa.RecordBatch.from_arrays([pa.array(docs[text]), pa.array(ties[text]), pa.array(first[text] + start, pa.int32()), pa.array(first[text] + stop, pa.int32())], names)

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) < BATCH:
                continue
            rows = pa.concat_tables(held)
            groups = rows.column("prefix").to_numpy()
            whole = int(np.flatnonzero(groups != groups[-1])[-1] + 1) if groups[0] != groups[-1] else 0
            if whole:
                yield from solve(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if held and sum(map(len, held)):
            yield from solve(pa.concat_tables(held))

    return suffixes.select(columns).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "doc long, tie long, start int, stop int")


def _by_window(suffixes: DataFrame, window: int) -> DataFrame:
    """The same for prefixes that are hot at any length: their subtree is one path, whose leaf is the whole window.

    Only the smallest document of such a leaf counts, which an aggregation by 128 bits of hash finds with map-side
    combining, and no group is gathered; among 10^13 windows two would clash once in 10^12 times.
    """

    def run(batches):
        known = _Hashes()
        for batch in batches:
            docs, ties, firsts = (batch.column(c).to_numpy() for c in ("doc", "tie", "first"))
            hashes = [known.of(w.encode().split(b" ")) for w in batch.column("words").to_pylist()]
            if not hashes:
                continue
            n = np.fromiter((len(h) - window + 1 for h in hashes), np.int64, len(hashes))
            keys = np.empty((int(n.sum()), 2), np.uint64)
            begins = np.cumsum(n) - n
            for h, at, k in zip(hashes, begins.tolist(), n.tolist(), strict=True):
                keys[at : at + k, 0] = _grams(h, window, ODD[0])
                keys[at : at + k, 1] = _grams(h ^ (h >> np.uint64(31)), window, ODD[1])
            start = np.repeat(firsts - begins, n) + np.arange(len(keys))
            key = pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([key, pa.array(np.repeat(docs, n)), pa.array(np.repeat(ties, n)), pa.array(start, pa.int32())], ["key", "doc", "tie", "start"])

    each = stored(suffixes.select("doc", "tie", "first", "words").mapInArrow(run, "key binary, doc long, tie long, start int"))
    least = stored(each.groupBy("key").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")))
    later = skew_safe_join(each, least, "key", "n", F.xxhash64("doc", "start"), "leaf").filter("doc > leaf.least")
    return later.select("doc", "tie", "start", (F.col("start") + window).alias("stop"))


def _shared(suffixes: DataFrame) -> DataFrame:
    """(prefix, n, a, b): the count and the least and greatest document of each prefix that more than one may hold."""
    found = suffixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    return stored(found.filter("a < b OR n > 1000"))


def _with_group(suffixes: DataFrame, shared: DataFrame) -> DataFrame:
    """The suffixes whose prefix two documents hold, with the size of its group as n."""
    found = skew_safe_join(suffixes, shared, "prefix", "n", F.xxhash64("doc", "first"), "group").filter("group.a < group.b")
    return found.withColumn("n", F.col("group.n")).drop("group")


def removals(texts: DataFrame, *, window: int = WINDOW, prefixes: Sequence[int] = PREFIXES, group: int = GROUP) -> DataFrame:
    """(doc, tie, spans) of word ranges to remove; texts: doc, tie, text.

    1. Each document samples about two suffixes for every `window - prefix` words; only prefixes that occur in two
       documents go on, so text that repeats nothing is left here.
    2. Prefixes are of variable length: where a group has more than `group` suffixes, its windows are given to suffixes
       by the next longer prefix. Equal windows always go the same way, as it depends on nothing but their words.
    3. Groups that fit are dealt out whole, and their subtrees are built; their nodes that are a window deep are repeats.
    """
    suffixes = stored(_find_suffixes(texts, window, prefixes[0]))
    shared = _shared(suffixes)
    spans = _with_group(suffixes, shared).groupBy("doc", "tie").agg(F.collect_list(F.struct("prefix", "n", "first", "windows")).alias("spans"))
    lengths = [*prefixes, window]
    rows = stored(_cut_out(texts.join(spans.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "spans"), window, group, lengths[1]))
    found, rest = _in_trees(rows.filter("NOT split"), window), rows.filter("split")
    if (shared.filter("a < b").agg(F.max("n")).first()[0] or 0) > group:
        for longer in lengths[2:]:
            grouped = _with_group(rest, _shared(rest))
            found = found.union(_in_trees(grouped.filter(F.col("n") <= group), window))
            rest = grouped.filter(F.col("n") > group)
            if longer < window:
                rest = stored(_lengthened(rest, window, longer))
        found = found.union(_by_window(rest, window))
    return found.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def kept_words(text: str, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words outside of spans, and the number of all words."""
    words = text.encode().split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["stop"] for s in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)], len(words)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, in_place: bool, **options) -> DataFrame:
    """(box, doc, text, spans): every row with the word ranges that it loses, null if none; rows that share an id are told apart by their places."""
    docs = docs if in_place else stored(docs)
    place = docs.metadataColumn("_metadata")
    tie = F.xxhash64(place["file_path"], place["row_index"])
    rows = spread(docs.select(boxed(docs).alias("box"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc"), tie.alias("tie"), F.coalesce(docs[text_col], F.lit("")).alias("text")))
    spans = removals(rows.select("doc", "tie", "text"), **options).hint("merge")  # the same plan for small tables and large
    return rows.join(spans, ["doc", "tie"], "left").select("box", "doc", "text", "spans")


def substring_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", in_place: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space) of every row.

    A word goes if a window of 50 words around it also starts in a document with a smaller id, in the texts as they
    came. Null texts have no words; a null id counts as larger than all others; rows that repeat an id are never each
    other's smaller document; texts shorter than a window keep everything; an empty table gives an empty one. in_place: docs is
    read from Parquet and not changed since; otherwise it is written once, so that rows have places.
    """

    def run(batches):
        for batch in batches:
            found = [kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([n - len(w) for w, n in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in found])],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = _with_spans(docs, id_col, text_col, in_place, **options).select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "text", "spans")
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: str | None = None, in_place: bool = False, **options) -> DataFrame:
    """docs with the repeated words gone from their texts; a column named `lengths`, if there is one, gets the new code points.

    Texts that lose nothing stay as they are, null and empty ones too; others become their kept words, joined by one
    space. Ids and rows count as for `substring_digests`; all other columns stay, whatever their names.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, list(s))[0]).decode() for t, s in zip(texts, found, strict=True)], dtype=object)

    found = _with_spans(docs, id_col, text_col, in_place, **options)
    found = found.select("box", F.when(F.col("spans").isNotNull(), cut(F.when(F.col("spans").isNotNull(), F.col("text")).otherwise(""), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")))).alias("cut"))
    text = F.coalesce("cut", F.col("box")[text_col])
    n = F.when(F.col("cut").isNotNull(), F.length("cut")).otherwise(F.col("box")[lengths]) if lengths in docs.columns else None
    return found.select(*[text.alias(c) if c == text_col else n.cast(docs.schema[c].dataType).alias(c) if c == lengths else F.col("box")[c].alias(c) for c in docs.columns])
