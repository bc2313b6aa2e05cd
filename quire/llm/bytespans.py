"""Repeated strings of bytes, found in suffix arrays of shards that hold all the text which may repeat together."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import boxed, shared_dir, small_batches, stored
from quire.llm.induction import MEMORY, Scratch, descending

WINDOW = 50
#: Bytes of an anchor: strings of 16 bytes meet by chance in many documents of a large table, and the more the larger it is.
ANCHOR = 24
#: Bytes of text in a block, of anchors in a bucket, of text in a shard, and windows that are hashed at a time.
BLOCK, BUCKET, SHARD, SLICE = 2 << 20, 8 << 20, 6 << 20, 1 << 19
#: Buckets, or shards, that are sent together at most, where there are many for each core.
GROUP = 8
#: Blocks that hold an anchor from which on its windows go to shards one by one.
HOT = 1000
LAST = (1 << 63) - 1
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTES = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on: polynomials of 1, 2, 4, ... bytes, then mixed."""
    found, size, factor = BYTES[data], 1, ODD[0]
    while size < n:
        step = min(size, n - size)
        found = found[:-step] * np.uint64(pow(ODD[0], step, 1 << 64)) + found[step:] if step == size else found[:-step] * np.uint64(factor) + found[step:]
        size += step
        factor = pow(ODD[0], size, 1 << 64)
    found = (found ^ found >> np.uint64(32)) * np.uint64(ODD[1])
    return found ^ found >> np.uint64(29)


def anchored(data: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, hash of the anchor) of each run of windows of the texts, which lie in `data` one after the other.

    The anchor of a window is the string of `anchor` bytes in it whose hash has the least upper half, the leftmost of
    such. Equal windows have equal anchors at equal places, wherever they stand; neighbours mostly share theirs.
    """
    begins = np.append(0, ends)[:-1]
    long = ends - begins >= window
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begins[long]] += 1
    edge[ends[long] - window + 1] -= 1
    whole = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    firsts, places, hashes = [], [], []
    for i in range(0, max(len(data) - window + 1, 0), SLICE):
        grams = _grams(data[i : i + SLICE + window - 1], anchor)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, size = window - anchor + 1, 1
        while size < span:
            step = min(size, span - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = whole[i : i + len(at)]
        new = own & np.append(True, (at[1:] != at[:-1]) | ~own[:-1])
        begin = np.flatnonzero(new)
        firsts.append(begin + i)
        hashes.append(grams[at[begin]])
        stop = np.flatnonzero(own & np.append(new[1:] | ~own[1:], True)) + 1
        places.append(stop - begin)
    empty = np.zeros(0, np.int64)
    if not firsts:
        return empty, empty, empty.astype(np.uint64)
    found = np.concatenate(hashes) * np.uint64(ODD[1])  # anchors have small upper halves, which are spread again
    return np.concatenate(firsts), np.concatenate(places), found ^ found >> np.uint64(32)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, owners, lengths, digests, texts, bytes): runs of a task's rows, ending as they reach `size` bytes, texts compressed.

    rows: file, at, doc, text. A block is named by the place of its first row; owners are file, at and doc of each row, digests
    128 bits of each text's SHA-256.
    """

    def run(batches):
        codec = pa.Codec("zstd", compression_level=4)
        owners: list[list[int]] = []
        texts: list[bytes] = []
        held = 0

        def block():
            data = b"".join(texts)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            packed = codec.compress(data, asbytes=True) if data else b""
            digests = b"".join(hashlib.sha256(t).digest()[:16] for t in texts)
            values = ([f"{owners[0][0]}:{owners[0][1]}"], [np.array(owners, np.int64).tobytes()], [lengths.tobytes()], [digests], [packed], [len(data)])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.string(), *(pa.binary(),) * 4, pa.int64()), strict=True)], ["block", "owners", "lengths", "digests", "texts", "bytes"])

        for batch in batches:
            for *owner, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                owners.append(owner)
                texts.append(text.encode())
                held += len(texts[-1])
                if held >= size:
                    yield block()
                    owners, texts, held = [], [], 0
        if owners:
            yield block()

    return small_batches(rows).select("file", "at", "doc", "text").mapInArrow(run, "block string, owners binary, lengths binary, digests binary, texts binary, bytes long")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, ends of the texts, owners) of a block."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    data = pa.decompress(row["texts"], row["bytes"], "zstd", asbytes=True) if row["bytes"] else b""
    return np.frombuffer(data, np.uint8), np.cumsum(lengths), np.frombuffer(row["owners"], np.int64).reshape(-1, 3)


def _flags(row: dict, n: int) -> np.ndarray:
    """Which of a block's n rows are copies, whose text a row with a smaller id has."""
    return np.unpackbits(np.frombuffer(row["copies"], np.uint8), count=n).view(bool) if row["copies"] else np.zeros(n, bool)


def _kept(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, ends of the texts, owners, numbers of the rows) of a block without its copies."""
    data, ends, owners = _opened(row)
    kept = ~_flags(row, len(owners))
    if kept.all():
        return data, ends, owners, np.arange(len(owners))
    lengths = np.diff(ends, prepend=0)
    return data[np.repeat(kept, lengths)], np.cumsum(lengths[kept]), owners[kept], np.flatnonzero(kept)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, whether more than one document has each, and which of them each run has."""
    values, inverse = np.unique(hashes, return_inverse=True)
    low, high = np.full(len(values), LAST), np.full(len(values), -LAST - 1)
    np.minimum.at(low, inverse, docs)
    np.maximum.at(high, inverse, docs)
    return values, low < high, inverse


def _placed(rows: DataFrame, places: int) -> DataFrame:
    """Writes blocks into the shared folder, bucketed by their names, so that what is joined to them comes to their texts.

    The table of the session's catalog stands for its files only, which stay there as those of `stored` do.
    """
    name = f"quire_{uuid.uuid4().hex}"
    rows.write.bucketBy(places, "block").option("path", f"{shared_dir(rows.sparkSession)}/{name}").saveAsTable(name, format="parquet")
    return rows.sparkSession.table(name)


def _listed(rows: DataFrame, places: int, value: Column, name: str) -> DataFrame:
    """(block, name): the values of each block, dealt over as many tasks as the table of blocks has places.

    Dealt over any other number, the larger of both holds for a join, and the table's texts might be shuffled.
    """
    return rows.repartition(places, "block").groupBy("block").agg(F.collect_list(value).alias(name))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _together(parts: int, cores: int) -> tuple[int, int]:
    """(groups, parts of a group) for so many parts at least.

    What is sent has a row for each block and group, so that rows would grow with the square of the input if parts were sent
    one by one; a group's parts are still worked on one after the other.
    """
    size = max(1, min(GROUP, parts // (8 * cores)))
    return -(-parts // size), size


def _least(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct digests in order, as two columns of words, the least document with each, and which of them each row has."""
    words = np.frombuffer(row["digests"], np.uint64).reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.append(True, (words[order[1:]] != words[order[:-1]]).any(1))[: len(order)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    docs = np.frombuffer(row["owners"], np.int64).reshape(-1, 3)[:, 2]
    begin = np.flatnonzero(new)
    return words[order[begin]], np.minimum.reduceat(docs[order], begin), which


def _copies(table: DataFrame, places: int, buckets: int) -> DataFrame:
    """(block, copies): bits for the rows of a block whose whole text a row with a smaller id has, told by 128 bits.

    A copy loses all of its text if that is as long as a window, and nothing that it has is any window's least document, so
    texts go on with their least document alone.
    """

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, docs, _ = _least(row)
                cuts = np.searchsorted(_bucket(words[:, 0], buckets), np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                some = [(int(b), row["block"], words[cuts[b] : cuts[b + 1]].tobytes(), docs[cuts[b] : cuts[b + 1]].tobytes()) for b in used]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "words", "docs"])

    def solve(rows: list[dict]):
        words, docs = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("words", np.uint64), ("docs", np.int64)))
        words = words.reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0]))
        new = np.append(True, (words[order[1:]] != words[order[:-1]]).any(1))
        begin, least = np.flatnonzero(new), np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(docs[order], begin)[np.cumsum(new) - 1]
        cuts = np.cumsum([0, *(len(r["docs"]) // 8 for r in rows)])
        found = [(r["block"], r["bucket"], least[a:b].tobytes()) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True) if (least[a:b] < docs[a:b]).any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["block", "bucket", "least"])

    def tell(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                words, least, which = _least(row)
                cuts = np.searchsorted(_bucket(words[:, 0], buckets), np.arange(buckets + 1))
                least = least.copy()
                for x in row["answers"] or []:
                    least[cuts[x["bucket"]] : cuts[x["bucket"] + 1]] = np.frombuffer(x["least"], np.int64)
                copies = np.frombuffer(row["owners"], np.int64).reshape(-1, 3)[:, 2] > least[which]
                if copies.any():
                    found.append((row["block"], np.packbits(copies).tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.binary()), strict=True)], ["block", "copies"])

    own = table.select("block", "owners", "digests")
    asks = small_batches(own).mapInArrow(ask, "bucket long, block string, words binary, docs binary")
    answers = asks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_grouped("bucket", solve), "block string, bucket long, least binary")
    each = _listed(answers, places, F.struct("bucket", "least"), "answers")
    return own.join(each.hint("merge"), "block", "left").mapInArrow(tell, "block string, copies binary")


def _grouped(key: str, solve):
    """Gives `solve` the rows of each key, which lie together, as a list."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0][key] != row[key]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    return run


def _asks(table: DataFrame, groups: int, size: int, window: int, anchor: int) -> DataFrame:
    """(bucket, block, hashes, many, n): a block's distinct anchors, each once, and whether several of its documents have it.

    The upper half of a hash says its bucket, the lower one is sent: that two anchors of a bucket have it by chance (once in
    4,000 anchors of a full bucket) sends pieces to a shard that share nothing there. A row holds `size` buckets, n anchors of each.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, owners, _ = _kept(row)
                first, _, hashes = anchored(data, ends, window, anchor)
                values, many, _ = _distinct(hashes, owners[np.searchsorted(ends, first, "right"), 2])
                cuts = np.searchsorted(_bucket(values, groups * size), np.arange(groups * size + 1))
                n = np.diff(cuts).reshape(groups, size)
                cuts, values, used = cuts[::size], values.astype("<u4"), np.flatnonzero(n.any(1))
                for i in range(0, len(used), 1024):
                    some = [(int(b), row["block"], values[cuts[b] : cuts[b + 1]].tobytes(), np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes(), n[b].tobytes()) for b in used[i : i + 1024]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.int64(), pa.string(), *(pa.binary(),) * 3), strict=True)], ["bucket", "block", "hashes", "many", "n"])

    return table.select("block", "owners", "lengths", "copies", "texts", "bytes").mapInArrow(run, "bucket long, block string, hashes binary, many binary, n binary")


def _answers(asks: DataFrame, groups: int, size: int, hot: int) -> DataFrame:
    """(block, bucket, shared, hot, n): bits for a block's anchors in a row's buckets; n of them occur in another document."""

    def solve(rows: list[dict]):
        hashes = np.concatenate([np.frombuffer(r["hashes"], "<u4") for r in rows])
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(r["hashes"]) // 4) for r in rows]).view(bool)
        n = np.array([np.frombuffer(r["n"], np.int64) for r in rows])
        begin = np.append(0, np.cumsum(n))[:-1].reshape(n.shape)
        shared, often = np.zeros((2, len(hashes)), bool)
        for i in range(size):
            parts = [slice(a, a + k) for a, k in zip(begin[:, i].tolist(), n[:, i].tolist(), strict=True)]
            _, inverse, counts = np.unique(np.concatenate([hashes[p] for p in parts]), return_inverse=True, return_counts=True)
            several = counts > 1
            several[inverse[np.concatenate([many[p] for p in parts])]] = True
            cuts = np.cumsum(n[:, i]).tolist()
            for p, b in zip(parts, cuts, strict=True):
                own = inverse[b - p.stop + p.start : b]
                shared[p], often[p] = several[own], counts[own] >= hot
        cuts = np.append(begin[:, 0], len(hashes)).tolist()
        found = []
        for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
            if shared[a:b].any():
                found.append((r["block"], r["bucket"], np.packbits(shared[a:b]).tobytes(), np.packbits(often[a:b]).tobytes(), int(shared[a:b].sum())))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["block", "bucket", "shared", "hot", "n"])

    return small_batches(asks).repartition(groups, "bucket").sortWithinPartitions("bucket").mapInArrow(_grouped("bucket", solve), "block string, bucket long, shared binary, hot binary, n long")


#: Distinct strings of windows of some blocks that go to one group of shards: names of the blocks, for each shard how many strings,
#: owners and bytes, and what `_packed` makes of the strings.
PIECES = "shard long, blocks array<string>, n array<long>, packed binary"
#: For each string: lower half of its anchor's hash, bytes, owners; for each owner: block, row in the block, first window in the text, document.
_PIECE = ("<u4", "<u2", "<u4")
_OWNER = ("<u2", "<i4", "<i4", "<i8")


def _mixed(parts: list[np.ndarray], odd: int) -> np.ndarray:
    found = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        found = (found ^ p.astype(np.uint64)) * np.uint64(odd)
        found ^= found >> np.uint64(31)
    return found


def _strings(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the strings of data that begin and are as long as told, one after the other."""
    return data[np.arange(int(length.sum())) + np.repeat(begin - np.cumsum(length) + length, length)]


def _packed(columns: list[np.ndarray]) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(b"".join(c.tobytes() for c in columns), asbytes=True)


def _unpacked(n: list[int], packed: bytes) -> list[np.ndarray]:
    """The columns of _PIECE and _OWNER and the bytes of the strings; n: strings, owners, bytes."""
    kinds = [(np.dtype(k), n[0]) for k in _PIECE] + [(np.dtype(k), n[1]) for k in _OWNER] + [(np.dtype(np.uint8), n[2])]
    whole, at, found = pa.decompress(packed, sum(k.itemsize * m for k, m in kinds), "zstd", asbytes=True), 0, []
    for k, m in kinds:
        found.append(np.frombuffer(whole, k, m, at))
        at += k.itemsize * m
    return found


def _told(data: np.ndarray, begin: np.ndarray, length: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each of these strings of 8 to `longest` bytes, from as many words of eight bytes for each."""
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    parts = [length] + [words[begin + np.minimum(i, length - 8)].copy().view("<u8")[:, 0] for i in range(0, longest, 8)]
    return _mixed(parts, ODD[0]), _mixed(parts, ODD[1])


def _pieces(found: DataFrame, buckets: tuple[int, int], shards: tuple[int, int], window: int, anchor: int) -> DataFrame:
    """PIECES rows of the anchors that occur in another document; found: blocks with their answers.

    Equal strings of the blocks of a batch are told by 128 bits of hash and are one piece. Windows of hot anchors are pieces of
    their own, which go where their own hash sends them. What goes from a batch to one group of shards is packed together.
    buckets, shards: groups, and how many are in each.
    """
    of_group = shards[1]

    def chosen(row: dict):
        """(data, ends, owners, first window, windows, hash, hot, row numbers) of a block's runs of windows whose anchor is shared."""
        data, ends, owners, numbers = _kept(row)
        first, count, hashes = anchored(data, ends, window, anchor)
        values, inverse = np.unique(hashes, return_inverse=True)
        cuts = np.searchsorted(_bucket(values, buckets[0] * buckets[1]), np.arange(0, buckets[0] * buckets[1] + 1, buckets[1]))
        shared, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
        for x in row["answers"]:
            a, b = int(cuts[x["bucket"]]), int(cuts[x["bucket"] + 1])
            shared[a:b] = np.unpackbits(np.frombuffer(x["shared"], np.uint8), count=b - a)
            hot[a:b] = np.unpackbits(np.frombuffer(x["hot"], np.uint8), count=b - a)
        some = shared[inverse]
        return data, ends, owners, first[some], count[some], hashes[some], hot[inverse[some]], numbers

    def pieces(rows: list[dict]):
        parts = [chosen(row) for row in rows]
        bases = np.cumsum([0, *(len(p[0]) for p in parts)])
        data = np.concatenate([p[0] for p in parts])
        first = np.concatenate([p[3] + base for p, base in zip(parts, bases[:-1], strict=True)])
        count, hashes, apart = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
        n = count[apart]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = np.concatenate((first[~apart], np.repeat(first[apart], n) + nth))
        if not len(begin):
            return
        length = np.concatenate((count[~apart], np.ones(len(nth), np.int64))) - 1 + window
        a, b = _told(data, begin, length, 2 * window)
        keys = np.concatenate((hashes[~apart], a[len(begin) - len(nth) :]))
        order = np.lexsort((b, a, keys))
        new = np.append(True, (keys[order[1:]] != keys[order[:-1]]) | (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
        which = np.searchsorted(bases, begin[order], "right") - 1
        row, at, doc = np.empty((3, len(order)), np.int64)
        for i, (_, ends, owners, *_) in enumerate(parts):
            own = which == i
            place = begin[order[own]] - bases[i]
            k = np.searchsorted(ends, place, "right")
            row[own], at[own], doc[own] = parts[i][7][k], place - np.append(0, ends)[k], owners[k, 2]
        one = np.flatnonzero(new)
        n, keys, begin, length = np.diff(np.append(one, len(order))), keys[order[one]], begin[order[one]], length[order[one]]
        cuts = np.searchsorted(_bucket(keys, shards[0] * of_group), np.arange(shards[0] * of_group + 1))
        owned = np.append(one, len(order))
        counts = np.diff(np.stack((cuts, owned[cuts], np.append(0, np.cumsum(length))[cuts])), axis=1)
        names, out = [r["block"] for r in rows], []
        for k in np.flatnonzero(np.diff(cuts[::of_group])).tolist():
            i, j = int(cuts[k * of_group]), int(cuts[(k + 1) * of_group])
            o = slice(int(owned[i]), int(owned[j]))
            text = _strings(data, begin[i:j], length[i:j])
            columns = [c.astype(t) for c, t in zip((keys[i:j], length[i:j], n[i:j], which[o], row[o], at[o], doc[o]), _PIECE + _OWNER, strict=True)]
            out.append((k, names, counts[:, k * of_group : (k + 1) * of_group].ravel().tolist(), _packed([*columns, text])))
            if len(out) == 256 or j == len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["shard", "blocks", "n", "packed"])
                out = []

    def run(batches):
        for batch in batches:
            if len(batch):
                yield from pieces(batch.to_pylist())

    return small_batches(found).mapInArrow(run, PIECES)


class Shard:
    """Distinct pieces of text; for each of their windows, the least document that has it."""

    def __init__(self, window: int, anchors: np.ndarray, texts: pa.Array, least: np.ndarray):
        self.window, self.anchors = window, anchors
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.begin, self.length = bounds[:-1], np.diff(bounds)
        self.counts = self.length - window + 1
        self.begins = np.cumsum(self.counts) - self.counts
        self.least = np.repeat(least, self.counts)

    def text(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, where each piece begins): the pieces, each before its end, and the end of all; 0 and 1 are the ends."""
        length = self.length[pieces]
        starts = np.cumsum(length + 1) - length - 1
        found = np.ones(int(length.sum()) + len(pieces) + 1, np.uint8)
        found[-1] = 0
        nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        # UTF-8 has no bytes from 0xF8 on, so there is room for two more symbols, and one above all.
        found[np.repeat(starts, length) + nth] = self.data[np.repeat(self.begin[pieces], length) + nth] + np.uint8(2)
        return found, starts

    def settle(self, scratch: Scratch, memory: int) -> None:
        """Gives all windows that are equal the least of their documents.

        The suffixes of all pieces lie in order; a run of them with a window in common is that window, wherever it
        stands. Pieces whose anchor no other piece has can't share a window, and stay out.
        """
        _, inverse, size = np.unique(self.anchors, return_inverse=True, return_counts=True)
        several = np.flatnonzero(size[inverse] > 1)
        if not len(several):
            return
        text, starts = self.text(several)
        ends = starts + self.length[several]
        held_place, held_shared = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def group(places: np.ndarray, shared: np.ndarray) -> None:
            """Gives whole runs their least document."""
            run = np.cumsum(shared < self.window)
            inside = np.append(run[1:] == run[:-1], False)
            inside[1:] |= run[1:] == run[:-1]
            places, run = places[inside], run[inside]
            piece = np.searchsorted(ends, places)
            fits = places + self.window <= ends[piece]
            places, run, piece = places[fits], run[fits], piece[fits]
            if not len(places):
                return
            window = self.begins[several[piece]] + places - starts[piece]
            cut = np.append(0, np.flatnonzero(np.diff(run)) + 1)
            found = np.minimum.reduceat(self.least[window], cut)
            self.least[window] = np.repeat(found, np.diff(np.append(cut, len(run))))

        for block in descending(text, 256, scratch, memory=memory, most=self.window):
            held_place, held_shared = np.append(held_place, block >> 8), np.append(held_shared, block & 255)
            fresh = np.flatnonzero(held_shared < self.window)
            if len(held_place) >= 1 << 16 and len(fresh) and fresh[-1]:
                group(held_place[: fresh[-1]], held_shared[: fresh[-1]])
                held_place, held_shared = held_place[fresh[-1] :], held_shared[fresh[-1] :]
        group(held_place, held_shared)


def _spans(pieces: DataFrame, groups: int, size: int, window: int, memory: int) -> DataFrame:
    """(block, spans): rows of a block with the bytes to remove, as triples (row, start, stop); one row for a block and group."""
    folder = shared_dir(pieces.sparkSession)

    def settled(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the block, span) of all bytes to remove that one shard's strings tell."""
        anchor, length, n, block, row, at, doc, text = (np.concatenate(c) for c in zip(*parts, strict=True))
        offsets = np.append(0, np.cumsum(length, dtype=np.int64)).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
        number, distinct = texts.indices.to_numpy(), texts.dictionary
        own = np.repeat(number, n)
        least = np.full(len(distinct), LAST)
        np.minimum.at(least, own, doc)
        anchors = np.zeros(len(distinct), np.int64)
        anchors[number] = anchor
        shard = Shard(window, anchors, distinct, least)
        scratch = Scratch(folder)
        try:
            shard.settle(scratch, memory)
        finally:
            scratch.close()
        # Runs of windows with one least document, for each piece.
        new = np.append(True, shard.least[1:] != shard.least[:-1])
        new[shard.begins] = True
        begin = np.flatnonzero(new)
        until = np.append(begin[1:], len(shard.least))
        first, stop = np.searchsorted(begin, shard.begins), np.searchsorted(begin, shard.begins + shard.counts)
        runs = stop[own] - first[own]
        which = np.repeat(np.arange(len(own)), runs)
        r = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs) + first[own[which]]
        gone = doc[which] > shard.least[begin[r]]
        which, r = which[gone], r[gone]
        start = at[which].astype(np.int64) + begin[r] - shard.begins[own[which]]
        return block[which], np.stack((row[which], start, start + until[r] - begin[r] - 1 + window), 1).astype(_SPAN)

    def spans(rows: list[dict]):
        """The spans of one group's rows, whose shards are settled one after the other."""
        names, numbered = np.unique([b for r in rows for b in r["blocks"]], return_inverse=True)
        numbered = numbered.astype(np.int32)
        firsts = np.cumsum([0, *(len(r["blocks"]) for r in rows)])
        held = []
        for r, base in zip(rows, firsts[:-1], strict=True):
            n = np.array(r["n"]).reshape(3, size)
            columns = _unpacked(n.sum(1).tolist(), r.pop("packed"))
            columns[3] = numbered[columns[3] + base]
            held.append((columns, np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(n, 1)), 1).tolist()))
        found = []
        for i in range(size):
            cut = [(c, [slice(x[i], x[i + 1]) for x in cuts]) for c, cuts in held if cuts[0][i] < cuts[0][i + 1]]
            if cut:
                found.append(settled([[*(x[s] for x in c[:3]), *(x[o] for x in c[3:7]), c[7][b]] for c, (s, o, b) in cut]))
        block, some = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(block, kind="stable")
        block, some = block[order], some[order]
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
        for i in range(0, len(cuts) - 1, 256):
            ends = cuts[i : i + 257].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([str(names[block[a]]) for a in ends[:-1]]), pa.array([some[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["block", "spans"])

    return small_batches(pieces).repartition(groups, "shard").sortWithinPartitions("shard").mapInArrow(_grouped("shard", spans), "block string, spans binary")


_SPAN = np.dtype("<i4")


def _merged(spans: np.ndarray, rows: int) -> list[np.ndarray]:
    """For each row, its spans (start, stop) in order, those that overlap or touch made one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    cuts = np.searchsorted(spans[:, 0], np.arange(rows + 1))
    found = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        start, reach = spans[a:b, 1], np.maximum.accumulate(spans[a:b, 2])
        new = np.append(True, start[1:] > reach[:-1]) if b > a else np.zeros(0, bool)
        last = np.append(new[1:], True) if b > a else new
        found.append(np.stack((start[new], reach[last]), 1))
    return found


def _lost(row: dict, ends: np.ndarray, window: int) -> list[np.ndarray]:
    """For each of a block's rows, the spans that it loses; copies lose all, if they are as long as a window."""
    found = _merged(np.frombuffer(b"".join(row["spans"] or []), _SPAN).reshape(-1, 3), len(ends))
    lengths = np.diff(ends, prepend=0)
    for i in np.flatnonzero(_flags(row, len(ends)) & (lengths >= window)).tolist():
        found[i] = np.array([[0, lengths[i]]])
    return found


def _found(docs: DataFrame, id_col: str, text_col: str, in_place: bool, window: int, anchor: int, block: int, bucket: int, shard: int, hot: int, memory: int) -> tuple[DataFrame, DataFrame]:
    """(docs with places, blocks with the spans of their rows)."""
    if not window - 64 < anchor <= window <= 255:
        raise ValueError("an anchor lies in a window of at most 255 bytes")
    docs = docs if in_place else stored(docs)
    place = docs.metadataColumn("_metadata")
    rows = docs.select(boxed(docs).alias("box"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.rdd.getNumPartitions()
    dealt = rows.drop("box").repartition(cores) if parts < cores else rows
    places = 2 * max(cores, parts)
    table = _placed(blocks(dealt, block), places)
    total, n = table.agg(F.sum("bytes"), F.sum(F.length("owners"))).first()
    copies = stored(_copies(table, places, max(cores, -(-(n or 0) // bucket))))
    asked = table.join(copies.hint("merge"), "block", "left")
    buckets = _together(max(cores, -(-8 * (total or 0) // (max((window - anchor) // 2, 1) * bucket))), cores)
    answers = stored(_answers(_asks(asked, *buckets, window, anchor), *buckets, hot))
    shards = _together(max(cores, -(-(answers.agg(F.sum("n")).first()[0] or 0) * (window + (window - anchor) // 2) // shard)), cores)
    each = _listed(answers, places, F.struct("bucket", "shared", "hot"), "answers").join(copies, "block", "left")
    pieces = _pieces(table.join(each.hint("merge"), "block"), buckets, shards, window, anchor)
    gathered = _listed(_spans(pieces, *shards, window, memory), places, F.col("spans"), "spans")
    return rows, table.join(gathered.hint("merge"), "block", "left").join(copies.hint("merge"), "block", "left")


def byte_digests(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", in_place: bool = False, window: int = WINDOW, anchor: int = ANCHOR,
    block: int = BLOCK, bucket: int = BUCKET, shard: int = SHARD, hot: int = HOT, memory: int = MEMORY,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that stay) of every row; see `removed_spans`."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, owners = _opened(row)
                lost = _lost(row, ends, window)
                whole, begin, found = data.tobytes(), 0, []
                for end, own, spans in zip(ends.tolist(), owners[:, 2].tolist(), lost, strict=True):
                    text, kept, at = whole[begin:end], hashlib.sha256(), 0
                    for a, b in spans.tolist():
                        kept.update(text[at:a])
                        at = b
                    kept.update(text[at:])
                    found.append((None if own == LAST else own, end - begin, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (*(pa.int64(),) * 4, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    _, found = _found(docs, id_col, text_col, in_place, window, anchor, block, bucket, shard, hot, memory)
    return small_batches(found).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", in_place: bool = False, window: int = WINDOW, anchor: int = ANCHOR,
    block: int = BLOCK, bucket: int = BUCKET, shard: int = SHARD, hot: int = HOT, memory: int = MEMORY,
) -> DataFrame:
    """docs with byte_spans, an array of (start, stop) of the UTF-8 bytes that repeat a document with a smaller id.

    A byte goes if a string of `window` bytes around it also starts in a document with a smaller id, in the texts as they
    came. 1. Rows are put into blocks; of rows with one text only those with its least id go on. 2. Each block asks which of its
    anchors another document has; buckets of anchors answer in bits, so a block names an anchor once, however many of its rows
    have it. 3. What may repeat goes to shards by its anchor, each distinct piece of a block once; a shard's suffixes are sorted by external induction, and runs of them with
    a window in common tell the least document of that window. 4. Spans go back to their blocks.

    Null and empty texts keep and lose nothing; a null id counts as larger than all others; rows that repeat an id are
    never each other's smaller document; texts shorter than a window keep everything; an empty table gives an empty one.
    A column of docs named byte_spans is replaced. in_place: docs is read from Parquet and not changed since; otherwise it
    is written once, so that rows have places.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                owners = np.frombuffer(row["owners"], np.int64).reshape(-1, 3)
                lost = _lost(row, np.cumsum(np.frombuffer(row["lengths"], np.int64)), window)
                some = [i for i, spans in enumerate(lost) if len(spans)]
                values = [[{"start": a, "stop": b} for a, b in lost[i].tolist()] for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(owners[some, 0]), pa.array(owners[some, 1]), pa.array(values, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["file", "at", "byte_spans"])

    rows, found = _found(docs, id_col, text_col, in_place, window, anchor, block, bucket, shard, hot, memory)
    spans = small_batches(found.filter("spans IS NOT NULL OR copies IS NOT NULL")).mapInArrow(run, "file long, at long, byte_spans array<struct<start:long,stop:long>>")
    names = [c for c in docs.columns if c.lower() != "byte_spans"]
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return rows.join(spans, ["file", "at"], "left").select(*[F.col("box")[c].alias(c) for c in names], F.coalesce("byte_spans", none).alias("byte_spans"))


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, unnest(range(CAST(length(x) // 2 - 49 AS BIGINT))) AS p, x FROM t WHERE length(x) >= 100),
s AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM w),
low AS (SELECT s, min(doc_id) AS first_id FROM s GROUP BY s HAVING count(*) > 1),
gone AS (SELECT r, p FROM s JOIN low USING (s) WHERE doc_id > first_id),
edges AS (SELECT r, p, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM gone WINDOW o AS (PARTITION BY r ORDER BY p)),
numbered AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM edges),
spans AS (SELECT r, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY r, k),
before AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed,
                string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN next IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
         FROM before JOIN t USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
