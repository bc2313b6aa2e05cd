"""Language-model scores by prediction by partial matching over bytes, trained on the corpus."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import crc_remainder, small_batches, stored

#: Bytes of the longest context.
ORDER = 5
#: Bytes of text that end a block: what a task holds at once, with the part of the trie that its texts touch.
BLOCK = 24 << 20
CHUNK = 1 << 20
#: Parts that grams and words are dealt over, by size; a task holds what is distinct in a part. A block of 24 MB has about
#: 1.5 million distinct grams, so that at the most parts its lists still hold a score of grams each.
PARTS, MOST_PARTS = 64, 1 << 16
#: A prime below 2^31 and a primitive root of it: what a gram leaves modulo the prime, times the root, is its part.
PRIME, ROOT = (1 << 31) - 1, 48271
#: Grams of chunks that are kept before they are merged.
MERGED = 1_500_000
#: What a symbol's count gives to the escape.
DISCOUNT = 0.5
FOLDS, HELD_OUT = 5, 1
SYMBOLS = 256
# Bytes that no UTF-8 text holds: contexts before the text, and the symbol after it.
BEFORE, END = 0xFE, 0xFF


def part_of(grams, parts: int):
    """The part of grams, of numpy or of a column: what a gram leaves modulo a prime is mixed before it is dealt, as grams share bytes."""
    return grams % PRIME * ROOT % PRIME % parts


def byte_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol as one number, index of the text) of every byte and end; texts are cut in no way."""
    pad = bytes([BEFORE]) * order
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    n = len(data) - order
    keys = np.zeros(n, np.int64)
    for k in range(order + 1):
        keys <<= 8
        keys |= data[k : k + n]
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 + order for t in texts), np.int64, len(texts)))[order:]
    real = data[order:] != BEFORE
    return keys[real], owner[real]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _bytes_of(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]


def packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as planes of their bytes, the lowest first: what sorted or small numbers share then compresses well."""
    width = np.dtype(kind).itemsize
    return values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


class Block:
    """What a run of documents holds, gathered chunk by chunk: grams and words with their counts in training texts (0: held
    out only), and the texts themselves, compressed."""

    def __init__(self, order: int):
        self.order, self.words, self.documents = order, Counter(), []
        self.found, self.sizes = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, ids: list[int | None], texts: list[bytes], held: list[bool]) -> None:
        grams, owner = byte_grams(texts, self.order)
        own, count = np.unique(grams * 2 + np.array(held, bool)[owner], return_counts=True)
        self.found.append((own >> 1, np.where(own & 1, 0, count)))
        self.sizes += len(own)
        if self.sizes > MERGED:
            self.found, self.sizes = [_merged(self.found)], 0
        for text, out in zip(texts, held, strict=True):
            self.words.update(dict.fromkeys(text.split(), 0) if out else text.split())
        self.documents.append((ids, held, zstandard.compress(b"".join(t + b"\xff" for t in texts), 3)))

    def rows(self, block: int, parts: int) -> Iterator[tuple]:
        """COUNTED rows: one for each part that is not empty, and one for each chunk of documents."""
        keys, sums = _merged(self.found)
        where = part_of(keys, parts)
        by = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[by], np.arange(parts + 1))
        dealt: list[list[bytes]] = [[] for _ in range(parts)]
        for w in self.words:
            dealt[zlib.crc32(w) % parts].append(w)
        for p in range(parts):
            own = by[cuts[p] : cuts[p + 1]]
            if len(own) or dealt[p]:
                numbers = packed(np.array([self.words[w] for w in dealt[p]], np.int64), "<i4")
                yield block, p, packed(keys[own], "<i8"), packed(sums[own], "<i4"), b" ".join(dealt[p]), numbers, None, None, None
        for ids, held, texts in self.documents:
            yield block, -1, None, None, None, None, ids, held, texts


#: A block's grams and words of one part, or, with part -1, some of its documents: ids, held_out, and texts, each before a byte 0xFF, compressed.
COUNTED = "block long, part int, grams binary, gram_n binary, words binary, word_n binary, ids array<long>, held array<boolean>, texts binary"


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _counted(rows: DataFrame, order: int, parts: int, block_bytes: int) -> DataFrame:
    """What each block holds; a block is a run of a task's rows that ends with the chunk that brings it to `block_bytes`.

    The result must be stored, as blocks are named by their task.
    """

    def run(batches):
        own, number, size = Block(order), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts, held = batch.column(0).to_pylist(), _bytes_of(batch.column(1).to_pylist()), batch.column(2).to_pylist()
            for start, part in _chunks(texts):
                own.add(ids[start : start + len(part)], part, held[start : start + len(part)])
                size += sum(map(len, part))
                if size >= block_bytes:
                    for row in own.rows(number, parts):
                        yield _table(COUNTED, [row])
                    own, number, size = Block(order), number + 1, 0
        if own.documents:
            for row in own.rows(number, parts):
                yield _table(COUNTED, [row])

    return small_batches(rows).select("doc_id", "text", "held_out").mapInArrow(run, COUNTED)


def sum_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) over all blocks of a part, which come one by one."""
    found, sizes = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in batches:
        for keys, n in zip(batch.column("grams").to_pylist(), batch.column("gram_n").to_pylist(), strict=True):
            found.append((unpacked(keys, "<i8"), unpacked(n, "<i4")))
            sizes += len(found[-1][0])
            if sizes > MERGED:
                found, sizes = [_merged(found)], 0
    keys, sums = _merged(found)
    for i in range(0, len(keys), CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + CHUNK]), pa.array(sums[i : i + CHUNK])], ["gram", "n"])


VOCABULARY = "part int, words binary, word_n binary, tokens long, distinct long"


def sum_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's words with their counts over all blocks, which come one by one, and their totals."""
    total: Counter = Counter()
    for batch in batches:
        for words, n in zip(batch.column("words").to_pylist(), batch.column("word_n").to_pylist(), strict=True):
            if words:
                for w, k in zip(words.split(b" "), unpacked(n, "<i4").tolist(), strict=True):
                    total[w] += k
    yield _table(VOCABULARY, [(key[0].as_py(), b" ".join(total), packed(np.array(list(total.values()), np.int64), "<i8"), total.total(), sum(k > 0 for k in total.values()))])


#: What is known of a part, then what its blocks ask; the order of kinds within a part is kept.
ASKED = "part int, kind int, block long, gram long, logp double, grams binary, words binary, word_n binary"
ANSWERS = "block long, grams binary, logs binary, words binary, word_n binary"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and part the logs of its grams, and the counts of its words that other blocks hold too.

    Only what is known of one part is held; blocks pass by.
    """
    part, known, words = None, [], {}
    for batch in batches:
        parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(parts) | np.diff(kinds)) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True):
            own = batch.slice(start, stop - start)
            if parts[start] != part:
                part, known, words = parts[start], [], {}
            if kinds[start] == 0:
                known.append((own.column("gram").to_numpy(), own.column("logp").to_numpy()))
            elif kinds[start] == 1:
                for w, n in zip(own.column("words").to_pylist(), own.column("word_n").to_pylist(), strict=True):
                    words.update(zip(w.split(b" ") if w else [], unpacked(n, "<i8").tolist(), strict=True))
            else:
                if len(known) != 1 or known[0][0].base is not None:
                    keys, logs = (np.concatenate([k[i] for k in known] or [np.zeros(0)]) for i in (0, 1))
                    by = np.argsort(keys)
                    known = [(keys[by], logs[by])]
                keys, logs = known[0]
                for block, grams, asked, n in zip(*(own.column(c).to_pylist() for c in ("block", "grams", "words", "word_n")), strict=True):
                    found = logs[np.searchsorted(keys, unpacked(grams, "<i8"))] if grams else np.zeros(0)
                    other = [w for w, k in zip(asked.split(b" ") if asked else [], unpacked(n, "<i4").tolist(), strict=True) if words[w] != k]
                    yield _table(ANSWERS, [(block, grams, packed(found, "<f4"), b" ".join(other), packed(np.array([words[w] for w in other], np.int64), "<i8"))])


def trie(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, logp) of every gram: log10 of the symbol's probability after its context.

    grams: gram, n (its training count, perhaps 0). The trie's level k holds contexts of k bytes; dropping the oldest
    byte of a context leads to its parent. With N the count and D the number of distinct symbols after a context, a
    symbol has (n - d) / N, and d D / N is left for the escape to the parent (method D: d is one half). All symbols
    seen after the child are excluded there. As a child's symbols are among its parent's, the exclusion takes the
    parent's count of just those symbols, E, from N, and the child's D from the parent's, so each level follows from
    its parent by one join; below order 0 the symbols left share equally. Contexts have at most 256 symbols, which
    bounds every window.
    """
    levels = [grams]
    for k in range(order):
        levels.append(stored(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - k)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))))
    context = Window.partitionBy(F.shiftright("gram", 8))
    seen = F.col("n") > 0
    parent = None
    for k, level in enumerate(reversed(levels)):
        found = level
        if k:
            found = level.join(parent, level["gram"].bitwiseAND(F.lit((1 << 8 * k) - 1)) == parent["p_gram"])
            found = found.withColumn("taken", F.coalesce(F.sum(F.when(seen, F.col("p_n"))).over(context), F.lit(0)))
        found = found.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.sum(seen.cast("long")).over(context))
        if k:
            rest, kinds = F.col("p_total") - F.col("taken"), F.col("p_kinds") - F.col("kinds")
            escaped = F.when(rest <= 0, F.col("p_escaped")).when(F.col("p_n") > 0, (F.col("p_n") - discount) / rest).otherwise(discount * kinds / rest * F.col("p_escaped"))
            unseen = F.col("p_prob")
        else:
            escaped = F.lit(1.0) / F.greatest(SYMBOLS - F.col("kinds"), F.lit(1))
            unseen = F.lit(1.0 / SYMBOLS)
        found = found.withColumn("escaped", escaped)
        prob = F.when(F.col("total") == 0, unseen).when(seen, (F.col("n") - discount) / F.col("total")).otherwise(discount * F.col("kinds") / F.col("total") * F.col("escaped"))
        found = stored(found.select("gram", "n", "total", "kinds", "escaped", prob.alias("prob")).toDF("p_gram", "p_n", "p_total", "p_kinds", "p_escaped", "p_prob"))
        parent = found
    return parent.select(F.col("p_gram").alias("gram"), F.log10("p_prob").alias("logp"))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_block(docs: pa.Table, known: pa.Table, *, order: int, tokens: int, distinct: int, ends: int) -> pa.Table:
    """Scores of a block's documents; docs: some of its documents in each row; known: what was answered to the block."""
    chunks = list(zip(docs.column("ids").to_pylist(), docs.column("held").to_pylist(), docs.column("texts"), strict=True))
    opened = lambda data: zstandard.decompress(data.as_buffer()).split(b"\xff")[:-1]
    counts: Counter = Counter()
    for _, held, data in chunks:
        for text, out in zip(opened(data), held, strict=True):
            if not out:
                counts.update(text.split())
    all_keys, all_logs = [], []
    for grams, logs, words, n in zip(*(known.column(c) for c in ("grams", "logs", "words", "word_n")), strict=True):
        all_keys.append(unpacked(grams.as_buffer(), "<i8") if grams.is_valid else np.zeros(0, np.int64))
        all_logs.append(unpacked(logs.as_buffer(), "<f4"))
        if words := words.as_py():
            counts.update({w: k - counts[w] for w, k in zip(words.split(b" "), unpacked(n.as_buffer(), "<i8").tolist(), strict=True)})
    keys = np.concatenate(all_keys)
    by = np.argsort(keys)
    keys, logs = keys[by], np.concatenate(all_logs)[by]
    whole = tokens + 0.5 * (distinct + 1)
    logs_of: dict[int, float] = {}
    ids, is_held, score, base, n_tokens, n_known = [], [], [], [], [], []
    for own_ids, held, data in chunks:
        texts = opened(data)
        own, owner = byte_grams(texts, order)
        score.append(np.bincount(owner, logs[np.searchsorted(keys, own)], len(texts)))
        ids += own_ids
        is_held += held
        for text in texts:
            found = [counts[w] for w in text.split()]
            found.append(ends)
            n_tokens.append(len(found))
            n_known.append(len(found) - found.count(0))
            total = 0.0
            for c in found:
                if (log := logs_of.get(c)) is None:
                    log = logs_of[c] = math.log10((c + 0.5) / whole)
                total += log
            base.append(total)
    columns = [pa.array(ids, pa.int64()), pa.array(is_held), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([tokens] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(score))]
    return pa.table(dict(zip([x.split()[0] for x in SCORES.split(", ")], columns, strict=True)))


def lm_scores(docs: DataFrame, *, order: int = ORDER, block_bytes: int = BLOCK, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model is the byte trie of all training texts; it learns from rows whose crc32 of the id does not leave 1 modulo
    5, and scores every whole text, A-Z in lower case, with its end. It is never held in one place: documents lie in
    blocks that end when they reach `block_bytes`, each block lists its grams and words, the lists are summed part by part, the trie
    is built as tables, and each block gets back just what its own grams and words need. The base is a word model with
    counts of the same texts.

    Texts are read once; each block's are stored with its lists and shuffled once, for the scores. Lists have one row for
    each block and part, and the number of parts does not grow beyond MOST_PARTS, so rows grow with the blocks; tasks
    hold a block, or what is distinct in a part. Log probabilities travel as 32-bit floats, which leaves scores with
    about seven digits.

    Null texts are empty and consist of the end alone; with no training text at all every symbol has 1/256; a null id
    hashes as the empty text; a text longer than a block is a block of its own; repeated rows count and are scored each;
    an empty table gives an empty one; other columns of docs are not read.
    """
    if not 1 <= order <= 6:
        raise ValueError("a gram of order + 1 bytes must fit a long, with a bit to spare")
    held_out = crc_remainder(docs[id_col], FOLDS) == HELD_OUT
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.sum((~held_out).cast("long")).alias("ends")).first()
    ends = size["ends"] or 0
    parts = parts or min(max(PARTS, 2 * ((size["bytes"] or 0) // block_bytes)), MOST_PARTS)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), held_out.alias("held_out"))
    counted = stored(_counted(rows, order, parts, block_bytes))
    lists = counted.filter("part >= 0")
    words = stored(lists.select("part", "words", "word_n").groupBy("part").applyInArrow(sum_words, VOCABULARY))
    totals = words.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = (totals["n"] or 0) + ends, (totals["distinct"] or 0) + (ends > 0)
    summed = stored(lists.select("part", "grams", "gram_n").groupBy("part").applyInArrow(sum_grams, "gram long, n long"))
    model = trie(summed, order).select(part_of(F.col("gram"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "gram", "logp")
    sides = model, words.select("part", F.lit(1).alias("kind"), "words", "word_n"), lists.select("part", F.lit(2).alias("kind"), "block", "grams", "words", "word_n")
    asked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides).select(*[x.split()[0] for x in ASKED.split(", ")])
    answers = asked.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_answered, ANSWERS)
    score = lambda a, b: score_block(a, b, order=order, tokens=tokens, distinct=distinct, ends=ends)
    texts = counted.filter("part < 0").select("block", "ids", "held", "texts")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
