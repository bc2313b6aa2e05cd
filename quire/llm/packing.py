"""Packing by power-of-two decomposition: every piece fills a sequence of its own length."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_symbols, numbered, small_batches, stored, tokenizer_path

SEQUENCE = 4096
END = 2
#: Bytes of white-space-separated chunks, words and their ids that a worker remembers at most; beyond, it starts anew. A
#: chunk or word of more than LONGEST bytes, as texts without white space have, is not remembered; chunks are looked up RUN at a time.
REMEMBERED, LONGEST, RUN = 192 << 20, 200, 50_000

# A word of Latin letters, all of them whole under NFC, then ASCII punctuation that starts no contraction or special token.
_plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{}~]*)")

_encoders: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, chunk by chunk.

    The tokenizer's normaliser and splitter never join what ASCII white space separates, so a text's ids are the ids
    of its chunks in a row, and each distinct chunk is encoded once for a worker. Most chunks are one word of Latin
    letters, which those steps only put in lower case and spell in byte symbols, then punctuation: such words go
    straight to the tokenizer's model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.ids = _Remembered(self._chunk)
        self.words = _Remembered(self._word)
        self.whole = _Remembered(self._whole)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])
        return _packed([t.id for t in self.model.tokenize(symbols)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if (plain := _plain.fullmatch(text)) is None:
            return self.whole[text]
        word, marks = plain.groups()
        return self.words[word.lower()] + (self.whole[marks] if marks else b"")

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            chunks, found = (text or "").encode().split(), []
            for i in range(0, len(chunks), RUN):
                if self.ids.size + self.words.size + self.whole.size > REMEMBERED:
                    for known in (self.ids, self.words, self.whole):
                        known.clear()
                        known.size = 0
                found.append(b"".join(map(self.ids.__getitem__, chunks[i : i + RUN])))
            yield b"".join(found)


class _Remembered(dict):
    """Values by key, with the bytes that they take: 200 for an entry, and what key and value hold."""

    def __init__(self, find):
        self.find, self.size = find, 0

    def __missing__(self, key):
        found = self.find(key)
        if len(key) <= LONGEST:
            self[key] = found
            self.size += 200 + len(key) + len(found)
        return found


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def encoder(path: str | None) -> ChunkEncoder:
    path = path or tokenizer_path()
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def binary_pieces(n: int, longest: int = SEQUENCE) -> Iterator[tuple[int, int]]:
    """(start, length) of pieces that cover n tokens: full ones, then the remainder's binary digits from the highest."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    while n > start:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


def pieces(docs: DataFrame, *, path: str | None = None, longest: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches):
        own, last = encoder(path), end.to_bytes(4, "little")
        for batch in batches:
            rows: list[list[int | None]] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids += last
                for start, length in binary_pieces(len(ids) // 4, longest):
                    for column, value in zip(rows, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, **options) -> DataFrame:
    """Packs every document into sequences of power-of-two length, none of which crosses documents or is padded.

    Equal lengths form a bucket; sequences are numbered bucket by bucket, so equal lengths lie together and batches of
    one shape can be cut from consecutive numbers. Pieces are dealt over the tasks that number them by their place in the
    stored table, so equal ones lie apart. Null and empty texts are the end token alone; repeated rows are
    packed once each; a null id is kept; an empty table gives an empty one; other columns of docs are not read.
    """
    cut = stored(pieces(docs, **options))  # the tokenizer runs once, though numbering reads its result twice
    place = cut.metadataColumn("_metadata")
    cut = cut.select("*", F.log2("length").cast("int").alias("bucket"), F.xxhash64(place["file_path"], place["row_index"]).alias("place"))
    found = numbered(cut, ["bucket"], F.col("place"), ["doc_id", "start", "ids_crc32"], "sequence_id", per_group=False)
    return found.drop("place").withColumn("offset", F.lit(0).cast("long"))
