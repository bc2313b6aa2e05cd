"""Fill-in-middle transformation: cuts between tokens, found by an automaton that reads all parts of a text at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import boxed, small_batches, stored, unboxed

SEED = 42
#: Of 100 documents, those that are transformed; of 100 of these, those that lead with the suffix.
FIM, SPM = 50, 80
#: Bytes that one step of the automaton's scan reads, and bytes from which a text's chunks are dealt over tasks.
LANE = 128
CHUNK = 1 << 20
MARKS = (b"<P>", b"<S>", b"<M>")

# Classes of bytes: other, white space, "<", one of "PSM", ">", and none at all (behind the end of a lane).
OTHER, SPACE, OPEN, LETTER, CLOSE, NONE = range(6)
# States: nothing read yet; in white space; in a word; in a word, just after "<"; just after "<" and a letter of a mark.
START, BLANK, WORD, OPENED, LETTERED = range(5)
STATES, CLASSES = 5, 6
_STATE, _TOKENS, _MARKS = 31, 12, 22  # an arc is one number: the next state's row, tokens begun, marks completed


def _arcs() -> np.ndarray:
    table = np.zeros((STATES, CLASSES), np.int32)
    for state in range(STATES):
        for kind in range(CLASSES):
            after = {SPACE: BLANK, OPEN: OPENED, NONE: state}.get(kind, WORD)
            if state == OPENED and kind == LETTER:
                after = LETTERED
            begun = kind != NONE and (state == START or kind == SPACE and state != BLANK)
            marked = state == LETTERED and kind == CLOSE
            table[state, kind] = after * CLASSES | begun << _TOKENS | marked << _MARKS
    return table.ravel()


ARCS = _arcs()
KIND = np.zeros(256, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[ord("<")], KIND[ord(">")], KIND[list(b"PSM")] = OPEN, CLOSE, LETTER


class Scan:
    """What the automaton does over chunks of bytes, from each state that it may enter them in.

    Chunks are cut into lanes, which are all read in step. A lane gives a function from states to states and, for each
    state, the tokens and marks met; functions of neighbours are composed in pairs, then pairs of pairs, so that each
    lane knows what happens from the begin of its chunk to its own end.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.lanes = -(-(ends - begins) // LANE)
        self.first = np.cumsum(self.lanes) - self.lanes
        self.chunk = np.repeat(np.arange(len(begins)), self.lanes)
        self.nth = np.arange(len(self.chunk)) - self.first[self.chunk]
        self.at = begins[self.chunk] + self.nth * LANE
        kinds = np.concatenate((KIND[data], np.zeros(LANE, np.uint8)))
        self.kinds = kinds[self.at + np.arange(LANE)[:, None]]  # a row for each step
        self.kinds[np.arange(LANE)[:, None] >= ends[self.chunk] - self.at] = NONE
        states = np.repeat(np.arange(STATES, dtype=np.int32)[:, None] * CLASSES, len(self.chunk), 1)
        met = np.zeros_like(states)
        for kind in self.kinds:
            arcs = ARCS[states + kind]
            met += arcs  # the states' numbers add up below the tokens' bits
            states = arcs & _STATE
        self.own = states // CLASSES
        self.to, self.tokens, self.marks = self.own.copy(), met.astype(np.int64) >> _TOKENS & (1 << _MARKS - _TOKENS) - 1, met.astype(np.int64) >> _MARKS
        step = 1
        while len(self.chunk) and step < self.lanes.max():
            late = np.flatnonzero(self.nth >= step)
            between = self.to[:, late - step]
            moved = [x[between, late] for x in (self.to, self.tokens, self.marks)]
            earlier = [x[:, late - step] for x in (self.tokens, self.marks)]
            self.to[:, late], self.tokens[:, late], self.marks[:, late] = moved[0], earlier[0] + moved[1], earlier[1] + moved[2]
            step *= 2

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next state, tokens, marks) of each chunk from each state; columns are chunks."""
        states = np.arange(STATES)[:, None]
        last, some = (self.first + self.lanes - 1).clip(0), self.lanes > 0
        if not len(self.chunk):
            return np.repeat(states, len(some), 1), *(np.zeros((STATES, len(some)), np.int64),) * 2
        return np.where(some, self.to[:, last], states), np.where(some, self.tokens[:, last], 0), np.where(some, self.marks[:, last], 0)

    def select(self, chunks: np.ndarray, entries: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Where, in the data, the token with each number begins, counted from 0 in its chunk, entered in the given state."""
        if not len(chunks):
            return np.zeros(0, np.int64)
        lane, high = self.first[chunks], self.first[chunks] + self.lanes[chunks] - 1
        while (lane < high).any():  # all searches halve in step
            middle = (lane + high) // 2
            past = self.tokens[entries, middle] > numbers
            lane, high = np.where(past, lane, np.minimum(middle + 1, high)), np.where(past, middle, high)
        inner = self.nth[lane] > 0
        before = np.where(inner, lane - 1, lane)
        states = np.where(inner, self.to[entries, before], entries).astype(np.int32) * CLASSES
        left, found = numbers - np.where(inner, self.tokens[entries, before], 0), self.at[lane].copy()
        for step, kind in enumerate(self.kinds[:, lane]):
            arcs = ARCS[states + kind]
            begun = (arcs >> _TOKENS & 1).astype(bool)
            found[begun & (left == 0)] += step
            left = left - begun
            states = arcs & _STATE
        return found


def draws(doc: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the id alone; a null id counts as the empty text."""
    found = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    middle = output.index(b"<M>")
    if form == "psm":
        suffix = output.index(b"<S>")
        return output[3:suffix] + output[middle + 3 :] + output[suffix + 3 : middle]
    prefix = output.index(b"<P>")
    return output[prefix + 3 : middle] + output[middle + 3 :] + output[3:prefix]


def _form(n: int, marked: bool, h: list[int], fim: int, spm: int) -> str:
    if not n or marked or h[2] % 100 >= fim:
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def _cuts(texts: list[bytes], docs: list[int | None], parts: list[list[dict] | None], fim: int, spm: int, seed: int, chunk: int) -> Iterator[tuple]:
    """(n, form, first cut, second cut) of each text; parts: summaries of the chunks of a giant text, else None."""
    whole = [i for i, p in enumerate(parts) if p is None]
    lengths = np.array([len(texts[i]) for i in whole], np.int64)
    ends = np.cumsum(lengths)
    scan = Scan(np.frombuffer(b"".join(texts[i] for i in whole), np.uint8), ends - lengths, ends)
    _, tokens, marks = scan.whole()
    n, marked = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    n[whole], marked[whole] = tokens[START], marks[START] > 0
    entered = {}
    for i, p in enumerate(parts):
        if p is not None:  # entry states of the chunks one by one, in their order
            states, counts = [START], [0]
            for x in sorted(p, key=lambda x: x["no"]):
                counts.append(counts[-1] + x["tokens"][states[-1]])
                marked[i] |= x["marks"][states[-1]] > 0
                states.append(x["to"][states[-1]])
            entered[i], n[i] = (states, counts), counts[-1]
    forms, cuts, asked = [], np.zeros((len(texts), 2), np.int64), []
    place = {i: k for k, i in enumerate(whole)}
    for i, (text, doc) in enumerate(zip(texts, docs, strict=True)):
        h = draws(doc, seed)
        forms.append(_form(int(n[i]), bool(marked[i]), h, fim, spm))
        if forms[i] == "plain":
            continue
        for side, unit in enumerate(sorted(x % (int(n[i]) + 1) for x in h[:2])):
            if unit == n[i]:
                cuts[i, side] = len(text)
            elif i in place:
                asked.append((i, side, place[i], unit))
            else:
                states, counts = entered[i]
                k = int(np.searchsorted(counts, unit, "right")) - 1
                piece = np.frombuffer(text[k * chunk : (k + 1) * chunk], np.uint8)
                cuts[i, side] = k * chunk + Scan(piece, np.zeros(1, np.int64), np.array([len(piece)])).select(*(np.array([x]) for x in (0, states[k], unit - counts[k])))[0]
    if asked:
        rows, sides, chunks, units = np.array(asked).T
        cuts[rows, sides] = scan.select(chunks, np.full(len(chunks), START), units) - (ends - lengths)[chunks]
    for i in range(len(texts)):
        yield int(n[i]), forms[i], int(cuts[i, 0]), int(cuts[i, 1])


def _summaries(giants: DataFrame, chunk: int) -> DataFrame:
    """(file, at, parts): for each giant text what the automaton does over each of its chunks, scanned by many tasks."""

    def cut(batches):
        for batch in batches:
            for file, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text.encode()
                for no in range(-(-len(text) // chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, at, no, text[no * chunk : (no + 1) * chunk])], ["file", "at", "no", "chunk"])

    def scan(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            for file, at, no, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = Scan(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)])).whole()
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at]), pa.array([no]), *(pa.array([x[:, 0].tolist()], kind) for x in found)], ["file", "at", "no", "to", "tokens", "marks"])

    chunks = giants.select("file", "at", "text").mapInArrow(cut, "file long, at long, no long, chunk binary")
    dealt = chunks.repartition(giants.sparkSession.sparkContext.defaultParallelism * 4, F.xxhash64("file", "at", "no"))
    each = dealt.mapInArrow(scan, "file long, at long, no long, to array<long>, tokens array<long>, marks array<long>")
    return each.groupBy("file", "at").agg(F.collect_list(F.struct("no", "to", "tokens", "marks")).alias("parts"))


_PARTS = "array<struct<no:long,to:array<long>,tokens:array<long>,marks:array<long>>>"


def _run(docs: DataFrame, id_col: str, text_col: str, box: bool, fim: int, spm: int, seed: int, chunk: int) -> DataFrame:
    """n, form, prefix_chars, middle_chars with the row's box and output, or with its id and the digests."""
    rows = docs.select(*([boxed(docs).alias("box")] if box else []), docs[id_col].cast("long").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    giant = F.octet_length("text") > chunk
    held = stored(rows.filter(giant))
    place = held.metadataColumn("_metadata")
    held = held.select("*", F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))
    known = held.join(_summaries(held, chunk).hint("merge"), ["file", "at"]).select(*rows.columns, F.col("parts").cast(_PARTS))
    rows = rows.filter(~giant).withColumn("parts", F.lit(None).cast(_PARTS)).union(known)
    named = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    named += [("output", pa.string())] if box else [("output_sha256", pa.string()), ("restored_sha256", pa.string())]

    def run(batches):
        for batch in batches:
            docs, texts = batch.column("doc").to_pylist(), [t.encode() for t in batch.column("text").to_pylist()]
            found: list[tuple] = []
            for text, (n, form, a, b) in zip(texts, _cuts(texts, docs, batch.column("parts").to_pylist(), fim, spm, seed, chunk), strict=True):
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                output = {"plain": text, "psm": b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle), "spm": b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle)}[form] if form != "plain" else text
                chars = (None, None) if form == "plain" else (len(prefix.decode()), len(middle.decode()))
                last = (output.decode(),) if box else (hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest())
                found.append((n, form, *chars, *last))
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), named, strict=True)] if found else [pa.array([], kind) for _, kind in named]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["box" if box else "doc_id", *(name for name, _ in named)])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    lead = f"box {rows.schema['box'].dataType.simpleString()}" if box else "doc_id long"
    return small_batches(rows).mapInArrow(run, ", ".join([lead, *(f"{n} {kinds[k]}" for n, k in named)]))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fim: int = FIM, spm: int = SPM, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output, the transformed text.

    Tokens are white space with the word behind it, or white space at the end; n of them leave n + 1 places for the two
    cuts. What happens to a document depends on the seed, its id and its text alone. Texts of up to a chunk are scanned
    where they lie; chunks of longer ones are dealt over all tasks, their functions composed in order, and only the
    chunks that hold a cut are read again. Null and empty texts and texts that hold a mark stay plain; a null id counts as
    the empty text; repeated rows are transformed alike; an empty table gives an empty one; columns of docs with the
    names of added ones are replaced.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    return unboxed(_run(docs, id_col, text_col, True, fim, spm, seed, chunk), docs.columns, {c: F.col(c) for c in added})


def fim_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fim: int = FIM, spm: int = SPM, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of output and of the text rebuilt from it; see `fill_in_middle`."""
    return _run(docs, id_col, text_col, False, fim, spm, seed, chunk)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
             CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, body, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                          ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN regexp_replace(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2')
                        ELSE regexp_replace(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1') END) AS restored_sha256
FROM o
"""
