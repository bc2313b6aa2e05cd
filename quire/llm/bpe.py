"""BPE by a tokenization automaton: merges become a deterministic automaton over tokens, one gadget at a time."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, pre_tokenizers

from quire.llm.common import byte_symbols, small_batches, tokenizer_path

#: Bytes of chunks with their ids and labels, distinct words, and states of the compiled automaton, that a worker holds at
#: most; beyond, it starts anew. A chunk or word of more than LONGEST bytes, as texts without white space have, is not
#: remembered; chunks are looked up RUN at a time.
CHUNKS, WORDS, STATES, LONGEST, RUN = 192 << 20, 200_000, 150_000, 200, 50_000


class MergeAutomaton:
    """The deterministic automaton whose paths are exactly the BPE encodings.

    It starts with one state and a loop for each base symbol. The gadget of merge (a, b), the r-th, acts where an a-arc
    meets a b-arc: the a-arc is led to a copy of its target that has no b-arc, and an ab-arc bypasses both. As all arcs
    of one token lead to one state, a state is named by the token just read, and its lost arcs need not be copied:
    - the state after token s = (x, y) is the one after y as it was when s was made, less what s lost since; so its
      lost arcs are those of the right spine s, y, ..., each up to the rank that made the token above it;
    - an arc of token t = (x, y) came from an x-arc that was there at t's rank; so t is lost with any token of its left
      spine t, x, ..., if that was lost up to the rank that made the token above it.
    The gadgets thus leave three tables (lost pairs, left and right spines), which tell every arc.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.vocabulary, never = vocabulary, len(merges)
        self.names = {i: t for t, i in vocabulary.items()}
        self.left = {i: [(i, never)] for i in self.names}
        self.right = {i: [(i, never)] for i in self.names}
        self.lost: dict[int, dict[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        if b in self.lost.setdefault(a, {}) or len(self.left[ab]) > 1:
            return
        self.lost[a][b] = rank
        self.left[ab] += [(t, min(bound, rank)) for t, bound in self.left[a]]
        self.right[ab] += [(t, min(bound, rank)) for t, bound in self.right[b]]

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after `state` has an arc of `token`."""
        for s, until in self.right[state]:
            if lost := self.lost.get(s):
                for t, since in self.left[token]:
                    rank = lost.get(t, until)
                    if rank < until and rank <= since:
                        return False
        return True


class SymbolTable:
    """The merge automaton with its arcs spelled out in symbols, made deterministic: a table of state and symbol to state.

    A state holds every place that the symbols read so far can lead to: a token just read, and the node of the tokens'
    trie that has been spelled since. Each prefix has one path of whole arcs, so exactly one arc ends in a state, whose
    token the state emits. Reading a word is one look-up a symbol; its path is then read off backwards, each state's
    token leading to the state before it. The last symbol of a word, with the end-of-word mark, is a symbol of its own.

    Only transitions that some word takes are compiled, each once, as the whole table has far more than texts ever use;
    400,000 distinct words lead to 113,000 states and 302,000 transitions.
    """

    def __init__(self, automaton: MergeAutomaton, end: str = ""):
        self.automaton, self.end = automaton, end
        self.symbols: dict[str, int] = {}
        self.child: dict[tuple[int, int], int] = {}
        self.token_at = [None]  # of a trie node
        self.size = {}
        for token, i in automaton.vocabulary.items():
            node, symbols = 0, self.spelled(token)
            self.size[i] = len(symbols)
            for s in symbols:
                s = self.symbols.setdefault(s, len(self.symbols))
                if (node, s) not in self.child:
                    self.child[node, s] = len(self.token_at)
                    self.token_at.append(None)
                node = self.child[node, s]
            self.token_at[node] = i
        self.marked = {i for s, i in self.symbols.items() if len(s) > 1}
        self.clear()

    def spelled(self, word: str) -> list[str]:
        """The symbols of a token or word; only the last of them may have the mark."""
        core = word.removesuffix(self.end) if self.end else word
        return [*core[:-1], core[-1] + self.end] if len(core) < len(word) else [*core]

    def clear(self) -> None:
        self.places: list[tuple] = [((None, 0),)]
        self.emitted: list[int | None] = [None]
        self.known = {(self.places[0], None): 0}
        self.next: dict[tuple[int, int], int] = {}

    def _compiled(self, state: int, symbol: int) -> int:
        """The transition's target: arcs that go on, and the one arc that ends, behind which any arc may begin."""
        going, ended, has_arc = [], None, self.automaton.has_arc
        for last, node in self.places[state]:
            if (to := self.child.get((node, symbol))) is None:
                continue
            token = self.token_at[to]
            if ended is None and token is not None and (last is None or has_arc(last, token)):
                ended = token
            if symbol not in self.marked:
                going.append((last, to))
        if ended is None:
            raise ValueError("a base symbol is missing in the vocabulary")
        if symbol not in self.marked:
            going.append((ended, 0))
        key = tuple(going), ended
        if (to := self.known.get(key)) is None:
            to = self.known[key] = len(self.places)
            self.places.append(key[0])
            self.emitted.append(ended)
        self.next[state, symbol] = to
        return to

    def path(self, word: str) -> list[int]:
        """The tokens of the arcs that spell word, its mark included."""
        if len(self.places) >= STATES:
            self.clear()
        state, read, table, number = 0, [], self.next, self.symbols
        for s in self.spelled(word):
            if s not in number:
                raise ValueError("a base symbol is missing in the vocabulary")
            pair = state, number[s]
            state = table[pair] if pair in table else self._compiled(*pair)
            read.append(state)
        out, at = [], len(read)
        while at:
            out.append(self.emitted[read[at - 1]])
            at -= self.size[out[-1]]
        return out[::-1]


class BpeCodec:
    """Encodes and decodes as the tokenizer file describes, by its compiled automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.end = model["end_of_word_suffix"] or ""
        automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.table = SymbolTable(automaton, self.end)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = automaton.names | {i: t for t, i in self.special.items()}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.splitter = pre_tokenizers.Split(Regex(splits[0]["pattern"]["Regex"]), "removed", invert=True)
        self.symbols = byte_symbols()
        self.first = os.path.commonprefix(list(self.special))
        self.paths: dict[str, list[int]] = {}
        self.ids, self.decoded = _Chunks(self), {}

    def _word(self, word: str) -> list[int]:
        if (ids := self.paths.get(word)) is None:
            if len(self.paths) >= WORDS:
                self.paths.clear()
            symbols = word if word.isascii() and word.isalnum() else "".join(self.symbols[b] for b in word.encode())
            ids = self.table.path(symbols + self.end)
            if len(symbols) <= LONGEST:
                self.paths[word] = ids
        return ids

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text)
        if not any(unicodedata.category(c) == "Cn" for c in text):
            return self.words.findall(text)
        # Code points that Python's tables don't know: only the library says whether they are letters.
        return [piece for piece, _ in self.splitter.pre_tokenize_str(text)]

    def encode_chunk(self, chunk: str) -> list[int]:
        parts = self.cuts.split(chunk) if self.special and self.first in chunk else [chunk]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                for word in [text] if text.isalpha() else self._split(text):
                    out += self._word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, separated as a tokenizer without a decoder does."""
        return " ".join(self.labels[i] for i in ids)

    def text(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids, decoded text) of a whole text."""
        chunks = (text or "").encode().split()
        ids, labels = [], []
        for i in range(0, len(chunks), RUN):
            if self.ids.size >= CHUNKS:
                self.ids.clear()
                self.decoded.clear()
                self.ids.size = 0
            run = chunks[i : i + RUN]
            ids.append("".join(map(self.ids.__getitem__, run)))
            labels.append("".join(map(self.decoded.__getitem__, run)))
            for chunk in self.ids.long:
                del self.decoded[chunk]
            self.ids.long.clear()
        ids = "".join(ids)
        return ids.count(" "), ids[:-1], "".join(labels)[:-1]


class _Chunks(dict):
    """Ids of what stands between white space, each followed by a space; filled in, with the labels, as asked for.

    `size` is what they take: 300 bytes for an entry, and what its three strings hold. Long chunks are listed in `long`:
    their labels stay until they are read.
    """

    def __init__(self, codec: BpeCodec):
        self.codec, self.size, self.long = codec, 0, set()

    def __missing__(self, chunk: bytes) -> str:
        ids = self.codec.encode_chunk(chunk.decode())
        labels = self.codec.decoded[chunk] = self.codec.decode(ids) + " " if ids else ""
        found = "".join([f"{i} " for i in ids])
        if len(chunk) <= LONGEST:
            self[chunk] = found
            self.size += 300 + len(chunk) + len(found) + len(labels)
        else:
            self.long.add(chunk)
        return found


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encode_decode(docs: DataFrame, *, path: str | None = None, digests: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids and decoded text of every whole text, or their SHA-256.

    Null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; an empty table gives
    an empty one; other columns of docs are not read. Rows stay in their partition, and nothing is shuffled.
    """
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches):
        own = codec(path or tokenizer_path())
        digest = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digests else str
        for batch in batches:
            found = [own.text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), *[pa.array([digest(x[i]) for x in found], pa.string()) for i in (1, 2)]],
                ["doc_id", "n_tokens", *names],
            )

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")
