"""Packing and BPE against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, packing
from quire.llm.common import tokenizer_path
from tests.llm.conftest import ROWS


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


alphabet = st.text(st.one_of(st.sampled_from("abcdefghij'st.,! \n\t<|>éßÄçΣİ中́\xa0\x1c0²"), st.characters(blacklist_categories=("Cs",))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(alphabet)
def test_both_encoders_agree_with_the_library(text):
    from tokenizers import Tokenizer

    if not hasattr(test_both_encoders_agree_with_the_library, "t"):
        test_both_encoders_agree_with_the_library.t = Tokenizer.from_file(tokenizer_path()), bpe.codec(tokenizer_path()), packing.encoder(None)
    tok, codec, chunks = test_both_encoders_agree_with_the_library.t
    ids = tok.encode(text, add_special_tokens=False).ids
    assert codec.text(text) == (len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))
    assert np.frombuffer(next(chunks.encode([text])), "<u4").tolist() == ids


def test_special_tokens(library):
    for text in ("a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>", ":\U00013460", ":\U0003d000a", "x\u0558.y"):
        assert bpe.codec(tokenizer_path()).text(text)[1] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_automaton_of_overlapping_merges():
    """All words over two letters: the only path is what merging by rank gives."""
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("ba", "ba"), ("aab", "aa")]
    vocabulary = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    table = bpe.SymbolTable(bpe.MergeAutomaton(vocabulary, merges))
    for n in range(1, 12):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert table.path(word) == [vocabulary[p] for p in parts], word


def test_compiled_table_is_read_without_search(library, monkeypatch):
    """A word that has been compiled needs no arc of the automaton again, and a table that starts anew gives the same."""
    codec = bpe.BpeCodec(tokenizer_path())
    words = ["tokenization", "supercalifragilistic", "a", "größe"]
    first = [codec._word(w) for w in words]
    codec.paths.clear()
    monkeypatch.setattr(codec.table, "_compiled", None)
    assert [codec._word(w) for w in words] == first == [library.encode(w, add_special_tokens=False).ids for w in words]
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "STATES", 5)
    codec.paths.clear()
    assert [codec._word(w) for w in words] == first


def test_bpe(odd, empty, library):
    expected = Counter()
    for k, t, _, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_decode(odd).collect())) == expected
    assert bpe.encode_decode(empty).count() == 0
    assert bpe.encode_decode(odd, digests=False).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_binary_pieces():
    for n in (0, 1, 5, 4095, 4096, 4097, 12_345):
        found = list(packing.binary_pieces(n))
        assert [s for s, _ in found] == list(np.cumsum([0] + [k for _, k in found])[:-1]) and sum(k for _, k in found) == n
        assert all(k & (k - 1) == 0 and k <= 4096 for _, k in found)


def test_packing(odd, empty, library):
    found = packing.pack(odd).collect()
    ids = [(k, library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t, _, _ in ROWS]
    expected = Counter()
    for k, x in ids:
        for start, length in packing.binary_pieces(len(x)):
            expected[k, start, length, zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == expected
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found))) and all(r["offset"] == 0 for r in found)
    by_bucket = defaultdict(list)
    for r in found:
        by_bucket[r["length"]].append(r["sequence_id"])
    assert all(max(v) - min(v) + 1 == len(v) for v in by_bucket.values())
    assert packing.pack(empty).count() == 0
