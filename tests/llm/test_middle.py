"""Fill-in-middle cuts and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fim, variants
from tests.llm.conftest import ROWS
from tests.util import same_rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc, len(tokens), "plain", None, None, sha(text), sha(text)
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc, len(tokens), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


MIDDLES = [(100 + i, t) for i, t in enumerate(["", " ", "a", " a ", "\ta\n\nb\x0b", "x <P> y", "<P", "P>", "<<P>", "<M>", "< P>", "<S", "é" * 300, "日本 語　テキスト x", "a\x1cb\x85c", "w " * 400] * 9)]


def test_middles(spark, odd, empty):
    found = fim.fim_digests(odd)
    assert Counter(map(tuple, found.collect())) == Counter(brute_middle(d, t) for d, t, _, _ in ROWS)
    df = spark.createDataFrame(MIDDLES, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, fim.fim_digests(df).collect())) == Counter(brute_middle(*r) for r in MIDDLES)
    assert fim.fim_digests(empty).count() == 0


def test_giant_texts_are_cut_across_chunks(spark):
    """Marks, letters and runs of white space lie across the chunks' borders, also runs longer than a chunk."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", " ", "\n", "  ", "word", "<", "P", ">", "日"]) for _ in range(rng.randint(200, 900))) for _ in range(60)]
    texts += [" " * 500, "x" * 500, "y" + " " * 300 + "z" * 300, "q " * 200 + "<M>", "z " * 63 + "<P>" + "y" * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, fim.fim_digests(df, chunk=129).collect())) == Counter(brute_middle(*r) for r in rows)


def test_output_is_the_text_in_another_order(odd):
    found = fim.fill_in_middle(odd, fim=100)
    assert [c for c in found.columns if c not in odd.columns] == ["form", "prefix_chars", "middle_chars", "output"]
    for r in found.collect():
        assert fim.restored(r["output"].encode(), r["form"]).decode() == (r["text"] or "")
        assert r["form"] == "plain" or r["prefix_chars"] + r["middle_chars"] <= len(r["text"])


def test_a_scan_of_parts_is_the_scan_of_the_whole():
    rng = random.Random(1)
    data = np.frombuffer("".join(rng.choice("a <P>S\n") for _ in range(3000)).encode(), np.uint8)
    one = lambda a, b: fim.Scan(data, np.array([a]), np.array([b])).whole()
    for cut in (0, 1, 127, 128, 129, 1500, 3000):
        (to, tokens, marks), left, right = one(0, 3000), one(0, cut), one(cut, 3000)
        assert (to[:, 0] == right[0][left[0][:, 0], 0]).all()
        for whole, a, b in ((tokens, left[1], right[1]), (marks, left[2], right[2])):
            assert (whole[:, 0] == a[:, 0] + b[left[0][:, 0], 0]).all()


def test_middles_by_sql(spark, sf_dir, duck):
    same_rows(fim.fim_digests(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck, fim.ORACLE_SQL)


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if edits(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * n else None, len(near))
    rows = set()
    for w, n in counts.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        form = out[w][0]
        rows.add((w, form, root, n, out[w][1], counts[form] if form else None))
    return rows


def test_variants(spark):
    """Few letters, so that many words are near in all ways at once; ties, chains, doubled letters, words at either end."""
    rng = random.Random(4)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(3, 6))): rng.choice([2, 2, 3, 25, 25, 300, 4000]) for _ in range(400)}
    counts |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "x" * 300: 2, "x" * 299 + "y": 20, "x" * 299: 20, "y" * 301: 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in variants.spelling_variants(df).collect()} == brute_variants(counts)
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_keys():
    words = ["a", "ab", "ba", "aab", "abb", "éa", "zzzz", "zzz"]
    keys = {w: variants.key(w) for w in words}
    assert len(set(keys.values())) == len(words)
    for w in words:
        less = {k for k, code in variants.neighbours(w) if code < 0}
        assert less == {variants.key(w[:i] + w[i + 1 :]) for i in range(len(w))}
        assert sum(code < 0 for _, code in variants.neighbours(w)) == len(less)
        assert [code for _, code in variants.neighbours(w) if code >= 0] == list(map(ord, w))
        for x in words:
            shared = {k for k, c in variants.neighbours(w) if c >= 0} & {k for k, c in variants.neighbours(x) if c >= 0}
            assert w == x or bool(shared) == (len(w) == len(x) and edits(w, x))


@pytest.mark.parametrize("most", [variants.HELD, 0])
def test_counts_of_words(spark, most):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, i]), rng.choice([None, "", "Wordone wordTWO, größerem É×÷éééééé ÿÿÿÿÿÿÿÿ x2longerword Ŵordthreé", "wordone " * 40])) for i in range(120)]
    expected = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                expected[run] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).repartition(3)
    assert {r["word"]: r["n"] for r in variants.word_counts(df, most=most).collect()} == {w: n for w, n in expected.items() if n >= 2}
    assert variants.document_variants(df.limit(0)).count() == 0


def test_variants_by_sql(spark, sf_dir, duck):
    same_rows(variants.document_variants(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck, variants.ORACLE_SQL)
