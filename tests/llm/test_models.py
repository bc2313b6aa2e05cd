"""Scores of learned models."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quire.llm import langid, ppm, toxicity
from tests.llm.conftest import LONG, ROWS

LETTERS = "abcdefghijklmnopqrstu"


def brute_scores(rows, order):
    texts = [(k, (t or "").encode().lower(), zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1) for k, t in rows]
    words, contexts, ends = Counter(), [defaultdict(Counter) for _ in range(order + 1)], 0
    for _, t, out in texts:
        if not out:
            words.update(t.split())
            ends += 1
            b = b"\xfe" * order + t + b"\xff"
            for i in range(order, len(b)):
                for o in range(order + 1):
                    contexts[o][b[i - o : i]][b[i]] += 1
    n, v = words.total() + ends, len(words) + (ends > 0)

    def probability(b, i):
        p, gone = 1.0, set()
        for o in range(order, -1, -1):
            seen = contexts[o].get(b[i - o : i], {})
            left = {s: c for s, c in seen.items() if s not in gone}
            if total := sum(left.values()):
                if b[i] in left:
                    return p * (left[b[i]] - 0.5) / total
                p *= 0.5 * len(left) / total
            gone |= set(seen)
        return p / (256 - len(gone))

    out = []
    for k, t, held in texts:
        b = b"\xfe" * order + t + b"\xff"
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(words[w] for w in t.split()), ends])
        out.append((k, held, len(t.split()) + 1, sum(words[w] > 0 for w in t.split()) + (ends > 0), n, base, sum(math.log10(probability(b, i)) for i in range(order, len(b)))))
    return out


@pytest.mark.parametrize("order,block,parts", [(5, 1 << 24, None), (2, 60, 3)])
def test_ppm(spark, order, block, parts):
    rows = [(k, t) for k, t, _, _ in ROWS if t is None or len(t) < 1000] + [(21, "hello hello world"), (22, "AAAA aaaa"), (30, "hello text")]
    found = ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_bytes=block, parts=parts).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(brute_scores(rows, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_ppm_blocks_end_by_bytes(spark):
    """However uneven the texts: a block ends as soon as it is full, and lists of nothing are not written."""
    rows = [(i, f"t{i} " * (150_000 if i > 20 else 1)) for i in range(40)]
    found = ppm._counted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).coalesce(1), 3, 500, 3 << 20).collect()
    blocks = defaultdict(list)
    for r in found:
        if r["part"] < 0:
            texts = zstandard.decompress(bytes(r["texts"])).split(b"\xff")[:-1]
            assert len(texts) == len(r["ids"]) == len(r["held"])
            blocks[r["block"]].append(sum(map(len, texts)))
    assert sum(map(sum, blocks.values())) == sum(len(t) for _, t in rows) and len(blocks) > 2 and all(sum(n[:-1]) < (3 << 20) for n in blocks.values())
    assert all(r["grams"] or r["words"] for r in found if r["part"] >= 0) and len(found) < 500 * len(blocks)


def test_ppm_of_odd_tables(spark, odd, empty):
    assert ppm.lm_scores(odd).count() == len(ROWS)
    assert ppm.lm_scores(empty).count() == 0
    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = ppm.lm_scores(spark.createDataFrame([(alone, "ab")], "doc_id long, text string")).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == pytest.approx(-3 * math.log10(256), rel=1e-6)


def test_ppm_probabilities_add_up(spark):
    text = "abracadabra"
    grams = Counter(b for b in ppm.byte_grams([text.encode()], 3)[0].tolist())
    context = int.from_bytes(b"bra", "big") << 8
    rows = [(g, n) for g, n in grams.items()] + [(context | s, 0) for s in range(256) if context | s not in grams]
    found = ppm.trie(spark.createDataFrame(rows, "gram long, n long"), 3).filter(f"shiftright(gram, 8) = {context >> 8}").collect()
    assert len(found) == 256 and sum(10 ** r["logp"] for r in found) == pytest.approx(1)


def test_language(odd, empty, sf_dir, spark):
    found = langid.identify(odd).collect()
    assert len(found) == len(ROWS)
    by = {r["doc_id"]: r for r in found}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == by[12]["lang_pred"] == "und" and by[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in found)
    assert langid.identify(empty).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = dict(map(tuple, docs.select("doc_id", "lang").collect()))
    held = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_language_backs_off():
    model = langid.WordFirst.of([(0, "haus", "de", 9), (0, "house", "en", 9), (3, "sch", "de", 5), (3, "the", "en", 5), (1, "x", "en", 3), (1, "x", "de", 1)])
    assert model.predict("haus")[0] == "de" and model.predict("xxschxx")[0] == "de" and model.predict("athex")[0] == "en" and model.predict("qqx")[0] == "en"
    assert model.predict("12 34") == ("und", 0.0) and model.predict("qqq")[1] == pytest.approx(0.5)


def test_language_keeps_every_repeated_entry(spark):
    common = [" ".join(f"{a}{b}{c}{d}" for a in "bcdfghjklm"[i :: 10] for b in LETTERS for c in LETTERS for d in LETTERS) for i in range(10)]
    rows = [(i, t, "de") for i, t in enumerate(common * 3)] + [(100, "vwxyvwxyvwxyvwxy " * 50 + "ñz ñz", "es")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("ñz")[0] == "es" and model.predict("bcad")[0] == "de"


def test_toxicity(odd, empty, spark):
    bad, good = "you are a total scumx and loserx", "what a fine day we had at the lake"
    rows = [(i, f"{bad if i % 3 == 0 else good} number{i} and more words follow here{i % 11}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(0, 0), (None, 1), (9999, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == 600 and all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) and all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    one = toxicity.toxicity(odd, labels.filter("toxic = 0")).collect()
    assert len(one) == len(ROWS) and len({r["score"] for r in one}) == 1
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ROWS)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_features():
    lexicon = {"scum": 2.0}
    at = dict(zip(toxicity.NAMES, toxicity.features("You are SCUM! sc*m 5cum fine", lexicon), strict=True))
    assert at["hits"] == pytest.approx(math.log1p(1)) and at["near"] > 0 and at["disguised_hits"] == 1 and at["disguised"] > 0 and at["exclamations"] > 0
    assert len(toxicity.features(None, lexicon)) == len(toxicity.features(LONG, lexicon)) == len(toxicity.NAMES)


def brute_features(text, lexicon):
    """The same 14 values, character by character."""
    text = text or ""
    strip = lambda w: w.strip(toxicity.PUNCTUATION)
    words = [strip(w) for w in text.lower().split()]
    n, hits, near, odd, plain, weight = max(len(words), 1), [], 0, 0, 0, 0.0
    for i, w in enumerate(words):
        if w in lexicon:
            hits.append(w)
            weight += lexicon[w]
            near += any(0 <= j < len(words) and words[j] in toxicity.SECOND_PERSON for j in range(i - toxicity.NEAR, i + toxicity.NEAR + 1))
        bare = "".join(c for c in w if c not in "'-")
        if any(c.isalpha() for c in w) and not all(c.isalpha() for c in bare):
            odd += 1
            undone = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in w if c not in "*.-_")
            if w not in lexicon and undone in lexicon:
                plain += 1
                weight += lexicon[undone]
    size = max(len(text.encode()), 1)
    capitals = sum("A" <= c <= "Z" for c in text)
    marks = sum(33 <= ord(c) <= 126 and not c.isalnum() for c in text)
    return [len(hits) / n, math.log(1 + len(hits)), weight / n, math.log(1 + weight), len(set(hits)), near / n, math.log(1 + near), capitals / size, text.count("!") / n, text.count("?") / n, marks / size, odd / n, plain, math.log(1 + len(words))]


def test_features_by_brute_force():
    rng = random.Random(4)
    lexicon = {"scum": 2.0, "loser": 1.5, "größe": 1.2, "it's": 1.1}
    parts = ["you", "scum", "SC*M", "5cum", "l0ser!", "Loser,", "größe", "it's", "it's-", "r2d2", "--", "«toi»", "word", "don't", "a1-b", "?!", "ÉÀ", "\n", "x@y"]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert toxicity.features(text, lexicon) == pytest.approx(brute_features(text, lexicon)), text
    assert toxicity.features(None, lexicon) == pytest.approx(brute_features(None, lexicon))


def test_lexicon_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(["a", "b", "c", "d"] + ["bad", "worse"] * (2 * (i % 4 == 0)) + ["worse"] * (i % 9 == 0)) for _ in range(5)), int(i % 4 == 0)) for i in range(400)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), odds=2.0, sure=2.5)
    bad, good, expected = sum(t for _, t in rows), sum(1 - t for _, t in rows), {}
    for w in {w for x, _ in rows for w in x.split()}:
        t, c = (sum(w in x.split() for x, k in rows if k == label) for label in (1, 0))
        odds, error = math.log((t + 0.5) / (bad + 1)) - math.log((c + 0.5) / (good + 1)), math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if odds >= math.log(2) and odds >= 2.5 * error:
            expected[w] = odds
    assert found == pytest.approx(expected) and found


def test_trees_and_calibration_by_brute_force(spark):
    """Scores follow the saved trees and the calibration's steps, worked out row by row."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["fine", "day", "scum", "you", "lake"] if i % 3 == 0 else ["fine", "day", "lake", "tree"]) for _ in range(12))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0 or i % 50 == 1)) for i in range(800)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r["score"] for r in model.score(docs, F.col("text"), F.col("doc_id")).collect()}
    steps, values = list(model.calibration.boundaries), list(model.calibration.predictions)

    def tree(node, x):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    trees = [(w, t._java_obj.rootNode()) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    for i, text in rows[::40]:
        x = toxicity.features(text, model.lexicon)
        p = 1 / (1 + math.exp(-2 * sum(w * tree(t, x) for w, t in trees)))
        assert found[i] == pytest.approx(min(max(float(np.interp(p, steps, values)), 0.0), 1.0), abs=1e-9)


def brute_language(rows):
    """Predictions by plain dictionaries, learned from (lang, text) rows."""
    counts = [defaultdict(Counter) for _ in range(langid.LONGEST + 1)]
    langs = sorted({lang for lang, _ in rows})
    pieces = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0][w][lang] += 1
            for n in range(1, langid.LONGEST + 1):
                for g in pieces(w, n):
                    counts[n][g][lang] += 1
    totals = [{x: sum(c[x] for c in table.values()) for x in langs} for table in counts]
    log = lambda n, e, x: math.log((counts[n][e][x] + 0.5) / (totals[n][x] + 0.5 * len(counts[n]) + 0.5))

    def word(w):
        for n in range(langid.LONGEST + 1):
            n = n and langid.LONGEST + 1 - n
            known = [e for e in ([w] if n == 0 else pieces(w, n)) if e in counts[n]]
            if known:
                return [sum(log(n, e, x) for e in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    def predict(text):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            return "und", 0.0
        total = [sum(column) for column in zip(*map(word, found))]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)

    return predict


def test_language_by_brute_force(spark, sf_dir):
    """Every word and n-gram of the sample counts, those seen once too, and unseen words back off."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id < 120")
    rows = [tuple(r) for r in docs.collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    predict = brute_language([(lang, t) for k, t, lang in rows if t is not None and lang is not None and not held(k)])
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for k, text, _ in rows:
        lang, score = predict(text)
        assert found[k]["held_out"] == held(k) and found[k]["lang_pred"] == lang and found[k]["score"] == pytest.approx(score, abs=1e-3)
