"""Sharding, exact dedup and fingerprints."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, exact_dedup, fingerprint, sharding
from tests.llm.conftest import ROWS


def test_sharding(odd):
    found = sharding.shard_documents(odd).collect()
    assert len(found) == len(ROWS)
    texts = Counter((k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for k, t, _, _ in ROWS)
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in found) == texts
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] == 8}) == 1


def test_shards_by_brute_force(odd, spark):
    """The highest -weight / ln(u) wins, u being a hash of key and shard."""

    def shard(key, weights):
        text = "" if key is None else str(key)
        uniform = lambda s: ((xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(text.encode(), 42)) >> 11) + 0.5) / (1 << 53)
        return max(range(len(weights)), key=lambda s: -weights[s] / math.log(uniform(s)))

    for r in sharding.shard_documents(odd).collect():
        assert (r["shard"], r["grown_shard"]) == (shard(r["doc_id"], [1.0] * 24), shard(r["doc_id"], [1.0] * 25))
    weights = [1.0, 0.5, 3.0, 2.0]
    for r in spark.range(500).select("id", sharding.rendezvous(F.col("id"), weights).alias("s")).collect():
        assert r["s"] == shard(r["id"], weights)


def test_sharding_weights_and_growth(spark):
    ids = spark.range(40_000)
    n = dict(map(tuple, ids.select(sharding.rendezvous(F.col("id"), (1.0, 2.0, 1.0)).alias("s")).groupBy("s").count().collect()))
    assert abs(n[1] / 40_000 - 0.5) < 0.02 and abs(n[0] / 40_000 - 0.25) < 0.02
    moved = ids.select(sharding.rendezvous(F.col("id"), (1.0,) * 9).alias("a"), sharding.rendezvous(F.col("id"), (1.0,) * 10).alias("b")).filter("a <> b")
    assert moved.filter("b <> 9").count() == 0 and abs(moved.count() / 40_000 - 0.1) < 0.02


def test_sharding_of_nothing(empty):
    assert sharding.shard_documents(empty).count() == 0


def brute_dedup():
    groups = defaultdict(list)
    for k, t, _, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k is None, k, t))
    out = Counter()
    for content, rows in groups.items():
        keep = min(rows)[2]
        for _, _, k, _ in rows:
            out[k, keep, len(rows), hashlib.sha256(content.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"digest": lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1)}, {"digest": lambda c: F.lit(b"same"), "salts": 3}])
def test_exact_dedup(odd, options):
    """Also with digests that collide: content decides."""
    found = exact_dedup.exact_dedup(odd, **options).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute_dedup()
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in found}) == len({r["text_sha256"] for r in kept})


@pytest.mark.parametrize("heavy", [1000, 3])
def test_exact_dedup_of_a_hot_text(spark, monkeypatch, heavy):
    """A third of all rows are copies, most without an id; hot texts take the way by broadcast, others by shuffle."""
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = [(None if i % 2 else i, " " * (i % 5) + ("hot" if i % 3 == 0 else f"t{i % 40}")) for i in range(300)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    groups = defaultdict(list)
    for k, t in rows:
        groups[t.strip()].append((-len(t), k is None, k or 0, k))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == 300 and Counter(r["text_sha256"] for r in found) == {digest(t): len(g) for t, g in groups.items()}
    for t, g in groups.items():
        own = [r for r in found if r["text_sha256"] == digest(t)]
        assert {r["keep_id"] for r in own} == {min(g)[3]} and {r["group_size"] for r in own} == {len(g)}
        assert [(r["doc_id"], -len(r["text"])) for r in own if r["kept"]] == [(min(g)[3], min(g)[0])]


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def _hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)), h)
    return h


def brute_codes(text, bins=128):
    """The same fingerprint, bin by bin."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return []
    least = {}
    for i in range(max(1, len(words) - 4)):
        x = _hash(words[i : i + 5]) >> 1
        least[x >> 56] = min(x, least.get(x >> 56, x))
    mix = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(struct.pack("<i", a), 42))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for j in range(bins):
        tries = [j, *(signed(mix(j, t)) % bins for t in range(fingerprint.TRIES))]
        at = next((b for b in tries if b in least), None)
        if at is None:
            at = min(least, key=lambda b: signed(mix(j, b)))
        out.append(least[at] & 255)
    return out


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(max((share - 1 / 256) / (1 - 1 / 256), 0.0), 1.0)


def test_fingerprints(odd):
    found = fingerprint.fingerprints(odd).collect()
    hashed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, signed(hashed(r[1]))), reverse=True)
    expected = Counter()
    for i, (k, t, _, _) in enumerate(order):
        a, b = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        own, other, after = brute_codes(a), brute_codes(edited), brute_codes(b)
        digits = lambda c: "".join(f"{x:02x}" for x in c)
        expected[k, len(a), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(other), round(brute_likeness(own, other), 9), round(brute_likeness(own, after), 9)] += 1
    assert Counter((*r[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == expected


@pytest.mark.parametrize("rows", [7, 40])
def test_order_over_many_buckets(spark, rows):
    """A third of the rows without a key, some keys that repeat, and the buckets' sizes bounded all the same."""
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") * F.col("id") % 409).alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = fingerprint.with_next(df, F.col("doc_id"), F.xxhash64("text"), {"text": F.col("text")}, rows=rows).collect()
    keys = {r["text"]: r["doc_id"] for r in df.collect()}
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    ordered = sorted(keys, key=lambda t: (keys[t] is not None, keys[t] or 0, tie(t)), reverse=True)
    assert Counter((r["text"], r["next_text"]) for r in found) == Counter(zip(ordered, ordered[1:] + ordered[:1]))
    quantiles = [k for k in (fingerprint.LEAST,) for _ in range(5)] + [10, 20]
    cut = df.select(fingerprint._cut(F.coalesce("doc_id", F.lit(fingerprint.LEAST)), F.xxhash64("text"), quantiles).alias("b")).groupBy("b").count().filter("b.number <= 1").collect()
    assert len([r for r in cut if r["count"] > 20]) >= 5 and max(r["count"] for r in cut) < 80


def test_likeness_has_no_bias(spark):
    words = [f"t{i}" for i in range(900)]
    pairs = [(" ".join(words[:800]), " ".join(words[: 800 - 8 * i] + words[800 : 800 + i])) for i in range(1, 40)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprint.likeness(fingerprint.codes(F.col("a")), fingerprint.codes(F.col("b"))).alias("s"))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    errors = [r["s"] - len(shingles(r["a"]) & shingles(r["b"])) / len(shingles(r["a"]) | shingles(r["b"])) for r in df.collect()]
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_fingerprints_of_nothing(empty):
    assert fingerprint.fingerprints(empty).count() == 0
