"""Suffix arrays by external induction and repeated bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bytespans, induction
from tests.llm.conftest import PASSAGE, ROWS
from tests.util import same_rows


def texts():
    rng = random.Random(1)
    for trial in range(60):
        kinds = rng.choice([1, 2, 3, 6])
        text = [1 + rng.randrange(kinds) for _ in range(rng.randint(1, 150))]
        yield kinds + 1, [1] * len(text) if trial % 9 == 0 else text[:7] * 20 if trial % 9 == 1 else text


@pytest.mark.parametrize("memory", [3, 40, 1 << 20])
def test_suffixes_are_in_order_with_what_they_have_in_common(memory, tmp_path):
    """With room for three tuples all queues and tapes lie on disk, and texts of names are sorted by recursion to the end."""
    spilled = 0
    for kinds, text in texts():
        data = bytes([*text, 0])
        scratch = induction.Scratch(str(tmp_path))
        found = np.concatenate(list(induction.descending(np.frombuffer(data, np.uint8), kinds, scratch, memory=memory, most=5)))
        spilled += scratch.written
        scratch.close()
        order = sorted(range(len(text)), key=lambda i: data[i:], reverse=True)
        shared = [0] + [next(n for n in range(6) if n == 5 or data[a + n] != data[b + n]) for a, b in zip(order, order[1:])]
        assert (found >> 8).tolist() == order and (found & 255).tolist() == shared
        assert induction.ascending(np.array([*text, 0]), kinds, scratch, memory=memory).tolist() == [len(text), *order[::-1]]
        scratch.close()
    assert not list(tmp_path.iterdir()) and bool(spilled) == (memory < 1 << 20)


def test_suffixes_of_longer_texts(tmp_path):
    """As many kinds as a byte has, so that names take several words; many ranges of keys, heavy ones and light ones."""
    rng = random.Random(2)
    for kinds, n in ((3, 5000), (30, 9000), (200, 3000)):
        data = bytes([*(1 + min(rng.randrange(kinds), rng.randrange(kinds)) for _ in range(n)), 0])
        scratch = induction.Scratch(str(tmp_path))
        found = np.concatenate(list(induction.descending(np.frombuffer(data, np.uint8), 256, scratch, memory=700, most=50)))
        scratch.close()
        order = sorted(range(n), key=lambda i: data[i:], reverse=True)
        assert (found >> 8).tolist() == order
        assert (found & 255).tolist() == [0] + [next(n for n in range(51) if n == 50 or data[a + n] != data[b + n]) for a, b in zip(order, order[1:])]


def brute_bytes(rows, window=50):
    order = lambda k: bytespans.LAST if k is None else k
    data, least = [(t or "").encode() for _, t in rows], {}
    for (k, _), b in zip(rows, data):
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            least[s] = min(order(k), least.get(s, order(k)))
    out = []
    for (k, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < order(k):
                gone[i : i + window] = b"\1" * window
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


SMALL = {"block": 3000, "bucket": 2000, "shard": 2000, "memory": 200}


@pytest.mark.parametrize("options", [{}, SMALL, {**SMALL, "hot": 2}, {**SMALL, "hot": 1}])
def test_repeated_bytes(spark, options):
    """Few letters, copies, passages that overlap, nulls and equal ids; small blocks, shards and queues; hot anchors window by window."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") if i % 3 else "xé" for _ in range(rng.randint(0, 200)))) for i in range(40)]
    passage = "".join(chr(rng.randint(97, 122)) for _ in range(400))
    rows += [(rng.choice([None, 50 + i, -i]), "".join(chr(rng.randint(0x3B1, 0x3C9)) for _ in range(rng.randint(0, 40))) + passage[(a := rng.randint(0, 300)) : a + rng.randint(40, 90)] * rng.randint(1, 2) + "日本語" * rng.randint(0, 20)) for i in range(80)]
    rows += [(7, rows[5][1]), (None, None), (None, ""), (90, rows[3][1]), (90, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, bytespans.byte_digests(df, **options).collect())) == brute_bytes(rows)


def test_other_windows(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, bytespans.byte_digests(df, window=9, anchor=4).collect())) == brute_bytes(rows, 9)


def test_odd_rows(odd, empty):
    assert Counter(map(tuple, bytespans.byte_digests(odd).collect())) == brute_bytes([(k, t) for k, t, _, _ in ROWS])
    assert bytespans.byte_digests(empty).count() == 0 and bytespans.removed_spans(empty).count() == 0
    found = bytespans.removed_spans(odd.withColumn("Byte_Spans", F.lit(1)))
    assert found.columns == [*odd.columns, "byte_spans"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(s) for s in rows[11]["byte_spans"]] == [(5, 5 + len(PASSAGE) + 2)] and rows[10]["byte_spans"] == rows[3]["byte_spans"] == []


def test_rows_equal_in_id_and_text(spark):
    """Many rows without an id and one text: each loses what the document with an id has, and none is counted for another."""
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").union(spark.range(5000).select(F.lit(None).cast("long"), F.lit(text)))
    found = Counter((r["n_removed"], r["n_spans"]) for r in bytespans.byte_digests(df.repartition(4)).collect())
    assert found == {(0, 0): 1, (len(text), 1): 5000}


def test_bytes_by_sql(spark, sf_dir, duck):
    same_rows(bytespans.byte_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), in_place=True), duck, bytespans.ORACLE_SQL)


def test_buckets_of_anchors_are_even():
    data = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    hashes = np.unique(bytespans.anchored(data, np.array([len(data)]), 50, 16)[2])
    counts = np.bincount(bytespans._bucket(hashes, 16), minlength=16)
    assert counts.max() < 1.2 * counts.mean() and counts.min() > 0.8 * counts.mean()


def test_texts_stay_where_their_blocks_lie(spark, tmp_path):
    """Blocks are joined to answers and spans without a shuffle of their texts, and what goes to a shard is packed."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = [(i, passage[i : i + 2000] + str(i) * 50) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    found = bytespans.byte_digests(spark.read.parquet(f"{tmp_path}/d"), in_place=True, block=20_000, shard=50_000)
    assert Counter(map(tuple, found.collect())) == brute_bytes(rows)
    assert "SelectedBucketsCount" in found._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sent(monkeypatch):
    """The rows that go to shards, for each query that is made."""
    found, spans = [], bytespans._spans
    monkeypatch.setattr(bytespans, "_spans", lambda pieces, *rest: found.append(pieces.drop("packed").collect()) or spans(pieces, *rest))
    return found


def test_rows_for_shards_grow_with_groups(spark, sent):
    """At over 300 small shards, what a batch of blocks sends has a row for eight of them; results are as ever."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(40)]
    rows = [(rng.choice([None, i]), (t := rng.choice(base))[rng.randint(0, 99) :] + str(i) + rng.choice(base)[rng.randint(0, 99) :]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, bytespans.byte_digests(df, block=3000, bucket=60, shard=400, memory=200).collect())) == brute_bytes(rows)
    groups, batches = len({r["shard"] for r in sent[0]}), len({tuple(r["blocks"]) for r in sent[0]})
    assert 30 < groups < 200 and len(sent[0]) <= groups * batches


def test_copies_go_to_no_shard(spark, sent):
    """Of equal texts the one with the least id goes on, so rows that repeat a table take no more text to shards than the table."""
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (0, 1, 49, 50, 51, 300, 900)]
    rows = [(rng.choice([None, 3, 4, *range(100)]), t) for t in base * 30] + [(-1 - i, t) for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, SMALL):
        assert Counter(map(tuple, bytespans.byte_digests(df, **options).collect())) == brute_bytes(rows)
    spans = {r["byte_spans"][0] if r["byte_spans"] else None for r in bytespans.removed_spans(df, **SMALL).collect()}
    assert spans == {None, *((0, len(t.encode())) for t in base if len(t.encode()) >= 50)}
    assert not any(sent)


def test_short_strings_in_many_documents_go_to_no_shard(spark, sent):
    """Strings of 20 bytes that documents have by chance, as large tables of prose do, are no reason to compare their windows."""
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(5)]
    rows = [(i, "".join("".join(chr(rng.randint(33, 126)) for _ in range(30)) + rng.choice(common) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, bytespans.byte_digests(df).collect())) == brute_bytes(rows)
    assert not any(sent)


def test_texts_stay_at_any_number_of_shuffle_partitions(spark, tmp_path, monkeypatch):
    """Answers and spans are dealt over as many tasks as the table of blocks has places, also if other shuffles have more."""
    plans, pieces = [], bytespans._pieces
    monkeypatch.setattr(bytespans, "_pieces", lambda found, *rest: plans.append(found) or pieces(found, *rest))
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = [(i, passage[i : i + 2000] + str(i % 50) * 50) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        plans.append(bytespans.byte_digests(spark.read.parquet(f"{tmp_path}/d"), in_place=True, block=20_000, shard=50_000))
        assert Counter(map(tuple, plans[1].collect())) == brute_bytes(rows)
        for found in plans:
            text = found._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount" in text and ", 40)" not in text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
