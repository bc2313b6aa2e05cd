"""Parts of even size, rows that can't be told apart, memories bounded by bytes, and columns of any name."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, packing, ppm, sharding, substring
from quire.llm.common import as_read, tokenizer_path
from tests.llm.test_near import brute_repeats


@pytest.mark.parametrize("parts", [64, 1000, 4096])
def test_parts_of_the_trie_are_even(spark, sf_dir, parts):
    texts = [(r["text"] or "").encode().lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    grams = np.unique(ppm.byte_grams(texts, ppm.ORDER)[0])
    sizes = np.bincount(ppm.part_of(grams, parts), minlength=parts)
    assert sizes.max() < 2 * sizes.mean() + 5 * sizes.mean() ** 0.5
    some = grams[:: len(grams) // 500]
    found = spark.createDataFrame([(int(g),) for g in some], "gram long").select(ppm.part_of(F.col("gram"), parts).alias("p")).collect()
    assert [r["p"] for r in found] == ppm.part_of(some, parts).tolist()


def test_rows_equal_in_id_and_text_take_linear_work(spark):
    """Ten thousand rows without an id and one text, which a document with an id has too."""
    text = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").union(spark.range(10_000).select(F.lit(None).cast("long"), F.lit(text)))
    began = time.time()
    found = Counter((r["n_words"], r["n_removed"]) for r in substring.substring_digests(df.repartition(4)).collect())
    assert found == {(120, 0): 1, (120, 120): 10_000} and time.time() - began < 240


def test_some_rows_equal_in_id_and_text(spark):
    rng = random.Random(2)
    base = [" ".join(f"k{rng.randint(0, 3)}" for _ in range(rng.randint(50, 130))) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(base)) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substring.substring_digests(df).collect())) == brute_repeats(rows)


def test_shards_keep_columns_of_any_name(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "concat('t', id % 7) AS text", "1 AS __rank", "2 AS __sub", "3 AS __first", "4 AS __n", "5 AS Slot", "6 AS __place", "7 AS __own0")
    found = sharding.shard_documents(df, (1.0,) * 5)
    assert set(found.columns) == {"doc_id", "text", "__rank", "__sub", "__first", "__n", "__place", "__own0", "size", "text_crc32", "law", "shard", "grown_shard", "slot"}
    assert [tuple(r) for r in found.select("__rank", "__sub", "__first", "__n", "__place", "__own0").distinct().collect()] == [(1, 2, 3, 4, 6, 7)]
    rows = found.select("shard", "slot").collect()
    for s, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_rows_are_numbered_by_their_place(spark):
    """A third of all rows equal: they lie in as many buckets as others, and get numbers of their own."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("same").alias("text"))
    slots = [(r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(4)).collect()]
    assert len(set(slots)) == 3000
    ids = sorted(r["sequence_id"] for r in packing.pack(df.repartition(4)).collect())
    assert ids == list(range(len(ids)))


def test_memories_are_bounded_by_bytes():
    """Texts without white space are one chunk each; they are not remembered, and short chunks only up to the bound."""
    rng = random.Random(1)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(40)] + [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(300)) for _ in range(30)]
    encoder = packing.ChunkEncoder(tokenizer_path())
    codec = bpe.BpeCodec(tokenizer_path())
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == whole
    assert [[int(i) for i in codec.text(t)[1].split()] for t in texts] == whole
    for known in (encoder.ids, encoder.words, encoder.whole, codec.ids, codec.decoded, codec.paths):
        assert max(map(len, known), default=0) <= 800
    assert codec.ids.size < 30 * 300 * 500 and not codec.ids.long


def test_tables_as_they_are_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert as_read(docs) and not as_read(docs.filter("doc_id > 1")) and not as_read(docs.union(docs)) and not as_read(spark.range(3).toDF("doc_id"))
