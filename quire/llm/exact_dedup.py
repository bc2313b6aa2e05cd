"""Exact deduplication by skew-safe combining, in built-in functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, boxed, skew_safe_join, stored, unboxed

SALTS = 16
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def decided(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=_digest, in_place: bool = False) -> DataFrame:
    """(box, keep_id, group_size, kept, text_sha256) of every row; box holds the row's own columns, see `exact_dedup`."""
    docs = docs if in_place else stored(docs)
    place = docs.metadataColumn("_metadata")
    rows = docs.select(
        boxed(docs).alias("box"),
        F.xxhash64(place["file_path"], place["row_index"]).alias("row"),
        normalised(docs[text_col]).alias("content"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).alias("chars"),
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("id"),
    )
    rows = rows.withColumns({"digest": digest(F.col("content")), "salt": F.pmod("row", F.lit(salts)).cast("int")})
    # One sortable number for (longest, smallest id): hash aggregation can hold it in its fixed-width buffer.
    best = F.col("chars").cast("decimal(10,0)") * F.lit(Decimal(1 << 64)) + (F.lit(Decimal(LAST)) - F.col("id").cast("decimal(20,0)"))
    rows = rows.withColumn("best", best)
    salted = rows.groupBy("digest", "content", "salt").agg(F.max_by("row", "best").alias("keep_row"), F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max_by("keep_row", "best").alias("keep_row"), F.max("best").alias("best"), F.sum("n").alias("group_size"))
    winners = merged.select("digest", "content", "group_size", "keep_row", (F.lit(Decimal(LAST)) - F.pmod("best", F.lit(Decimal(1 << 64)))).cast("long").alias("keep"))

    alone = stored(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.max("group_size").alias("group_size"), F.max("keep_row").alias("keep_row"), F.max("keep").alias("keep")))
    if alone.filter("variants > 1").isEmpty():
        table, key = alone.drop("variants"), "digest"
    else:  # a digest stands for several contents: the content itself is the key
        table, key = stored(winners.drop("digest")), "content"
    found = skew_safe_join(rows.select("box", "row", "digest", "content"), table, key, "group_size", F.col("row"), "found")
    return found.select(
        "box",
        F.when(F.col("found.keep") != LAST, F.col("found.keep")).alias("keep_id"),
        F.col("found.group_size").alias("group_size"),
        (F.col("row") == F.col("found.keep_row")).alias("kept"),
        (F.sha2("content", 256) if digest is not _digest else F.lower(F.hex("digest"))).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of docs; options are those of `decided`.

    Texts are equal if they agree after white space is deleted. Three stages combine equal texts, each of them with
    the whole content in its key, so that a digest collision never joins two texts:
    1. each map task combines its own copies (partial aggregation),
    2. the survivors meet by (digest, content, salt), so a hot text is spread over `salts` tasks,
    3. at most `salts` winners of a text meet by (digest, content).
    Winners are named by the place of their row in its file. The decision goes back to the rows by digest; digests that
    hold over a thousandth of all rows are broadcast, and their rows gather nowhere.

    The longest original text stays, then the smallest id. Null text counts as empty; a null id sorts last and is
    returned as keep_id null; of rows that repeat id and content one is kept, any of those with the longest text; very
    long texts are hashed and compared whole; an empty table gives an empty one. Columns of docs with the names of added
    ones are replaced, all others stay. in_place: docs is read from Parquet and not changed since; otherwise it is
    written once, so that rows have places.
    """
    return unboxed(decided(docs, **options), docs.columns, {c: F.col(c) for c in ("keep_id", "group_size", "kept", "text_sha256")})


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
c AS (SELECT doc_id, length(body) AS chars, regexp_replace(body, '[\x20\x09-\x0D]', '', 'g') AS content FROM t),
k AS (SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY content) AS group_size FROM c)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM k
"""
