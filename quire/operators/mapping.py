"""Payloads of template blocks looked up in the order of their source, with the fall-backs for what no block has taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

# Fixed value: the heading that acknowledgements begin with.
THANKS = "致谢"


def first_sources(bindings: DataFrame, blocks: DataFrame, *, key: str = "doc_id", payload: str = "payload", text: str = "text", order: str = "idx") -> DataFrame:
    """bindings with source_index, the first block of their document whose text is the payload's but for outer white space, and its kind and level.

    Blocks with one text become one first, the one that stands first, while they are read; so a line that a document repeats,
    or one that stands in all of them, is gathered nowhere. The two sides meet by a hash of document and text, and
    texts are compared. Bindings without such a block, or without a payload, have nulls.
    """
    trimmed = T.uni_trim(F.col(text))
    first = F.min(F.struct(F.col(order).alias("source_index"), "kind", "level")).alias("__first")
    known = blocks.filter(trimmed != "").groupBy(F.col(key).alias("__key"), trimmed.alias("__text")).agg(first).withColumn("__hash", F.xxhash64("__key", "__text"))
    asked = bindings.withColumn("__said", T.uni_trim(F.col(payload))).withColumn("__at", F.xxhash64(key, "__said"))
    same = (F.col("__at") == F.col("__hash")) & (F.col(key) == F.col("__key")) & (F.col("__said") == F.col("__text"))
    found = asked.join(known, same, "left")
    return found.select(*bindings.columns, *[F.col("__first")[c].alias(c) for c in ("source_index", "kind", "level")])


def back_matter(lines: DataFrame, *, key: str = "doc_id", order: str = "idx", text: str = "text") -> DataFrame:
    """(key, block_id, order, text): references, and acknowledgements from their heading on, of the lines of a back matter.

    The heading itself is dropped; what stands behind it in its line is the first acknowledgement. Blank lines are left out.
    """
    said = T.uni_trim(F.col(text))
    bare = T.squeezed(F.col(text))
    heading = bare.startswith(THANKS)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.filter(said != "").withColumns({"__heading": heading, "__thanks": F.max(heading).over(w)})
    rest = F.when(F.col("__heading"), F.substring(bare, len(THANKS) + 1, 1 << 30)).otherwise(said)
    return rows.select(key, F.when(F.col("__thanks"), "acknowledgement").otherwise("references").alias("block_id"), order, rest.alias(text)).filter(F.col(text) != "")


def with_fallbacks(bindings: DataFrame, matter: DataFrame, *, key: str = "doc_id", order: str = "idx", text: str = "text") -> DataFrame:
    """(key, block_id, block_kind, payload): the bindings, and one for each kind of back matter that no binding of its document has by id or kind."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    payloads = matter.groupBy(key, "block_id").agg(joined.alias("payload"))
    by_id = bindings.select(key, F.col("block_id"))
    by_kind = bindings.select(key, F.col("block_kind").alias("block_id"))
    missing = payloads.join(by_id.union(by_kind).distinct(), [key, "block_id"], "left_anti")
    named = ["block_id", "block_kind", "payload"]
    return bindings.select(key, *named).unionByName(missing.select(key, "block_id", F.lit("back_matter").alias("block_kind"), "payload"))
