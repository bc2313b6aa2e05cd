"""Rendezvous hashing of record keys over weighted shards, in built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, stored

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose weighted score for the key is highest.

    Shard s scores -w / ln(u), u being a uniform hash of (key, s): each shard wins in proportion to its weight,
    and a shard that is added takes keys only into itself. Null keys count as the empty text.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(s: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.lit(float(w)) / F.ln(u)).alias("score"), F.lit(-s).alias("shard"))

    scores = [score(s, w) for s, w in enumerate(weights)]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, *, grown_weight: float = 1.0, in_place: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals documents over shards; adds size, text_crc32, law, shard, slot and grown_shard.

    A document's shard follows from its id and the weights alone, so reruns and appended rows never move others.
    `slot` numbers a shard's rows without gaps. Null text: size 8, crc32 of the empty text; null id: the key is the
    empty text; repeated ids share a shard and get slots of their own; an empty table gives an empty one. Columns of docs
    with the names of added ones are replaced, all others stay, whatever their names. Rows are dealt over the tasks that
    number them by their place, so rows that are equal lie apart. in_place: docs is read from Parquet and not changed
    since; otherwise it is written once, so that rows have places.
    """
    docs = docs if in_place else stored(docs)
    text, place = F.coalesce(docs[text_col], F.lit("")), docs.metadataColumn("_metadata")
    added = {
        "size": (F.octet_length(text) + 8).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "law": F.lit("key"),
        "shard": rendezvous(docs[id_col], weights).cast("int"),
        "grown_shard": rendezvous(docs[id_col], [*weights, grown_weight]).cast("int"),
    }
    own = {f"__own{i}": c for i, c in enumerate(docs.columns) if c.lower() not in {*added, "slot"}}
    found = docs.select(*[docs[f"`{c}`"].alias(k) for k, c in own.items()], *[v.alias(k) for k, v in added.items()], docs[id_col].alias("__id"), F.xxhash64(place["file_path"], place["row_index"]).alias("__place"))
    found = numbered(found, ["shard"], F.col("__place"), ["__id", "text_crc32"], "slot", per_group=True)
    return found.select(*[F.col(k).alias(c) for k, c in own.items()], *added, "slot")
