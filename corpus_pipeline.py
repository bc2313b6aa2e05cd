"""From raw documents to packed training sequences, one stored stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, langid, packing, simhash, substring
from quire.llm.common import as_read, documents, spread, stored


# Common to all stages: columns of docs pass through under any name, n_chars alone follows its text; nulls may stand in
# any column; texts are worked on whole, empty and very long ones too; an empty table gives an empty one.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or hold no letter go; the predicted language itself rejects nothing, even if none can be learned.

    Repeated rows stay each; of equal scores the language first in the alphabet wins.
    """
    docs = spread(docs)
    return langid.decided(docs, langid.fit(docs)).filter("lettered").select("box.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest one, then the smallest id, null last; null counts as empty.

    Of rows that repeat id and text one stays.
    """
    return exact_dedup.decided(docs, in_place=as_read(docs)).filter("kept").select("box.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, null last; of rows with one id, by a hash of the text.

    Rows that repeat id and text stay both, which the stage before has left none of.
    """
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document with a smaller id holds, n_chars as they are then.

    A null id counts as the largest; rows that share an id keep what they share; texts that lose nothing stay as they
    are, null and empty ones too.
    """
    return substring.without_repeats(docs, lengths="n_chars", in_place=as_read(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", sequences),
]

#: The first and last stages use a learned model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
