"""Helpers that several operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the class of a Java or RE2 pattern.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_read(df: DataFrame) -> bool:
    """Whether df is a table just as Spark reads it, so that its rows have places in files."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def spread(df: DataFrame) -> DataFrame:
    """Deals a table that is read in fewer pieces than there are cores over all of them; larger tables stay as they are.

    A file with one row group is one task, however many cores there are, and Python work on it would use one of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """Sends rows to Python workers in batches of at most `size` bytes (or one row), as texts may be long; returns df.

    The setting is the session's, as Spark reads it when the result is asked for; a smaller one of the caller's stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    known = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not known or not 0 < int(known[1]) <= size:
        conf.set(key, size)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may name none; it gets one of its own."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        there = context.getCheckpointDir()
    return there


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns, replacing any of the same name in any case."""
    taken = {k.lower() for k in new}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


def boxed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no column of an operator can clash with them; `box.*` opens it."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def unboxed(found: DataFrame, names: Sequence[str], added: dict[str, Column]) -> DataFrame:
    """The columns of `box`, named `names`, and the added ones, which replace those of the same name in any case."""
    taken = {k.lower() for k in added}
    return found.select(*[F.col("box")[c].alias(c) for c in names if c.lower() not in taken], *[v.alias(k) for k, v in added.items()])


#: Keys that hold more than one HEAVY-th of all rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000


def skew_safe_join(rows: DataFrame, table: DataFrame, key: str, count: str, spread: Column, out: str) -> DataFrame:
    """rows with a struct `out` of table's other columns, null where table has no such key.

    table has each key once, and `count` is the number of rows that hold it. The few keys with more than one HEAVY-th of
    all these rows are broadcast, and their rows are dealt over the tasks of the other join by `spread`, where they match
    nothing. So no task gathers a hot key, and rows are shuffled once, in small tables as in large ones.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    kind = rows.schema[key].dataType.simpleString()
    found = F.struct(*[c for c in table.columns if c != key])
    heavy = table.filter(F.col(count) * HEAVY > total).select(F.col(key).alias("__key"), found.alias("__heavy"))
    light = table.filter(F.col(count) * HEAVY <= total).select(F.col(key).alias("__at"), F.lit(False).alias("__hot"), found.alias("__light"))
    dealt = spread.cast("string").cast(kind) if kind in ("string", "binary") else spread
    hot = F.col("__heavy").isNotNull()
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("__key"), "left").drop("__key")
    marked = marked.withColumns({"__hot": hot, "__at": F.when(hot, dealt).otherwise(F.col(key))})
    return marked.join(light.hint("merge"), ["__at", "__hot"], "left").select(*rows.columns, F.coalesce("__heavy", "__light").alias(out))


#: Rows that are meant to be ranked together.
BUCKET_ROWS = 1_000_000


def numbered(df: DataFrame, group: Sequence[str], spread: Column, order: Sequence[str], out: str, *, per_group: bool, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds gapless numbers from 0, within each group or over all rows, without gathering a group in one task.

    Rows of a group are dealt over buckets by a hash of `spread` and ranked within a bucket, about `bucket_rows` at a
    time; counts of the buckets (groups x buckets rows) give each bucket's first number and come back by a join on the
    keys that the ranks are partitioned by.
    """
    buckets = max(64, -(-df.count() // bucket_rows))
    df = df.withColumn("__sub", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    keys = [*group, "__sub"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*group) if per_group else Window.partitionBy(F.lit(0))).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = df.withColumn("__rank", rank).join(first, keys)
    return joined.withColumn(out, F.col("__first") + F.col("__rank") - 1).drop("__sub", "__rank", "__first")


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]
