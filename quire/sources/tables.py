"""Tables as Parquet, and rows written out in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; columns and filters are pruned and pushed to the scan by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table that is read in fewer pieces than there are cores over all of them, for Python work on its rows.

    Tables of short rows are small files, which Spark reads in a task or two, however much is made of each row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """Sends rows to Python workers in batches of at most `size` bytes (or one row), as contents may be long; returns df.

    The setting is the session's, as Spark reads it when the result is asked for; a smaller one of the caller's stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = re.fullmatch(r"(\d+)b?", df.sparkSession.conf.get(key))
    if not known or not 0 < int(known[1]) <= size:
        df.sparkSession.conf.set(key, size)
    return df


def rows(spark: SparkSession, values: str, names: str) -> DataFrame:
    """A small frame from SQL VALUES, in the spelling that DuckDB shares."""
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({names})")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query in the SQL that DuckDB shares, over the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def dealt(values: str, names: str, of: str, key: str) -> str:
    """SQL of a row for each row of a table, with the id `key` and the values of one of the samples, dealt by that id.

    values: rows that begin with 1, 2, ..., as names begin with id.
    """
    count = 1 + max(int(x) for x in re.findall(r"(?:^|\), )\((\d+), ", values))
    rest = names.split(", ", 1)[1]
    return f"SELECT t.{key} AS id, {', '.join('v.' + n for n in rest.split(', '))} FROM {of} t JOIN (VALUES {values}) AS v({names}) ON v.id = 1 + t.{key} % {count - 1}"


def with_deleted(df: DataFrame, show: Literal["", "true", "false"], deleted: Column) -> DataFrame:
    """Soft-deleted rows: all ("") or only deleted ("true") or only live ("false") ones."""
    return df.filter(deleted) if show == "true" else df.filter(~deleted) if show == "false" else df


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key; raises LookupError if there is none."""
    found = df.filter(F.col(key) == F.lit(value)).orderBy(key).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value}")
    return found


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path where driver and executors share files. Only a local session may name none; it gets one of its own."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        there = context.getCheckpointDir()
    return f"{there}/quire-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
