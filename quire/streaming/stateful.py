"""Time-driven steps as Structured Streaming, with batch folds that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quire.sources.tables import shared_folder

#: Events of a key that are folded in one row at most.
RUN = 20_000


def event_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A table's Parquet files as a stream, be it one file or a folder; a streamed path must be a folder or a pattern.

    All files that are there come in one micro-batch, as their times may overlap in any way; `files` bounds a batch, for
    files that come in order of time.
    """
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path}*")


@dataclass
class Batches:
    """A stream and what makes each of its micro-batches a result.

    `step` gets a batch, its number and the stream's folder, in order, and again for a batch that was not finished; what it
    keeps must lie in that folder, by the batch's number. `settings` are the session's while the stream is started.
    """

    stream: DataFrame
    step: Callable[[DataFrame, int, str], DataFrame]
    schema: StructType
    settings: dict[str, str] = field(default_factory=dict)


def _keyed(events: DataFrame, key: str, time: str, event: str) -> DataFrame:
    return events.select(F.col(key).cast("long").alias("key"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"), F.col(event).cast("long").alias("event"))


def fold(events: DataFrame, rate: float, cap: float, before: DataFrame | None = None, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(key, event, allowed) of events (key, at, event), and (key, tokens, last) after them; `before` has the latter of earlier ones.

    Events are dealt by ranges of (key, at, event), so a hot key lies in many tasks, and cut into runs of at most `run`.
    The n-th runs of all keys are folded at once and leave tokens and time to the next ones, as Parquet: there are as
    many rounds as the hottest key has runs.
    """
    spark, at = events.sparkSession, shared_folder(events.sparkSession)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = events.repartitionByRange(n, "key", "at", "event").sortWithinPartitions("key", "at", "event")
    # ids ascend over the ranges and leave wide gaps between them, so no run spans two ranges
    ordered.withColumn("run", F.expr(f"monotonically_increasing_id() div {int(run)}")).write.parquet(f"{at}/events")
    placed = spark.read.schema("key long, at double, event long, run long").parquet(f"{at}/events")
    runs = placed.groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("e"))
    numbers = placed.select("key", "run").distinct().withColumn("round", F.row_number().over(Window.partitionBy("key").orderBy("run")))
    numbers = numbers.select(F.col("key").alias("__key"), F.col("run").alias("__run"), "round")
    runs.join(numbers, F.col("key").eqNullSafe(F.col("__key")) & (F.col("run") == F.col("__run"))).select("key", "round", "e").write.partitionBy("round").parquet(f"{at}/runs")

    def step(s, e):
        refilled = F.when(s["last"].isNull(), s["tokens"]).otherwise(F.least(F.lit(float(cap)), s["tokens"] + F.greatest(e["at"] - s["last"], F.lit(0.0)) * rate))
        ok = refilled >= 1
        return F.struct((refilled - ok.cast("int")).alias("tokens"), e["at"].alias("last"), F.concat(s["out"], F.when(ok, "1").otherwise("0")).alias("out"))

    old = before if before is not None else spark.sql("SELECT 0L AS key, 0D AS tokens, 0D AS last WHERE false")
    state = old
    last_round = numbers.agg(F.max("round")).first()[0] or 0
    event_type = "array<struct<at:double,event:bigint>>"
    done_type = f"key long, e {event_type}, tokens double, last double, out string"
    for i in range(1, last_round + 1):
        known = state.select(F.col("key").alias("__key"), "tokens", "last")
        todo = spark.read.schema(f"key long, e {event_type}").parquet(f"{at}/runs/round={i}").join(known, F.col("key").eqNullSafe(F.col("__key")), "left")
        start = F.struct(F.coalesce("tokens", F.lit(float(min(rate, cap)))).alias("tokens"), F.col("last").alias("last"), F.lit("").alias("out"))
        todo.select("key", "e", F.aggregate("e", start, step).alias("end")).select("key", "e", "end.*").write.parquet(f"{at}/done/round={i}")
        state = spark.read.schema(done_type).parquet(f"{at}/done/round={i}")
    if not last_round:
        return spark.sql("SELECT 0L AS key, 0L AS event, true AS allowed WHERE false"), old
    done = spark.read.schema(f"{done_type}, round int").parquet(f"{at}/done")
    found = done.select("key", F.explode(F.arrays_zip(F.col("e.event").alias("event"), F.split("out", "").alias("ok"))).alias("o"))
    ends = old.select("key", "tokens", "last", F.lit(0).alias("round")).unionByName(done.select("key", "tokens", "last", "round"))
    state = ends.groupBy("key").agg(F.max_by(F.struct("tokens", "last"), "round").alias("s")).select("key", "s.tokens", "s.last")
    return found.select("key", "o.event", (F.col("o.ok") == "1").alias("allowed")), state


def token_bucket(events: DataFrame, key: str, time: str, event: str, rate: float, cap: float, run: int = RUN) -> Batches:
    """(key, event, allowed) of a stream of events: each micro-batch is folded in order of time, from the state that the ones before left.

    The state after a batch lies in the stream's folder under the batch's number.
    """

    def step(batch: DataFrame, number: int, folder: str) -> DataFrame:
        earlier = [n for n in _numbers(batch.sparkSession, folder, "state") if n < number]
        before = batch.sparkSession.read.schema("key long, tokens double, last double").parquet(f"{folder}/state-{max(earlier)}") if earlier else None
        found, after = fold(batch, rate, cap, before, run)
        after.write.mode("overwrite").parquet(f"{folder}/state-{number}")
        return found

    return Batches(_keyed(events, key, time, event), step, StructType.fromDDL("key long, event long, allowed boolean"))


def token_bucket_batch(events: DataFrame, key: str, time: str, event: str, rate: float, cap: float, run: int = RUN) -> DataFrame:
    """The same over a whole table, folded in the engine over each key's events in order."""
    return fold(_keyed(events, key, time, event), rate, cap, run=run)[0]


def expiring(events: DataFrame, time: str, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Pending events per window of `minutes`, which count as expired once the watermark passes the window's end."""
    windows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, f"{minutes} minutes").alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("expired")).select(F.col("w.start").alias("start"), "expired")


def once_per_key(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Repeated requests of a key within the watermark give one row."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The batches of which the folder holds a whole result of this kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(str(f.getPath().getParent().getName()).rpartition("-")[2]) for f in found)


def drained(stream: DataFrame | Batches, name: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows; each micro-batch goes to Parquet in the shared folder.

    folder: where the stream keeps its progress, its results and its state. A stream that failed, or one whose input has
    grown, goes on in the same folder: a batch that is tried again replaces what it had written, so no row is lost or comes
    twice. Without one the stream runs from its start, in a folder of its own.
    """
    work = stream if isinstance(stream, Batches) else Batches(stream, lambda batch, number, at: batch, stream.schema)
    spark, at = work.stream.sparkSession, folder or shared_folder(work.stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        work.step(batch, number, at).write.mode("overwrite").parquet(f"{at}/batch-{number}")

    before = {k: spark.conf.get(k, None) for k in work.settings}
    for k, v in work.settings.items():
        spark.conf.set(k, v)
    try:
        q = work.stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{at}/log").queryName(name).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    try:
        q.awaitTermination()
    finally:
        q.stop()
    done = [f"{at}/batch-{n}" for n in _numbers(spark, at, "batch")]
    return spark.read.schema(work.schema).parquet(*done) if done else spark.createDataFrame([], work.schema)
