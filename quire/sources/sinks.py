"""Rows written and read back: appends, updates as new tables, results by last write, reports and logs.

Files go to the shared folder or a given path; Spark's commit protocol makes a write whole or not at all, also when
executors are lost. A table is changed by writing the changed one, as plain files have no update in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.relational import update_where
from quire.sources.tables import shared_folder


def appended(parts: Sequence[DataFrame], path: str | None = None) -> DataFrame:
    """The table after appending each part in turn."""
    first = parts[0]
    path = path or shared_folder(first.sparkSession)
    for part in parts:
        part.select(*first.columns).write.mode("append").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def insert_select(table: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The table with the rows of source whose key it lacks; one row for a key that source holds more than once."""
    new = source.groupBy(key).agg(F.min(F.struct(*[c for c in table.columns if c != key])).alias("r")).select(key, "r.*")
    return appended([table, new.select(*table.columns).join(table.select(key), key, "left_anti").select(*table.columns)])


def added_to(table: DataFrame, key: str, column: str, events: DataFrame) -> DataFrame:
    """The table with the number of events of each key added to a column."""
    n = events.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return table.join(n, key, "left").withColumn(column, F.col(column) + F.coalesce("__n", F.lit(0))).select(*table.columns)


def update_by_ids(table: DataFrame, key: str, ids: DataFrame, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table with the rows of the ids changed, and how many were (n)."""
    marked = table.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    return update_where(marked, F.col("__hit"), changes).select(*table.columns), marked.agg(F.count_if("__hit").alias("n"))


def restored(table: DataFrame, deleted_at: str, which: Column) -> DataFrame:
    """The table with rows brought back: their time of deletion is null again."""
    return update_where(table, which, {deleted_at: F.lit(None).cast(table.schema[deleted_at].dataType)})


def last_written(log: DataFrame, key: str, at: Sequence[str]) -> DataFrame:
    """Of an append-only log of results the last one of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(key, "r.*")


def job_results(log: DataFrame, updates: DataFrame, key: str, at: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The last result of each job after appending updates, and the updates of jobs that the log does not know, which are faults."""
    known = updates.join(log.select(key).distinct(), key, "left_semi")
    return last_written(appended([log, known.select(*log.columns)]), key, at), updates.join(log.select(key).distinct(), key, "left_anti")


def reports(issues: DataFrame, key: str) -> DataFrame:
    """(key, report): the issues of each subject as JSON, in order."""
    rest = [c for c in issues.columns if c != key]
    return issues.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("report"))


def audit_log(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Appends rows as JSON lines and reads the whole log."""
    path = path or shared_folder(rows.sparkSession)
    rows.write.mode("append").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def json_settings(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Settings in JSON as columns; of a text that is wrapped in `rule_pack` what is inside, null where the text is no object."""
    bare = F.coalesce(F.get_json_object(column, "$.rule_pack"), F.col(column))
    return rows.withColumn("__s", F.from_json(bare, schema)).select(*rows.columns, "__s.*")


def first_known(names: Sequence[str], column: str) -> Column:
    """The first of several spellings of a setting that a JSON text has."""
    return F.coalesce(*[F.get_json_object(column, f"$.{name}") for name in names])


def blocked(events: DataFrame, key: str, at: str, revokes: Column, ttl: str) -> DataFrame:
    """Adds blocked: whether a revocation of the key, no older than ttl, stands before the event.

    The state of a key is the time of its last revocation; older ones are forgotten, as they end no later.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(revokes, F.col(at))).over(w)
    return events.withColumn("blocked", F.coalesce(F.col(at) < last + F.expr(f"INTERVAL {ttl}"), F.lit(False)))


def purged(state: DataFrame, expires: str, now: Column) -> DataFrame:
    """The state without what has expired."""
    return state.filter(F.col(expires) > now)


def template_package(styles: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, manifest): the styles and the block catalogue of a template as one JSON text, in order."""
    listed = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
    return listed(styles, "styles").join(listed(blocks, "blocks"), key, "full_outer").select(key, F.to_json(F.struct("blocks", "styles")).alias("manifest"))


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return shared_folder(spark)
