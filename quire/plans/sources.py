"""Queries over markup, streams and a learned classifier."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import cart, paragraphs
from quire.plans.registry import query
from quire.sources.markup import html_blocks as blocks
from quire.sources.tables import sql, stored, table
from quire.streaming import stateful


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""
SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part
""")
def raw_sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("events", "orders", "part")
    frames = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {{{n}}}" for n in names), **frames)


@query("SELECT * FROM (VALUES ('c_acctbal'), ('c_custkey'), ('c_mktsegment'), ('c_name'), ('c_nationkey')) t(name)")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = f"customer_{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").createOrReplaceTempView(view)
    found = spark.createDataFrame([(c.name,) for c in spark.catalog.listColumns(view)], "name string")
    spark.catalog.dropTempView(view)
    return found


HEADS = """
SELECT i AS id, concat(CASE i % 8 WHEN 0 THEN '504B0304' WHEN 1 THEN 'D0CF11E0' WHEN 2 THEN '25504446' WHEN 3 THEN '7B5C727466' WHEN 4 THEN '3C21444F43' WHEN 5 THEN '3C68746D6C' WHEN 6 THEN '00' ELSE '01020304' END, CASE WHEN i % 3 = 0 THEN '' ELSE '4142' END) AS h FROM (SELECT p_partkey FROM part) AS t(i)
"""


@query(f"""
SELECT id, CASE WHEN length(h) < 8 THEN NULL WHEN h LIKE '504B0304%' THEN 'docx' WHEN h LIKE 'D0CF11E0%' THEN 'doc' WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE '7B5C727466%' THEN 'rtf' WHEN h LIKE '3C21444F43%' OR h LIKE '3C68746D6C%' THEN 'html' ELSE '' END AS kind FROM ({HEADS})
""")
def file_type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, HEADS).select("id", T.sniffed(F.unhex("h")).alias("kind"))


@query(r"SELECT c_custkey AS id, 'Hello ' || c_mktsegment || chr(10) || 'Next' || c_nationkey AS text FROM customer")
def rtf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0\fs24 Hello {\b "), "c_mktsegment", F.lit(r"}\par Next"), F.col("c_nationkey").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), source.alias("s")).select("id", T.rtf_text(F.col("s")).alias("text"))


@query("""
SELECT start, expired FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS expired FROM events WHERE event_type = 'signup' GROUP BY 1)
WHERE start + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events WHERE event_type = 'signup')
""")
def order_expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending events by half-hour window, as a stream; only windows that the watermark has passed appear."""
    still = table(spark, sf_dir, "events")
    events = stateful.event_stream(spark, f"{sf_dir}/events.parquet", still.schema).filter("event_type = 'signup'")
    return stateful.drained(stateful.expiring(events, "ts"), f"expiry_{uuid.uuid4().hex}")


#: DuckDB: a user's events one after the other, each with the tokens that the one before left.
BUCKET = """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS event, epoch_us(ts) / 1e6 AS at_, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS n FROM events),
f AS (SELECT key, event, n, at_, least(1.0::DOUBLE / 86400, 2.0) AS refilled FROM e WHERE n = 1
 UNION ALL SELECT e.key, e.event, e.n, e.at_, least(2.0::DOUBLE, f.refilled - CASE WHEN f.refilled >= 1 THEN 1 ELSE 0 END + greatest(e.at_ - f.at_, 0.0::DOUBLE) * (1.0::DOUBLE / 86400)) FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, event, refilled >= 1 AS allowed FROM f
"""


@query(BUCKET)
def token_bucket_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = table(spark, sf_dir, "events")
    events = stateful.event_stream(spark, f"{sf_dir}/events.parquet", still.schema)
    return stateful.drained(stateful.token_bucket(events, "user_id", "ts", "event_id", 1 / 86_400, 2), f"bucket_{uuid.uuid4().hex}")


@query(BUCKET)
def token_bucket_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.token_bucket_batch(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1 / 86_400, 2)


@query()
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depth-12 tree over the paragraph features, weighted by confidence, with rule labels as truth."""
    lines = paragraphs.paragraphs(table(spark, sf_dir, "documents"), total="lines").withColumns({"font_size_pt": F.when(F.col("idx") == 0, 16.0).otherwise(12.0), "is_bold": F.col("idx") % 7 == 0, "alignment": F.lit("left")})
    found = paragraphs.with_rule_label(paragraphs.with_features(lines, "lines"))
    sample = stored(found.select("doc_id", "idx", "label", F.round(100 * F.col("confidence")).cast("long").alias("weight"), paragraphs.vector().alias("features")))
    return cart.predict(sample, cart.grow(sample, bins=cart.BINS)).select("doc_id", "idx", "label", "predicted")
