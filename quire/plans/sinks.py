"""Queries that write and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.documents import ISSUES, found_issues
from quire.plans.registry import query
from quire.sources import sinks as S
from quire.sources.tables import sql, table


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey FROM customer WHERE c_nationkey >= 8")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return S.appended([customers.filter("c_nationkey < 10"), customers.filter("c_nationkey >= 8").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)])


@query("""
WITH t AS (SELECT c_nationkey AS id, min(c_mktsegment) AS code FROM customer WHERE c_nationkey % 3 = 0 GROUP BY c_nationkey)
SELECT * FROM t UNION ALL SELECT s_nationkey, min(coalesce(nullif(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, ''), 'none')) FROM supplier WHERE s_nationkey NOT IN (SELECT id FROM t) GROUP BY s_nationkey
""")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "customer").filter("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("id")).agg(F.min("c_mktsegment").alias("code"))
    name = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name"))
    source = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.coalesce(F.nullif(name, F.lit("")), F.lit("none")).alias("code"))
    return S.insert_select(now, source, "id")


@query("SELECT c_custkey, c_nationkey + count(o_orderkey) AS used FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey, c_nationkey")
def arithmetic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("used"))
    grants = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return S.added_to(codes, "c_custkey", "used", grants)


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN 'closed' ELSE o_orderstatus END AS status FROM orders")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    ids = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return S.update_by_ids(orders, "o_custkey", ids, {"status": F.lit("closed")})[0].select("o_orderkey", "status")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 1 THEN CAST(l_shipdate AS VARCHAR) END AS deleted_at FROM lineitem")
def restored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("deleted_at", F.when(F.col("l_returnflag") == "R", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")))
    return S.restored(lines, "deleted_at", F.col("l_suppkey") % 2 == 0).select("l_orderkey", "l_linenumber", "deleted_at")


@query("""
WITH u AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 1 AND user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0))
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM u GROUP BY user_id
""")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.job_results(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), "user_id", ["event_id"])[0]


@query(f"WITH {ISSUES} SELECT doc_id, md5(CAST(to_json(list({{'kind': kind, 'severity': severity, 'target': target}} ORDER BY kind, severity, target)) AS VARCHAR)) AS digest FROM i GROUP BY doc_id")
def check_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reports(found_issues(spark, sf_dir), "doc_id").select("doc_id", F.md5("report").alias("digest"))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = S.folder(spark)
    S.audit_log(events.filter("event_id % 3 = 0"), path)
    return S.audit_log(events.filter("event_id % 3 > 0"), path).withColumn("value", F.round("value", 6))


@query("""
WITH r AS (SELECT user_id, ts, event_id, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS last FROM events)
SELECT event_id, coalesce(ts < last + INTERVAL 2 DAY, false) AS blocked FROM r
""")
def revoked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocked(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", "2 DAY").select("event_id", "blocked")


@query("WITH n AS (SELECT max(ts) - INTERVAL 10 DAY AS now FROM events) SELECT event_id FROM events, n WHERE event_type = 'error' AND ts + INTERVAL 2 DAY > now")
def purged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts").alias("m")).first()["m"]) - F.expr("INTERVAL 10 DAY")
    state = events.filter("event_type = 'error'").withColumn("expires", F.col("ts") + F.expr("INTERVAL 2 DAY"))
    return S.purged(state, "expires", now).select("event_id")


#: Settings in three dialects, some in a wrapper, some broken.
SETTINGS = """
SELECT i AS id, CASE i % 6 WHEN 0 THEN concat('{"rule_pack": {"font": "Sim", "size": ', CAST(i % 20 AS STRING), '}}') WHEN 1 THEN concat('{"font": "Kai", "size": ', CAST(i % 9 AS STRING), '}') WHEN 2 THEN '{"字体": "宋体", "字号": "小四"}'
 WHEN 3 THEN '{"fontName": "Times", "fontSize": "12"}' WHEN 4 THEN 'no json' ELSE '{}' END AS s FROM (SELECT c_custkey FROM customer) AS t(i)
"""


@query(f"""
WITH b AS (SELECT id, CASE WHEN json_valid(s) THEN coalesce(json_extract(s, '$.rule_pack'), CAST(s AS JSON)) END AS s FROM ({SETTINGS})) SELECT id, json_extract_string(s, '$.font') AS font, TRY_CAST(json_extract_string(s, '$.size') AS INT) AS size FROM b
""")
def json_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.json_settings(sql(spark, sf_dir, SETTINGS), "s", "font string, size int").select("id", "font", "size")


@query(f"""
WITH b AS (SELECT id, CASE WHEN json_valid(s) THEN s END AS s FROM ({SETTINGS}))
SELECT id, coalesce(json_extract_string(s, '$.font'), json_extract_string(s, '$.字体'), json_extract_string(s, '$.fontName')) AS font, coalesce(json_extract_string(s, '$.size'), json_extract_string(s, '$.字号'), json_extract_string(s, '$.fontSize')) AS size FROM b
""")
def standard_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SETTINGS).select("id", S.first_known(("font", "字体", "fontName"), "s").alias("font"), S.first_known(("size", "字号", "fontSize"), "s").alias("size"))


@query("""
WITH s AS (SELECT p_brand AS k, list({'name': p_type, 'size': n} ORDER BY p_type, n) AS l FROM (SELECT p_brand, p_type, max(p_size) AS n FROM part WHERE p_size > 10 GROUP BY ALL) GROUP BY p_brand),
b AS (SELECT p_brand AS k, list({'seq': i, 'kind': p_type} ORDER BY i) AS l FROM (SELECT p_brand, p_type, min(p_partkey) AS i FROM part WHERE p_size < 30 GROUP BY ALL) GROUP BY p_brand)
SELECT k, md5(concat('{', concat_ws(',', '"blocks":' || CAST(to_json(b.l) AS VARCHAR), '"styles":' || CAST(to_json(s.l) AS VARCHAR)), '}')) AS digest FROM s FULL JOIN b USING (k)
""")
def template_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("k", F.col("p_brand"))
    styles = parts.filter("p_size > 10").groupBy("k", F.col("p_type").alias("name")).agg(F.max("p_size").alias("size"))
    blocks = parts.filter("p_size < 30").groupBy("k", F.col("p_type").alias("kind")).agg(F.min("p_partkey").alias("seq")).select("k", "seq", "kind")
    return S.template_package(styles, blocks, "k").select("k", F.md5("manifest").alias("digest"))
