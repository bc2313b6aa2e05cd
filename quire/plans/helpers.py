"""Text helpers over generated lines; the SQL that makes the rows is shared by both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.registry import query
from quire.plans.text import RE2
from quire.sources.tables import sql, table

#: A line for each order: every start with every end, some with white space around.
LINES = """
SELECT a.k AS id, concat(CASE WHEN a.i % 4 = 0 THEN '  ' ELSE '' END,
 CASE a.i WHEN 0 THEN '1' WHEN 1 THEN '1.2' WHEN 2 THEN '2.3.4' WHEN 3 THEN '12' WHEN 4 THEN '3.' WHEN 5 THEN '一、' WHEN 6 THEN '（二）' WHEN 7 THEN '(3)' WHEN 8 THEN '（4）' WHEN 9 THEN '[5]'
  WHEN 10 THEN '摘要' WHEN 11 THEN '摘要：' WHEN 12 THEN '摘要；；' WHEN 13 THEN '2024年 3 月' WHEN 14 THEN '1.4.2' WHEN 15 THEN '1.1' WHEN 16 THEN 'a 4' WHEN 17 THEN '20' WHEN 18 THEN '1.2.3.4' WHEN 19 THEN '摘 要' ELSE '' END,
 CASE b.i WHEN 0 THEN '绪论' WHEN 1 THEN ' Introduction' WHEN 2 THEN '国内外研究现状：12' WHEN 3 THEN '国外研究现状' WHEN 4 THEN '国内现状 7' WHEN 5 THEN '结论/总结' WHEN 6 THEN 'Text' WHEN 7 THEN '方法与结果的分析9' WHEN 8 THEN '' WHEN 9 THEN '日'
  WHEN 10 THEN '丐丑专且丕世丘丙业丛东丝' WHEN 11 THEN '研究。abc' WHEN 12 THEN '的数据处理方法研究分析abcdefghij0123数据处理方法研究分析' WHEN 13 THEN ' 5 x' WHEN 14 THEN '.5' WHEN 15 THEN '万' WHEN 16 THEN ':内容' WHEN 17 THEN '附录' WHEN 18 THEN ' Reference A. 2021' ELSE '7Seven' END) AS s
FROM (SELECT o_orderkey AS k, o_orderkey % 21 AS i FROM orders) AS a JOIN (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 21) AS BIGINT) % 20 AS i FROM orders) AS b ON a.k = b.k
"""
TRIM = f"regexp_replace(s, '^[{RE2}]+|[{RE2}]+$', '', 'g')"


def _count(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LINES)


@query(rf"""
WITH l AS (SELECT *, {TRIM} AS t FROM ({LINES}))
SELECT id, CASE WHEN regexp_matches(t, '^\d+') THEN len(string_split(regexp_extract(t, '^\d+(?:\.\d+){{0,3}}'), '.')) ELSE 0 END AS science,
 CASE WHEN regexp_matches(t, '^[一二三四五六七八九十]+、') THEN 1 WHEN regexp_matches(t, '^(（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\))') THEN 2 WHEN regexp_matches(t, '^\d+\.') THEN 3 WHEN regexp_matches(t, '^(（\d+）|\(\d+\))') THEN 4 ELSE 0 END AS arts,
 regexp_replace(s, '(^|[ \t\n\r])([1-9]|[1-9][0-9]*(?:\.[0-9]*)?\.[0-9]+)([^0-9. \t\n\r])', '\1\2 \3', 'g') AS spaced,
 CASE WHEN t = '摘要' THEN '' WHEN regexp_matches(t, '^摘要[：:]') THEN trim(substr(t, 4)) WHEN regexp_matches(t, '^摘要[；;]') THEN trim(regexp_replace(t, '^摘要[；;]+', '')) END AS after_marker FROM l
""")
def heading_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _lines(spark, sf_dir).select("id", T.science_depth(s).alias("science"), T.arts_depth(s).alias("arts"), T.spaced_heading_numbers(s).alias("spaced"), T.after_marker(s, "摘要").alias("after_marker"))


@query(rf"""
WITH l AS (SELECT *, {TRIM} AS t FROM ({LINES})), m AS (SELECT *, regexp_extract(t, '^([1-9]|1[0-9]|20)([\p{{Han}}A-Za-z].*?)(\d*)$', ['n', 'title', 'page']) AS p FROM l)
SELECT id, CASE WHEN regexp_matches(t, '^\d{{4}}年\s*\d{{1,2}}\s*月') THEN regexp_replace(regexp_extract(t, '^\d{{4}}年\s*\d{{1,2}}\s*月'), '\s', '', 'g')
 WHEN regexp_matches(t, '^\d+\.\d+\s*国内外研究现状[：:]?\s*\d*$') THEN '1.4 国内外研究现状' || coalesce(' ' || nullif(regexp_extract(t, '\d*$'), ''), '')
 WHEN regexp_matches(t, '^\d+\.\d+\.\d+\s*国外研究现状[：:]?\s*\d*$') THEN '1.4.1 国外研究现状' || coalesce(' ' || nullif(regexp_extract(t, '\d*$'), ''), '')
 WHEN regexp_matches(t, '^\d+\.\d+\.\d+\s*国内(研究)?现状[：:]?\s*\d*$') THEN '1.4.2 国内研究现状' || coalesce(' ' || nullif(regexp_extract(t, '\d*$'), ''), '')
 WHEN contains(t, '结论/总结') THEN replace(t, '结论/总结', '结论')
 WHEN regexp_matches(t, '^\d+(\.\d+)+[\p{{Han}}A-Za-z]') THEN regexp_replace(t, '^(\d+(?:\.\d+)+)([\p{{Han}}A-Za-z])', '\1 \2')
 WHEN p.title <> '' AND length(trim(p.title)) <= 30 AND regexp_matches(p.title, '绪论|引言|研究|对象|方法|结果|分析|结论|总结|参考文献|致谢') THEN p.n || ' ' || trim(p.title) || coalesce(' ' || nullif(p.page, ''), '')
 ELSE s END AS text FROM m
""")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.visible_text(F.col("s")).alias("text"))


GARBAGE = rf"""n >= 3 AND ((rare * 2 > n AND marks = 0) OR (n > 30 AND marks = 0 AND rare + common > floor(n / 2) AND plain > floor(n / 4)) OR (n > 10 AND rare > 5 AND common < floor(rare / 2)))"""
COUNTED = rf"""
SELECT *, length(t) AS n, {_count('[\\x{4E00}-\\x{4FFF}\\x{9001}-\\x{9FFF}]')} AS rare, {_count('[\\x{5000}-\\x{9000}]')} AS common, {_count('[，。、：；“”（）《》]')} AS marks, {_count('[A-Za-z0-9]')} AS plain FROM (SELECT *, {TRIM} AS t FROM ({LINES}))
"""


@query(rf"""
SELECT CAST(floor(id / 7) AS BIGINT) AS doc, coalesce(string_agg(t, chr(10) ORDER BY id) FILTER (n >= 2 AND NOT ({GARBAGE})), '') AS text, count(*) FILTER ({GARBAGE}) AS garbage FROM ({COUNTED}) GROUP BY 1
""")
def line_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("doc", F.floor(F.col("id") / 7))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"]), "\n").alias("whole")
    return lines.groupBy("doc").agg(whole, F.count_if(T.is_garbage(T.uni_trim(F.col("s")))).alias("garbage")).select("doc", T.cleaned_lines(F.col("whole")).alias("text"), "garbage")


@query(r"""
WITH k AS (SELECT doc_id, regexp_replace(text, '[^\x20-\x7E\x{4E00}-\x{9FFF}\n\r]', '', 'g') AS kept FROM documents) SELECT doc_id, CASE WHEN strlen(kept) >= 10 THEN md5(kept) END AS digest FROM k
""")
def fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fallback_text(F.col("text"))).alias("digest"))


#: Eighty documents of eight lines each: which lines stand where depends on the document.
SECTIONS = """
SELECT d.i AS doc, k.i AS line, CASE (d.i * 3 + k.i * (1 + d.i % 5)) % 11 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'abstract of all' WHEN 2 THEN 'Keywords: a' WHEN 3 THEN '参考文献' WHEN 4 THEN '[1] one' WHEN 5 THEN '2. two' WHEN 6 THEN '无' WHEN 7 THEN 'Zeta 2020' WHEN 8 THEN '致谢' WHEN 9 THEN '' ELSE ' 目录' END AS text
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(8) AS k(i)
"""


@query(rf"""
WITH l AS (SELECT *, trim(lower(text)) AS low FROM ({SECTIONS})),
s AS (SELECT doc, min(line) FILTER (low = 'abstract' OR low LIKE 'abstract %') AS a, min(line) FILTER (low LIKE '参考文献%') AS r FROM l GROUP BY doc),
e AS (SELECT doc, a, r, min(line) FILTER (line > a AND (low LIKE 'keywords%' OR low LIKE '目录%')) AS a_end, min(line) FILTER (line > r AND (low LIKE '附录%' OR low LIKE '致谢%' OR low LIKE '攻读%' OR low LIKE '声明%')) AS r_end FROM l JOIN s USING (doc) GROUP BY ALL)
SELECT doc, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (line > a AND line < coalesce(a_end, 99)), '') AS section,
 coalesce(string_agg(trim(text), '|' ORDER BY line) FILTER (line > r AND line < coalesce(r_end, 99) AND regexp_matches(trim(text), '^(\[\d+\]|\d+\.)|[A-Za-z]')), '') AS refs FROM l JOIN e USING (doc) GROUP BY doc
""")
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("s")
    docs = sql(spark, sf_dir, SECTIONS).groupBy("doc").agg(whole)
    return docs.select("doc", T.section_by_heading(F.col("s"), ["abstract"], ["keywords", "目录"]).alias("section"), F.array_join(T.reference_lines(F.col("s")), "|").alias("refs"))


SIZES = """
SELECT id, concat(CASE WHEN id % 3 = 0 THEN '小' ELSE '' END, CASE CAST(floor(id / 3) AS INT) % 9 WHEN 0 THEN '初' WHEN 1 THEN '一' WHEN 2 THEN '二' WHEN 3 THEN '三' WHEN 4 THEN '四' WHEN 5 THEN '五' WHEN 6 THEN '六' WHEN 7 THEN '七' ELSE '八' END, CASE WHEN id % 2 = 0 THEN '号' ELSE '' END) AS s FROM (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) AS t(id)
UNION ALL SELECT id, concat(CAST(id % 13 AS STRING), CASE id % 4 WHEN 0 THEN 'pt' WHEN 1 THEN '磅' WHEN 2 THEN '' ELSE 'px' END) FROM (SELECT p_partkey FROM part WHERE p_partkey % 2 = 1) AS t(id)
"""


@query(f"""
WITH m(s, v) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in T.FONT_SIZES.items())}), n AS (SELECT id, regexp_replace(s, '号$', '') AS s FROM ({SIZES}))
SELECT id, CAST(coalesce(v, nullif(greatest(TRY_CAST(regexp_replace(n.s, '(pt|磅)$', '') AS DOUBLE), 0), 0), 12) AS DOUBLE) AS points FROM n LEFT JOIN m ON m.s = n.s
""")
def font_size_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SIZES).select("id", T.font_points(F.col("s")).alias("points"))


@query(r"""
WITH l AS (SELECT p_partkey AS id, p_size % 8 AS n, CASE p_size % 5 WHEN 0 THEN '2.54' WHEN 1 THEN '2.54c' WHEN 2 THEN CAST(p_size AS VARCHAR) || 'c' WHEN 3 THEN CAST(p_size AS VARCHAR) || 'cm' ELSE 'c' END AS u FROM part)
SELECT id, CASE WHEN u = '2.54' THEN '2.54cm' WHEN regexp_matches(u, '^\d+(\.\d+)?c$') THEN u || 'm' ELSE u END AS unit, coalesce(['一', '二', '三', '四', '五'][n], CAST(n AS VARCHAR)) AS numeral FROM l
""")
def units_and_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    unit = F.when(size % 5 == 0, "2.54").when(size % 5 == 1, "2.54c").when(size % 5 == 2, F.concat(size.cast("string"), F.lit("c"))).when(size % 5 == 3, F.concat(size.cast("string"), F.lit("cm"))).otherwise("c")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.repaired_unit(unit).alias("unit"), T.chinese_number(size % 8).alias("numeral"))


@query("""
WITH w AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) % 9) AS i, CAST(l_quantity AS BIGINT) % 9 AS x FROM lineitem), t AS (SELECT k, sum(x) AS total, max(i) AS last FROM w GROUP BY k),
s AS (SELECT k, i, last, total, CASE WHEN i < last THEN greatest(CAST(floor(x * 100.0 / nullif(total, 0) + 0.5) AS BIGINT), 1) END AS scaled FROM w JOIN t USING (k))
SELECT k, string_agg(CAST(CASE WHEN total = 0 THEN 0 WHEN i = last THEN 100 - coalesce(rest, 0) ELSE scaled END AS VARCHAR), ',' ORDER BY i) AS widths FROM (SELECT *, sum(scaled) OVER (PARTITION BY k) AS rest FROM s) GROUP BY k
""")
def scaled_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", (F.col("l_quantity").cast("long") % 9).alias("x")).alias("w"))
    widths = T.scaled_widths(F.col("w.x"), F.lit(100).cast("long"))
    return lines.groupBy("k").agg(F.array_sort(F.collect_list("w")).alias("w")).select("k", F.array_join(F.transform(widths, lambda x: x.cast("string")), ",").alias("widths"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN '******' WHEN c_nationkey % 3 = 1 AND c_custkey % 2 = 1 THEN '******' ELSE c_name END AS shown,
 coalesce(CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END >= CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END, false) AS allowed FROM customer
""")
def secrets_and_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.get(F.array(*map(F.lit, ("alipay", "wechat", "other"))), F.col("c_nationkey") % 3)
    key = F.get(F.array(F.lit("private_key"), F.lit("api_key")), (F.col("c_custkey") % 2).cast("int"))
    shown = T.masked_settings(provider, F.create_map(key, F.col("c_name")))
    level = lambda c: F.get(F.array(*map(F.lit, ("read", "write", "admin", "odd"))), (F.col(c) % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(F.map_values(shown), 0).alias("shown"), T.level_allows(level("c_nationkey"), level("c_custkey")).alias("allowed"))


@query("""
WITH q AS (SELECT o_orderkey, round((o_orderkey % 11) / 10 * 0.35 + (o_orderkey % 7) / 6 * 0.30 + (o_orderkey % 3) / 2 * 0.20 + (o_orderkey % 2) * 0.15, 4) AS score FROM (SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders))
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, score, CASE WHEN score >= 0.98 THEN 'high' ELSE 'review' END AS grade FROM q
""")
def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = T.parse_quality((k % 11) / 10, (k % 7) / 6, (k % 3) / 2, (k % 2).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("q")).select("o_orderkey", "q.*")


@query("SELECT l_orderkey, string_agg(CAST(mode AS VARCHAR), ',' ORDER BY first) AS modes FROM (SELECT l_orderkey, l_linestatus AS mode, min(i) AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus) AS i FROM lineitem) GROUP BY ALL) GROUP BY l_orderkey")
def distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus"))), lambda x: x["l_linestatus"])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(listed), ",").alias("modes"))


@query("SELECT l_orderkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS suppliers FROM (SELECT l_orderkey, l_suppkey AS v FROM lineitem UNION SELECT o_orderkey, 7 FROM orders) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY l_orderkey")
def added_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value is added to a list unless it is there."""
    listed = F.array_union(F.collect_set("l_suppkey"), F.array(F.lit(7).cast("long")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(listed), lambda x: x.cast("string")), ",").alias("suppliers"))
