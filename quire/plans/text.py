"""Text queries over documents, pages and written-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.registry import query
from quire.sources.tables import dealt, sql, table

#: The class of Unicode white space in RE2 spelling, for the SQL.
RE2 = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SAMPLES = dealt("(1, '  　摘要：研究  '), (2, 'Hello  World\t\tagain'), (3, ''), (4, '毕业设计 thesis 中文 words 12'), (5, 'a\n\n\n\nb')", "id, s", "documents", "doc_id")


@query(f"""
SELECT id, regexp_replace(s, '^[{RE2}]+|[{RE2}]+$', '', 'g') AS trimmed, regexp_replace(s, '[{RE2}]+', '', 'g') AS squeezed,
 length(regexp_replace(s, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS han, length(regexp_replace(s, '\\P{{Han}}', '', 'g')) AS han_b,
 len(regexp_extract_all(s, '[^\\x00-\\x7F{RE2}]')) AS wide, len(regexp_extract_all(s, '[A-Za-z]+')) AS ascii_words,
 len(regexp_extract_all(s, '[A-Za-z]')) > len(regexp_extract_all(s, '[^\\x00-\\x7F{RE2}]')) AS is_foreign
FROM ({SAMPLES}) t
""")
def unicode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return sql(spark, sf_dir, SAMPLES).select(
        "id", T.uni_trim(s).alias("trimmed"), T.squeezed(s).alias("squeezed"), T.han_block_count(s).alias("han"), T.han_count(s).alias("han_b"),
        T.wide_count(s).alias("wide"), T.ascii_words(s).alias("ascii_words"), T.is_foreign(s).alias("is_foreign"),
    )


@query(f"""
SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, len(regexp_extract_all(text, '[^{RE2}]+')) AS words,
 length(text) - length(replace(text, chr(10), '')) + 1 AS paragraphs, len(regexp_extract_all(text, '[A-Za-z]+')) AS ascii_words FROM documents
""")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).alias("bytes"), F.length(text).alias("chars"), T.words(text).alias("words"), F.size(F.split(text, "\n")).alias("paragraphs"), T.ascii_words(text).alias("ascii_words")
    )


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
SELECT page_id, regexp_replace(regexp_replace(h, '[{RE2}]+', ' ', 'g'), '^[{RE2}]+|[{RE2}]+$', '', 'g') AS text FROM c
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""
WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 6000.0) AS BIGINT) AS n FROM documents)
SELECT doc_id, i AS idx, length(substr(text, 6000 * i + 1, 6000)) AS chars, md5(substr(text, 6000 * i + 1, 6000)) AS digest FROM (SELECT doc_id, text, unnest(range(n)) AS i FROM n)
""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("idx", "c"))
    return each.select("doc_id", "idx", F.length("c").alias("chars"), F.md5("c").alias("digest"))


HEADINGS = dealt("(1, '1.2.3 Deep'), (2, '(1) short'), (3, '(1) a much longer remainder than twenty'), (4, '2.1 Second'), (5, '3. Third'), (6, '第一章 绪论'), (7, '一、引言'), (8, '（二）方法'), (9, '4 Fourth'), (10, '1998 2000'), (11, 'plain')", "id, s", "documents", "doc_id")


@query(rf"""
SELECT id, CASE WHEN regexp_matches(s, '^\d+\.\d+\.\d+') THEN 3
 WHEN regexp_matches(s, '^[(（]\d+[)）]') THEN CASE WHEN length(regexp_replace(s, '^[(（]\d+[)）]', '')) <= 20 THEN 3 ELSE 0 END
 WHEN regexp_matches(s, '^\d+\.\d+|^[(（][一二三四五六七八九十]+[)）]') THEN 2
 WHEN regexp_matches(s, '^([一二三四五六七八九十]+|\d+)[、.]|^第[一二三四五六七八九十\d]+[章节]|^\d+ +[^\d ]') THEN 1 ELSE 0 END AS level
FROM ({HEADINGS}) t
""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, HEADINGS).select("id", T.heading_level(F.col("s")).alias("level"))


CAPTIONS = dealt("(1, 'Figure 3 Result'), (2, 'Table 2-4 Data'), (3, 'Figure 1.2 Map'), (4, '图 5 结构'), (5, '表2.1 数据'), (6, 'none'), (7, 'Figure'), (8, 'Figure 12345678901'), (9, 'Table 99999999999-2')", "id, s", "documents", "doc_id")


@query(rf"""
WITH p AS (SELECT id, regexp_extract(s, '^(图|表|Figure|Table) *(?:(\d+)([.-]))?(\d+)', ['label', 'chapter', 'mark', 'n']) AS p FROM ({CAPTIONS}) t)
SELECT id, p.label AS label, CASE p.mark WHEN '.' THEN 'chapter_dot' WHEN '-' THEN 'chapter_hyphen' ELSE 'simple' END AS format,
 coalesce(TRY_CAST(p.chapter AS INT), -1) AS chapter, TRY_CAST(p.n AS INT) AS ordinal FROM p WHERE p.label <> ''
""")
def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CAPTIONS).select("id", T.caption(F.col("s")).alias("c")).filter("c IS NOT NULL").select("id", "c.*").fillna(-1, ["chapter"])


PAIRS = dealt("(1, '题目：基于 Spark'), (2, 'Name: Ann: B'), (3, 'empty:'), (4, 'none'), (5, '：x')", "id, s", "documents", "doc_id")


@query(rf"""
WITH c AS (SELECT id, s, CASE WHEN contains(s, '：') THEN '：' ELSE ':' END AS m FROM ({PAIRS}) t),
k AS (SELECT id, trim(substr(s, 1, strpos(s, m) - 1)) AS k, trim(substr(s, strpos(s, m) + 1)) AS v, strpos(s, m) AS place FROM c)
SELECT id, k AS "key", v AS "value" FROM k WHERE place > 0 AND k <> '' AND v <> ''
""")
def key_value_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PAIRS).select("id", T.key_value(F.col("s")).alias("p")).filter("p IS NOT NULL").select("id", "p.*")


LISTS = dealt("(1, '模型，数据；训练'), (2, 'a, b;;c ,'), (3, '')", "id, s", "documents", "doc_id")


@query(f"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(s, '[，、；;,]'), lambda k: trim(k)), lambda k: k <> ''), '|') AS keywords FROM ({LISTS}) t")
def keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LISTS).select("id", F.array_join(T.keywords(F.col("s")), "|").alias("keywords"))


@query("""
WITH n AS (SELECT p_partkey AS id, (p_size * 83 + p_partkey) % 4000 AS n FROM part)
SELECT id, ['', 'M', 'MM', 'MMM'][CAST(floor(n / 1000) AS INT) + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][CAST(floor(n / 100) AS INT) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][CAST(floor(n / 10) AS INT) % 10 + 1]
 || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman FROM n
""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_size") * 83 + F.col("p_partkey")) % 4000
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.roman(n).alias("roman"))


CODES = dealt("(1, 'ab-cd 1234', 'a/b:c.docx', 'ABCDEF+Times New-Roman'), (2, 'short', 'fine.txt', 'Sim_Sun')", "id, c, f, n", "documents", "doc_id")


@query(rf"""
SELECT id, sha256(upper(regexp_replace(c, '[- ]', '', 'g'))) AS hashed, CASE WHEN length(c) < 9 THEN c ELSE left(c, 4) || '-****-' || right(c, 4) END AS masked,
 regexp_replace(f, '[<>:"/\\|?*]', '_', 'g') AS file, regexp_replace(regexp_replace(lower(n), '^[^+]*\+', ''), '[ _-]', '', 'g') AS font FROM ({CODES}) t
""")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sql(spark, sf_dir, CODES)
    return found.select("id", T.code_hash(F.col("c")).alias("hashed"), T.masked_code(F.col("c")).alias("masked"), T.safe_filename(F.col("f")).alias("file"), T.font_key(F.col("n")).alias("font"))


SPACINGS = """
SELECT i AS id, CASE i % 8 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN '1.5' WHEN 3 THEN concat(CAST(i % 4 AS STRING), '.25倍') WHEN 4 THEN concat(CAST(i AS STRING), '磅') WHEN 5 THEN concat('fixed ', CAST(i AS STRING), 'pt') WHEN 6 THEN CAST(i AS STRING) ELSE 'odd' END AS s FROM (SELECT p_partkey FROM part) AS t(i)
"""


@query(rf"""
WITH n AS (SELECT id, s, TRY_CAST(regexp_extract(s, '\d+(\.\d+)?') AS DOUBLE) AS n FROM ({SPACINGS}))
SELECT id, CAST(CASE s WHEN 'single' THEN 240 WHEN '1.5' THEN 360 WHEN 'double' THEN 480 ELSE CASE WHEN s LIKE '%倍' THEN n * 240 WHEN regexp_matches(s, '(磅|pt)$') THEN n * 20 WHEN regexp_matches(s, '^\d') THEN CASE WHEN n <= 10 THEN n * 240 ELSE n END ELSE 0 END END AS DOUBLE) AS twips FROM n
""")
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SPACINGS).select("id", T.line_twips(F.col("s")).alias("twips"))


@query("""
SELECT p_partkey, CAST(floor(p_size * 567 + 0.5) AS BIGINT) AS twips, CAST(trunc(p_size * 36000.0) AS BIGINT) AS emu, round(p_size * 2.83465::DOUBLE, 2) AS points, round(p_size / 25.4::DOUBLE, 4) AS inches FROM part
""")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    mm = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.twips(mm).alias("twips"), (mm * 36000).cast("long").alias("emu"), F.round(mm * F.lit(2.83465), 2).alias("points"), F.round(mm / F.lit(25.4), 4).alias("inches"))


REQUESTS = dealt("(1, 'record:read', 'read', 'record', 'GET'), (2, 'record:update', 'update', 'record', 'GET'), (3, '*:*', '*', 'cms', 'DELETE'), (4, 'user:delete', 'delete', 'user', 'DELETE'), (5, 'user:x', 'x', 'user', 'GET')", "id, code, method, resource, verb", "documents", "doc_id")


@query(f"""
SELECT id, (split_part(code, ':', 1) IN ('*', resource)) AND (method = '*' OR coalesce(CASE method WHEN 'read' THEN 'GET' WHEN 'create' THEN 'POST' WHEN 'update' THEN 'PUT' WHEN 'delete' THEN 'DELETE' END = verb, false)) AS ok
FROM ({REQUESTS}) t
""")
def permission_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = sql(spark, sf_dir, REQUESTS)
    return asked.select("id", F.coalesce(T.permitted(*[F.col(c) for c in ("code", "method", "resource", "verb")]), F.lit(False)).alias("ok"))


REPLIES = dealt("(1, 'noise [1,2] end]'), (2, 'none'), (3, '[{\"a\":1}]')", "id, s", "documents", "doc_id")


@query(rf"SELECT id, CASE WHEN regexp_matches(s, '(?s)\[.*\]') THEN regexp_extract(s, '(?s)\[.*\]') ELSE s END AS part FROM ({REPLIES}) t")
def json_array_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, REPLIES).select("id", T.json_array_part(F.col("s")).alias("part"))


TITLES = """
SELECT i AS id, concat(CASE i % 5 WHEN 0 THEN 'the' WHEN 1 THEN 'pH' WHEN 2 THEN 'DNA' WHEN 3 THEN 'state-of-art' ELSE 'SPARK2' END, ' ', CASE i % 7 WHEN 0 THEN 'effect' WHEN 1 THEN 'A' WHEN 2 THEN 'oF' WHEN 3 THEN 'x' WHEN 4 THEN 'well-Known' WHEN 5 THEN 'ON' ELSE 'data' END) AS s FROM (SELECT p_partkey FROM part) AS t(i)
"""


@query(rf"""
SELECT id, array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN contains(w, '-') OR w = 'pH' OR regexp_matches(w, '^[A-Z]{{2,}}$') THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ') AS title FROM ({TITLES})
""")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TITLES).select("id", T.title_case(F.col("s")).alias("title"))
