"""Rule-pack queries over tables, and over rows that both engines generate from the same SQL, as the tables hold no packages or layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import rulepack
from quire.plans.documents import LINES
from quire.plans.registry import query
from quire.plans.rendered import GOLDEN
from quire.plans.text import RE2
from quire.sources.tables import sql, table

PRESENT = "SELECT d.i AS doc_id, CASE (d.i + s.i) % 5 WHEN 0 THEN 'cover' WHEN 1 THEN 'body' WHEN 2 THEN 'toc' ELSE 'references' END AS section FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(3) AS s(i)"


@query(f"SELECT doc_id, 'section_missing' AS kind, 'repairable' AS severity, s AS target FROM (SELECT DISTINCT doc_id FROM ({PRESENT})) d CROSS JOIN (VALUES ('cover'), ('body'), ('references'), ('odd')) w(s) WHERE (doc_id, s) NOT IN ({PRESENT})")
def required_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = sql(spark, sf_dir, PRESENT)
    return rulepack.required_sections(present, present, ("cover", "body", "references", "odd"))


FIELDS = """
SELECT d.i AS doc_id, k.i AS idx, concat(CASE (d.i + k.i) % 4 WHEN 0 THEN 'Name' WHEN 1 THEN 'Major' WHEN 2 THEN 'Names' ELSE 'Title' END, CASE d.i % 3 WHEN 0 THEN ': ' WHEN 1 THEN '：' ELSE ' ' END, CASE (d.i * 3 + k.i) % 7 WHEN 0 THEN '' WHEN 1 THEN '____' WHEN 2 THEN 'XX' WHEN 3 THEN '待填' WHEN 4 THEN '...' WHEN 5 THEN 'Ann' ELSE 'Xa' END) AS text
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(3) AS k(i)
"""


@query(rf"""
WITH l AS ({FIELDS}), w(label) AS (VALUES ('Name'), ('Major'))
SELECT doc_id, 'field_missing' AS kind, 'repairable' AS severity, label AS target FROM (SELECT DISTINCT doc_id FROM l) d CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, trim(regexp_replace(substr(text, length(label) + 1), '^[:：]', '')) AS rest FROM l, w WHERE starts_with(text, label)) r
 WHERE r.doc_id = d.doc_id AND r.label = w.label AND rest <> '' AND NOT regexp_matches(rest, '^(_+|…+|\.{{3,}}|X+|x+|待填|请填写)$'))
""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.required_fields(sql(spark, sf_dir, FIELDS), ("Name", "Major"))


@query(rf"""
SELECT doc_id, 'title_too_long' AS kind, 'repairable' AS severity, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS VARCHAR) AS target FROM ({LINES}) WHERE idx = 0 AND len(regexp_extract_all(text, '[A-Za-z]+')) > 12
UNION ALL SELECT doc_id, 'body_too_short', 'repairable', CAST(len(regexp_extract_all(text, '[^\x00-\x7F{RE2}]')) AS VARCHAR) FROM documents WHERE len(regexp_extract_all(text, '[^\x00-\x7F{RE2}]')) < 20
""")
def length_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"))
    return rulepack.lengths(docs, title_cn=20, title_en=12, least_body=20)


REFERENCES = """
SELECT d.i AS doc_id, k.i AS idx, concat(CASE (d.i + k.i) % 5 WHEN 0 THEN '' ELSE concat('[', CAST(k.i + 1 AS STRING), '] ') END, CASE d.i % 3 WHEN 0 THEN '王五. 题目' ELSE 'Ann B. A title' END, CASE (d.i * 2 + k.i) % 4 WHEN 0 THEN '' ELSE '. Press, ' END, CAST(2012 + (d.i * 7 + k.i * 5) % 14 AS STRING), CASE k.i % 3 WHEN 0 THEN '[J]' WHEN 1 THEN '[EB/OL]' ELSE '' END) AS text
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(6) AS k(i) WHERE k.i < 1 + d.i % 6
"""


@query(rf"""
WITH l AS (SELECT *, CAST(nullif(regexp_extract(text, '20[2-3]\d'), '') AS INT) AS year, len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[^\x00-\x7F{RE2}]')) AS alien FROM ({REFERENCES})),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (alien) / count(*) AS alien, count(*) FILTER (year >= 2020) / count(*) AS recent FROM l GROUP BY doc_id)
SELECT doc_id, 'reference_shape' AS kind, 'repairable' AS severity, CAST(idx AS VARCHAR) AS target FROM l WHERE NOT regexp_matches(text, '^\[\d+\].+\. .+(\[[A-Z](/[A-Z]+)?\]|//)')
UNION ALL SELECT doc_id, 'reference_quantity', 'warning', CAST(n AS VARCHAR) FROM c WHERE n < 3 UNION ALL SELECT doc_id, 'reference_foreign', 'warning', CAST(round(alien, 4) AS VARCHAR) FROM c WHERE alien < 0.3 UNION ALL SELECT doc_id, 'reference_recent', 'warning', CAST(round(recent, 4) AS VARCHAR) FROM c WHERE recent < 0.5
""")
def reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.reference_rules(sql(spark, sf_dir, REFERENCES), least=3, foreign=0.3, recent=0.5)


@query("""
SELECT doc_id, 'page_setup' AS kind, 'repairable' AS severity, name AS target FROM (SELECT p_partkey AS doc_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1430 + p_size % 30 END AS top_margin, 1780 + p_size AS left_margin FROM part) UNPIVOT INCLUDE NULLS (v FOR name IN (top_margin, left_margin))
WHERE v IS NULL OR abs(v - CASE name WHEN 'top_margin' THEN 1445 ELSE 1800 END) > 10
""")
def page_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    actual = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(size % 7 != 0, 1430 + size % 30).alias("top_margin"), (1780 + size).alias("left_margin"))
    return rulepack.page_setup(actual, {"top_margin": 1445, "left_margin": 1800})


HEADINGS = """
SELECT d.i AS doc_id, k.i AS idx, CASE (d.i + k.i * (d.i % 3)) % 6 WHEN 0 THEN '1 A' WHEN 1 THEN '1.1.1.1.1 Deep' WHEN 2 THEN CASE WHEN d.i % 2 = 0 THEN '第二章 B' ELSE '2.1 C' END WHEN 3 THEN '（一）节' WHEN 4 THEN '1.2.3.4 D' ELSE 'plain' END AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS k(i)
"""


@query(rf"""
WITH l AS (SELECT *, CASE WHEN regexp_matches(text, '^\d') THEN 'decimal' WHEN regexp_matches(text, '^(第|[一二三四五六七八九十（(])') THEN 'chapter' END AS scheme FROM ({HEADINGS}))
SELECT doc_id, 'heading_scheme_mixed' AS kind, 'warning' AS severity, '2' AS target FROM l GROUP BY doc_id HAVING count(DISTINCT scheme) > 1
UNION ALL SELECT doc_id, 'heading_too_deep', 'warning', CAST(idx AS VARCHAR) FROM l WHERE scheme = 'decimal' AND len(string_split(regexp_extract(text, '^[\d.]*\d'), '.')) > 4
""")
def heading_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.heading_scheme(sql(spark, sf_dir, HEADINGS))


PLACED = """
SELECT d.i AS doc_id, k.i AS idx, CASE (d.i + k.i) % 3 WHEN 0 THEN 'p' WHEN 1 THEN CASE WHEN d.i % 2 = 0 THEN 'tbl' ELSE 'p' END ELSE 'drawing' END AS kind, CASE (d.i * 2 + k.i) % 6 WHEN 0 THEN 'Table 1 a' WHEN 1 THEN 'Figure 1-2 b' WHEN 2 THEN '表2 数据' WHEN 3 THEN '图3.1 图' ELSE 'text' END AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(9) AS k(i)
"""


@query(rf"""
WITH l AS (SELECT *, lead(kind) OVER w AS after, lag(kind) OVER w AS before FROM ({PLACED}) WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, 'caption_position' AS kind, 'repairable' AS severity, CAST(idx AS VARCHAR) AS target FROM l WHERE (regexp_matches(text, '^(Table|表) *\d') AND coalesce(after, '') <> 'tbl') OR (regexp_matches(text, '^(Figure|图) *\d') AND coalesce(before, '') <> 'drawing')
""")
def caption_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.caption_positions(sql(spark, sf_dir, PLACED))


LAYOUT = """
SELECT d.i AS doc_id, s.i AS idx, CASE WHEN (d.i + s.i) % 3 = 0 THEN concat('h', CAST(s.i AS STRING)) END AS header_id, CASE (d.i + s.i * 2) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'f1' ELSE concat('f', CAST(s.i AS STRING)) END AS footer_id,
 CASE (d.i + s.i) % 4 WHEN 0 THEN 'upperRoman' WHEN 1 THEN 'decimal' WHEN 2 THEN NULL ELSE 'lowerRoman' END AS number_format, CASE (d.i * 3 + s.i) % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 END AS number_start FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS s(i) WHERE s.i < 1 + d.i % 4
"""


@query(f"""
WITH l AS (SELECT *, CAST(idx AS VARCHAR) AS t, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place FROM ({LAYOUT}))
SELECT doc_id, 'section_header_footer_inherited' AS kind, 'repairable' AS severity, t AS target FROM l WHERE header_id IS NULL AND EXISTS (SELECT 1 FROM l b WHERE b.doc_id = l.doc_id AND b.idx < l.idx AND b.header_id IS NOT NULL)
UNION ALL SELECT doc_id, 'linked_header_footer_sections', 'repairable', footer_id FROM l WHERE footer_id IS NOT NULL GROUP BY doc_id, footer_id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'cover_page_number_present', 'repairable', number_format FROM l WHERE n >= 3 AND place = 1 AND number_format IS NOT NULL
UNION ALL SELECT doc_id, 'front_page_number_not_roman', 'repairable', t FROM l WHERE n >= 3 AND place = 2 AND NOT (coalesce(number_format, '') ILIKE '%roman' AND coalesce(number_start, 0) = 1)
UNION ALL SELECT doc_id, 'body_page_number_not_decimal_start', 'repairable', t FROM l WHERE n >= 3 AND place = 3 AND NOT (coalesce(number_format, 'decimal') = 'decimal' AND coalesce(number_start, 0) = 1)
""")
def section_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = sql(spark, sf_dir, LAYOUT)
    return rulepack.section_headers(layout).union(rulepack.page_numbers(layout))


TABLES = "SELECT d.i AS doc_id, k.i AS idx, (d.i + k.i) % 5 = 0 AS on_cover, d.i % 2 = 0 AS centred, (d.i + k.i) % 7 = 1 AS floating, (d.i * k.i) % 3 AS width, (d.i + k.i) % 3 > 0 AS repeats_header, (d.i + k.i) % 4 > 0 AS three_lines FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(5) AS k(i)"


@query(f"""
WITH t AS (SELECT *, CAST(idx AS VARCHAR) AS target FROM ({TABLES}) WHERE NOT on_cover) SELECT doc_id, 'table_layout_not_centered' AS kind, 'repairable' AS severity, target FROM t WHERE NOT centred OR width <= 0 OR floating
UNION ALL SELECT doc_id, 'table_repeating_header_missing', 'repairable', target FROM t WHERE NOT repeats_header UNION ALL SELECT doc_id, 'table_three_line_format', 'repairable', target FROM t WHERE NOT three_lines
""")
def table_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.tables(sql(spark, sf_dir, TABLES), three_lines=True)


MEDIA = "SELECT d.i AS doc_id, concat('word/media/', CAST(k.i AS STRING), CASE (d.i + k.i) % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.png' WHEN 2 THEN '.GIF' ELSE '.jpeg' END) AS part_name FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS k(i) UNION ALL SELECT i, 'word/styles.xml' FROM (SELECT doc_id FROM documents) AS t(i)"
LINKS = "SELECT d.i AS doc_id, 'word/document.xml' AS source_part, CASE (d.i + k.i) % 6 WHEN 0 THEN concat('media/', CAST(k.i AS STRING), '.PNG') WHEN 1 THEN '../word/styles.xml' WHEN 2 THEN 'http://x' WHEN 3 THEN '#top' WHEN 4 THEN '/word/gone.xml' ELSE './media/1.png' END AS target, (d.i + k.i) % 6 = 2 AS external FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(5) AS k(i)"
TYPES = "SELECT i AS doc_id, CASE WHEN i % 3 = 0 THEN 'GIF' ELSE 'png' END AS extension FROM (SELECT doc_id FROM documents) AS t(i)"


@query(f"""
WITH r AS (SELECT doc_id, CASE WHEN target LIKE '/%' THEN substr(target, 2) WHEN target LIKE '../%' THEN substr(target, 4) WHEN target LIKE './%' THEN 'word/' || substr(target, 3) ELSE 'word/' || target END AS path FROM ({LINKS}) WHERE NOT external AND target NOT LIKE '#%')
SELECT DISTINCT doc_id, 'relationship_target_missing' AS kind, 'repairable' AS severity, path AS target FROM r WHERE (doc_id, path) NOT IN ({MEDIA})
UNION ALL SELECT doc_id, 'media_content_type_missing', 'repairable', part_name FROM ({MEDIA}) WHERE part_name LIKE '%/media/%' AND (doc_id, lower(split_part(part_name, '.', -1))) NOT IN (SELECT doc_id, lower(extension) FROM ({TYPES}))
""")
def package_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sql(spark, sf_dir, MEDIA)
    return rulepack.relationship_targets(sql(spark, sf_dir, LINKS), parts).union(rulepack.media_types(parts, sql(spark, sf_dir, TYPES)))


PAGES = f"{GOLDEN} UNION ALL SELECT i, 9, CASE WHEN i % 4 = 0 THEN '  ' ELSE 'Err or !' END FROM (SELECT doc_id FROM documents) AS t(i)"
TEXT_RULES = "SELECT d.i AS doc_id, CASE WHEN r.i % 2 = 0 THEN 'required' ELSE 'forbidden' END AS rule, CASE r.i WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Error!' WHEN 2 THEN 'Not there' ELSE 'End' END AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS r(i)"


@query(f"""
WITH p AS (SELECT doc_id, page, replace(text, ' ', '') AS bare FROM ({PAGES})), r AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND contains(bare, replace(r.text, ' ', ''))) AS held FROM ({TEXT_RULES}) r)
SELECT doc_id, 'missing_rendered_text' AS kind, 'error' AS severity, text AS target FROM r WHERE rule = 'required' AND NOT held UNION ALL SELECT doc_id, 'forbidden_rendered_text', 'error', text FROM r WHERE rule = 'forbidden' AND held
UNION ALL SELECT doc_id, 'blank_rendered_page', 'error', CAST(page AS VARCHAR) FROM p WHERE bare = ''
""")
def rendered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.rendered(sql(spark, sf_dir, PAGES), sql(spark, sf_dir, TEXT_RULES))


PRINTED = f"SELECT doc_id, page, CASE WHEN (doc_id + page) % 5 > 0 THEN CAST(page - 1 AS STRING) END AS printed, text FROM ({GOLDEN}) AS g"
TOC = "SELECT d.i AS doc_id, CASE h.i WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Method' WHEN 2 THEN 'Results' ELSE 'Gone' END AS heading FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS h(i)"


@query(f"SELECT h.doc_id, heading, arg_min(printed, page) AS printed FROM ({TOC}) h JOIN ({PRINTED}) p ON p.doc_id = h.doc_id AND printed IS NOT NULL AND contains(replace(text, ' ', ''), heading) GROUP BY h.doc_id, heading")
def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.toc_pages(sql(spark, sf_dir, TOC), sql(spark, sf_dir, PRINTED))


REQUIREMENTS = """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN concat('Top margin ', CAST(p_size AS STRING), '.5 cm, left ', CAST(p_partkey % 9 + 1 AS STRING), 'cm; line spacing 1.5; at least references: ', CAST(p_partkey % 40 + 1 AS STRING))
 ELSE concat('上边距 ', CAST(p_size AS STRING), '.54cm，关键词 ', CAST(p_partkey % 4 + 2 AS STRING), ' 至 8 个') END AS text FROM part
"""


@query("""
SELECT p_partkey AS doc_id, p_size || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '.54' END AS top_cm, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 9 + 1 AS VARCHAR) END AS left_cm, CASE WHEN p_partkey % 2 = 0 THEN '1.5' END AS line,
 CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 40 + 1 AS VARCHAR) END AS "references", CASE WHEN p_partkey % 2 = 1 THEN CAST(p_partkey % 4 + 2 AS VARCHAR) END AS keywords FROM part
""")
def requirement_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.requirements(sql(spark, sf_dir, REQUIREMENTS))


ABSTRACTS = """
SELECT d.i AS doc_id, concat('cover', chr(10), CASE WHEN d.i % 5 = 0 THEN 'none' ELSE '摘要' END, chr(10), repeat('内容文字', CAST((d.i * 37) % 900 AS INT)), chr(10), '关键词', chr(10), CASE WHEN d.i % 3 = 0 THEN 'nothing' ELSE 'Abstract' END, chr(10), CASE WHEN d.i % 4 = 0 THEN ' ' ELSE 'We study.' END, chr(10), 'Keywords') AS text FROM (SELECT doc_id FROM documents) AS d(i)
"""


@query(f"""
SELECT doc_id, 'cn_abstract_len' AS kind, 'warning' AS severity, CAST(4 * ((doc_id * 37) % 900) AS VARCHAR) AS target FROM ({ABSTRACTS}) WHERE doc_id % 5 > 0 AND 4 * ((doc_id * 37) % 900) BETWEEN 1 AND 1999
UNION ALL SELECT doc_id, 'en_abstract_missing', 'warning', 'missing' FROM ({ABSTRACTS}) WHERE doc_id % 3 = 0 OR doc_id % 4 = 0
""")
def abstract_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.abstracts(sql(spark, sf_dir, ABSTRACTS))


@query(f"""
WITH v AS (SELECT doc_id, 1 AS n FROM ({HEADINGS}) WHERE text LIKE '第%' UNION ALL SELECT doc_id, 2 FROM ({HEADINGS}) WHERE text = 'plain')
SELECT doc_id, 'profile_rule' AS kind, 'repairable' AS severity, CAST(sum(n) AS VARCHAR) AS target FROM v GROUP BY doc_id
""")
def profile_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = sql(spark, sf_dir, HEADINGS)
    return rulepack.profile([headings.filter("text LIKE '第%'").select("doc_id", F.lit(1).alias("n")), headings.filter("text = 'plain'").select("doc_id", F.lit(2).alias("n"))])


@query(rf"""
WITH c AS (SELECT *, regexp_extract(text, '^(Table|Figure|表|图)') AS label FROM ({PLACED}) WHERE regexp_matches(text, '^(Table|Figure|表|图) *\d'))
SELECT doc_id, 'duplicate_caption' AS kind, 'warning' AS severity, text AS target FROM c GROUP BY doc_id, text HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, 'references_title_missing', 'warning', '参考文献' FROM ({PLACED})
""")
def template_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulepack.template_quality(sql(spark, sf_dir, PLACED))
