"""Rule packs and template differences over the lines of documents, whose styles inherit from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import packs, paragraphs
from quire.plans.documents import LINES, STYLES
from quire.plans.registry import query
from quire.sources.tables import sql, table

#: Rules written out, and one for each nation: its name must not be used.
PACK = """
SELECT * FROM (VALUES ('body-size', 'paragraph', 'body', 'size', 'at_most?', '60', 'repairable'), ('body-length', 'paragraph', 'body', 'chars', 'at_least', '45', 'warning'), ('body-font', 'paragraph', 'body', 'font', 'present', CAST(NULL AS STRING), 'repairable'),
 ('heading-bold', 'paragraph', 'heading', 'bold', 'equals', 'true', 'repairable'), ('heading-font', 'paragraph', 'heading', 'font', 'one_of?', 'font8|font12 | font16|font20', 'warning'), ('heading-size', 'paragraph', 'heading', 'size', 'near?', '40±25', 'warning'),
 ('double-space', 'paragraph', '*', 'text', 'lacks', '  ', 'repairable'), ('heading-end', 'paragraph', 'heading', 'text', 'matches', '[A-Za-z0-9]$', 'warning'),
 ('section-pages', 'section', '*', 'lines', 'at_most', '40', 'warning'), ('section-language', 'section', 'en', 'source', 'differs', 'web', 'fatal')) AS t(rule, scope, label, attribute, comparison, value, severity)
UNION ALL SELECT concat('no-', n_name), 'paragraph', '*', 'text', 'lacks', n_name, 'warning' FROM nation
"""
LABELLED = f"SELECT doc_id, idx, text, length(text) AS chars, CASE WHEN text = '' THEN NULL WHEN length(text) < 40 THEN 'heading' ELSE 'body' END AS label, (doc_id * 31 + idx) % 190 AS style_id, CASE WHEN (doc_id + idx) % 11 = 0 THEN 'own' END AS own_font FROM ({LINES})"
EFFECTIVE = f"""
st AS ({STYLES}), ch AS (SELECT style_id AS node, style_id AS at_, 0 AS depth FROM st UNION ALL SELECT node, s.based_on, depth + 1 FROM ch JOIN st s ON s.style_id = ch.at_ WHERE s.based_on IS NOT NULL AND depth < 30),
ef AS (SELECT node AS style_id, arg_min(font, depth) FILTER (font <> '') AS font, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, coalesce(bool_or(bold), false) AS bold FROM ch JOIN st s ON s.style_id = ch.at_ GROUP BY node),
p AS (SELECT l.doc_id, l.idx, l.text, l.chars, l.label, coalesce(own_font, font) AS font, size, bold FROM ({LABELLED}) l LEFT JOIN ef USING (style_id))
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs.paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "idx", "text")
    n, key = F.length("text"), F.col("doc_id")
    return lines.select(
        "doc_id", "idx", "text", n.alias("chars"), F.when(F.col("text") == "", None).when(n < 40, "heading").otherwise("body").alias("label"),
        ((key * 31 + F.col("idx")) % 190).alias("style_id"), F.when((key + F.col("idx")) % 11 == 0, "own").alias("own_font"),
    )


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.styled(labelled(spark, sf_dir), sql(spark, sf_dir, STYLES), ["font", "size"], ["bold"])


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each document: its language is the label."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(0).alias("idx"), F.col("lang").alias("label"), "source", F.size(F.split("text", "\n")).alias("lines"))


@query(f"""
WITH RECURSIVE r AS ({PACK}), {EFFECTIVE},
c AS (SELECT 'paragraph' AS scope, doc_id, idx, label, a.k AS attribute, a.v AS actual FROM (SELECT *, unnest([{{'k': 'text', 'v': text}}, {{'k': 'chars', 'v': CAST(chars AS VARCHAR)}}, {{'k': 'font', 'v': font}}, {{'k': 'size', 'v': CAST(size AS VARCHAR)}}, {{'k': 'bold', 'v': CAST(bold AS VARCHAR)}}]) AS a FROM p)
 UNION ALL SELECT 'section', doc_id, 0, lang, a.k, a.v FROM (SELECT *, unnest([{{'k': 'source', 'v': source}}, {{'k': 'lines', 'v': CAST(len(string_split(text, chr(10))) AS VARCHAR)}}]) AS a FROM documents)),
m AS (SELECT c.*, rule, severity, value, comparison, CASE replace(comparison, '?', '') WHEN 'equals' THEN actual = value WHEN 'differs' THEN actual <> value WHEN 'at_least' THEN TRY_CAST(actual AS DOUBLE) >= TRY_CAST(value AS DOUBLE)
  WHEN 'at_most' THEN TRY_CAST(actual AS DOUBLE) <= TRY_CAST(value AS DOUBLE) WHEN 'near' THEN abs(TRY_CAST(actual AS DOUBLE) - TRY_CAST(split_part(value, '±', 1) AS DOUBLE)) <= TRY_CAST(split_part(value, '±', 2) AS DOUBLE)
  WHEN 'one_of' THEN list_contains(list_transform(string_split(value, '|'), lambda x: trim(x)), actual) WHEN 'matches' THEN regexp_matches(actual, value) WHEN 'lacks' THEN NOT contains(lower(actual), lower(value)) WHEN 'present' THEN trim(actual) <> '' END AS ok
  FROM c JOIN r ON r.scope = c.scope AND r.attribute = c.attribute AND (r.label = '*' OR r.label = c.label))
SELECT scope, doc_id, CAST(idx AS BIGINT) AS idx, rule, severity, value AS expected, CASE WHEN attribute = 'text' THEN md5(actual) ELSE actual END AS actual FROM m WHERE NOT coalesce(ok, false) AND NOT (comparison LIKE '%?' AND actual IS NULL)
""")
def rule_pack_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of rules of two scopes, some written out and some made from a table, over styled lines and sections."""
    frames = {"paragraph": effective(spark, sf_dir), "section": sections(spark, sf_dir)}
    found = packs.check(sql(spark, sf_dir, PACK), frames, ["doc_id", "idx"])
    of_text = F.col("rule").startswith("no-") | F.col("rule").isin("double-space", "heading-end")
    return found.withColumns({"idx": F.col("idx").cast("long"), "actual": F.when(of_text, F.md5("actual")).otherwise(F.col("actual"))})


#: DuckDB: the most frequent value of an attribute for each label of the template's documents.
MODE = "SELECT label, v FROM (SELECT label, {0} AS v, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, {0}) AS r FROM p WHERE doc_id % 10 = 0 AND {0} IS NOT NULL AND label IS NOT NULL GROUP BY label, {0}) WHERE r = 1"


@query(f"""
WITH RECURSIVE {EFFECTIVE}, f AS (SELECT label, any_value(f.v) AS font, any_value(s.v) AS size, any_value(b.v) AS bold FROM (SELECT DISTINCT label FROM p WHERE doc_id % 10 = 0 AND label IS NOT NULL) LEFT JOIN ({MODE.format('font')}) f USING (label) LEFT JOIN ({MODE.format('size')}) s USING (label) LEFT JOIN ({MODE.format('bold')}) b USING (label) GROUP BY label),
m AS (SELECT doc_id, f.label, CAST(f.font IS NOT NULL AND p.font IS DISTINCT FROM f.font AS INT) AS a, CAST(f.size IS NOT NULL AND p.size IS DISTINCT FROM f.size AS INT) AS b, CAST(f.bold IS NOT NULL AND p.bold IS DISTINCT FROM f.bold AS INT) AS c,
 CAST(f.font IS NOT NULL AS INT) + CAST(f.size IS NOT NULL AS INT) + CAST(f.bold IS NOT NULL AS INT) AS told FROM p LEFT JOIN f ON f.label = p.label WHERE doc_id % 10 > 0)
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (label IS NULL) AS unknown, count(*) FILTER (a + b + c > 0) AS wrong, CAST(sum(a) AS BIGINT) AS font_wrong, CAST(sum(b) AS BIGINT) AS size_wrong, CAST(sum(c) AS BIGINT) AS bold_wrong,
 round((sum(told) - sum(a + b + c)) / nullif(sum(told), 0), 4) AS score FROM m GROUP BY doc_id
""")
def template_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenth document is the template's; all others are held against its formats, label by label."""
    rows = effective(spark, sf_dir)
    formats = packs.template_formats(rows.filter("doc_id % 10 = 0 AND label IS NOT NULL"), "label", ["font", "size", "bold"])
    return packs.classified_diff(rows.filter("doc_id % 10 > 0"), formats, ["doc_id"], "label", ["font", "size", "bold"])
