"""Payload lookups, back matter and state machines over the lines of documents, with markers put in by their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import machines, mapping, paragraphs
from quire.plans.documents import LINES
from quire.plans.registry import query
from quire.plans.text import RE2
from quire.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraphs(table(spark, sf_dir, "documents")).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{RE2}]+|[{RE2}]+$', '', 'g')"


@query(f"""
WITH l AS ({LINES}), b AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN '  ' || text || chr(10) WHEN idx % 3 = 1 THEN text || '?' ELSE text END AS payload FROM l WHERE idx % 2 = 0),
t AS (SELECT doc_id, {_trim('text')} AS t, min(idx) AS first_ FROM l GROUP BY ALL)
SELECT b.doc_id, CAST(b.idx AS BIGINT) AS idx, CAST(first_ AS BIGINT) AS source_index, CASE WHEN first_ IS NOT NULL THEN CASE WHEN first_ % 4 = 0 THEN 'table' ELSE 'paragraph' END END AS kind, CAST(first_ % 5 AS BIGINT) AS level
FROM b LEFT JOIN t ON t.doc_id = b.doc_id AND t.t = {_trim('payload')} AND t.t <> ''
""")
def payload_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other line as a payload, some with white space around and some that no block has."""
    lines, i = _lines(spark, sf_dir), F.col("idx")
    blocks = lines.withColumns({"kind": F.when(i % 4 == 0, "table").otherwise("paragraph"), "level": i % 5})
    said = F.when(i % 3 == 0, F.concat(F.lit("  "), "text", F.lit("\n"))).when(i % 3 == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return mapping.first_sources(lines.filter(i % 2 == 0).select("doc_id", "idx", said.alias("payload")), blocks).drop("payload")


#: Every seventh line is the heading of the acknowledgements, in one document of three with more behind it.
MATTER = "CASE WHEN idx % 7 = 5 THEN CASE doc_id % 3 WHEN 0 THEN '致 谢' WHEN 1 THEN '致谢' || text ELSE text END ELSE text END"


@query(f"""
WITH l AS (SELECT doc_id, idx, {MATTER} AS text FROM ({LINES})), m AS (SELECT *, {_trim('text')} AS t, regexp_replace(text, '[{RE2}]+', '', 'g') AS bare FROM l),
h AS (SELECT *, (SELECT min(idx) FROM m x WHERE x.doc_id = m.doc_id AND x.bare LIKE '致谢%') AS heading FROM m WHERE t <> ''),
p AS (SELECT doc_id, idx, CASE WHEN heading IS NOT NULL AND idx >= heading THEN 'acknowledgement' ELSE 'references' END AS block_id, CASE WHEN bare LIKE '致谢%' THEN substr(bare, 3) ELSE t END AS s FROM h),
f AS (SELECT doc_id, block_id, string_agg(s, chr(10) ORDER BY idx) AS payload FROM p WHERE s <> '' GROUP BY ALL)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'references' ELSE 'intro' END AS block_id, CASE doc_id % 5 WHEN 0 THEN 'acknowledgement' ELSE 'text' END AS block_kind, md5('given') AS payload FROM documents
UNION ALL SELECT doc_id, block_id, 'back_matter', md5(payload) FROM f WHERE NOT (block_id = 'references' AND doc_id % 4 = 0) AND NOT (block_id = 'acknowledgement' AND doc_id % 5 = 0)
""")
def back_matter_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "references").otherwise("intro").alias("block_id"), F.when(F.col("doc_id") % 5 == 0, "acknowledgement").otherwise("text").alias("block_kind"), F.lit("given").alias("payload"))
    marked = F.when(F.col("doc_id") % 3 == 0, "致 谢").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("致谢"), "text")).otherwise(F.col("text"))
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 7 == 5, marked).otherwise(F.col("text")))
    return mapping.with_fallbacks(given, mapping.back_matter(lines)).withColumn("payload", F.md5("payload"))


EVENTS = ("originality", "abstract_title", "keywords", "en_abstract_title", "en_keywords", "toc_title", "references_title", "acknowledgements_title", "appendix_title", "heading", "heading", "references_title")
EVENT = "CASE WHEN text = '' THEN 'blank' ELSE CASE (doc_id * 7 + idx * 5) % 29 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EVENTS)) + " END END"
ARCS = ", ".join(f"('{a.state}', '{a.event}', {repr(a.next) if a.next else 'NULL'}, {repr(a.emit) if a.emit else 'NULL'})" for a in machines.THESIS)


@query(f"""
WITH RECURSIVE a(state, event, next, emit) AS (VALUES {ARCS}), l AS (SELECT doc_id, idx, {EVENT} AS event FROM ({LINES})),
m AS (SELECT doc_id, CAST(-1 AS BIGINT) AS idx, CAST('' AS VARCHAR) AS event, 'cover' AS state, '' AS emit FROM documents
 UNION ALL SELECT doc_id, idx, coalesce(event, '*'), coalesce(x.next, state), coalesce(x.emit, x.next, state) FROM (
  SELECT m.doc_id, CAST(l.idx AS BIGINT) AS idx, l.event, m.state, (SELECT {{'next': a.next, 'emit': a.emit}} FROM a WHERE a.state IN (m.state, '*') AND a.event IN (l.event, '*') ORDER BY CAST(a.event = '*' AS INT) * 2 * CAST(a.state <> '*' AS INT) + CAST(a.state = '*' AS INT) + CAST(a.state = '*' AND a.event = '*' AS INT) * 5 LIMIT 1) AS x
  FROM m JOIN l ON l.doc_id = m.doc_id AND l.idx = m.idx + 1))
SELECT doc_id, idx, event, state, emit FROM m WHERE idx >= 0
""")
def zone_machine_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return machines.run(lines, ["doc_id"], "idx", F.expr(EVENT), machines.THESIS, "cover")


@query(f"""
WITH l AS (SELECT doc_id, idx, (idx + doc_id) % 6 = 2 AND doc_id % 5 > 0 AS title, (idx + doc_id * 3) % 11 = 7 AS main FROM ({LINES})), b AS (SELECT doc_id, min(idx) AS b FROM l WHERE title GROUP BY doc_id)
SELECT l.doc_id, CAST(b AS BIGINT) AS "begin", CAST(coalesce(min(idx) FILTER (main AND NOT title AND idx > b) - 1, max(idx)) AS BIGINT) AS "end" FROM l JOIN b USING (doc_id) GROUP BY l.doc_id, b
""")
def contents_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("idx"), F.col("doc_id")
    return machines.contents_range(_lines(spark, sf_dir), ["doc_id"], "idx", ((i + d) % 6 == 2) & (d % 5 > 0), (i + d * 3) % 11 == 7)
