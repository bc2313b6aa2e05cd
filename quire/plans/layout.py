"""Lines of pages from the words of documents with places, and heading levels of chains of styles from part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout, paragraphs
from quire.plans.documents import LINES
from quire.plans.registry import query
from quire.sources.tables import sql, table


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each line as spans, forty lines a page; words of a line lie up to 0.4 apart in height, in no order of x."""
    lines = paragraphs.paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "idx", F.posexplode(F.split("text", " ")).alias("k", "word"))
    low = (F.col("idx") % 40).cast("double") * 12
    return lines.select("doc_id", F.floor(F.col("idx") / 40).alias("page"), (F.col("k") * 7.5).alias("x"), (800.0 - low - (F.col("k") * 7 % 5) * 0.1).alias("y"), F.concat("word", F.lit(" ")).alias("text"))


@query(f"""
WITH l AS (SELECT doc_id, CAST(floor(idx / 40) AS BIGINT) AS page, idx, text FROM ({LINES}))
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) - 1 AS line, md5(text || ' ') AS digest FROM l
""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_lines(spans(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", "line", F.md5("text").alias("digest"))


#: Chains of ninety styles each, whose last is based on itself, on one that no row defines, or on nothing.
CHAINS = """
SELECT concat(CASE WHEN i % 90 = 13 THEN concat('heading ', CAST(i % 9 + 1 AS STRING), '.') ELSE 's' END, CAST(i AS STRING)) AS style_id,
 CASE WHEN i % 90 < 89 THEN concat(CASE WHEN (i + 1) % 90 = 13 THEN concat('heading ', CAST((i + 1) % 9 + 1 AS STRING), '.') ELSE 's' END, CAST(i + 1 AS STRING)) WHEN i % 4 = 0 THEN concat('s', CAST(i AS STRING)) WHEN i % 4 = 1 THEN 'Heading 4' END AS based_on,
 CASE i % 23 WHEN 0 THEN 'heading 2' WHEN 1 THEN '标题 三' WHEN 2 THEN 'Heading_5' ELSE 'Body' END AS name, CASE WHEN i % 31 = 7 THEN CAST(i % 12 AS INT) END AS outline FROM (SELECT p_partkey FROM part) AS t(i)
"""


@query(f"""
WITH RECURSIVE s AS ({CHAINS}), o AS (SELECT style_id, based_on, coalesce(outline + 1, nullif(CASE WHEN name = 'heading 2' THEN 2 WHEN name = '标题 三' THEN 3 WHEN name = 'Heading_5' THEN 5 ELSE 0 END, 0)) AS own FROM s),
c AS (SELECT style_id, based_on AS up, own AS level, 0 AS depth FROM o UNION ALL SELECT c.style_id, o.based_on, CASE WHEN o.style_id IS NOT NULL THEN o.own WHEN c.up = 'Heading 4' THEN 4 END, depth + 1 FROM c LEFT JOIN o ON o.style_id = c.up WHERE c.level IS NULL AND c.up IS NOT NULL AND depth < 100)
SELECT style_id, CAST(CASE WHEN max(level) BETWEEN 1 AND 9 THEN max(level) ELSE 0 END AS INT) AS level FROM c GROUP BY style_id
""")
def style_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.style_levels(sql(spark, sf_dir, CHAINS))
