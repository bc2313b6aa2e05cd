"""Queries over generated renderings, in SQL that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import rendered as R
from quire.plans.registry import query
from quire.sources.tables import sql

WORDS = "CASE {} WHEN 0 THEN 'Abs tract' WHEN 1 THEN 'Intro duction' WHEN 2 THEN 'Method' WHEN 3 THEN 'Results' ELSE 'End' END"


def _pages(shift: str) -> str:
    return f"SELECT d.i AS doc_id, p.i + 1 AS page, concat('page ', {WORDS.format('(p.i + ' + shift + ') % 6')}, ' ', {WORDS.format('(p.i * 2 + d.i) % 5')}) AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS p(i)"


def _spans(font: str, size: str, x: str) -> str:
    return f"SELECT d.i AS doc_id, s.i AS seq, s.i + 1 AS page, {WORDS.format('(s.i + d.i) % 6')} AS text, {font} AS font, {size} AS font_size, {x} AS x, 100.0D AS width, 400.0D AS page_width FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(4) AS s(i)"


GOLDEN, CANDIDATE = _pages("0"), _pages("d.i % 2")
PAIRS = "SELECT d.i AS doc_id, p.i AS name, CASE p.i WHEN 0 THEN 'Abstract' ELSE 'Method' END AS left, CASE p.i WHEN 0 THEN 'Introduction' WHEN 1 THEN 'End' ELSE 'Results' END AS right FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(3) AS p(i)"
LANDMARKS = "SELECT d.i AS doc_id, CASE p.i WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Methods' ELSE 'Results' END AS landmark FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(3) AS p(i)"
GOLD_SPANS = _spans("'ABC+Sim Sun'", "12.0D", "150.0D")
OTHER_SPANS = _spans("CASE WHEN (d.i + s.i) % 3 = 0 THEN 'Kai-Ti' ELSE 'simsun' END", "12.0D + (d.i % 4) * 0.1D", "CAST(147 + s.i * 2 + d.i % 3 AS DOUBLE)")
STYLE_RULES = "SELECT d.i AS doc_id, r.i AS name, CASE r.i WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Method' ELSE 'Gone' END AS wanted, CASE d.i % 3 WHEN 0 THEN 'Sim' ELSE '' END AS font, CASE d.i % 2 WHEN 0 THEN 12.0D ELSE 0.0D END AS size, CASE d.i % 5 WHEN 0 THEN 0.05D ELSE 0.0D END AS tolerance, CASE d.i % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'left' ELSE '' END AS alignment FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(3) AS r(i)"


def _duck(sql: str) -> str:
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", sql).replace(" AS left,", ' AS "left",').replace(" AS right ", ' AS "right" ')


def _page_of(side: str, pages: str) -> str:
    return f"(SELECT coalesce(min(g.page), 0) FROM ({_duck(pages)}) g WHERE g.doc_id = p.doc_id AND contains(replace(g.text, ' ', ''), p.\"{side}\"))"


@query(f"""
WITH p AS ({_duck(PAIRS)}), f AS (SELECT *, {_page_of('left', GOLDEN)} AS gl, {_page_of('right', GOLDEN)} AS gr, {_page_of('left', CANDIDATE)} AS cl, {_page_of('right', CANDIDATE)} AS cr FROM p)
SELECT doc_id, CASE WHEN cl = 0 OR cr = 0 THEN 'candidate_same_page_landmark_missing' ELSE 'candidate_same_page_drift' END AS kind, 'error' AS severity, CAST(name AS VARCHAR) AS target FROM f WHERE gl > 0 AND gl = gr AND (cl = 0 OR cr = 0 OR cl <> cr)
""")
def same_page_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.same_page_drift(sql(spark, sf_dir, GOLDEN), sql(spark, sf_dir, CANDIDATE), sql(spark, sf_dir, PAIRS))


def _span_of(needles: str, needle: str, spans: str) -> str:
    near = f"(contains(replace(s.text, ' ', ''), replace(n.{needle}, ' ', '')) OR contains(replace(n.{needle}, ' ', ''), replace(s.text, ' ', '')))"
    return f"SELECT n.doc_id, n.{needle} AS needle, arg_min({{'font': regexp_replace(regexp_replace(lower(s.font), '^[^+]*\\+', ''), '[ _-]', '', 'g'), 'size': s.font_size, 'x': s.x, 'w': s.width, 'p': s.page_width}}, s.seq) AS span FROM ({_duck(needles)}) n JOIN ({_duck(spans)}) s ON s.doc_id = n.doc_id AND {near} GROUP BY ALL"


@query(f"""
WITH n AS ({_duck(LANDMARKS)}), b AS (SELECT n.doc_id, n.landmark AS target, g.span AS g, c.span AS c FROM n LEFT JOIN ({_span_of(LANDMARKS, 'landmark', GOLD_SPANS)}) g ON g.doc_id = n.doc_id AND g.needle = n.landmark LEFT JOIN ({_span_of(LANDMARKS, 'landmark', OTHER_SPANS)}) c ON c.doc_id = n.doc_id AND c.needle = n.landmark)
SELECT doc_id, 'landmark_style_unavailable' AS kind, 'warning' AS severity, target FROM b WHERE g IS NULL OR c IS NULL UNION ALL SELECT doc_id, 'landmark_font_drift', 'error', target FROM b WHERE g.font <> c.font
UNION ALL SELECT doc_id, 'landmark_font_size_drift', 'error', target FROM b WHERE abs(c.size - g.size) > 0.25 UNION ALL SELECT doc_id, 'landmark_horizontal_drift', 'error', target FROM b WHERE abs(c.x - g.x) > 3
""")
def landmark_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.style_drift(sql(spark, sf_dir, GOLD_SPANS), sql(spark, sf_dir, OTHER_SPANS), sql(spark, sf_dir, LANDMARKS))


@query(f"""
WITH n AS ({_duck(STYLE_RULES)}), b AS (SELECT n.*, s.span FROM n LEFT JOIN ({_span_of(STYLE_RULES, 'wanted', OTHER_SPANS)}) s ON s.doc_id = n.doc_id AND s.needle = n.wanted),
a AS (SELECT *, CAST(name AS VARCHAR) AS target, CASE WHEN abs(span.x + span.w / 2 - span.p / 2) <= 6 THEN 'center' WHEN span.x > span.p / 2 THEN 'right' ELSE 'left' END AS side FROM b)
SELECT doc_id, 'rendered_style_target_missing' AS kind, 'error' AS severity, target FROM a WHERE span IS NULL UNION ALL SELECT doc_id, 'rendered_font_mismatch', 'error', target FROM a WHERE font <> '' AND NOT contains(span.font, lower(font))
UNION ALL SELECT doc_id, 'rendered_font_size_mismatch', 'error', target FROM a WHERE size > 0 AND abs(span.size - size) > CASE WHEN tolerance > 0 THEN tolerance ELSE 0.25 END
UNION ALL SELECT doc_id, 'rendered_alignment_mismatch', 'error', target FROM a WHERE alignment <> '' AND span IS NOT NULL AND side <> alignment
""")
def rendered_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.style_rules(sql(spark, sf_dir, OTHER_SPANS), sql(spark, sf_dir, STYLE_RULES))


PICTURES = """
SELECT d.i AS doc_id, k.i AS idx, CASE (d.i + k.i) % 6 WHEN 0 THEN '图2.1 结构' WHEN 1 THEN '图3 结构' WHEN 2 THEN ' ' WHEN 3 THEN '' ELSE 'text' END AS text, (d.i + k.i * 3) % 4 = 0 AS picture, d.i % 5 = 0 AS anchored, 5700000 + (k.i % 3) * 100000 AS width,
 k.i % 2 = 0 AS kept_with_next, (d.i + k.i) % 7 = 0 AS grouped, k.i > 2 AS in_body FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(14) AS k(i)
"""


@query(rf"""
WITH p AS ({PICTURES}), f AS (SELECT *, CAST(idx AS VARCHAR) AS target, coalesce((SELECT arg_min(n.text, n.idx) FROM p n WHERE n.doc_id = p.doc_id AND n.idx > p.idx AND trim(n.text) <> ''), '') AS after FROM p WHERE picture AND in_body)
SELECT doc_id, 'floating_image_anchor' AS kind, 'repairable' AS severity, target FROM f WHERE anchored UNION ALL SELECT doc_id, 'image_width_over_text_area', 'repairable', target FROM f WHERE width > 5800000
UNION ALL SELECT doc_id, 'image_keep_with_caption_missing', 'repairable', target FROM f WHERE NOT grouped AND (after NOT LIKE '图%' OR NOT kept_with_next)
UNION ALL SELECT doc_id, 'figure_caption_missing_chapter_number', 'repairable', target FROM f WHERE NOT grouped AND after LIKE '图%' AND NOT regexp_matches(after, '^图\d+[.-]\d+')
""")
def picture_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pictures(sql(spark, sf_dir, PICTURES))


@query(f"""
WITH c AS (SELECT doc_id, max(page) AS n FROM ({GOLDEN}) GROUP BY doc_id), k AS (SELECT doc_id, max(page) AS n FROM ({CANDIDATE}) WHERE page < 4 OR doc_id % 3 > 0 GROUP BY doc_id), l AS (SELECT doc_id, landmark AS target FROM ({LANDMARKS}) UNION ALL SELECT i, 'Nowhere' FROM (SELECT doc_id FROM documents) t(i)),
f AS (SELECT *, coalesce((SELECT min(page) FROM ({GOLDEN}) g WHERE g.doc_id = l.doc_id AND contains(replace(text, ' ', ''), target)), 0) AS g, coalesce((SELECT min(page) FROM ({CANDIDATE}) g WHERE (page < 4 OR g.doc_id % 3 > 0) AND g.doc_id = l.doc_id AND contains(replace(text, ' ', ''), target)), 0) AS c FROM l)
SELECT doc_id, 'page_count_drift' AS kind, 'error' AS severity, CAST(k.n AS VARCHAR) AS target FROM c JOIN k USING (doc_id) WHERE abs(c.n - k.n) > 0
UNION ALL SELECT doc_id, CASE WHEN g = 0 THEN 'golden_landmark_missing' WHEN c = 0 THEN 'candidate_landmark_missing' ELSE 'landmark_page_drift' END, CASE WHEN g = 0 THEN 'warning' ELSE 'error' END, target FROM f WHERE g = 0 OR c = 0 OR g <> c
""")
def golden_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.issues import golden_drift as drift

    landmarks = sql(spark, sf_dir, f"{LANDMARKS} UNION ALL SELECT i, 'Nowhere' FROM (SELECT doc_id FROM documents) AS t(i)")
    return drift(sql(spark, sf_dir, GOLDEN), sql(spark, sf_dir, CANDIDATE).filter("page < 4 OR doc_id % 3 > 0"), landmarks)
