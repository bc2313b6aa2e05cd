"""Classification queries over generated theses; the SQL that makes the rows is shared by both engines, and the SQL that
checks walks each document row by row where the operators use windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import classify as C
from quire.plans.registry import query
from quire.sources.tables import sql, table

THESES = """
SELECT d.i AS doc_id, k.i AS idx, CASE WHEN (d.i + k.i) % 13 = 12 THEN 'table' ELSE 'paragraph' END AS kind,
 CASE (d.i * 7 + k.i * (1 + d.i % 3)) % 27 WHEN 0 THEN '目 录' WHEN 1 THEN '摘要：内容' WHEN 2 THEN '摘要' WHEN 3 THEN 'Abstract' WHEN 4 THEN '关键词：a；b' WHEN 5 THEN '关键词' WHEN 6 THEN 'Key words: x' WHEN 7 THEN '参考文献'
  WHEN 8 THEN CASE WHEN d.i % 2 = 0 THEN '致谢' ELSE '致谢；谢谢' END WHEN 9 THEN '表2.1 数据' WHEN 10 THEN '图3 结构' WHEN 11 THEN '1 绪论' WHEN 12 THEN '1.2 背景' WHEN 13 THEN '第二章 方法' WHEN 14 THEN '一、引言' WHEN 15 THEN '姓名：张三' WHEN 16 THEN 'Name: Ann'
  WHEN 17 THEN '' WHEN 18 THEN '[7] A. Work' WHEN 19 THEN '2 Methods' WHEN 20 THEN '普通正文' WHEN 21 THEN '  ' WHEN 22 THEN '表：数据' WHEN 23 THEN '图 结构' WHEN 24 THEN '1 Introduction' WHEN 25 THEN '[9]B. Book' ELSE 'plain body text' END AS text,
 CASE k.i % 4 WHEN 0 THEN 'Heading1' WHEN 1 THEN 'Normal' WHEN 2 THEN '标题 2' ELSE '' END AS style, k.i % 9 = 5 AS figure, d.i % 2 = 0 AS data
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(30) AS k(i)
"""
#: Labels and confidences that rules, a model and an arbiter might give.
SCORED = """
SELECT d.i AS doc_id, k.i AS idx, CASE (d.i + k.i * 5) % 7 WHEN 0 THEN 'heading_1' WHEN 1 THEN 'references_title' WHEN 2 THEN 'acknowledgements_title' ELSE 'body' END AS label, ((d.i * 31 + k.i * 17) % 60 + 40) / 100.0D AS confidence,
 CASE (d.i + k.i) % 4 WHEN 0 THEN '' WHEN 1 THEN 'title' ELSE 'abstract' END AS model_label, ((d.i * 13 + k.i * 29) % 50 + 50) / 100.0D AS model_confidence,
 CASE (d.i + k.i * 3) % 5 WHEN 0 THEN 'nonsense' WHEN 1 THEN 'cover' ELSE 'keywords' END AS said_label, ((d.i * 11 + k.i * 7) % 130 - 10) / 100.0D AS said_confidence
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(45) AS k(i) WHERE k.i < 5 + d.i % 41
"""
DUCK_SCORED = SCORED.replace("100.0D", "100.0::DOUBLE")
COMPACT = "regexp_replace(trim(text), '[ \\t\\x{A0}\\x{3000}]', '', 'g')"


def _theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, THESES)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SCORED)


ROLES = rf"""
WITH l AS (SELECT *, trim(text) AS t, {COMPACT} AS c FROM ({THESES})),
r AS (SELECT *, CASE WHEN kind = 'table' THEN 'table' WHEN regexp_matches(t, '^第[一二三四五六七八九十百千万\d]+章(?:\s*\S+)?$') OR regexp_matches(t, '^[一二三四五六七八九十百]+[、．.]\s*\S+') THEN 'heading' WHEN t = '' THEN 'blank' WHEN c = '目录' THEN 'toc_title'
 WHEN c LIKE '摘要%' THEN 'abstract_cn' WHEN lower(t) LIKE 'abstract%' THEN 'abstract_en' WHEN c LIKE '关键词%' THEN 'keywords_cn' WHEN lower(t) LIKE 'keywords%' OR lower(t) LIKE 'key words%' THEN 'keywords_en' WHEN c = '参考文献' THEN 'references_title' WHEN c = '致谢' THEN 'acknowledgements_title'
 WHEN regexp_matches(t, '^表\d') THEN 'table_caption' WHEN regexp_matches(t, '^图\d') THEN 'figure_caption' WHEN regexp_matches(t, '^\d+(\.\d+){{0,3}}\s+\S') THEN 'heading' ELSE 'body_paragraph' END AS role FROM l),
v AS (SELECT *, CASE WHEN role = 'heading' THEN greatest(length(regexp_extract(t, '^[\d.]+')) - length(replace(regexp_extract(t, '^[\d.]+'), '.', '')), 0) + 1 ELSE 0 END AS level FROM r),
s AS (SELECT *, CASE WHEN role IN ('abstract_cn', 'abstract_en') THEN 'abstract' WHEN role = 'toc_title' THEN 'toc' WHEN role = 'heading' AND level = 1 THEN 'body' WHEN role = 'references_title' THEN 'references' WHEN role = 'acknowledgements_title' THEN 'acknowledgements' END AS begins FROM v)
SELECT doc_id, idx, kind, role, level, CAST(round(CASE WHEN role IN ('table', 'blank') THEN 0.99 ELSE least(0.99, CASE WHEN role = 'body_paragraph' THEN 0.55 WHEN role IN ('heading', 'table_caption', 'figure_caption') THEN 0.82 WHEN regexp_matches(t, '[:：;；]') THEN 0.88 ELSE 0.95 END
 + CASE WHEN style IN ('Heading1', '标题 2') THEN 0.12 ELSE 0 END) END, 2) AS DOUBLE) AS confidence, coalesce((SELECT b.begins FROM s b WHERE b.doc_id = s.doc_id AND b.idx <= s.idx AND b.begins IS NOT NULL ORDER BY b.idx DESC LIMIT 1), 'cover') AS section FROM s
"""


@query(ROLES)
def ast_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ast_roles(_theses(spark, sf_dir)).select("doc_id", "idx", "kind", "role", "level", "confidence", "section")


@query(f"SELECT doc_id, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (role = 'blank') AS blanks, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (role = 'heading') AS headings FROM ({ROLES}) GROUP BY doc_id")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.role_counts(C.ast_roles(_theses(spark, sf_dir)))


PARTS = rf"""
WITH RECURSIVE l AS (SELECT doc_id, idx, kind, trim(text) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM ({THESES}) WHERE trim(text) <> ''),
m AS (SELECT *, CASE WHEN kind = 'table' THEN NULL WHEN regexp_matches(t, '^(摘要|关键词|参考文献|致谢)\s*([：:；;]|$)') THEN regexp_extract(t, '^(摘要|关键词|参考文献|致谢)') END AS marker, regexp_matches(t, '^(摘要|关键词|参考文献|致谢)$') AS alone,
 kind <> 'table' AND (regexp_matches(t, '^\d+(\.\d+){{0,3}}\s+\S') OR regexp_matches(t, '^第[一二三四五六七八九十百千万\d]+章') OR regexp_matches(t, '^[一二三四五六七八九十百]+[、．.]\s*\S')) AS heads FROM l),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, 'cover' AS state, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS text FROM m
 UNION ALL SELECT m.doc_id, m.n, CASE WHEN m.kind = 'table' THEN state WHEN marker = '摘要' THEN 'abstract_cn' WHEN marker = '关键词' THEN CASE WHEN alone THEN 'keywords_cn' ELSE 'body' END WHEN marker = '参考文献' THEN 'references' WHEN marker = '致谢' THEN 'acknowledgement'
   WHEN heads AND state NOT IN ('references', 'acknowledgement') THEN 'body' WHEN state = 'keywords_cn' THEN 'body' ELSE state END,
  CASE WHEN m.kind = 'table' THEN CASE WHEN state = 'body' THEN 'table' END WHEN marker IS NOT NULL THEN 'section_label' WHEN heads AND state NOT IN ('references', 'acknowledgement') THEN 'heading'
   WHEN state = 'cover' THEN CASE WHEN regexp_matches(t, '^[^：:]+[：:].+') THEN 'cover_field' END ELSE state END, m.idx, m.t FROM f JOIN m ON m.doc_id = f.doc_id AND m.n = f.n + 1)
SELECT doc_id, idx, part, text FROM f WHERE part IS NOT NULL
"""


@query(PARTS)
def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.section_parts(_theses(spark, sf_dir))


@query(f"""
SELECT doc_id, trim(regexp_extract(text, '^([^：:]+)[：:](.+)', 1)) AS "key", arg_max(trim(regexp_extract(text, '^([^：:]+)[：:](.+)', 2)), idx) AS "value" FROM ({PARTS}) WHERE part = 'cover_field' GROUP BY ALL
""")
def cover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cover_fields(C.section_parts(_theses(spark, sf_dir)))


BLOCKS = rf"""
WITH RECURSIVE l AS (SELECT doc_id, idx, kind = 'paragraph' AS p, trim(text) AS t, {COMPACT} AS c, figure, data, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM ({THESES})),
m AS (SELECT *, CASE WHEN p THEN regexp_extract(t, '^(\d+)\s+\S', 1) ELSE '' END AS number, p AND (c LIKE '1绪论%' OR regexp_matches(lower(t), '^1\s+introduction')) AS starts FROM l),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS idx, '' AS block, '1' AS chapter, false AS in_body, false AS body, false AS toc, false AS refs, '' AS text, false AS p FROM m
 UNION ALL SELECT doc_id, n, idx, block, CASE WHEN starts THEN '1' WHEN block = 'body_heading' THEN number ELSE chapter END, body OR block IN ('body_heading', 'references_title', 'acknowledgements', 'reference_entry'), body OR starts,
  CASE WHEN p AND c = '目录' THEN true WHEN starts OR (p AND c IN ('参考文献', '致谢')) THEN false ELSE toc END, CASE WHEN starts OR (p AND c = '致谢') THEN false WHEN p AND c = '参考文献' THEN true ELSE refs END, t, p
 FROM (SELECT m.*, f.chapter, f.body, f.toc, f.refs, CASE WHEN m.p AND c = '目录' THEN 'toc' WHEN starts THEN 'body_heading' WHEN m.p AND c = '参考文献' THEN 'references_title' WHEN m.p AND c = '致谢' THEN 'acknowledgements' WHEN m.p AND refs AND regexp_matches(t, '^\[\d+\]') THEN 'reference_entry'
   WHEN m.p AND regexp_matches(t, '^表\d') THEN 'table_caption' WHEN m.p AND regexp_matches(t, '^图\d') THEN 'figure_caption' WHEN m.p AND toc THEN 'toc' WHEN m.p AND figure AND body THEN 'figure' WHEN m.p AND body THEN CASE WHEN number <> '' THEN 'body_heading' ELSE 'body_paragraph' END
   WHEN NOT m.p THEN CASE WHEN data THEN 'data_table' ELSE 'layout_table' END ELSE 'front_matter' END AS block FROM f JOIN m ON m.doc_id = f.doc_id AND m.n = f.n + 1))
SELECT doc_id, idx, block, chapter, in_body, text, p FROM f WHERE n > 0
"""


@query(f"SELECT doc_id, idx, block, chapter, in_body FROM ({BLOCKS})")
def semantic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.semantic_blocks(_theses(spark, sf_dir)).select("doc_id", "idx", "block", "chapter", "in_body")


@query(f"""
SELECT doc_id, idx, block, left(text, 80) AS preview, before, after FROM (SELECT *, lag(raw, 1, '') OVER w AS before, lead(raw, 1, '') OVER w AS after FROM (SELECT b.* EXCLUDE (text), t.text, t.text AS raw FROM ({BLOCKS}) b JOIN ({THESES}) t USING (doc_id, idx)) WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
WHERE in_body AND block IN ('data_table', 'layout_table', 'figure')
""")
def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.candidates(C.semantic_blocks(_theses(spark, sf_dir)))


@query(rf"""
WITH u AS (SELECT *, left(text, 1) AS label, regexp_replace(substr(text, 2), '^[：:.— \x{{3000}}-]+', '') AS name FROM ({BLOCKS}) WHERE in_body AND p AND regexp_matches(text, '^[表图][^\d]'))
SELECT doc_id, idx, label || chapter || '.' || row_number() OVER (PARTITION BY doc_id, chapter, label ORDER BY idx) || ' ' || name AS caption FROM u
""")
def numbered_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered_captions(C.semantic_blocks(_theses(spark, sf_dir)))


@query(rf"SELECT doc_id, idx, '[' || row_number() OVER (PARTITION BY doc_id ORDER BY idx) || '] ' || trim(regexp_replace(text, '^\[\d+\]', '')) AS text FROM ({BLOCKS}) WHERE block = 'reference_entry'")
def renumbered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.renumbered_references(C.semantic_blocks(_theses(spark, sf_dir)))


@query(f"""
SELECT doc_id, idx, CASE WHEN label = 'body' AND EXISTS (SELECT 1 FROM ({DUCK_SCORED}) r WHERE r.doc_id = s.doc_id AND r.label = 'references_title' AND r.idx < s.idx)
 AND NOT EXISTS (SELECT 1 FROM ({DUCK_SCORED}) r WHERE r.doc_id = s.doc_id AND r.label = 'acknowledgements_title' AND r.idx <= s.idx) THEN 'references' ELSE label END AS label FROM ({DUCK_SCORED}) s
""")
def order_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.order_constraints(_scored(spark, sf_dir).select("doc_id", "idx", "label"))


@query("""
SELECT id, CASE s WHEN 'Heading1' THEN 'heading_1' WHEN ' heading 2 ' THEN 'heading_2' WHEN '标题3' THEN 'heading_3' WHEN 'TITLE' THEN 'title' WHEN 'TOC 2' THEN 'table_of_contents' WHEN 'TocHeading' THEN 'table_of_contents_title' ELSE '' END AS label
FROM (SELECT id, CASE id % 9 WHEN 0 THEN 'Heading1' WHEN 1 THEN ' heading 2 ' WHEN 2 THEN '标题3' WHEN 3 THEN 'TITLE' WHEN 4 THEN 'TOC 2' WHEN 5 THEN 'TocHeading' WHEN 6 THEN 'heading5' WHEN 7 THEN 'Normal' END AS s FROM (SELECT p_partkey FROM part) t(id))
""")
def style_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = sql(spark, sf_dir, "SELECT id, CASE id % 9 WHEN 0 THEN 'Heading1' WHEN 1 THEN ' heading 2 ' WHEN 2 THEN '标题3' WHEN 3 THEN 'TITLE' WHEN 4 THEN 'TOC 2' WHEN 5 THEN 'TocHeading' WHEN 6 THEN 'heading5' WHEN 7 THEN 'Normal' END AS s FROM (SELECT p_partkey FROM part) AS t(id)")
    return styles.select("id", C.style_label(F.col("s")).alias("label"))


@query(f"SELECT label, count(*) AS n, count(*) FILTER (confidence < 0.92) AS low FROM ({DUCK_SCORED}) GROUP BY label")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_stats(_scored(spark, sf_dir), []).select("label", "n", "low")


@query(f"SELECT doc_id, round(100.0 * count(*) FILTER (model_label <> '') / count(*), 4) AS coverage, round(100.0 * count(*) FILTER (model_label <> '') / count(*), 4) >= 70 AS enough FROM ({DUCK_SCORED}) GROUP BY doc_id")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(_scored(spark, sf_dir).withColumn("label", F.col("model_label")))


CASCADE = f"""
WITH s AS ({DUCK_SCORED}), m AS (SELECT *, confidence < 0.92 AND model_label <> '' AND model_confidence >= 0.8 AS taken FROM s),
r AS (SELECT doc_id, idx, said_label, said_confidence, CASE WHEN taken THEN model_label ELSE label END AS label, CASE WHEN taken THEN model_confidence ELSE confidence END AS confidence, CASE WHEN taken THEN 'model' ELSE 'rule' END AS source FROM m),
g AS (SELECT doc_id, count(*) FILTER (confidence < 0.92) > 3 AS asks, count(*) FILTER (confidence < 0.6) > 5 AS asks_later FROM r GROUP BY doc_id),
i AS (SELECT *, CASE WHEN said_confidence <= 0 OR said_confidence > 1 THEN 0.85 ELSE said_confidence END AS sure, CASE WHEN confidence < 0.9 THEN count(*) FILTER (confidence < 0.9) OVER (PARTITION BY doc_id ORDER BY idx) END AS item FROM r JOIN g USING (doc_id)),
a AS (SELECT *, coalesce(asks AND item <= 30 AND said_label <> 'nonsense' AND sure >= confidence, false) AS answered FROM i)
"""


@query(CASCADE + "SELECT doc_id, idx, CASE WHEN answered THEN said_label ELSE label END AS label, round(CASE WHEN answered THEN sure ELSE confidence END, 4) AS confidence, CASE WHEN answered THEN 'arbiter' ELSE source END AS source FROM a")
def classification_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    found = C.with_model(scored.drop("said_label", "said_confidence"))
    answers = scored.select("doc_id", "idx", F.col("said_label").alias("label"), F.col("said_confidence").alias("confidence"))
    merged = C.arbitrated(found, answers, C.needs_arbiter(found, independent=False))
    return merged.select("doc_id", "idx", "label", F.round("confidence", 4).alias("confidence"), "source")


@query(CASCADE + "SELECT doc_id, asks, asks_later FROM g")
def arbitration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.with_model(_scored(spark, sf_dir))
    return C.needs_arbiter(found, independent=False).join(C.needs_arbiter(found, independent=True).withColumnRenamed("asks", "asks_later"), "doc_id")


@query(f"""
WITH n AS (SELECT *, floor((row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) / 10) AS batch FROM ({DUCK_SCORED}))
SELECT doc_id, idx, CASE WHEN (doc_id + batch) % 3 = 0 OR said_label = 'nonsense' THEN label ELSE said_label END AS label FROM n
""")
def whole_document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    answers = scored.filter("said_label <> 'nonsense'").select("doc_id", "idx", F.col("said_label").alias("label"))
    failed = sql(spark, sf_dir, "SELECT d.i AS doc_id, b.i AS batch FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(5) AS b(i) WHERE (d.i + b.i) % 3 = 0")
    return C.whole_document(scored.select("doc_id", "idx", "label"), answers, failed, 10)


@query("""
SELECT c_nationkey, n, CASE WHEN n >= 2000 THEN 'independent' WHEN n >= 500 THEN 'apprentice' ELSE 'cold_start' END AS phase, n - c_nationkey * 90 >= 200 AS due FROM (SELECT c_nationkey, sum(c_custkey) % 2600 AS n FROM customer GROUP BY c_nationkey)
""")
def training_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.tables import table

    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.sum("c_custkey") % 2600).alias("n"))
    return counts.select("c_nationkey", "n", C.training_phase(F.col("n")).alias("phase"), C.retrain_due(F.col("n"), F.col("c_nationkey") * 90).alias("due"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows to train on: a report of a fixed size, so a top-k."""
    from quire.sources.tables import table

    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query(f"""
SELECT doc_id, CASE label WHEN 'heading_1' THEN 'body' WHEN 'references_title' THEN 'references' WHEN 'acknowledgements_title' THEN 'thanks' ELSE label END AS section, min(idx) AS first_idx, string_agg(model_label, chr(10) ORDER BY idx) AS text FROM ({DUCK_SCORED}) GROUP BY ALL
""")
def label_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("doc_id", "idx", "label", F.col("model_label").alias("text"))
    return C.sections_of(rows, {"heading_1": "body", "references_title": "references", "acknowledgements_title": "thanks"})


@query(f"""
WITH s AS (SELECT doc_id, idx AS seq, label AS key FROM ({DUCK_SCORED})), h AS (SELECT doc_id, idx AS seq, CASE idx % 3 WHEN 0 THEN '' WHEN 1 THEN 'body' ELSE 'title' END AS key, said_label AS style FROM ({DUCK_SCORED}) WHERE idx < 12)
SELECT s.doc_id, s.seq, s.key, CASE WHEN h.key = '' OR h.key = s.key THEN h.style ELSE 'default' END AS style FROM s LEFT JOIN h USING (doc_id, seq)
""")
def segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    key = F.when(F.col("idx") % 3 == 0, "").when(F.col("idx") % 3 == 1, "body").otherwise("title")
    hints = scored.filter("idx < 12").select("doc_id", F.col("idx").alias("seq"), key.alias("key"), F.col("said_label").alias("style"))
    return C.aligned(scored.select("doc_id", F.col("idx").alias("seq"), F.col("label").alias("key")), hints)


@query(f"""
WITH r AS ({ROLES}), m(role, repair) AS (VALUES ('heading', 'style'), ('body_paragraph', 'style'), ('table_caption', 'caption'), ('figure_caption', 'caption'), ('table', 'layout'), ('references_title', 'style')), w(role, style) AS (VALUES ('heading', 'Heading 1'), ('table', 'Grid'))
SELECT doc_id, idx, role, repair, coalesce(style, '') AS style FROM r JOIN m USING (role) LEFT JOIN w USING (role)
""")
def repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.tables import rows

    return C.repair_targets(C.ast_roles(_theses(spark, sf_dir)), rows(spark, "('heading', 'Heading 1'), ('table', 'Grid')", "role, style"))


@query("""
SELECT id AS doc_id, 'artifact_missing' AS kind FROM (SELECT doc_id FROM documents) t(id) WHERE id % 4 = 0 UNION ALL SELECT id, 'steps_missing' FROM (SELECT doc_id FROM documents) t(id) WHERE id % 3 = 0
UNION ALL SELECT id, 'guard_missing:rewrite_text' FROM (SELECT doc_id FROM documents) t(id) WHERE id % 5 = 0 UNION ALL SELECT id, 'guard_missing:delete_paragraph' FROM (SELECT doc_id FROM documents) t(id) WHERE id % 5 < 2
""")
def contract_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 > 0, "fixed.docx").alias("artifact"),
        F.when(F.col("id") % 3 > 0, F.array(F.lit("verify"))).otherwise(F.array().cast("array<string>")).alias("steps"),
        F.when(F.col("id") % 5 == 1, F.array(F.lit("rewrite_text"))).when(F.col("id") % 5 > 1, F.array(F.lit("delete_paragraph"), F.lit("rewrite_text"))).alias("guards"),
    )
    return C.contract_faults(made)
