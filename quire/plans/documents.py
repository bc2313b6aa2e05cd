"""Document queries: lines of documents as paragraphs, and written-out rows where the tables lack the case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import formats, issues, paragraphs
from quire.operators.hierarchy import closure, inherited, paths
from quire.plans.registry import query
from quire.plans.text import RE2
from quire.sources.tables import sql, table

LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS text FROM documents"
TRIM = f"regexp_replace(text, '^[{RE2}]+|[{RE2}]+$', '', 'g')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraphs(table(spark, sf_dir, "documents"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with formats worked out from their place, as the tables hold none."""
    plain = _lines(spark, sf_dir).withColumns({"font_size_pt": F.when(F.col("idx") == 0, 16.0).otherwise(12.0), "is_bold": F.col("idx") % 7 == 0, "alignment": F.lit("left")})
    return paragraphs.with_features(plain)


@query(f"SELECT doc_id, idx, md5(text) AS digest FROM ({LINES})")
def paragraph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "idx", F.md5("text").alias("digest"))


FEATURES = rf"""
l AS (SELECT doc_id, idx, {TRIM} AS text, count(*) OVER (PARTITION BY doc_id) AS total FROM ({LINES})),
f AS (SELECT *, strlen(text) AS bytes, length(text) AS n, idx / total AS position, regexp_matches(text, '[。.]$') AS period, contains(text, chr(9)) AS tab,
 lower(text) AS low, CASE WHEN length(text) < 30 THEN replace(lower(text), ' ', '') ELSE lower(text) END AS compact,
 CASE WHEN contains(text, chr(9)) THEN regexp_matches(text, '\t\s*\d+\s*$') ELSE len(regexp_extract_all(text, '\.')) > 5 OR len(regexp_extract_all(text, '…')) > 2 OR len(regexp_extract_all(text, '·')) > 5 OR len(regexp_extract_all(text, '．')) >= 2 END AS toc,
 CASE WHEN idx = 0 THEN 16.0 ELSE 12.0 END AS size, idx % 7 = 0 AS bold,
 CASE WHEN regexp_matches(text, '^\d+\.\d+\.\d+') THEN 3 WHEN regexp_matches(text, '^[(]\d+[)]') THEN CASE WHEN length(regexp_replace(text, '^[(]\d+[)]', '')) <= 20 THEN 3 ELSE 0 END
  WHEN regexp_matches(text, '^\d+\.\d+') THEN 2 WHEN regexp_matches(text, '^\d+[、.]|^\d+ +[^\d ]') THEN 1 ELSE 0 END AS level FROM l)
"""


@query(f"WITH {FEATURES} SELECT doc_id, idx, bytes AS byte_length, n AS rune_length, round(position, 9) AS position, period AS ends_period, toc AS has_toc, tab AS has_tab, level FROM f")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("doc_id", "idx", "byte_length", "rune_length", F.round("position", 9).alias("position"), "ends_period", "has_toc", "has_tab", "level")


@query(rf"""
WITH {FEATURES},
h AS (SELECT *, greatest(least(0.90 + CASE level WHEN 1 THEN CASE WHEN size >= 15.5 THEN 0.05 WHEN size < 13 THEN -0.35 ELSE 0 END WHEN 2 THEN CASE WHEN size BETWEEN 14.5 AND 16 THEN 0.05 WHEN size < 13 THEN -0.30 ELSE 0 END
 WHEN 3 THEN CASE WHEN size < 12.5 THEN -0.20 ELSE 0 END ELSE 0 END + CASE WHEN bold THEN 0.04 WHEN level = 1 THEN -0.05 ELSE 0 END + CASE WHEN n < 50 THEN 0.02 ELSE 0 END
 + CASE WHEN period THEN -0.20 ELSE 0 END + CASE WHEN n > 80 THEN -0.25 ELSE 0 END, 1.0), 0.5) AS sure FROM f)
SELECT doc_id, idx, CASE WHEN n = 0 THEN 'body' WHEN toc THEN 'table_of_contents' WHEN contains(low, 'abstract') THEN CASE WHEN bytes < 30 THEN 'en_abstract_title' ELSE 'en_abstract' END
 WHEN regexp_matches(low, 'key ?words') THEN 'en_keywords' WHEN level > 0 THEN CASE WHEN sure < 0.65 THEN 'body' ELSE 'heading_' || level END
 WHEN contains(low, 'references') THEN CASE WHEN n < 20 THEN 'references_title' ELSE 'references' END
 WHEN bytes >= 30 AND regexp_matches(text, '^(\[\d+\]|\d+\. )') THEN 'references' ELSE 'body' END AS label FROM h
""")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.with_rule_label(_features(spark, sf_dir)).select("doc_id", "idx", "label")


@query("""
SELECT conv_id, turn, role, lag(role, 1, '') OVER w AS prev_label, lead(role, 1, '') OVER w AS next_label FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.with_context(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "role", "prev_label", "next_label")


@query(f"""
WITH l AS (SELECT doc_id, idx, CASE WHEN length(text) > 60 THEN 'long' ELSE 'short' END AS label, round((length(text) % 100) / 100.0, 4) AS confidence FROM ({LINES})),
w AS (SELECT *, lag(label) OVER w AS p, lead(label) OVER w AS n, lag(confidence) OVER w AS pc, lead(confidence) OVER w AS nc FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, CASE WHEN p = n AND label <> p AND confidence < 0.9 THEN p ELSE label END AS label, CASE WHEN p = n AND label <> p AND confidence < 0.9 THEN least(pc, nc) ELSE confidence END AS confidence FROM w
""")
def neighbour_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    labelled = _lines(spark, sf_dir).select("doc_id", "idx", F.when(n > 60, "long").otherwise("short").alias("label"), F.round((n % 100) / 100, 4).alias("confidence"), F.lit(12.0).alias("font_size_pt"), F.lit(False).alias("is_bold"), F.lit("left").alias("alignment"))
    return paragraphs.smoothed(labelled, ["doc_id"], "idx").select("doc_id", "idx", "label", "confidence")


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS since FROM conversations
""")
def sticky_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("role") == "user", F.col("turn"))
    return paragraphs.carried(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", marker, "since", -1).select("conv_id", "turn", "since")


LABELLED = """
SELECT d.i AS doc_id, k.i AS idx, CASE (d.i * 5 + k.i * (1 + d.i % 4)) % 14 WHEN 0 THEN 'cover' WHEN 1 THEN 'abstract_title' WHEN 2 THEN 'abstract' WHEN 3 THEN 'en_abstract' WHEN 4 THEN 'en_keywords' WHEN 5 THEN 'table_of_contents_title' WHEN 6 THEN 'table_of_contents'
  WHEN 7 THEN 'heading_1' WHEN 8 THEN 'heading_2' WHEN 9 THEN 'references_title' WHEN 10 THEN 'title' WHEN 11 THEN 'references' ELSE 'body' END AS label,
 CASE (d.i + k.i * 3) % 11 WHEN 0 THEN CASE WHEN k.i > 15 THEN '附录 A' ELSE 'x' END WHEN 1 THEN CASE WHEN k.i > 12 THEN 'Acknowledgements' ELSE 'y' END WHEN 2 THEN 'a........1' WHEN 3 THEN 'An appendix that is much too long to be a heading' ELSE 'text' END AS text
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(25) AS k(i)
"""


@query(rf"""
WITH RECURSIVE l AS (SELECT *, lower(text) AS low, label LIKE 'heading\_%' ESCAPE '\' AS heads, len(regexp_extract_all(text, '\.')) > 5 AS toc FROM ({LABELLED})),
f AS (SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS idx, 0 AS zone, '' AS label FROM l UNION ALL SELECT l.doc_id, l.idx, CASE WHEN regexp_matches(low, '附录|appendix') AND length(text) <= 30 THEN 7 WHEN regexp_matches(low, '致谢|acknowledg') AND length(text) <= 20 THEN 6 WHEN zone = 5 AND heads AND NOT toc THEN 4
  WHEN zone <= 0 AND l.label IN ('abstract', 'abstract_title') THEN 1 WHEN zone <= 1 AND l.label IN ('en_abstract', 'en_abstract_title', 'en_keywords') THEN 2 WHEN zone <= 2 AND l.label IN ('table_of_contents', 'table_of_contents_title') THEN 3
  WHEN zone <= 3 AND (heads OR l.label = 'body') AND NOT toc THEN CASE WHEN zone = 0 AND l.label = 'body' THEN zone ELSE 4 END WHEN zone = 4 AND l.label = 'references_title' AND NOT toc THEN 5 ELSE zone END, l.label FROM f JOIN l ON l.doc_id = f.doc_id AND l.idx = f.idx + 1),
m(z, label, new) AS (VALUES {', '.join(f"({paragraphs.ZONES.index(z)}, '{a}', '{b}')" for z, t in paragraphs.RELABEL.items() for a, b in t.items())})
SELECT doc_id, idx, [{', '.join(f"'{z}'" for z in paragraphs.ZONES)}][zone + 1] AS zone, coalesce(new, f.label) AS label FROM f LEFT JOIN m ON m.z = f.zone AND m.label = f.label WHERE idx >= 0
""")
def zone_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.zones(sql(spark, sf_dir, LABELLED))


CAPTIONED = """
SELECT d.i AS doc_id, k.i AS idx, concat(CASE (d.i + k.i) % 3 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Table ' ELSE '图' END, CASE (d.i + CAST(floor(k.i / 4) AS INT)) % 4 WHEN 0 THEN '1-' WHEN 1 THEN '2.' ELSE '' END, CAST(CAST(floor(k.i / 3) AS INT) + 1 - CASE WHEN d.i % 5 = 0 THEN 1 ELSE 0 END AS STRING), CASE WHEN d.i % 7 = 3 AND k.i = 2 THEN '99999999999' ELSE ' caption' END) AS text
FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(12) AS k(i) UNION ALL SELECT i, 50, 'plain' FROM (SELECT doc_id FROM documents) AS t(i)
"""


@query(rf"""
WITH p AS (SELECT doc_id, idx, regexp_extract(text, '^(图|表|Figure|Table) *(?:(\d+)([.-]))?(\d+)', ['label', 'chapter', 'mark', 'n']) AS p FROM ({CAPTIONED})),
c AS (SELECT doc_id, idx, p.label AS label, p.mark AS mark, p.chapter AS chapter, TRY_CAST(p.n AS INT) AS ordinal FROM p WHERE p.label <> ''),
e AS (SELECT *, coalesce(max(ordinal) OVER (PARTITION BY doc_id, label, mark, chapter ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS expected FROM c),
g AS (SELECT doc_id, label, min(idx) AS idx, count(DISTINCT mark) AS forms, bool_or(mark = '') AS simple FROM c GROUP BY doc_id, label)
SELECT doc_id, idx, 'caption_number_sequence' AS kind FROM e WHERE ordinal <= 0 OR ordinal <> expected UNION ALL SELECT doc_id, idx, 'caption_numbering_mixed_format' FROM g WHERE forms > 1 UNION ALL SELECT doc_id, idx, 'caption_missing_chapter_number' FROM g WHERE forms > 1 AND simple
""")
def caption_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.caption_issues(sql(spark, sf_dir, CAPTIONED))


@query(rf"""
WITH l AS (SELECT *, coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY idx), '[.!?。！？]\s*$'), true) AS begins FROM ({LINES})),
i AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM l)
SELECT doc_id, min(idx) AS first_idx, md5(string_agg(text, ' ' ORDER BY idx)) AS digest FROM i GROUP BY doc_id, island
""")
def fragment_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.coalesced(_lines(spark, sf_dir), ["doc_id"], "idx", "text").select("doc_id", "first_idx", F.md5("text").alias("digest"))


@query(rf"""
SELECT doc_id, count(*) AS n_references, round(count(*) FILTER (CAST(nullif(regexp_extract(text, '20[2-3]\d'), '') AS INT) >= 2020) / count(*), 6) AS recent_share,
 round(count(*) FILTER (len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[^\x00-\x7F{RE2}]'))) / count(*), 6) AS foreign_share FROM ({LINES}) GROUP BY doc_id
""")
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.reference_stats(_lines(spark, sf_dir))


@query(f"""
SELECT doc_id, idx, CAST(coalesce(sum(CAST(text = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section FROM ({LINES})
""")
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.sections(_lines(spark, sf_dir), F.col("text") == "").select("doc_id", "idx", "section")


@query(f"""
SELECT doc_id, coalesce(min(idx) FILTER (length(text) > 80), -1) AS first_long, coalesce(min(idx) FILTER (text LIKE '%the%'), -1) AS first_the FROM ({LINES}) GROUP BY doc_id
""")
def front_and_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.first_rows(_lines(spark, sf_dir), {"first_long": F.length("text") > 80, "first_the": F.col("text").like("%the%")})


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, l_shipmode_stand AS f, count(*) AS n FROM (SELECT *, CAST(l_quantity AS BIGINT) AS l_shipmode_stand FROM lineitem) GROUP BY ALL),
k AS (SELECT l_returnflag, l_linestatus, arg_min(f, (-n, f)) AS quantity FROM m WHERE f IS NOT NULL GROUP BY ALL),
a AS (SELECT l_returnflag, l_linestatus, CAST(floor(sum(l_linenumber) / count(*)) AS BIGINT) AS l_linenumber, count(*) FILTER (l_discount > 0.05) * 2 > count(*) AS discounted FROM lineitem GROUP BY ALL)
SELECT * FROM a JOIN k USING (l_returnflag, l_linestatus)
""")
def consensus_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").withColumns({"quantity": F.col("l_quantity").cast("long"), "discounted": F.col("l_discount") > 0.05})
    return formats.consensus(samples, ["l_returnflag", "l_linestatus"], ["quantity"], ["l_linenumber"], ["discounted"])


SPEC_COLUMNS = ("font_east_asia", "font_ascii", "size_half_pt", "bold", "alignment", "line", "space_before", "space_after", "first_line_indent")
SPECS = """
SELECT i AS id, CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'SimSun' ELSE 'Hei' END AS e_font_east_asia, CASE i % 3 WHEN 0 THEN 'Times' END AS e_font_ascii, CASE i % 5 WHEN 0 THEN 0 ELSE 24 + i % 3 END AS e_size_half_pt, i % 2 = 0 AS e_bold, CASE i % 3 WHEN 0 THEN 'left' ELSE '' END AS e_alignment,
 i % 7 * 100 AS e_line, i % 3 * 20 AS e_space_before, i % 2 * 30 AS e_space_after, i % 5 * 100 AS e_first_line_indent, CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SimSun' ELSE 'Hei' END AS a_font_east_asia, CASE i % 7 WHEN 0 THEN 'Times' ELSE 'Arial' END AS a_font_ascii, 23 + i % 4 AS a_size_half_pt,
 i % 3 = 0 AS a_bold, CASE i % 4 WHEN 0 THEN 'left' WHEN 1 THEN NULL ELSE 'center' END AS a_alignment, i % 7 * 100 + i % 30 AS a_line, CASE WHEN i % 6 = 0 THEN NULL ELSE i % 4 * 20 END AS a_space_before, i % 3 * 25 AS a_space_after, i % 5 * 100 + i % 50 AS a_first_line_indent FROM (SELECT p_partkey FROM part) AS t(i)
"""


def _compared() -> str:
    out = []
    for name, severity, tolerance in formats.ATTRIBUTES:
        given = "true" if name == "bold" else f"e_{name} <> ''" if tolerance is None else f"e_{name} <> 0"
        differs = f"e_{name} IS DISTINCT FROM a_{name}" if tolerance is None else f"abs(e_{name} - coalesce(a_{name}, 0)) > {tolerance}"
        out.append(f"SELECT id, '{name}' AS attribute, '{severity}' AS severity, CAST(e_{name} AS VARCHAR) AS wanted, CAST(a_{name} AS VARCHAR) AS found FROM s WHERE e_{name} IS NOT NULL AND {given} AND {differs}")
    return " UNION ALL ".join(out)


@query(f"WITH s AS ({SPECS}) {_compared()}")
def spec_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in SPEC_COLUMNS])
    return formats.spec_diff(sql(spark, sf_dir, SPECS).select("id", side("e").alias("expected"), side("a").alias("actual")))


@query(f"""
WITH l AS (SELECT *, length(text) % 3 AS font, length(text) % 4 AS line FROM ({LINES})),
p AS (SELECT doc_id, max(CAST(contains(lower(text), 'the') AS INT)) + max(CAST(contains(lower(text), 'of') AS INT)) + max(CAST(contains(lower(text), 'and') AS INT)) AS have,
 count(*) FILTER (regexp_matches(text, '^[A-Z]')) AS numbered, least(count(*) FILTER (length(text) > 400) * 5 + count(*) FILTER (text = '') * 2, 100) AS penalty, 100.0 * count(*) FILTER (length(text) <= 400 AND text <> '') / count(*) AS compliance FROM l GROUP BY doc_id),
f AS (SELECT doc_id, round(100.0 * max(n) / sum(n), 6) AS font FROM (SELECT doc_id, font, count(*) AS n FROM l GROUP BY ALL) GROUP BY doc_id), g AS (SELECT doc_id, round(100.0 * max(n) / sum(n), 6) AS spacing FROM (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL) GROUP BY doc_id),
s AS (SELECT *, (have / 3 * 0.6 + least(numbered / 3, 1.0) * 0.4) * 100 AS structure, 100 - penalty AS issues FROM p JOIN f USING (doc_id) JOIN g USING (doc_id))
SELECT doc_id, font, spacing, round(structure, 4) AS structure, issues, round(font * 0.25 + spacing * 0.2 + structure * 0.25 + compliance * 0.15 + issues * 0.15, 4) AS score FROM s
""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts and line spacings, which the tables lack, are stood for by the lengths of lines."""
    low = F.lower("text")
    held = lambda w: F.max(F.contains(low, F.lit(w)).cast("int"))
    long, blank = F.length("text") > 400, F.col("text") == ""
    penalty = F.count_if(long) * formats.PENALTIES["warning"] + F.count_if(blank) * formats.PENALTIES["info"]
    lines = _lines(spark, sf_dir).withColumns({"font": F.length("text") % 3, "line": F.length("text") % 4})
    counted = lines.groupBy("doc_id").agg(
        (held("the") + held("of") + held("and")).alias("have"), F.count_if(F.col("text").rlike("^[A-Z]")).alias("numbered"), penalty.alias("penalty"), (F.count_if(~long & ~blank) * 100.0 / F.count(F.lit(1))).alias("compliance")
    )
    shares = formats.modal_share(lines, ["doc_id"], "font", "font").join(formats.modal_share(lines, ["doc_id"], "line", "spacing"), "doc_id")
    scored = counted.join(shares, "doc_id").withColumns({"structure": formats.structure_score(F.col("have"), F.col("numbered")), "issues": formats.issue_score(F.col("penalty"))})
    total = formats.overall({name: F.col(name) for name in formats.WEIGHTS})
    return scored.select("doc_id", "font", "spacing", F.round("structure", 4).alias("structure"), "issues", F.round(total, 4).alias("score"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, round(max(n) / sum(n) * 100, 6) AS score FROM c GROUP BY source
""")
def font_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.font_consistency(table(spark, sf_dir, "documents"), ["source"], "lang")


def found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the lines of all documents, all rules in one pass."""
    text, place = F.col("text"), F.lpad(F.col("idx").cast("string"), 6, "0")
    rules = [
        ("placeholder", issues.REPAIRABLE, text.contains("{{"), place),
        ("long_paragraph", issues.FATAL, F.length(text) > 600, place),
        ("short_paragraph", issues.WARNING, F.octet_length(T.uni_trim(text)) < 20, place),
        ("digits", F.when(F.col("idx") % 2 == 0, issues.REPAIRABLE).otherwise(issues.WARNING), text.rlike(r"\d{3,}"), place),
    ]
    return issues.checked(_lines(spark, sf_dir), ["doc_id"], rules)


ISSUES = rf"""
l AS (SELECT doc_id, lpad(CAST(idx AS VARCHAR), 6, '0') AS target, text FROM ({LINES})),
i AS (SELECT doc_id, 'placeholder' AS kind, 'repairable' AS severity, target FROM l WHERE contains(text, '{{{{') UNION ALL SELECT doc_id, 'long_paragraph', 'fatal', target FROM l WHERE length(text) > 600
 UNION ALL SELECT doc_id, 'short_paragraph', 'warning', target FROM l WHERE strlen({TRIM}) < 20 UNION ALL SELECT doc_id, 'digits', CASE WHEN CAST(target AS INT) % 2 = 0 THEN 'repairable' ELSE 'warning' END, target FROM l WHERE regexp_matches(text, '\d{{3,}}'))
"""


@query(f"WITH {ISSUES} SELECT doc_id, count(*) AS total, count(*) FILTER (severity = 'fatal') AS n_fatal, count(*) FILTER (severity = 'repairable') AS n_repairable, count(*) FILTER (severity = 'warning') AS n_warning FROM i GROUP BY doc_id")
def issue_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.relational import histogram

    return histogram(found_issues(spark, sf_dir), ["doc_id"], "severity", ["fatal", "repairable", "warning"])


@query(f"WITH {ISSUES} SELECT doc_id, kind, arg_min(severity, target) AS severity, min(target) AS target FROM i GROUP BY doc_id, kind")
def issue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.once_per_kind(found_issues(spark, sf_dir), ["doc_id"])


@query(f"""
WITH {ISSUES} SELECT d.doc_id, CASE WHEN bool_or(severity = 'fatal') THEN 'rejected' WHEN bool_or(severity = 'repairable') THEN 'review_required' ELSE 'compliant' END AS status FROM documents d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id
""")
def compliance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.status(found_issues(spark, sf_dir), table(spark, sf_dir, "documents"), ["doc_id"])


@query(f"WITH {ISSUES} SELECT doc_id, md5(string_agg(kind || '|' || target, chr(10) ORDER BY kind || '|' || target)) AS fingerprint FROM i GROUP BY doc_id")
def issue_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.fingerprint(found_issues(spark, sf_dir), ["doc_id"]).withColumn("fingerprint", F.md5("fingerprint"))


KEYWORD_LINES = "SELECT i AS id, concat(repeat('词；', CAST(i % 7 AS INT)), CASE i % 5 WHEN 0 THEN '末' WHEN 1 THEN 'a, b' WHEN 2 THEN '。' WHEN 3 THEN ' ；last' ELSE 'x;y' END) AS line FROM (SELECT p_partkey FROM part) AS t(i)"


@query(f"""
SELECT id, CASE WHEN regexp_matches(line, '[,，]|[.。]$') THEN 1 WHEN len(list_filter(regexp_split_to_array(line, '[；;]'), lambda k: trim(k) <> '')) NOT BETWEEN 3 AND 5 THEN 1 ELSE 0 END AS violations FROM ({KEYWORD_LINES})
""")
def rule_pack_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, KEYWORD_LINES).select("id", issues.keyword_violations(F.col("line"), 3, 5).alias("violations"))


USED = "SELECT l_orderkey AS doc_id, concat('s', CAST(l_partkey % 5 AS STRING)) AS id FROM lineitem"
#: References and definitions that one task compares, about 150 bytes each.
TOGETHER = 1 << 20
DEFINED = "SELECT o_orderkey AS doc_id, concat('s', CAST((o_custkey + i) % 5 AS STRING)) AS id FROM orders CROSS JOIN (VALUES (0), (1), (2)) AS k(i)"


@query(f"""
SELECT DISTINCT doc_id, 'style_reference_missing' AS kind, 'repairable' AS severity, id AS target FROM ({USED}) u WHERE (doc_id, id) NOT IN (SELECT doc_id, id FROM ({DEFINED}) d)
UNION ALL SELECT DISTINCT coalesce(u.doc_id, d.doc_id), 'bookmark_pair_missing', 'repairable', coalesce(u.id, d.id) FROM ({USED}) u FULL JOIN ({DEFINED}) d ON u.doc_id = d.doc_id AND u.id = d.id WHERE u.id IS NULL OR d.id IS NULL
""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").count() + 3 * table(spark, sf_dir, "orders").count()
    found = issues.sides(sql(spark, sf_dir, USED), sql(spark, sf_dir, DEFINED), ["doc_id", "id"], 1 + rows // TOGETHER)
    lacks, alone = F.col("used") & ~F.col("defined"), F.col("used") != F.col("defined")
    return issues.checked(found, ["doc_id"], [("style_reference_missing", "repairable", lacks, F.col("id")), ("bookmark_pair_missing", "repairable", alone, F.col("id"))])


@query("""
SELECT l_orderkey AS doc_id, 'page_footer_total_mismatch' AS kind, 'error' AS severity, CAST(total AS VARCHAR) AS target FROM (SELECT l_orderkey, max(l_linenumber) AS current, max(l_orderkey % 7 + 1) AS total FROM lineitem GROUP BY l_orderkey) WHERE current <> total
""")
def footer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("current"), (F.col("l_orderkey") % 7 + 1).alias("total"))
    return issues.footer_totals(pages)


#: Chains of styles, some of which end in a loop.
STYLES = """
SELECT i AS style_id, CASE WHEN i % 10 = 0 AND i > 0 THEN CASE WHEN i % 20 = 0 THEN i + 3 END WHEN i > 0 THEN i - 1 END AS based_on, CASE i % 4 WHEN 0 THEN concat('font', CAST(i AS STRING)) WHEN 1 THEN '' END AS font, CASE i % 3 WHEN 1 THEN i END AS size, CASE i % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS bold FROM (SELECT p_partkey - 1 FROM part) AS t(i)
"""


@query(f"""
WITH RECURSIVE s AS ({STYLES}), c AS (SELECT style_id AS node, style_id AS at, 0 AS depth FROM s UNION ALL SELECT node, s.based_on, depth + 1 FROM c JOIN s ON s.style_id = c.at WHERE s.based_on IS NOT NULL AND depth < 30)
SELECT node AS style_id, arg_min(font, depth) FILTER (font <> '') AS font, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, coalesce(bool_or(bold), false) AS bold FROM c JOIN s ON s.style_id = c.at GROUP BY node
""")
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherited(sql(spark, sf_dir, STYLES), "style_id", "based_on", ["font", "size"], ["bold"])


ROLES = "(1, NULL, 'root'), (2, 1, 'admin'), (3, 2, 'editor'), (4, 1, 'viewer'), (5, 3, 'author')"
#: Trees of forty parts each, where a node has two children.
TREES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 40 > 1 THEN p_partkey - p_partkey % 40 + CAST(floor((p_partkey % 40) / 2) AS BIGINT) END AS parent, p_brand AS code FROM part"


@query(f"""
WITH RECURSIVE r AS (SELECT id AS node, id AS ancestor, 0 AS depth FROM ({TREES}) t UNION ALL SELECT r.node, t.parent, depth + 1 FROM r JOIN ({TREES}) t ON t.id = r.ancestor WHERE t.parent IS NOT NULL)
SELECT * FROM r
""")
def role_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(sql(spark, sf_dir, TREES), "id", "parent")


@query(f"""
WITH RECURSIVE r AS (SELECT id, 0 AS depth, code AS path FROM ({TREES}) t WHERE parent IS NULL UNION ALL SELECT t.id, depth + 1, path || '/' || t.code FROM r JOIN ({TREES}) t ON t.parent = r.id)
SELECT * FROM r
""")
def menu_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(sql(spark, sf_dir, TREES), "id", "parent", "code")


@query("""
SELECT category, coalesce(CASE WHEN category % 3 = 0 THEN concat('c', category) END, CASE WHEN category % 2 = 0 THEN concat('b', category) END, concat('a', category)) AS font, coalesce(CASE WHEN category % 5 = 0 AND category % 3 = 0 THEN 30 END, CASE WHEN category % 2 = 0 AND category % 4 = 0 THEN 20 END, 10) AS size FROM (SELECT p_partkey FROM part) t(category)
""")
def rule_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda letter: F.concat(F.lit(letter), F.col("id").cast("string")).alias("font")
    every, key = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), F.col("id").alias("category")
    low = every.select(key, named("a"), F.lit(10).alias("size"))
    middle = every.filter("id % 2 = 0").select(key, named("b"), F.when(F.col("id") % 4 == 0, 20).alias("size"))
    high = every.filter("id % 3 = 0").select(key, named("c"), F.when(F.col("id") % 5 == 0, 30).alias("size"))
    return formats.effective([low, middle, high], "category", ["font", "size"])


WANTED = "SELECT d.i AS doc_id, k.i AS idx, concat('t', CAST((d.i * 3 + k.i * (1 + d.i % 3)) % 5 AS STRING)) AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(3) AS k(i)"
WRITTEN = "SELECT d.i AS doc_id, k.i AS idx, concat('t', CAST((d.i + k.i * 2) % 5 AS STRING)) AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(8) AS k(i) WHERE k.i < 2 + d.i % 7"


@query(f"""
WITH RECURSIVE f AS (SELECT doc_id, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS done FROM (SELECT DISTINCT doc_id FROM ({WANTED})) UNION ALL SELECT b.doc_id, b.idx, done + CASE WHEN b.text = (SELECT a.text FROM ({WANTED}) a WHERE a.doc_id = f.doc_id AND a.idx = f.done) THEN 1 ELSE 0 END FROM f JOIN ({WRITTEN}) b ON b.doc_id = f.doc_id AND b.idx = f.idx + 1)
SELECT doc_id, max(done) = 3 AS found FROM f GROUP BY doc_id
""")
def ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.in_order(sql(spark, sf_dir, WANTED), sql(spark, sf_dir, WRITTEN))
