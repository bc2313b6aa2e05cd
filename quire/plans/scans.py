"""Sources and small operators that had no query of their own."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks, formats, paragraphs
from quire.operators import relational as R
from quire.plans.documents import LINES
from quire.plans.registry import query
from quire.plans.text import RE2
from quire.sources import markup
from quire.sources.tables import lookup, small_batches, table


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_custkey <= 77)")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(table(spark, sf_dir, "customer"), "c_custkey", 77).select("c_custkey", "c_name")


@query("SELECT 'all' AS scope, count(*) AS n FROM orders UNION ALL SELECT 'self', count(*) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'department', 0 UNION ALL SELECT 'custom', 0")
def closed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope that lacks what it needs shows nothing."""
    orders, out = table(spark, sf_dir, "orders"), None
    for scope in ("all", "self", "department", "custom"):
        n = R.data_scope(orders, scope, F.lit(7), "o_custkey", "o_shippriority").agg(F.count(F.lit(1)).alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = n if out is None else out.union(n)
    return out


@query(f"""
WITH l AS (SELECT *, sum(CAST(text <> '' AS INT)) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS steps FROM ({LINES})),
g AS (SELECT doc_id, idx AS gi, steps AS gs FROM l WHERE text LIKE '%of%'), n AS (SELECT l.doc_id, l.idx, l.steps, max(gi) AS gi, arg_max(gs, gi) AS gs FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND gi < idx WHERE text LIKE '%the%' GROUP BY ALL)
SELECT doc_id, idx, CASE WHEN gs - steps <= 8 THEN gi ELSE -1 END AS nearest FROM n
""")
def nearest_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs.paragraphs(table(spark, sf_dir, "documents"))
    return blocks.nearest(lines, ["doc_id"], "idx", F.col("text").like("%the%"), F.col("text").like("%of%"), F.col("text") != "", back=True).fillna(-1, ["nearest"])


@query(f"""
WITH l AS (SELECT *, regexp_replace(text, '^[{RE2}]+|[{RE2}]+$', '', 'g') AS t FROM ({LINES}))
SELECT doc_id, idx, md5((SELECT arg_min(n.text, n.idx) FROM l n WHERE n.doc_id = l.doc_id AND n.idx > l.idx AND n.t <> '')) AS after FROM l
""")
def next_non_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.next_non_blank(paragraphs.paragraphs(table(spark, sf_dir, "documents")), ["doc_id"], "idx", "text", "after")
    return found.select("doc_id", "idx", F.md5("after").alias("after"))


@query("SELECT p_partkey, CASE WHEN s >= 95 THEN 95 WHEN s >= 90 THEN 85 WHEN s >= 80 THEN 70 WHEN s >= 70 THEN 50 WHEN s >= 60 THEN 30 ELSE 10 END AS band, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT p_partkey, p_size + 50 AS s FROM part)")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("p_size") + 50
    return table(spark, sf_dir, "part").select("p_partkey", formats.percentile_band(score).alias("band"), formats.grade(score).alias("grade"))


@query(rf"""
WITH q AS (SELECT doc_id, text, regexp_replace(text, '[{RE2}]+', '', 'g') AS seen FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{RE2}]+|[{RE2}]+$', '', 'g')) AS collapsed, length(seen) > 0 AND len(regexp_extract_all(seen, '[\x00-\x7F]')) * 2 >= length(seen) AS mostly_ascii,
 round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}]')) / length(text) ELSE 0 END, 6) AS han_ratio, CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS preview FROM q
""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapsed(s)).alias("collapsed"), T.mostly_ascii(s).alias("mostly_ascii"), F.round(T.han_ratio(s), 6).alias("han_ratio"), T.shortened(s, 160).alias("preview"))


@query("""
WITH b AS (SELECT doc_id, idx, text FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS idx, unnest(p) AS text FROM (SELECT doc_id, CASE WHEN len(parts) <= 1 THEN lines ELSE parts END AS p FROM
 (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS lines FROM documents))))
SELECT doc_id, idx, md5(text) AS digest FROM b
""".replace("\\\\", "\\"))
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraph_chunks(F.col("text"))).alias("idx", "text"))
    return found.select("doc_id", "idx", F.md5("text").alias("digest"))


def _package(lines: list[str]) -> bytes:
    """A package with a paragraph for each line, every third in a table, with a tracked deletion after each."""
    from html import escape

    parts = []
    for i, line in enumerate(lines):
        p = f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r><w:del w:id="1"><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
        parts.append(f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr></w:tbl>" if i % 3 == 2 else p)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="x"><w:body>{"".join(parts)}</w:body></w:document>')
    return out.getvalue()


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def packed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: _package(list(x)))

    kept = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[\x20-\x7E]+$"))
    return small_batches(table(spark, sf_dir, "documents")).select("doc_id", packed(kept).alias("package"))


KEPT_LINES = rf"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, text FROM ({LINES}) WHERE regexp_matches(text, '^[\x20-\x7E]+$')"


@query(f"SELECT doc_id, idx, CASE WHEN idx % 3 = 2 THEN 'tbl' ELSE 'p' END AS kind, md5(text) AS digest FROM ({KEPT_LINES})")
def docx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as office packages, read back as body elements."""
    found = markup.docx_paragraphs(_packages(spark, sf_dir), "doc_id", "package")
    return found.select("doc_id", "idx", "kind", F.md5("text").alias("digest"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'not a package' WHEN 2 THEN 'missing part' ELSE 'not a package' END AS why FROM documents
""")
def package_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("other.xml", "<x/>")

    @F.pandas_udf("string")
    def why(packages: pd.Series) -> pd.Series:
        return packages.map(markup.unsafe)

    given = F.when(F.col("doc_id") % 4 == 0, F.col("package")).when(F.col("doc_id") % 4 == 1, F.lit(b"no zip")).when(F.col("doc_id") % 4 == 2, F.lit(broken.getvalue()))
    return _packages(spark, sf_dir).select("doc_id", why(given).alias("why"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of each key; later ones change nothing."""
    events = table(spark, sf_dir, "events")
    return R.latest_per_key(events, ["user_id", "event_type"], [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")], ["event_id"]).select("event_id", "user_id")
