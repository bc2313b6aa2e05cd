"""Office packages written from the tables, then read by the office source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import packages
from quire.plans.packages import PACKAGES, VERIFIED
from quire.plans.registry import query
from quire.plans.scans import KEPT_LINES
from quire.sources import markup, office, registry
from quire.sources.tables import shared_folder, sql, table

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = '<Types><Default Extension="xml" ContentType="application/xml"/></Types>'


def _escaped(line):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(a), F.lit(b))
    return line


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package, part, content): each document as a package of three parts, its printable lines as paragraphs."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[\x20-\x7E]+\z"))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), _escaped(x), F.lit("</w:t></w:r></w:p>"))), "")
    document = F.concat(F.lit(f'<w:document xmlns:w="{NAMESPACE}"><w:body>'), F.coalesce(body, F.lit("")), F.lit("</w:body></w:document>"))
    core = F.concat(F.lit("<core><language>"), F.coalesce("lang", F.lit("")), F.lit("</language></core>"))
    parts = (("[Content_Types].xml", F.lit(TYPES)), ("word/document.xml", document), ("docProps/core.xml", core))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.encode(c, "UTF-8").alias("content")) for n, c in parts]))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("package"), each.alias("p")).select("package", "p.*")


def _doc_id(package: str = "package"):
    return F.regexp_extract(package, r"(-?\d+)\.docx$", 1).cast("long").alias("doc_id")


def _written(spark: SparkSession, parts: DataFrame) -> str:
    path = shared_folder(spark)
    office.write(parts, path, folders=True)
    return path


@query(rf"""
WITH d AS (SELECT doc_id, lang, '<w:document xmlns:w="{NAMESPACE}"><w:body>' || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[\x20-\x7E]+$')),
 lambda x: '<w:p><w:r><w:t xml:space="preserve">' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w:t></w:r></w:p>'), '') || '</w:body></w:document>' AS document FROM documents)
SELECT doc_id, 'word/document.xml' AS part, strlen(document) AS size FROM d UNION ALL SELECT doc_id, '[Content_Types].xml', {len(TYPES)} FROM d UNION ALL SELECT doc_id, 'docProps/core.xml', strlen('<core><language>' || coalesce(lang, '') || '</language></core>') FROM d
""")
def office_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of all packages with their sizes, none of them inflated."""
    found = office.read(spark, _written(spark, document_parts(spark, sf_dir)), content="false")
    return found.select(_doc_id(), "part", "size")


@query(f"SELECT doc_id, CAST(idx AS BIGINT) AS idx, 'p' AS kind, md5(text) AS digest FROM ({KEPT_LINES})")
def office_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body elements of all packages; of each only the document is inflated."""
    found = office.read(spark, _written(spark, document_parts(spark, sf_dir)), parts="word/document.xml").filter("fault IS NULL")
    bodies = found.select(_doc_id(), F.decode("content", "UTF-8").alias("document"))
    return markup.body_elements(bodies, "doc_id", "document").select("doc_id", F.col("idx").cast("long").alias("idx"), "kind", F.md5("text").alias("digest"))


@query(VERIFIED)
def office_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with all kinds of faults, written as files, read and verified."""
    parts = sql(spark, sf_dir, PACKAGES).select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("package"), F.col("part_name").alias("part"), F.encode("content", "UTF-8").alias("content"))
    found = office.read(spark, _written(spark, parts), strict="false").filter("fault IS NULL")
    return packages.verify(found.select(_doc_id(), F.col("part").alias("part_name"), F.decode("content", "UTF-8").alias("content")))


@query(rf"""
WITH p AS (SELECT doc_id * 3 + 1 AS id, text FROM documents)
SELECT id, 'rtf' AS format, count(*) AS n FROM (SELECT c_custkey * 3 + 2 AS id, unnest(['Hello ' || c_mktsegment, 'Next']) FROM customer) GROUP BY id
UNION ALL SELECT id, '' AS format, count(*) FROM (SELECT id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\v\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM p) WHERE regexp_matches(line, '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1C-\x1F\v]') GROUP BY id
""")
def sniffed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two formats in one table, each read by the parser of its own."""
    rtf = F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello {\b "), "c_mktsegment", F.lit(r"}\par Next}"))
    files = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select((F.col("doc_id") * 3 + 1).alias("id"), F.encode("text", "UTF-8").alias("content"))
    files = files.union(table(spark, sf_dir, "customer").select(F.col("c_custkey") * 3 + 2, F.encode(rtf, "UTF-8")))
    return registry.elements(files, "id", "content").groupBy("id", "format").agg(F.count(F.lit(1)).alias("n"))
