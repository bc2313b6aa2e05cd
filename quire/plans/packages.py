"""Package queries over generated packages, in SQL that Spark and DuckDB share; each package misses something else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators import packages
from quire.plans.registry import query
from quire.plans.text import RE2
from quire.sources.tables import sql

PACKAGES = f"""
SELECT i AS doc_id, p AS part_name, CASE p
 WHEN 'word/document.xml' THEN CASE WHEN i % 41 = 0 THEN '<w:document/>' ELSE concat('<w:document xmlns:w="x"><w:body>',
  CASE i % 6 WHEN 0 THEN '<w:r w:rsidR="1"><w:r w:rsidR="2"><w:t>a</w:t></w:r></w:r>' WHEN 1 THEN '<w:r><w:pict><w:txbxContent><w:r><w:t>box</w:t></w:r></w:txbxContent></w:pict></w:r>'
   WHEN 2 THEN '<w:r><w:rPr><w:bookmarkStart w:id="9" w:name="in"/></w:rPr></w:r><w:bookmarkEnd w:id="9"/>' WHEN 3 THEN '<w:rPr><w:bookmarkStart w:id="8" w:name="out"/></w:rPr><w:bookmarkEnd w:id="8"/>' WHEN 4 THEN '<w:r/><w:r><w:t>b</w:t></w:r>' ELSE '<w:t>plain</w:t>' END,
  CASE i % 4 WHEN 0 THEN '<w:pStyle w:val="Gone"/>' WHEN 1 THEN '<w:pStyle w:val="Body"/><w:numId w:val="1"/>' WHEN 2 THEN '<w:rStyle w:val="Lost"/><w:numId w:val="7"/>' ELSE '' END,
  CASE i % 5 WHEN 0 THEN '<w:ins w:id="1"><w:t>new</w:t></w:ins>' WHEN 1 THEN '<w:commentRangeStart w:id="0"/>' WHEN 2 THEN '<w:jc w:val="start"/>' WHEN 3 THEN '<w:t>{{{{name}}}}</w:t>' ELSE '<w:insideH/>' END,
  CASE i % 7 WHEN 0 THEN '<w:headerReference w:type="even" r:id="h1"/>' WHEN 1 THEN '<w:footerReference r:id="h1"/>' WHEN 2 THEN '<w:headerReference r:id="none"/>' ELSE '' END,
  CASE i % 8 WHEN 0 THEN '<w:instrText> REF gone </w:instrText>' WHEN 1 THEN '<w:instrText>PAGEREF in</w:instrText>' WHEN 2 THEN '<w:instrText>REF _Toc1</w:instrText>' WHEN 3 THEN '<w:instrText>SEQ x</w:instrText>' WHEN 4 THEN '<w:bookmarkStart w:id="5" w:name="five"/>' WHEN 5 THEN '<w:bookmarkEnd w:id="6"/>' ELSE '' END,
  CASE i % 9 WHEN 0 THEN '<w:footnoteReference w:id="1"/>' WHEN 1 THEN '<w:footnoteReference w:id="2"/>' ELSE '' END, '</w:body></w:document>') END
 WHEN 'word/styles.xml' THEN CASE WHEN i % 10 = 3 THEN '<w:styles/>' ELSE '<w:style w:type="p" w:styleId="Body"/>' END
 WHEN 'word/numbering.xml' THEN CASE WHEN i % 11 = 0 THEN '<w:num w:numId="1"><w:abstractNumId w:val="3"/></w:num>' ELSE '<w:abstractNum w:abstractNumId="0"/><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>' END
 WHEN 'word/settings.xml' THEN CASE i % 3 WHEN 0 THEN '<w:updateFields/>' WHEN 1 THEN '<w:evenAndOddHeaders/>' ELSE '<w:settings/>' END
 WHEN 'word/footnotes.xml' THEN '<w:footnote w:id="-1"/><w:footnote w:id="1"/>'
 WHEN 'word/comments.xml' THEN '<w:comments/>'
 WHEN 'word/header1.xml' THEN '<w:hdr xmlns:w="x"><w:r><w:t>h</w:t></w:r></w:hdr>'
 WHEN '[Content_Types].xml' THEN concat('<Default Extension="PNG"/><Override PartName="/word/styles.xml" ContentType="wordprocessingml.styles+xml"/>', CASE WHEN i % 4 = 0 THEN '<Override PartName="/word/media/b.gif" ContentType="image/gif"/>' ELSE '' END, CASE WHEN i % 2 = 0 THEN '<Override PartName="/word/header1.xml" ContentType="wordprocessingml.header+xml"/><Override PartName="/word/numbering.xml" ContentType="wordprocessingml.numbering+xml"/>' ELSE '' END)
 WHEN 'word/_rels/document.xml.rels' THEN concat('<Relationship Id="s" Type="x/relationships/styles" Target="styles.xml"/><Relationship Id="h1" Type="x/relationships/header" Target="header1.xml"/>',
  CASE i % 4 WHEN 0 THEN '<Relationship Id="m" Type="x/relationships/image" Target="media/a.png"/>' WHEN 1 THEN '<Relationship Id="u" Type="x/relationships/link" Target="http://y" TargetMode="External"/>' WHEN 2 THEN '<Relationship Id="n" Type="x/relationships/numbering" Target="/word/numbering.xml"/>' ELSE '<Relationship Id="q" Type="x/relationships/custom" Target="../custom/z.xml"/>' END)
 WHEN '_rels/.rels' THEN '<Relationship Id="d" Type="x/relationships/officeDocument" Target="word/document.xml"/>'
 ELSE '' END AS content
FROM (SELECT doc_id FROM documents) AS t(i) CROSS JOIN (VALUES ('word/document.xml'), ('word/styles.xml'), ('word/numbering.xml'), ('word/settings.xml'), ('word/footnotes.xml'), ('word/comments.xml'), ('word/header1.xml'),
 ('[Content_Types].xml'), ('word/_rels/document.xml.rels'), ('_rels/.rels'), ('word/media/a.png'), ('word/media/b.gif')) AS q(p)
WHERE NOT (p = 'word/document.xml' AND i % 31 = 0) AND NOT (p = 'word/comments.xml' AND i % 6 > 0) AND NOT (p = 'word/footnotes.xml' AND i % 5 = 0) AND NOT (p = 'word/header1.xml' AND i % 13 = 0)
 AND NOT (p = 'word/numbering.xml' AND i % 17 = 0) AND NOT (p = 'word/media/b.gif' AND i % 3 > 0) AND NOT (p = 'word/media/a.png' AND i % 8 = 0)
"""

#: DuckDB: depths as running sums over the tags of a part.
STRUCTURE = r"""
tags AS (SELECT doc_id, part_name, unnest(regexp_extract_all(content, '</?w:(?:txbxContent|rPr|r|bookmarkStart)\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(content, '</?w:(?:txbxContent|rPr|r|bookmarkStart)\b[^>]*>'), 1) AS k FROM w WHERE contains(content, 'xmlns:w=')),
named AS (SELECT *, regexp_extract(tag, '^</?w:(\w+)', 1) AS name, CASE WHEN tag LIKE '</%' THEN -1 WHEN tag LIKE '%/>' THEN 0 ELSE 1 END AS step FROM tags),
depths AS (SELECT *, coalesce(sum(step) FILTER (name = 'r') OVER b, 0) AS run, coalesce(sum(step) FILTER (name = 'txbxContent') OVER b, 0) AS box FROM named WINDOW b AS (PARTITION BY doc_id, part_name ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
props AS (SELECT *, coalesce(sum(step) FILTER (name = 'rPr' AND run > 0) OVER (PARTITION BY doc_id, part_name ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS props FROM depths),
structure AS (
 SELECT DISTINCT doc_id, 'nested_word_run' AS kind, 'fatal' AS severity, part_name AS target FROM depths WHERE name = 'r' AND step >= 0 AND run > 0 AND box = 0
 UNION SELECT doc_id, 'bookmark_in_run_properties', 'fatal', part_name FROM props WHERE name = 'bookmarkStart' AND step >= 0 AND props > 0
 UNION SELECT doc_id, 'tracked_changes_not_finalized', 'repairable', part_name FROM w WHERE contains(content, 'xmlns:w=') AND regexp_matches(content, '<w:(ins|del|moveFrom|moveTo)[\s/>]')
 UNION SELECT doc_id, 'comments_not_finalized', 'repairable', part_name FROM w WHERE contains(content, 'xmlns:w=') AND regexp_matches(content, '<w:(commentRangeStart|commentReference)[\s/>]'))
"""


def _found(pattern: str, where: str) -> str:
    return f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(content, '{pattern}', 1)) AS v FROM {where}"


def _lacking(kind: str, used: str, defined: str, also: str = "true") -> str:
    return f"UNION SELECT doc_id, '{kind}', 'repairable', v FROM ({used}) u WHERE {also} AND NOT EXISTS (SELECT 1 FROM ({defined}) d WHERE d.doc_id = u.doc_id AND d.v = u.v)"


def _linked(part: str, kind: str, content_type: str, relation: str) -> str:
    short = part.removeprefix("word/")
    return f"""UNION SELECT p.doc_id, '{kind}_content_type_missing', 'repairable', '[Content_Types].xml' FROM p JOIN d USING (doc_id) WHERE part_name = '{part}' AND NOT (contains(types, 'PartName="/{part}"') AND contains(types, '{content_type}'))
UNION SELECT p.doc_id, '{kind}_relationship_missing', 'repairable', 'word/_rels/document.xml.rels' FROM p JOIN d USING (doc_id) WHERE part_name = '{part}' AND NOT (contains(links, '{relation}') AND contains(links, '{short}'))"""


WORD_BUT = "(SELECT * FROM w WHERE part_name <> '{}')"
ONLY = "(SELECT * FROM p WHERE part_name = '{}')"
STARTS, ENDS = (_found(x, "w") for x in (packages.BOOKMARK_START, packages.BOOKMARK_END))
MARKS = _found(r'<w:footnoteReference\b[^>]*\bw:id="([1-9]\d*)"', "w")
NOTES = _found(r'<w:footnote\b[^>]*\bw:id="([1-9]\d*)"', ONLY.format("word/footnotes.xml"))
VERIFIED = rf"""
WITH p AS ({PACKAGES}), w AS (SELECT * FROM p WHERE part_name LIKE 'word/%' AND part_name LIKE '%.xml'),
d AS (SELECT doc_id, max(CASE WHEN part_name = 'word/document.xml' THEN content END) AS document, coalesce(max(CASE WHEN part_name = 'word/settings.xml' THEN content END), '') AS settings,
 coalesce(max(CASE WHEN part_name = '[Content_Types].xml' THEN content END), '') AS types, coalesce(max(CASE WHEN part_name = 'word/_rels/document.xml.rels' THEN content END), '') AS links, bool_or(regexp_matches(content, '<w:instrText[^>]*>\s*(TOC|REF|PAGEREF|NOTEREF|SEQ)\b')) AS refreshed FROM p GROUP BY doc_id),
r AS (SELECT doc_id, part_name, regexp_extract(t, '\bId="([^"]*)"', 1) AS id, regexp_extract(t, '\bType="([^"]*)"', 1) AS type, regexp_extract(t, '\bTarget="([^"]*)"', 1) AS target, contains(t, 'External') AS external
 FROM (SELECT doc_id, part_name, unnest(regexp_extract_all(content, '<Relationship\b[^>]*>')) AS t FROM p WHERE part_name LIKE '%.rels')),
full_path AS (SELECT *, CASE WHEN target LIKE '/%' THEN substr(target, 2) WHEN target LIKE '../%' THEN substr(target, 4) WHEN part_name = '_rels/.rels' THEN target ELSE 'word/' || target END AS path FROM r),
refs AS (SELECT doc_id, regexp_extract(t, 'r:id="([^"]*)"', 1) AS id, regexp_extract(t, '<w:(header|footer)', 1) AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(content, '<w:(?:headerReference|footerReference)\b[^>]*/>')) AS t FROM p WHERE part_name = 'word/document.xml')),
{STRUCTURE}
SELECT * FROM structure
UNION SELECT doc_id, 'missing_document_xml', 'fatal', 'word/document.xml' FROM d WHERE document IS NULL
UNION SELECT doc_id, 'placeholder', 'repairable', 'word/document.xml' FROM d WHERE regexp_matches(document, '\{{\{{[^{{}}]+\}}\}}')
UNION SELECT doc_id, 'short_document', 'warning', 'word/document.xml' FROM d WHERE strlen(regexp_replace(document, '^[{RE2}]+|[{RE2}]+$', '', 'g')) < 20
UNION SELECT doc_id, 'renderer_incompatible_ooxml', 'fatal', part_name FROM w WHERE contains(content, 'w:val="start"')
UNION SELECT doc_id, 'comments_not_finalized', 'repairable', part_name FROM p WHERE part_name = 'word/comments.xml'
{_lacking("style_reference_missing", _found(packages.USED_STYLE, WORD_BUT.format("word/styles.xml")), _found(packages.DEFINED_STYLE, ONLY.format("word/styles.xml")), "doc_id IN (SELECT doc_id FROM p WHERE part_name = 'word/styles.xml' AND contains(content, 'w:styleId'))")}
{_lacking("numbering_abstract_missing", _found(packages.USED_ABSTRACT, ONLY.format("word/numbering.xml")), _found(packages.DEFINED_ABSTRACT, ONLY.format("word/numbering.xml")))}
{_lacking("numbering_reference_missing", _found(packages.USED_NUMBER, WORD_BUT.format("word/numbering.xml")), _found(packages.DEFINED_NUMBER, ONLY.format("word/numbering.xml")))}
{_lacking("bookmark_pair_missing", STARTS, ENDS)} {_lacking("bookmark_pair_missing", ENDS, STARTS)}
{_lacking("bookmark_reference_missing", _found(r"<w:instrText[^>]*>\s*(?:REF|PAGEREF|NOTEREF)\s+([^\\\s<]+)", "w"), _found(packages.BOOKMARK, "w"), "v NOT LIKE '\\_Toc%' ESCAPE '\\'")}
UNION SELECT doc_id, 'even_headers_not_enabled', 'repairable', 'word/settings.xml' FROM d WHERE contains(document, 'w:type="even"') AND NOT contains(settings, '<w:evenAndOddHeaders')
UNION SELECT doc_id, 'header_footer_reference_relationship_missing', 'repairable', id FROM refs WHERE (doc_id, id) NOT IN (SELECT doc_id, id FROM r WHERE part_name = 'word/_rels/document.xml.rels')
UNION SELECT refs.doc_id, 'header_footer_reference_type_mismatch', 'repairable', refs.id FROM refs JOIN r ON r.doc_id = refs.doc_id AND r.id = refs.id AND part_name = 'word/_rels/document.xml.rels' WHERE NOT contains(type, '/relationships/' || kind)
UNION SELECT doc_id, 'header_footer_content_type_missing', 'repairable', '[Content_Types].xml' FROM full_path JOIN d USING (doc_id) WHERE part_name = 'word/_rels/document.xml.rels' AND regexp_matches(type, '/relationships/(header|footer)') AND NOT (contains(types, 'PartName="/' || path || '"') AND contains(types, 'wordprocessingml.' || regexp_extract(type, '/relationships/(header|footer)', 1) || '+xml'))
UNION SELECT doc_id, 'media_content_type_missing', 'repairable', '[Content_Types].xml' FROM p JOIN d USING (doc_id) WHERE part_name LIKE 'word/media/%' AND NOT contains(types, 'PartName="/' || part_name || '"') AND NOT list_contains(list_transform(regexp_extract_all(types, '<Default\b[^>]*\bExtension="([^"]+)"', 1), lambda e: lower(e)), lower(regexp_extract(part_name, '\.([^.]*)$', 1)))
UNION SELECT doc_id, 'relationship_target_missing', 'repairable', target FROM full_path WHERE NOT external AND (doc_id, path) NOT IN (SELECT doc_id, part_name FROM p)
UNION SELECT doc_id, 'fields_not_marked_for_update', 'repairable', 'word/settings.xml' FROM d WHERE refreshed AND NOT contains(settings, '<w:updateFields')
{_lacking("footnotes_reference_missing_definition", MARKS, NOTES, "doc_id IN (SELECT doc_id FROM p WHERE part_name = 'word/footnotes.xml')").replace("'repairable', v", "'repairable', 'word/footnotes.xml'")}
{_lacking("footnotes_definition_unreferenced", NOTES, MARKS).replace("'repairable', v", "'repairable', 'word/footnotes.xml'")}
{chr(10).join(_linked(*x) for x in packages.LINKED_PARTS)}
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PACKAGES)


@query(f"WITH p AS ({PACKAGES}), w AS (SELECT * FROM p WHERE part_name LIKE 'word/%' AND part_name LIKE '%.xml'), {STRUCTURE} SELECT * FROM structure")
def part_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.structure(_parts(spark, sf_dir))


@query(VERIFIED)
def package_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.verify(_parts(spark, sf_dir))


@query(f"""
SELECT doc_id, CASE WHEN bool_or(severity = 'fatal') THEN 'rejected' WHEN bool_or(severity = 'repairable') THEN 'review_required' ELSE 'compliant' END AS status
FROM (SELECT DISTINCT doc_id FROM ({PACKAGES})) LEFT JOIN ({VERIFIED}) USING (doc_id) GROUP BY doc_id
""")
def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.verdicts(_parts(spark, sf_dir))
