"""Checks of office packages as rows of XML parts (doc_id, part_name, content): one pass over the parts, one row per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.issues import FATAL, REPAIRABLE, WARNING, checked, status

DOCUMENT, SETTINGS, STYLES, NUMBERING, TYPES, RELATIONS = "word/document.xml", "word/settings.xml", "word/styles.xml", "word/numbering.xml", "[Content_Types].xml", "word/_rels/document.xml.rels"
# Parts that must be declared and linked, with their issue name, content type and kind of relationship.
LINKED_PARTS = (
    ("word/styles.xml", "styles", "wordprocessingml.styles+xml", "/relationships/styles"),
    ("word/numbering.xml", "numbering", "wordprocessingml.numbering+xml", "/relationships/numbering"),
    ("word/fontTable.xml", "font_table", "wordprocessingml.fontTable+xml", "/relationships/fontTable"),
    ("word/theme/theme1.xml", "theme", "theme+xml", "/relationships/theme"),
    ("word/settings.xml", "settings", "wordprocessingml.settings+xml", "/relationships/settings"),
    ("word/webSettings.xml", "web_settings", "wordprocessingml.webSettings+xml", "/relationships/webSettings"),
    ("word/footnotes.xml", "footnotes", "wordprocessingml.footnotes+xml", "/relationships/footnotes"),
    ("word/endnotes.xml", "endnotes", "wordprocessingml.endnotes+xml", "/relationships/endnotes"),
)
# Patterns of what parts hold.
PLACEHOLDER = r"\{\{[^{}]+\}\}"
REFRESHED_FIELD = r"(?is)<w:instrText\b[^>]*>\s*(?:TOC|REF|PAGEREF|NOTEREF|SEQ)\b"
TOC_PAGE_ZERO = r'(?s)TOC \\o .*?<w:tab/>.*?<w:t>0</w:t>.*?w:fldCharType="end"'
USED_STYLE = r'<w:(?:pStyle|rStyle|tblStyle)\b[^>]*\bw:val="([^"]+)"'
DEFINED_STYLE = r'<w:style\b[^>]*\bw:styleId="([^"]+)"'
USED_NUMBER = r'<w:numId\b[^>]*\bw:val="([^"]+)"'
DEFINED_NUMBER = r'<w:num\b[^>]*\bw:numId="([^"]+)"'
USED_ABSTRACT = r'<w:abstractNumId\b[^>]*\bw:val="([^"]+)"'
DEFINED_ABSTRACT = r'<w:abstractNum\b[^>]*\bw:abstractNumId="([^"]+)"'
BOOKMARK = r'<w:bookmarkStart\b[^>]*\bw:name="([^"]+)"'
BOOKMARK_START = r'<w:bookmarkStart\b[^>]*\bw:id="([^"]+)"'
BOOKMARK_END = r'<w:bookmarkEnd\b[^>]*\bw:id="([^"]+)"'
FIELD_REFERENCE = r"(?is)<w:instrText\b[^>]*>\s*(?:REF|PAGEREF|NOTEREF)\s+([^\\\s<]+)"
HEADER_REFERENCE = r"<w:(?:headerReference|footerReference)\b[^>]*/>"
RELATION = r"<Relationship\b[^>]*>"
TAG = r"<(/?)w:(txbxContent|rPr|r|bookmarkStart)(?=[\s/>])[^>]*>"


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)


def nesting(content: Column) -> Column:
    """(nested, bookmark): a run that begins in a run outside of any text box, and a bookmark in a run's properties.

    One pass over the tags in order, with the depths of runs, properties and text boxes; a closed tag only ends what is open.
    """
    tags = F.transform(_all(content, TAG, 0), lambda t: F.struct(F.regexp_extract(t, TAG, 2).alias("name"), t.startswith("</").alias("ends"), t.endswith("/>").alias("alone")))

    def step(s: Column, t: Column) -> Column:
        begins = ~t["ends"]
        change = F.when(t["alone"], 0).when(begins, 1).otherwise(-1)
        depth = lambda name, counts: F.greatest(s[name] + F.when(counts, change).otherwise(0), F.lit(0)).alias(name)
        return F.struct(
            depth("run", t["name"] == "r"),
            depth("props", (t["name"] == "rPr") & (t["ends"] | (s["run"] > 0))),
            depth("box", t["name"] == "txbxContent"),
            (s["nested"] | (begins & (t["name"] == "r") & (s["run"] > 0) & (s["box"] == 0))).alias("nested"),
            (s["bookmark"] | (begins & (t["name"] == "bookmarkStart") & (s["props"] > 0))).alias("bookmark"),
        )

    start = F.struct(*[F.lit(0).alias(n) for n in ("run", "props", "box")], F.lit(False).alias("nested"), F.lit(False).alias("bookmark"))
    return F.aggregate(tags, start, step, lambda s: F.struct(s["nested"], s["bookmark"]))


def structure_rules(content: Column, nested: Column) -> list[tuple[str, str, Column]]:
    """(kind, severity, test) of an XML part of the word folder; nested: what `nesting` gives."""
    return [
        ("nested_word_run", FATAL, nested["nested"]),
        ("bookmark_in_run_properties", FATAL, nested["bookmark"]),
        ("tracked_changes_not_finalized", REPAIRABLE, content.rlike(r"<w:(ins|del|moveFrom|moveTo)(?=[\s/>])")),
        ("comments_not_finalized", REPAIRABLE, content.rlike(r"<w:(commentRangeStart|commentReference)(?=[\s/>])")),
    ]


def structure(parts: DataFrame) -> DataFrame:
    """(doc_id, kind, severity, target) of faults in the structure of XML parts of the word folder."""
    content = F.col("content")
    word = parts.filter(F.col("part_name").startswith("word/") & F.col("part_name").endswith(".xml") & F.contains(content, F.lit("xmlns:w="))).withColumn("nest", nesting(content))
    return checked(word, ["doc_id"], [(kind, severity, test, F.col("part_name")) for kind, severity, test in structure_rules(content, F.col("nest"))])


def resolved(part: Column, target: Column) -> Column:
    """The part that a relationship's target names: relative to the folder of the part it belongs to, or from the root."""
    folder = F.regexp_replace(F.regexp_extract(part, r"^(.*?)_rels/[^/]*$", 1), "/$", "")
    path = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), target))
    for _ in range(4):  # nested ../ one after the other
        path = F.regexp_replace(path, r"(^|/)[^/.][^/]*/\.\./", "$1")
    return F.regexp_replace(path, r"(^|/)(\./)+", "$1")


def facts(parts: DataFrame) -> DataFrame:
    """One row per package with what its parts say; a package's parts meet in one row, which its size limit bounds."""
    name, content = F.col("part_name"), F.col("content")
    word = name.startswith("word/") & name.endswith(".xml")
    of = lambda part, value: F.flatten(F.collect_list(F.when(name == part, value)))
    in_word = lambda value, *but: F.array_distinct(F.flatten(F.collect_list(F.when(word & ~name.isin("", *but), value))))
    text_of = lambda part: F.coalesce(F.max(F.when(name == part, content)), F.lit(""))
    read = parts.withColumns({"nest": F.when(word & F.contains(content, F.lit("xmlns:w=")), nesting(content)), "word": word})
    listed = [F.when(F.col("nest").isNotNull() & test, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), name.alias("target"))) for kind, severity, test in structure_rules(content, F.col("nest"))]
    listed.append(F.when(word & F.contains(content, F.lit('w:val="start"')), F.struct(F.lit("renderer_incompatible_ooxml").alias("kind"), F.lit(FATAL).alias("severity"), name.alias("target"))))
    pairs = F.when(word, F.array_union(F.array_except(_all(content, BOOKMARK_START), _all(content, BOOKMARK_END)), F.array_except(_all(content, BOOKMARK_END), _all(content, BOOKMARK_START))))
    relation = F.transform(_all(content, RELATION, 0), lambda t: F.struct(name.alias("part"), _attribute(t, "Id").alias("id"), _attribute(t, "Type").alias("type"), F.trim(_attribute(t, "Target")).alias("target"), (F.lower(_attribute(t, "TargetMode")) == "external").alias("external")))
    return read.groupBy("doc_id").agg(
        F.collect_set("part_name").alias("names"),
        text_of(DOCUMENT).alias("document"),
        text_of(SETTINGS).alias("settings"),
        text_of(TYPES).alias("types"),
        text_of(RELATIONS).alias("links"),
        F.flatten(F.collect_list(F.filter(F.array(*listed), lambda x: x.isNotNull()))).alias("structure"),
        of(STYLES, _all(content, DEFINED_STYLE)).alias("styles"),
        in_word(_all(content, USED_STYLE), STYLES).alias("used_styles"),
        of(NUMBERING, _all(content, DEFINED_NUMBER)).alias("numbers"),
        in_word(_all(content, USED_NUMBER), NUMBERING).alias("used_numbers"),
        of(NUMBERING, _all(content, DEFINED_ABSTRACT)).alias("abstracts"),
        of(NUMBERING, _all(content, USED_ABSTRACT)).alias("used_abstracts"),
        in_word(_all(content, BOOKMARK)).alias("bookmarks"),
        in_word(_all(content, FIELD_REFERENCE)).alias("references"),
        F.array_distinct(F.flatten(F.collect_list(pairs))).alias("unpaired"),
        F.flatten(F.collect_list(F.when(name.endswith(".rels"), relation))).alias("relations"),
        *[in_word(_all(content, rf'<w:{e}Reference\b[^>]*\bw:id="(\d+)"')).alias(f"{e}_marks") for e in ("footnote", "endnote")],
        *[of(f"word/{e}s.xml", _all(content, rf'<w:{e}\b[^>]*\bw:id="(\d+)"')).alias(f"{e}_notes") for e in ("footnote", "endnote")],
        F.coalesce(F.bool_or(word & content.rlike(REFRESHED_FIELD)), F.lit(False)).alias("refreshed"),
    )


def _issue(test: Column, kind: str, severity: str, target: Column) -> Column:
    return F.when(test, F.array(F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), target.alias("target"))))


def _each(values: Column, kind: str, severity: str = REPAIRABLE) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), v.cast("string").alias("target")))


def verify(parts: DataFrame) -> DataFrame:
    """(doc_id, kind, severity, target): every issue of every package, each kind and target once.

    Null contents count as empty parts; a package without a document has that issue and those of its other parts.
    """
    found = facts(parts.withColumn("content", F.coalesce("content", F.lit(""))))
    has = lambda part: F.array_contains("names", part)
    document, types, links = F.col("document"), F.col("types"), F.col("links")
    said = lambda text, what: F.contains(text, F.lit(what))
    by_id = F.filter("relations", lambda r: r["part"] == RELATIONS)
    headers = F.transform(_all(document, HEADER_REFERENCE, 0), lambda t: F.struct(_attribute(t, "r:id").alias("id"), F.regexp_extract(t, "<w:(header|footer)", 1).alias("kind"), F.filter(by_id, lambda r: r["id"] == _attribute(t, "r:id")).alias("to")))
    page_parts = F.filter(by_id, lambda r: r["type"].rlike("/relationships/(header|footer)") & (r["target"] != ""))
    undeclared = F.filter(page_parts, lambda r: ~F.contains(types, F.concat(F.lit('PartName="/'), resolved(r["part"], r["target"]), F.lit('"'))) | ~F.contains(types, F.concat(F.lit("wordprocessingml."), F.regexp_extract(r["type"], "/relationships/(header|footer)", 1), F.lit("+xml"))))
    extensions = F.transform(_all(types, r'<Default\b[^>]*\bExtension="([^"]+)"'), F.lower)
    extension = lambda n: F.lower(F.regexp_extract(n, r"\.([^.]*)$", 1))
    declared = lambda n: F.array_contains(extensions, extension(n)) | F.contains(types, F.concat(F.lit('PartName="/'), n, F.lit('"')))
    media = F.exists("names", lambda n: n.startswith("word/media/") & ~declared(n))
    lost = F.filter("relations", lambda r: ~r["external"] & (r["target"] != "") & ~r["target"].startswith("#") & ~F.array_contains(F.col("names"), resolved(r["part"], r["target"])))
    checks = [
        _issue(~has(DOCUMENT), "missing_document_xml", FATAL, F.lit(DOCUMENT)),
        _issue(document.rlike(PLACEHOLDER), "placeholder", REPAIRABLE, F.lit(DOCUMENT)),
        _issue(has(DOCUMENT) & (F.octet_length(T.uni_trim(document)) < 20), "short_document", WARNING, F.lit(DOCUMENT)),
        F.col("structure"),
        _issue(has("word/comments.xml"), "comments_not_finalized", REPAIRABLE, F.lit("word/comments.xml")),
        _each(F.when(F.size("styles") > 0, F.array_except("used_styles", "styles")), "style_reference_missing"),
        _each(F.array_except("used_abstracts", "abstracts"), "numbering_abstract_missing"),
        _each(F.array_except("used_numbers", "numbers"), "numbering_reference_missing"),
        _each(F.col("unpaired"), "bookmark_pair_missing"),
        _each(F.filter(F.array_except("references", "bookmarks"), lambda r: ~r.startswith("_Toc")), "bookmark_reference_missing"),
        _issue(document.rlike('w:type="even"') & document.rlike("<w:(header|footer)Reference") & ~said(F.col("settings"), "<w:evenAndOddHeaders"), "even_headers_not_enabled", REPAIRABLE, F.lit(SETTINGS)),
        _each(F.transform(F.filter(headers, lambda h: F.size(h["to"]) == 0), lambda h: h["id"]), "header_footer_reference_relationship_missing"),
        _each(F.transform(F.filter(headers, lambda h: (F.size(h["to"]) > 0) & ~F.contains(F.get(h["to"], F.lit(0))["type"], F.concat(F.lit("/relationships/"), h["kind"]))), lambda h: h["id"]), "header_footer_reference_type_mismatch"),
        _issue(F.size(undeclared) > 0, "header_footer_content_type_missing", REPAIRABLE, F.lit(TYPES)),
        _issue(media, "media_content_type_missing", REPAIRABLE, F.lit(TYPES)),
        _each(F.transform(lost, lambda r: r["target"]), "relationship_target_missing"),
        _issue(F.col("refreshed") & ~said(F.col("settings"), "<w:updateFields"), "fields_not_marked_for_update", REPAIRABLE, F.lit(SETTINGS)),
        _issue(F.col("refreshed") & document.rlike(TOC_PAGE_ZERO), "toc_page_numbers_not_materialized", REPAIRABLE, F.lit(SETTINGS)),
    ]
    for part, kind, content_type, relation in LINKED_PARTS:
        short = part.removeprefix("word/")
        checks.append(_issue(has(part) & ~(said(types, f'PartName="/{part}"') & said(types, content_type)), f"{kind}_content_type_missing", REPAIRABLE, F.lit(TYPES)))
        checks.append(_issue(has(part) & ~(said(links, relation) & said(links, short)), f"{kind}_relationship_missing", REPAIRABLE, F.lit(RELATIONS)))
    for e in ("footnote", "endnote"):
        real = lambda c: F.filter(c, lambda i: i.try_cast("int") > 0)
        marks, notes, part = real(F.col(f"{e}_marks")), real(F.col(f"{e}_notes")), f"word/{e}s.xml"
        checks.append(_issue(has(part) & (F.size(F.array_except(marks, notes)) > 0), f"{e}s_reference_missing_definition", REPAIRABLE, F.lit(part)))
        checks.append(_issue(has(part) & (F.size(F.array_except(notes, marks)) > 0), f"{e}s_definition_unreferenced", REPAIRABLE, F.lit(part)))
    empty = F.array().cast("array<struct<kind:string,severity:string,target:string>>")
    every = F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in checks]))
    return found.select("doc_id", F.explode(every).alias("i")).select("doc_id", "i.*")


def verdicts(parts: DataFrame) -> DataFrame:
    """(doc_id, status) of every package."""
    return status(verify(parts), parts, ["doc_id"])
