"""Checks of a thesis against a pack of rules; each gives issue rows (doc_id, kind, severity, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators.issues import REPAIRABLE, WARNING, checked, issues, union_of

# The sections that are asked for, the shape of a reference entry, and what stands for a missing value.
SECTIONS = ("cover", "title_page", "abstract_cn", "abstract_en", "toc", "body", "references", "acknowledgements")
ENTRY = r"^\[\d+\].+\. .+(\[[A-Z](/[A-Z]+)?\]|//)"
PLACEHOLDER = r"^(_+|…+|\.{3,}|X+|x+|待填|请填写)$"


def _where(rows: DataFrame, test: Column, kind: str, severity: str, target: Column) -> DataFrame:
    return issues(rows.filter(test), kind, severity, ["doc_id"], target)


def required_sections(present: DataFrame, docs: DataFrame, wanted: tuple[str, ...] = SECTIONS) -> DataFrame:
    """An issue per wanted section that a document lacks; a section nobody knows is lacking everywhere."""
    pairs = docs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, wanted))).alias("section"))
    return issues(pairs.join(present.select("doc_id", "section"), ["doc_id", "section"], "left_anti"), "section_missing", REPAIRABLE, ["doc_id"], F.col("section"))


def required_fields(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """An issue per label that no paragraph fills: it starts with the label, and the rest, less a colon, says something."""
    docs = rows.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    rest = T.uni_trim(F.regexp_replace(F.substring(F.col("r.text"), F.length("d.label") + 1, F.length("r.text")), "^[:：]", ""))
    filled = F.startswith("r.text", "d.label") & (rest != "") & ~rest.rlike(PLACEHOLDER)
    found = docs.alias("d").join(rows.alias("r"), (F.col("d.doc_id") == F.col("r.doc_id")) & filled, "left_anti")
    return issues(found, "field_missing", REPAIRABLE, ["doc_id"], F.col("label"))


def lengths(facts: DataFrame, *, title_cn: int, title_en: int, least_body: int) -> DataFrame:
    """Titles over their length in Han characters or English words, bodies under theirs; facts: doc_id, title, body."""
    title, body = F.col("title"), T.wide_count(F.col("body"))
    han, words = T.han_count(title), T.ascii_words(title)
    rules = [
        ("title_too_long", REPAIRABLE, han > title_cn, han),
        ("title_too_long", REPAIRABLE, (han == 0) & (words > title_en), words),
        ("body_too_short", REPAIRABLE, F.col("wide") < F.lit(least_body), F.col("wide")),
    ]
    return checked(facts.withColumn("wide", body), ["doc_id"], rules)


def reference_rules(rows: DataFrame, *, least: int, foreign: float, recent: float, this_year: int = 2025) -> DataFrame:
    """Entries of the wrong shape, too few of them, and too small shares in other languages or of five years; rows: doc_id, idx, text."""
    year = F.nullif(T.first_year(F.col("text")), F.lit("")).cast("int")
    n = F.count(F.lit(1))
    counted = rows.groupBy("doc_id").agg(n.alias("n"), (F.count(F.when(T.is_foreign(F.col("text")), 1)) / n).alias("foreign"), (F.count(F.when(year >= this_year - 5, 1)) / n).alias("recent"))
    shapes = checked(rows, ["doc_id"], [("reference_shape", REPAIRABLE, ~F.col("text").rlike(ENTRY), F.col("idx"))])
    shares = [
        ("reference_quantity", WARNING, F.col("n") < least, F.col("n")),
        ("reference_foreign", WARNING, F.col("foreign") < foreign, F.round("foreign", 4)),
        ("reference_recent", WARNING, F.col("recent") < recent, F.round("recent", 4)),
    ]
    return shapes.unionByName(checked(counted, ["doc_id"], shares))


def page_setup(actual: DataFrame, wanted: dict[str, int], tolerance: int = 10) -> DataFrame:
    """Page measures (in twips, on both sides) that are off by more than the tolerance."""
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("wanted"), F.col(k).alias("found")) for k, v in wanted.items()])).alias("m")
    each = actual.select("doc_id", listed).select("doc_id", "m.*")
    return _where(each, F.col("found").isNull() | (F.abs(F.col("found") - F.col("wanted")) > tolerance), "page_setup", REPAIRABLE, F.col("name"))


def heading_scheme(rows: DataFrame, deepest: int = 4) -> DataFrame:
    """Headings of two schemes in one document, and numbers that go too deep; rows: doc_id, idx, text of headings."""
    scheme = F.when(F.col("text").rlike(r"^\d"), "decimal").when(F.col("text").rlike("^(第|[一二三四五六七八九十（(])"), "chapter")
    depth = F.size(F.split(F.regexp_extract("text", r"^\d+(\.\d+)*", 0), r"\."))
    mixed = rows.withColumn("scheme", scheme).groupBy("doc_id").agg(F.count_distinct("scheme").alias("n"))
    return union_of([_where(mixed, F.col("n") > 1, "heading_scheme_mixed", WARNING, F.col("n")), _where(rows, F.col("text").rlike(r"^\d") & (depth > deepest), "heading_too_deep", WARNING, F.col("idx"))])


def caption_positions(rows: DataFrame) -> DataFrame:
    """Table captions must stand right above a table, figure captions right below a drawing; rows: doc_id, idx, kind, text."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    near = rows.withColumns({"next": F.lead("kind").over(w), "last": F.lag("kind").over(w), "c": T.caption(F.col("text"))})
    is_table = F.col("c.label").isin("Table", "表")
    wrong = F.col("c").isNotNull() & ~F.coalesce(F.when(is_table, F.col("next") == "tbl").otherwise(F.col("last") == "drawing"), F.lit(False))
    return _where(near, wrong, "caption_position", REPAIRABLE, F.col("idx"))


def section_headers(sections: DataFrame) -> DataFrame:
    """Later sections without a header after one that had it, and footers used twice; sections: doc_id, idx, header_id, footer_id."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    had = sections.withColumn("had", F.max(F.col("header_id").isNotNull()).over(before))
    twice = sections.filter("footer_id IS NOT NULL").groupBy("doc_id", "footer_id").agg(F.count(F.lit(1)).alias("n"))
    return union_of([_where(had, F.col("had") & F.col("header_id").isNull(), "section_header_footer_inherited", REPAIRABLE, F.col("idx")), _where(twice, F.col("n") > 1, "linked_header_footer_sections", REPAIRABLE, F.col("footer_id"))])


def page_numbers(sections: DataFrame) -> DataFrame:
    """With three sections and more: none on the cover, Roman from 1 in front, decimal from 1 in the body; sections: doc_id, idx, number_format, number_start."""
    w = Window.partitionBy("doc_id")
    ranked = sections.withColumns({"n": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy("idx"))}).filter("n >= 3")
    form, start = F.col("number_format"), F.col("number_start")
    place = F.col("place")
    rules = [
        ("cover_page_number_present", REPAIRABLE, (place == 1) & form.isNotNull(), form),
        ("front_page_number_not_roman", REPAIRABLE, (place == 2) & ~F.coalesce(F.lower(form).like("%roman") & (start == 1), F.lit(False)), F.col("idx")),
        ("body_page_number_not_decimal_start", REPAIRABLE, (place == 3) & ~((F.coalesce(form, F.lit("decimal")) == "decimal") & F.coalesce(start == 1, F.lit(False))), F.col("idx")),
    ]
    return checked(ranked, ["doc_id"], rules)


def tables(found: DataFrame, *, three_lines: bool) -> DataFrame:
    """Tables outside of the cover: centred, with a width, a repeating header and, if asked, three lines."""
    idx = F.col("idx")
    rules = [
        ("table_layout_not_centered", REPAIRABLE, ~(F.col("centred") & (F.col("width") > 0) & ~F.col("floating")), idx),
        ("table_repeating_header_missing", REPAIRABLE, ~F.col("repeats_header"), idx),
        ("table_three_line_format", REPAIRABLE, ~F.col("three_lines") & F.lit(three_lines), idx),
    ]
    return checked(found.filter("NOT on_cover"), ["doc_id"], rules)


def relationship_targets(relations: DataFrame, parts: DataFrame) -> DataFrame:
    """Internal targets that are no part of the package; a relative target starts at the folder of its source part."""
    folder = F.regexp_replace("source_part", "[^/]*$", "")
    path = F.when(F.col("target").startswith("/"), F.substring("target", 2, 1_000_000)).otherwise(F.concat(folder, "target"))
    path = F.regexp_replace(F.regexp_replace(path, r"[^/]+/\.\./", ""), r"\./", "")
    used = relations.filter("NOT external AND target <> '' AND NOT startswith(target, '#')").select("doc_id", path.alias("part_name"))
    return issues(used.distinct().join(parts.select("doc_id", "part_name"), ["doc_id", "part_name"], "left_anti"), "relationship_target_missing", REPAIRABLE, ["doc_id"], F.col("part_name"))


def media_types(parts: DataFrame, declared: DataFrame) -> DataFrame:
    """Media whose extension, in any case, has no declared content type; declared: doc_id, extension."""
    media = parts.filter(F.col("part_name").like("%/media/%")).select("doc_id", "part_name", F.lower(F.substring_index("part_name", ".", -1)).alias("extension"))
    return issues(media.join(declared.select("doc_id", F.lower("extension").alias("extension")), ["doc_id", "extension"], "left_anti"), "media_content_type_missing", REPAIRABLE, ["doc_id"], F.col("part_name"))


def rendered(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Required texts that no page holds, forbidden ones that one does, and blank pages; rules: doc_id, rule, text."""
    bare = pages.withColumn("bare", T.squeezed(F.col("text")))
    hits = rules.alias("r").join(bare.alias("p"), (F.col("r.doc_id") == F.col("p.doc_id")) & F.contains(F.col("p.bare"), T.squeezed(F.col("r.text"))), "left_semi")
    required = rules.filter("rule = 'required'").join(hits, ["doc_id", "rule", "text"], "left_anti")
    return union_of(
        [
            issues(required, "missing_rendered_text", "error", ["doc_id"], F.col("text")),
            issues(hits.filter("rule = 'forbidden'"), "forbidden_rendered_text", "error", ["doc_id"], F.col("text")),
            _where(bare, F.col("bare") == "", "blank_rendered_page", "error", F.col("page")),
        ]
    )


def toc_pages(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, heading, printed): the printed number of the first page that holds each heading; pages without one don't count."""
    held = pages.filter("printed IS NOT NULL").withColumn("bare", T.squeezed(F.col("text"))).alias("p")
    found = headings.alias("h").join(held, (F.col("h.doc_id") == F.col("p.doc_id")) & F.contains(F.col("p.bare"), T.squeezed(F.col("h.heading"))))
    return found.groupBy("h.doc_id", "h.heading").agg(F.min_by("p.printed", "p.page").alias("printed"))


def requirements(texts: DataFrame) -> DataFrame:
    """Rules found in free text (doc_id, text): margins in cm, size, line spacing and minimum counts, null if unsaid."""
    part = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    return texts.select(
        "doc_id",
        part(r"(?i)(?:上|top)[^\d]{0,8}(\d+(?:\.\d+)?) *cm").alias("top_cm"),
        part(r"(?i)(?:左|left)[^\d]{0,8}(\d+(?:\.\d+)?) *cm").alias("left_cm"),
        part(r"(?i)(?:行距|line spacing)[^\d]{0,8}(\d+(?:\.\d+)?)").alias("line"),
        part(r"(?i)(?:参考文献|references)[^\d]{0,12}(\d+)").alias("references"),
        part(r"(?i)(?:关键词|keywords)[^\d]{0,8}(\d+)").alias("keywords"),
    )


#: Characters that a Chinese abstract should have at least.
ABSTRACT_CHARS = 2000


def abstracts(docs: DataFrame, least: int = ABSTRACT_CHARS) -> DataFrame:
    """A Chinese abstract that is there but short, and an English one that is missing; docs: doc_id, text."""
    found = docs.withColumns({"cn": F.length(T.section_by_heading(F.col("text"), ["摘要"], ["关键词", "abstract", "目录"])), "en": T.uni_trim(T.section_by_heading(F.col("text"), ["abstract"], ["keywords", "目录", "正文"]))})
    rules = [("cn_abstract_len", WARNING, (F.col("cn") > 0) & (F.col("cn") < least), F.col("cn")), ("en_abstract_missing", WARNING, F.col("en") == "", F.lit("missing"))]
    return checked(found, ["doc_id"], rules)


def profile(violations: list[DataFrame]) -> DataFrame:
    """One issue per document with the sum of all violations (doc_id, n) of a profile's rules; none without any."""
    total = union_of(violations).groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 0")
    return issues(total, "profile_rule", REPAIRABLE, ["doc_id"], F.col("n"))


def template_quality(rows: DataFrame, title: str = "参考文献") -> DataFrame:
    """Captions that a template holds twice, and templates without a title of references; rows: doc_id, idx, text."""
    captions = rows.filter(T.caption(F.col("text")).isNotNull()).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    titled = rows.groupBy("doc_id").agg(F.bool_or(T.squeezed(F.coalesce("text", F.lit(""))) == title).alias("there")).filter("NOT there")
    return issues(captions, "duplicate_caption", WARNING, ["doc_id"], F.col("text")).unionByName(issues(titled, "references_title_missing", WARNING, ["doc_id"], F.lit(title)))
