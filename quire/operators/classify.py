"""Roles, sections and labels of paragraphs, worked out from order by windows; and how several classifiers are combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

HIGH, MODEL, ARBITRATED, ITEMS, BATCH = 0.92, 0.80, 0.90, 30, 100
# The titles that begin a part of a thesis, and patterns of headings and captions.
TOC, ABSTRACT, KEYWORDS, REFERENCES, THANKS = "目录", "摘要", "关键词", "参考文献", "致谢"
DECIMAL_HEADING = r"^(\d+(?:\.\d+){0,3})\s+\S+"
CHAPTER_HEADING = r"^第[一二三四五六七八九十百千万\d]+章(?:\s*\S+)?$"
LISTED_HEADING = r"^[一二三四五六七八九十百]+[、．.]\s*\S+"
TABLE_CAPTION, FIGURE_CAPTION = r"^表\d+", r"^图\d+"
# Labels of built-in paragraph styles.
STYLE_LABELS = {
    "heading1": "heading_1", "heading 1": "heading_1", "标题 1": "heading_1", "标题1": "heading_1",
    "heading2": "heading_2", "heading 2": "heading_2", "标题 2": "heading_2", "标题2": "heading_2",
    "heading3": "heading_3", "heading 3": "heading_3", "标题 3": "heading_3", "标题3": "heading_3",
    "heading4": "heading_4", "heading 4": "heading_4", "标题 4": "heading_4", "标题4": "heading_4",
    "title": "title", "论文标题": "title",
    "toc1": "table_of_contents", "toc 1": "table_of_contents", "toc2": "table_of_contents", "toc 2": "table_of_contents", "toc3": "table_of_contents", "toc 3": "table_of_contents",
    "tocheading": "table_of_contents_title", "toc heading": "table_of_contents_title",
}
LABELS = (
    "title", "cover", "originality_declaration", "abstract_title", "abstract", "en_abstract_title", "en_abstract", "keywords", "en_keywords", "heading_1", "heading_2", "heading_3",
    "body", "references_title", "references", "table_of_contents_title", "table_of_contents",
)


def _up_to(keys: list[str] = ["doc_id"]) -> Window:
    return Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: list[str] = ["doc_id"]) -> Window:
    return Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)


def compact(s: Column) -> Column:
    return F.regexp_replace(T.uni_trim(s), "[ \t 　]", "")


def style_label(style: Column) -> Column:
    """The label of a built-in style, in any case; empty for other styles."""
    table = F.create_map(*[F.lit(x) for pair in STYLE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(T.uni_trim(style))), F.lit(""))


def ast_roles(rows: DataFrame) -> DataFrame:
    """Adds role, level, confidence and section; rows: doc_id, idx, kind (paragraph or table), text, style.

    The first rule that fits gives a paragraph's role, but for chapter and listed headings, which come before all. The
    confidence follows from the kind of evidence and the style; sections begin at their titles and headings of level 1.
    """
    text = T.uni_trim(F.coalesce("text", F.lit("")))
    short, low = compact(text), F.lower(text)
    number = F.regexp_extract(text, DECIMAL_HEADING, 1)
    role = lambda name, evidence, level=0: F.struct(F.lit(name).alias("role"), F.lit(evidence).alias("evidence"), (F.lit(level) if isinstance(level, int) else level).alias("level"))
    found = F.when(F.col("kind") == "table", role("table", "part"))
    rules = [
        (text.rlike(CHAPTER_HEADING) | text.rlike(LISTED_HEADING), role("heading", "regex", 1)),
        (text == "", role("blank", "empty")),
        (short == TOC, role("toc_title", "keyword")),
        (short.startswith(ABSTRACT), role("abstract_cn", "keyword")),
        (low.startswith("abstract"), role("abstract_en", "keyword")),
        (short.startswith(KEYWORDS), role("keywords_cn", "keyword")),
        (low.startswith("keywords") | low.startswith("key words"), role("keywords_en", "keyword")),
        (short == REFERENCES, role("references_title", "keyword")),
        (short == THANKS, role("acknowledgements_title", "keyword")),
        (text.rlike(TABLE_CAPTION), role("table_caption", "regex")),
        (text.rlike(FIGURE_CAPTION), role("figure_caption", "regex")),
        (number != "", role("heading", "regex", F.size(F.split(number, r"\.")))),
    ]
    for test, value in rules:
        found = found.when(test, value)
    named = rows.withColumn("__r", found.otherwise(role("body_paragraph", "fallback")))
    name, evidence, style = F.col("__r.role"), F.col("__r.evidence"), F.coalesce("style", F.lit(""))
    base = F.when(evidence == "keyword", 0.88 + F.when(text.rlike("[:：;；]"), 0.0).otherwise(0.07)).when(evidence == "regex", 0.82).otherwise(0.55)
    sure = F.when(name.isin("table", "blank"), 0.99).otherwise(F.least(base + F.when(F.lower(style).contains("heading") | style.contains("标题"), 0.12).otherwise(0.0), F.lit(0.99)))
    starts = (
        F.when(name.isin("abstract_cn", "abstract_en"), "abstract")
        .when(name == "toc_title", "toc")
        .when((name == "heading") & (F.col("__r.level") == 1), "body")
        .when(name == "references_title", "references")
        .when(name == "acknowledgements_title", "acknowledgements")
    )
    section = F.coalesce(F.last(starts, ignorenulls=True).over(_up_to()), F.lit("cover"))
    return named.withColumns({"role": name, "level": F.col("__r.level"), "confidence": F.round(sure, 2), "section": section}).drop("__r")


def role_counts(roles: DataFrame) -> DataFrame:
    """Per document: paragraphs, blank ones, tables and headings."""
    n = lambda test, name: F.count_if(test).alias(name)
    return roles.groupBy("doc_id").agg(n(F.col("kind") == "paragraph", "paragraphs"), n(F.col("role") == "blank", "blanks"), n(F.col("kind") == "table", "tables"), n(F.col("role") == "heading", "headings"))


def section_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, idx, part, text) of the sections of a thesis; rows: doc_id, idx, kind, text. Blank rows and those of no part go.

    A marker (abstract, keywords, references, thanks; alone or before a colon) begins a section, a heading the body, but
    not in references and thanks; keywords are one line. On the cover only keys with values count, tables only in the body.
    """
    text = T.uni_trim(F.col("text"))
    marked = [F.when(T.after_marker(text, m).isNotNull(), F.struct(F.lit(m).alias("marker"), T.after_marker(text, m).alias("rest"))) for m in (ABSTRACT, KEYWORDS, REFERENCES, THANKS)]
    paragraph = F.col("kind") != "table"
    known = rows.filter(text != "").withColumns({"text": text, "mark": F.when(paragraph, F.coalesce(*marked)), "heads": paragraph & (text.rlike(DECIMAL_HEADING) | text.rlike(CHAPTER_HEADING) | text.rlike(LISTED_HEADING))})
    known = known.withColumns({"heads": F.col("heads") & F.col("mark").isNull(), "part_of": F.count("mark").over(_up_to())})
    within = ["doc_id", "part_of"]
    begun = F.first("mark").over(Window.partitionBy(*within).orderBy("idx"))
    known = known.withColumns({"begun": begun, "headed": F.coalesce(F.max("heads").over(_before(within)), F.lit(False)), "said": F.count(F.when(paragraph & F.col("mark").isNull() & ~F.col("heads"), 1)).over(_before(within))})
    marker, rest = F.col("begun.marker"), F.col("begun.rest")
    last = F.when(marker == REFERENCES, "references").when(marker == THANKS, "acknowledgement")
    first = F.when(marker == ABSTRACT, "abstract_cn").when((marker == KEYWORDS) & (rest == "") & (F.col("said") == 0), "keywords_cn").when(marker == KEYWORDS, "body").otherwise("cover")
    state = F.coalesce(last, F.when(F.col("headed"), "body").otherwise(first))
    part = (
        F.when(~paragraph, F.when(state == "body", "table"))
        .when(F.col("mark").isNotNull(), "section_label")
        .when(F.col("heads") & last.isNull(), "heading")
        .when(state == "cover", F.when(T.key_value(F.col("text")).isNotNull(), "cover_field"))
        .otherwise(state)
    )
    return known.select("doc_id", "idx", part.alias("part"), "text").filter("part IS NOT NULL")


def cover_fields(parts: DataFrame) -> DataFrame:
    """(doc_id, key, value) of the cover; of a key that is there twice the last value."""
    fields = parts.filter("part = 'cover_field'").select("doc_id", "idx", T.key_value(F.col("text")).alias("f"))
    return fields.groupBy("doc_id", F.col("f.key").alias("key")).agg(F.max_by("f.value", "idx").alias("value"))


def semantic_blocks(rows: DataFrame) -> DataFrame:
    """Adds block, chapter and in_body; rows: doc_id, idx, kind, text, figure (holds a drawing), data (a table of data)."""
    text = T.uni_trim(F.coalesce("text", F.lit("")))
    short, paragraph = compact(text), F.col("kind") == "paragraph"
    starts_body = short.startswith("1绪论") | F.lower(text).rlike(r"^1\s+introduction")
    event = F.when(paragraph, F.when(short == TOC, "toc").when(starts_body, "body").when(short == REFERENCES, "references").when(short == THANKS, "thanks"))
    last = lambda value: F.last(value, ignorenulls=True).over(_before())
    known = rows.withColumn("__e", event)
    known = known.withColumns(
        {
            "__toc": F.coalesce(last(F.col("__e")) == "toc", F.lit(False)),
            "__refs": F.coalesce(last(F.when(F.col("__e") != "toc", F.col("__e"))) == "references", F.lit(False)),
            "__body": F.coalesce(last(F.when(F.col("__e") == "body", True)), F.lit(False)),
        }
    )
    inside = F.col("__body")
    chapter = F.when(F.col("__e") == "body", "1").otherwise(F.regexp_extract(text, r"^(\d+)\s+\S+", 1))
    block = (
        F.when(F.col("__e") == "toc", "toc").when(F.col("__e") == "body", "body_heading").when(F.col("__e") == "references", "references_title").when(F.col("__e") == "thanks", "acknowledgements")
        .when(paragraph & F.col("__refs") & text.rlike(r"^\[\d+\]"), "reference_entry")
        .when(paragraph & text.rlike(TABLE_CAPTION), "table_caption")
        .when(paragraph & text.rlike(FIGURE_CAPTION), "figure_caption")
        .when(paragraph & F.col("__toc"), "toc")
        .when(paragraph & F.col("figure") & inside, "figure")
        .when(paragraph & inside, F.when(chapter != "", "body_heading").otherwise("body_paragraph"))
        .when(~paragraph, F.when(F.col("data"), "data_table").otherwise("layout_table"))
        .otherwise("front_matter")
    )
    known = known.withColumn("block", block)
    within = F.col("block").isin("body_heading", "references_title", "acknowledgements", "reference_entry", "figure", "body_paragraph") | inside
    return known.withColumns({"chapter": F.coalesce(F.last(F.when(F.col("block") == "body_heading", chapter), ignorenulls=True).over(_up_to()), F.lit("1")), "in_body": within}).drop("__e", "__toc", "__refs", "__body")


def candidates(blocks: DataFrame, shown: int = 80) -> DataFrame:
    """(doc_id, idx, block, preview, before, after): tables and figures of the body with the blocks next to them."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    around = blocks.withColumns({"before": F.lag("text", 1, "").over(w), "after": F.lead("text", 1, "").over(w)})
    return around.filter(F.col("in_body") & F.col("block").isin("data_table", "layout_table", "figure")).select("doc_id", "idx", "block", F.left("text", F.lit(shown)).alias("preview"), "before", "after")


def numbered_captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, caption) of captions of the body without a number: label, chapter and a number within the chapter."""
    text = T.uni_trim(F.col("text"))
    label = F.when(text.rlike(r"^表(?!\d).") & ~text.startswith("续表"), "表").when(text.rlike(r"^图(?!\d)."), "图")
    bare = F.regexp_replace(F.substring(text, 2, 1 << 30), "^[：:.—\\- 　]+", "")
    found = blocks.filter(F.col("in_body") & (F.col("kind") == "paragraph")).withColumns({"label": label, "name": F.when(bare != "", bare).when(label == "表", "相关数据").otherwise("图示")}).filter("label IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("doc_id", "chapter", "label").orderBy("idx"))
    return found.select("doc_id", "idx", F.concat("label", "chapter", F.lit("."), n.cast("string"), F.lit(" "), T.uni_trim(F.col("name"))).alias("caption"))


def renumbered_references(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, text) of reference entries, numbered in order within each list of references."""
    entries = blocks.filter("block = 'reference_entry'")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return entries.select("doc_id", "idx", F.concat(F.lit("["), n.cast("string"), F.lit("] "), T.uni_trim(F.regexp_replace("text", r"^\s*\[\d+\]\s*", ""))).alias("text"))


def order_constraints(rows: DataFrame) -> DataFrame:
    """Body paragraphs after the first references title and before the first thanks become references; rows: doc_id, idx, label."""
    w = Window.partitionBy("doc_id")
    first = lambda label: F.min(F.when(F.col("label") == label, F.col("idx"))).over(w)
    known = rows.withColumns({"__refs": first("references_title"), "__thanks": first("acknowledgements_title")})
    moved = (F.col("label") == "body") & (F.col("idx") > F.col("__refs")) & (F.col("__thanks").isNull() | (F.col("idx") < F.col("__thanks")))
    return known.withColumn("label", F.when(moved, "references").otherwise(F.col("label"))).drop("__refs", "__thanks")


def label_stats(rows: DataFrame, keys: list[str], sure: float = HIGH) -> DataFrame:
    """(keys, label, n, low): rows of each label, and how many of them are unsure."""
    return rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < sure).alias("low"))


def coverage(rows: DataFrame, least: float = 70.0) -> DataFrame:
    """(doc_id, coverage, enough): the share of paragraphs with a label, in percent."""
    share = F.round(F.count_if(F.col("label").isNotNull() & (F.col("label") != "")) * 100.0 / F.count(F.lit(1)), 4)
    return rows.groupBy("doc_id").agg(share.alias("coverage")).withColumn("enough", F.col("coverage") >= least)


def with_model(rows: DataFrame) -> DataFrame:
    """The model's word where the rules are unsure and the model is not; rows: label, confidence, model_label, model_confidence."""
    taken = (F.col("confidence") < HIGH) & (F.col("model_label") != "") & (F.col("model_confidence") >= MODEL)
    pick = lambda model, rule: F.when(taken, F.col(model)).otherwise(F.col(rule))
    return rows.withColumns({"source": F.when(taken, "model").otherwise("rule"), "label": pick("model_label", "label"), "confidence": pick("model_confidence", "confidence")}).drop("model_label", "model_confidence")


def needs_arbiter(rows: DataFrame, *, independent: bool, calls: int = 0, most_calls: int = 1) -> DataFrame:
    """(doc_id, asks): whether a document has enough unsure paragraphs: over 3 under 0.92, or, once independent, over 5 under 0.6."""
    low, least = (0.6, 5) if independent else (HIGH, 3)
    return rows.groupBy("doc_id").agg(((F.count_if(F.col("confidence") < low) > least) & F.lit(calls < most_calls)).alias("asks"))


def arbitrated(rows: DataFrame, answers: DataFrame, asks: DataFrame) -> DataFrame:
    """An arbiter's answers (doc_id, idx, label, confidence) over the first unsure paragraphs of documents that ask.

    Answers with an unknown label don't count, a confidence outside of 0 to 1 is 0.85, and one below the current is refused.
    """
    said = F.when((F.col("confidence") <= 0) | (F.col("confidence") > 1), 0.85).otherwise(F.col("confidence"))
    valid = answers.filter(F.col("label").isin(*LABELS)).select("doc_id", "idx", F.col("label").alias("__l"), said.alias("__c"))
    unsure = (F.col("confidence") < ARBITRATED).cast("int")
    place = rows.join(asks, "doc_id", "left").withColumn("__item", F.when(unsure == 1, F.sum(unsure).over(_up_to())))
    taken = F.coalesce(F.col("asks") & (F.col("__item") <= ITEMS) & (F.col("__c") >= F.col("confidence")), F.lit(False))
    joined = place.join(valid, ["doc_id", "idx"], "left").withColumn("__t", taken)
    pick = lambda new, old: F.when(F.col("__t"), F.col(new)).otherwise(F.col(old))
    return joined.withColumns({"source": F.when(F.col("__t"), "arbiter").otherwise(F.col("source")), "label": pick("__l", "label"), "confidence": pick("__c", "confidence")}).select(*rows.columns)


def whole_document(rows: DataFrame, answers: DataFrame, failed: DataFrame, batch: int = BATCH) -> DataFrame:
    """Answers for whole documents, asked for in batches of paragraphs; a batch that failed (doc_id, batch) keeps its labels."""
    lost = failed.withColumn("__lost", F.lit(True))
    numbered = rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1) / batch))
    new = answers.select("doc_id", "idx", F.col("label").alias("__l"))
    joined = numbered.join(lost, ["doc_id", "batch"], "left").join(new, ["doc_id", "idx"], "left")
    return joined.withColumn("label", F.when(F.col("__lost").isNull() & F.col("__l").isNotNull(), F.col("__l")).otherwise(F.col("label"))).select(*rows.columns)


def training_phase(samples: Column) -> Column:
    return F.when(samples >= 2000, "independent").when(samples >= 500, "apprentice").otherwise("cold_start")


def retrain_due(samples: Column, trained: Column, step: int = 200) -> Column:
    return samples - trained >= step


def sections_of(rows: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(doc_id, section, first_idx, text): paragraphs by the section of their label, sections in order of their first one."""
    table = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    known = rows.withColumn("section", F.coalesce(F.try_element_at(table, F.col("label")), F.col("label")))
    parts = known.groupBy("doc_id", "section").agg(F.min("idx").alias("first_idx"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("p"))
    return parts.select("doc_id", "section", "first_idx", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def aligned(segments: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, seq, key, style): each segment with the hint at its place, unless that names another key; else the default."""
    named = hints.select("doc_id", "seq", F.col("key").alias("__key"), F.col("style").alias("__style"))
    fits = (F.coalesce("__key", F.lit("")) == "") | (F.col("__key") == F.col("key"))
    return segments.join(named, ["doc_id", "seq"], "left").select("doc_id", "seq", "key", F.coalesce(F.when(fits, F.col("__style")), F.lit("default")).alias("style"))


# What may be repaired for each role, and what never is.
REPAIRS = {"heading": "style", "body_paragraph": "style", "table_caption": "caption", "figure_caption": "caption", "table": "layout", "references_title": "style"}
BLOCKED = ("rewrite_text", "delete_paragraph")


def repair_targets(roles: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, idx, role, repair, style): what to repair of each node by its role, with the style that a rule (role, style) wants."""
    repairs = roles.sparkSession.createDataFrame(list(REPAIRS.items()), "role string, repair string")
    nodes = roles.select("doc_id", "idx", "role").join(repairs, "role").join(styles.select("role", F.col("style").alias("wanted")), "role", "left")
    return nodes.select("doc_id", "idx", "role", "repair", F.coalesce("wanted", F.lit("")).alias("style"))


def contract_faults(contracts: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(doc_id, kind) of contracts (doc_id, artifact, steps, guards): no artifact, no step, or a blocked action without guard."""
    missing = F.array_except(F.array(*map(F.lit, blocked)), F.coalesce("guards", F.array().cast("array<string>")))
    faults = F.concat(
        F.when(F.coalesce("artifact", F.lit("")) == "", F.array(F.lit("artifact_missing"))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, F.array(F.lit("steps_missing"))).otherwise(F.array().cast("array<string>")),
        F.transform(missing, lambda g: F.concat(F.lit("guard_missing:"), g)),
    )
    return contracts.select("doc_id", F.explode(faults).alias("kind"))
