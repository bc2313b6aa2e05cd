"""Rendered pages and spans: drift from a golden rendering, styles, and pictures next to their captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators.issues import REPAIRABLE, WARNING, checked, pages_with

ERROR = "error"
SIZE_DRIFT, X_DRIFT, CENTRE = 0.25, 3.0, 6.0
#: The width of a text area in EMU that is taken where no page setup is known.
TEXT_WIDTH = 5_800_000


def span_of(spans: DataFrame, needles: DataFrame, needle: str) -> DataFrame:
    """The needles (doc_id, needle, ...) with the first span (in order of seq) that holds the text or is part of it, white space aside."""
    bare = spans.select("doc_id", F.struct(*[c for c in spans.columns if c != "doc_id"]).alias("span"), T.squeezed(F.col("text")).alias("__bare")).filter("__bare <> ''")
    wanted = needles.withColumn("__needle", T.squeezed(F.col(needle)))
    near = F.contains("__bare", "__needle") | F.contains("__needle", "__bare")
    first = wanted.join(bare, "doc_id").filter(near).groupBy("doc_id", needle).agg(F.min_by("span", "span.seq").alias("span"))
    return wanted.drop("__needle").join(first, ["doc_id", needle], "left")


def same_page_drift(golden: DataFrame, candidate: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of landmarks (doc_id, name, left, right) that the golden rendering holds on one page and the candidate does not."""
    out = pairs
    for side, pages in (("g", golden), ("c", candidate)):
        for place in ("left", "right"):
            marks = pairs.select("doc_id", F.col(place).alias("landmark")).distinct()
            found = pages_with(pages, marks, f"{side}_{place}").withColumnRenamed("landmark", place)
            out = out.join(found, ["doc_id", place], "left")
    together = (F.col("g_left") > 0) & (F.col("g_left") == F.col("g_right"))
    gone = (F.col("c_left") == 0) | (F.col("c_right") == 0)
    rules = [
        ("candidate_same_page_landmark_missing", ERROR, together & gone, F.col("name")),
        ("candidate_same_page_drift", ERROR, together & ~gone & (F.col("c_left") != F.col("c_right")), F.col("name")),
    ]
    return checked(out, ["doc_id"], rules)


def style_drift(golden: DataFrame, candidate: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Landmarks (doc_id, landmark) whose span has another font, size or place than the golden one, or that has none."""
    both = span_of(golden, landmarks, "landmark").withColumnRenamed("span", "g").join(span_of(candidate, landmarks, "landmark").withColumnRenamed("span", "c"), ["doc_id", "landmark"])
    lost = F.col("g").isNull() | F.col("c").isNull()
    far = lambda field, most: F.abs(F.col(f"c.{field}") - F.col(f"g.{field}")) > most
    rules = [
        ("landmark_style_unavailable", WARNING, lost, F.col("landmark")),
        ("landmark_font_drift", ERROR, T.font_key(F.col("c.font")) != T.font_key(F.col("g.font")), F.col("landmark")),
        ("landmark_font_size_drift", ERROR, far("font_size", SIZE_DRIFT), F.col("landmark")),
        ("landmark_horizontal_drift", ERROR, far("x", X_DRIFT), F.col("landmark")),
    ]
    return checked(both, ["doc_id"], rules)


def alignment(x: Column, width: Column, page: Column) -> Column:
    return F.when(F.abs(x + width / 2 - page / 2) <= CENTRE, "center").when(x > page / 2, "right").otherwise("left")


def style_rules(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (doc_id, name, wanted, font, size, tolerance, alignment) that their span breaks; empty and zero wishes are none."""
    found = span_of(spans, rules, "wanted")
    font = T.font_key(F.col("font"))
    tolerance = F.when(F.col("tolerance") > 0, F.col("tolerance")).otherwise(SIZE_DRIFT)
    side = alignment(F.col("span.x"), F.col("span.width"), F.col("span.page_width"))
    checks = [
        ("rendered_style_target_missing", ERROR, F.col("span").isNull(), F.col("name")),
        ("rendered_font_mismatch", ERROR, (font != "") & ~F.contains(T.font_key(F.col("span.font")), font), F.col("name")),
        ("rendered_font_size_mismatch", ERROR, (F.col("size") > 0) & (F.abs(F.col("span.font_size") - F.col("size")) > tolerance), F.col("name")),
        ("rendered_alignment_mismatch", ERROR, (F.col("alignment") != "") & (F.col("span.page_width") > 0) & (side != F.col("alignment")), F.col("name")),
    ]
    return checked(found, ["doc_id"], checks)


def pictures(rows: DataFrame, most: int = TEXT_WIDTH) -> DataFrame:
    """Issues of pictures in the body; rows: doc_id, idx, text, picture, anchored, width, kept_with_next, grouped, in_body.

    A picture is inline, no wider than the text, and kept with the figure caption that follows, which names its chapter.
    """
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    after = T.uni_trim(F.coalesce(F.first(F.when(T.uni_trim("text") != "", F.col("text")), ignorenulls=True).over(w), F.lit("")))
    found = rows.withColumn("after", after).filter(F.col("picture") & F.col("in_body"))
    captioned, idx = F.col("after").startswith("图"), F.col("idx")
    single = ~F.col("grouped")
    rules = [
        ("floating_image_anchor", REPAIRABLE, F.col("anchored"), idx),
        ("image_width_over_text_area", REPAIRABLE, F.col("width") > most, idx),
        ("image_keep_with_caption_missing", REPAIRABLE, single & (~captioned | ~F.col("kept_with_next")), idx),
        ("figure_caption_missing_chapter_number", REPAIRABLE, single & captioned & ~F.col("after").rlike(r"^图\d+[.-]\d+"), idx),
    ]
    return checked(found, ["doc_id"], rules)
