"""Text of pages from spans with places, and levels of headings from styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators.hierarchy import nearest

#: How far two spans of a line may lie apart in height.
TOLERANCE = 0.5
DEEPEST = 9
# Names of heading styles, before their number.
HEADING, TITLE, NUMERALS = "heading", "标题", "一二三四五六七八九"


def page_lines(spans: DataFrame, keys: list[str], *, tolerance: float = TOLERANCE, x: str = "x", y: str = "y", text: str = "text") -> DataFrame:
    """(keys, line, y, text) of the lines of each page, the topmost first; spans: keys (document and page), x, y upwards, text.

    Spans are sorted by height; where the next one lies further below than `tolerance`, a line ends, so a line is a group
    of spans that hang together (gaps and islands), whatever their order in x. In a line spans stand by x, then by text,
    and are joined as they are, as a rendering places its blanks too. A page is one window; null texts are empty, and spans without a
    place are left out.
    """
    placed = spans.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    down = Window.partitionBy(*keys).orderBy(F.col(y).desc(), x, text)
    gap = (F.lag(y).over(down) - F.col(y) > tolerance).cast("int")
    numbered = placed.withColumn("__gap", F.coalesce(gap, F.lit(0))).withColumn("line", F.sum("__gap").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    listed = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.coalesce(text, F.lit("")).alias("t"))))
    return numbered.groupBy(*keys, "line").agg(F.max(y).alias(y), F.array_join(F.transform(listed, lambda s: s["t"]), "").alias(text))


def page_texts(lines: DataFrame, keys: list[str], *, text: str = "text") -> DataFrame:
    """(keys, text) of each page: its lines in order, without any white space."""
    listed = F.array_sort(F.collect_list(F.struct("line", text)))
    return lines.groupBy(*keys).agg(T.squeezed(F.array_join(F.transform(listed, lambda s: s[text]), "")).alias(text))


def named_level(name: Column) -> Column:
    """1 to 9 by the name of a heading style, 0 for other names and null."""
    bare = F.regexp_replace(F.lower(T.uni_trim(F.coalesce(name, F.lit("")))), "[ _-]", "")
    digit = F.regexp_extract(bare, f"^(?:{HEADING}|{TITLE})([1-9])$", 1)
    spelt = F.instr(F.lit(NUMERALS), F.nullif(F.regexp_extract(bare, f"^{TITLE}([{NUMERALS}])$", 1), F.lit("")))
    return F.when(digit != "", digit.try_cast("int")).otherwise(F.coalesce(spelt, F.lit(0)))


def style_levels(styles: DataFrame, *, style: str = "style_id", parent: str = "based_on", name: str = "name", outline: str = "outline") -> DataFrame:
    """(style, level) of every style: 1 to 9, 0 where it is no heading.

    A style's own level is one more than its outline level, else that of its name, else that of its id. The nearest style of
    the chain with a level decides, of any number of styles and through cycles, which end; a level above 9 that decides is none. A
    style that is based on one without a definition has the level that the missing one's id names, if nothing nearer has any.
    """
    first = lambda *levels: F.coalesce(*[F.nullif(x, F.lit(0)) for x in levels])
    level = first(F.col(outline) + 1, named_level(F.col(name)), named_level(F.col(style).cast("string")))
    own = styles.select(F.col(style).alias("style"), F.col(parent).alias("parent"), level.alias("level"))
    gone = own.select(F.col("parent").alias("style")).distinct().join(own, "style", "left_anti").select("style", F.lit(None).cast(own.schema["parent"].dataType), first(named_level(F.col("style").cast("string"))))
    found = own.select("style").distinct().join(nearest(own.union(gone), "style", "parent", ["level"]), "style", "left").withColumnRenamed("style", style)
    return found.select(style, F.when(F.col("level").between(1, DEEPEST), F.col("level")).otherwise(0).cast("int").alias("level"))


def heading_levels(rows: DataFrame, levels: DataFrame, *, style: str = "style_id", outline: str = "outline", id_level: bool = True) -> DataFrame:
    """rows with level: by the paragraph's own outline level, else by its style, else by the name of a style without a definition; 0 for body text."""
    known = levels.select(F.col(style).alias("__style"), F.col("level").alias("__level"))
    own = F.when(F.col(outline).between(0, DEEPEST - 1), F.col(outline) + 1)
    by_id = named_level(F.col(style)) if id_level else F.lit(0)
    return rows.join(known, F.col(style) == F.col("__style"), "left").select(*rows.columns, F.coalesce(own, "__level", by_id).cast("int").alias("level"))
