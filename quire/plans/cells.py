"""Tables with merged cells, written from the rows of part and supplier and read back as names with values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import cells
from quire.sources.tables import spread, table


def _cell(text: Column | str, marks: str = "") -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit(f"<w:tc><w:tcPr>{marks}</w:tcPr><w:p><w:r><w:t>"), text, F.lit("</w:t></w:r></w:p></w:tc>"))


def _row(*found: Column) -> Column:
    return F.concat(F.lit("<w:tr>"), *found, F.lit("</w:tr>"))


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's main part for each part: merged cells down and across, and a title that goes on in the row below."""
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("long").cast("string")
    brand = F.when(F.col("p_partkey") % 3 == 0, _row(_cell("Brand"), _cell(F.col("p_brand"), '<w:gridSpan w:val="2"/>'))).otherwise(_row(_cell("Brand"), _cell(F.col("p_brand")), _cell(F.col("p_type"))))
    first = F.concat(
        F.lit("<w:tbl>"), _row(_cell("Name"), _cell(F.col("p_name"))), brand, _row(_cell("Size", '<w:vMerge w:val="restart"/>'), _cell(size)), _row(_cell("", "<w:vMerge/>"), _cell(price)),
        _row(_cell("题目"), _cell(F.col("p_type"))), _row(_cell(""), _cell(F.col("p_name"))), F.lit("</w:tbl>"),
    )
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.concat(F.lit("<w:body>"), first, F.lit("<w:p><w:r><w:t>between</w:t></w:r></w:p><w:tbl>"), _row(_cell("alone")), F.lit("</w:tbl></w:body>")).alias("document"))


@query("""
SELECT p_partkey, 0 AS "table", "row", name, value FROM (
 SELECT p_partkey, 0 AS "row", 'Name' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 1, 'Brand', CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || ' ' || p_type END FROM part
 UNION ALL SELECT p_partkey, 2, 'Size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 3, 'Size', CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) FROM part
 UNION ALL SELECT p_partkey, 4, '题目', p_type FROM part UNION ALL SELECT p_partkey, 5, '题目续行', p_name FROM part)
UNION ALL SELECT p_partkey, 1, 0, '题目续行', 'alone' FROM part
""")
def table_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells.cells(part_tables(spark, sf_dir), "p_partkey", "document", "docx")
    return cells.fields(found, "p_partkey")


@query("""
WITH s AS (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS n, 1 + s_suppkey % 3 AS wide, 1 + s_suppkey % 2 AS tall FROM supplier)
SELECT s_suppkey, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS "column", CASE WHEN r = 0 AND c < wide THEN 'head' WHEN r = 0 THEN n WHEN c = 0 AND r - 1 < tall THEN s_name ELSE 'x' || CAST(r AS VARCHAR) END AS text
FROM s CROSS JOIN range(3) AS y(r) CROSS JOIN range(5) AS x(c) WHERE (r = 0 AND c <= wide) OR (r > 0 AND c < 2) AND NOT (r = 2 AND tall = 1 AND c = 1)
""")
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's table for each supplier, with cells of one to three columns and one or two rows."""
    wide, tall = (1 + F.col("s_suppkey") % 3).cast("string"), (1 + F.col("s_suppkey") % 2).cast("string")
    page = F.concat(
        F.lit("<html><p>before<table><tr><th colspan="), wide, F.lit(">head</th><td>"), F.col("s_nationkey").cast("string"), F.lit("</td></tr><tr><td rowspan='"), tall,
        F.lit("'>"), "s_name", F.lit("<td>x1<tr><td>x2</table>after"),
    )
    found = cells.cells(spread(table(spark, sf_dir, "supplier")).select("s_suppkey", page.alias("page")), "s_suppkey", "page", "html")
    return cells.grid(found).select("s_suppkey", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "text")
