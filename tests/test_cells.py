"""Tables on a grid, and what they say as names with values."""

import pytest

from quire.sources import cells
from quire.sources.cells import Cell


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([], []),
        ([[]], []),
        ([[Cell("a"), Cell("b")], [Cell("c")]], [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, "c")]),
        ([[Cell("a", 2), Cell("b", 1, 2)], [Cell("c"), Cell("d"), Cell("e")]], [(0, 0, 1, 2, "a"), (0, 2, 2, 1, "b"), (1, 0, 1, 1, "c"), (1, 1, 1, 1, "d"), (1, 3, 1, 1, "e")]),
        ([[Cell("a", 1, 9)], [Cell("b")], [Cell("c")]], [(0, 0, 3, 1, "a"), (1, 1, 1, 1, "b"), (2, 1, 1, 1, "c")]),
        ([[Cell("k"), Cell("a")], [Cell("", 1, 1, True), Cell("b")], [Cell("", 1, 1, True), Cell("c")]], [(0, 0, 3, 1, "k"), (0, 1, 1, 1, "a"), (1, 1, 1, 1, "b"), (2, 1, 1, 1, "c")]),
        ([[Cell("x", 1, 1, True)]], [(0, 0, 1, 1, "x")]),
        ([[Cell("w", 2)], [Cell("", 2, 1, True)], [Cell("n")]], [(0, 0, 2, 2, "w"), (2, 0, 1, 1, "n")]),
    ],
)
def test_cells_are_laid_on_a_grid(rows, expected):
    assert list(cells.laid(rows)) == expected


def test_tables_of_pages():
    page = "<p>x<table><caption>no</caption><tr><td>a<b> b</b><td colspan=2>c<table><tr><td>in</table></td></tr><tr><th rowspan='2'>d</table><td>out<table><td>lone"
    assert cells.html_tables(page) == [[[Cell("a b"), Cell("cin", 2)], [Cell("d", 1, 2)]], [[Cell("lone")]]]
    assert cells.html_tables("") == [] and cells.html_tables("<table><tr></table>") == [[[]]]
    assert cells.html_tables("<table><tr><td colspan=99999999><td colspan=x rowspan=0>y")[0][0] == [Cell("", cells.WIDEST), Cell("y")]


def test_tables_of_documents():
    text = lambda s: f"<w:p><w:r><w:t>{s}</w:t><w:tab/></w:r></w:p>"
    xml = f'<w:body>{text("out")}<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr>{text("a&amp;b")}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr></w:tc><w:tc><w:tbl><w:tr><w:tc>{text("in")}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>{text("t")}</w:body>'
    assert cells.docx_tables(xml) == [[[Cell("a&b", 2)], [Cell("", 1, 1, True), Cell("in")]]]


def test_names_and_values(spark):
    rows = "<table><tr><td>Title<td>Source Paper<tr><td>College<td> Nursing <td>College<tr><td rowspan=2>Tall<td>one<tr><td>two<tr><td>&nbsp;<td>alone<tr><td>题目<td>a<tr><td><td>b</table>"
    df = spark.createDataFrame([(1, rows), (2, None), (3, "<table><tr><td>x</table>"), (4, "no table")], "k long, page string")
    found = cells.cells(df, "k", "page", "html")
    assert [tuple(r) for r in cells.fields(found, "k").orderBy("table", "row").collect()] == [
        (1, 0, 0, "Title", "Source Paper"), (1, 0, 1, "College", "Nursing College"), (1, 0, 2, "Tall", "one"), (1, 0, 3, "Tall", "two"), (1, 0, 5, "题目", "a"), (1, 0, 6, "题目续行", "b"),
    ]
    assert cells.fields(found, "k", {}).count() == 5
    assert cells.grid(found).filter("k = 1 AND row = 3").orderBy("column").select("text").collect() == [("Tall",), ("two",)]
    assert cells.fields(found.limit(0), "k").count() == 0


def test_short_tables_are_parsed_by_all_cores(spark, sf_dir):
    from quire.plans.cells import part_tables

    assert part_tables(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_long_contents_come_in_small_batches(spark):
    from quire.sources import markup

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    found = markup.html_blocks(spark.createDataFrame([(1, "<p>a")], "k long, page string"), "k", "page")
    assert 0 < int(spark.conf.get(key).rstrip("b")) <= 4 << 20 and found.count() == 1
    spark.conf.unset(key)
