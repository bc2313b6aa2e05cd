"""Tables of documents and pages as cells on a grid, and what they say as names with values."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows or columns that one cell may span.
WIDEST = 1000
# Fixed value: a lone cell below this name goes on with it, under the name beside it.
CONTINUED = {"题目": "题目续行"}


class Cell(NamedTuple):
    """A cell as it is written: its text, the columns and rows that it spans, and whether it goes on with the cell above."""

    text: str
    columns: int = 1
    rows: int = 1
    continues: bool = False


def laid(rows: list[list[Cell]]) -> Iterator[tuple[int, int, int, int, str]]:
    """(row, column, rows, columns, text) of each cell: it takes the first place of its row that no cell from above has."""
    taken: dict[tuple[int, int], int] = {}
    found: list[list] = []
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken and not cell.continues:
                c += 1
            above = taken.get((r - 1, c)) if cell.continues else None
            if above is not None:
                found[above][2] = r + 1 - found[above][0]
            else:
                above = len(found)
                found.append([r, c, min(cell.rows, len(rows) - r), cell.columns, cell.text])
            for i in range(r, r + (1 if cell.continues else found[above][2])):
                taken.update({(i, k): above for k in range(c, c + cell.columns)})
            c += cell.columns
    return map(tuple, found)


_DOCX = re.compile(r'(?s)<(/?)w:(tbl|tr|tc|t|tab|br)(?=[\s/>])([^>]*?)(/?)>(?:([^<]*)(?=</w:t>))?|<w:(gridSpan|vMerge)(?=[\s/>])([^>]*)>')


def _span(text: str | None) -> int:
    return min(int(text), WIDEST) if text and text.isdigit() and int(text) else 1


def docx_tables(document: str) -> list[list[list[Cell]]]:
    """The cells of each table of a main part; a table in a cell is text of that cell."""
    tables: list[list[list[Cell]]] = []
    depth, text, columns, goes_on = 0, [], 1, False
    for m in _DOCX.finditer(document):
        close, name, _, alone, said, mark, rest = m.groups()
        if mark == "gridSpan" and depth == 1:
            columns = _span((re.search(r'w:val="(\d+)"', rest) or [None, None])[1])
        elif mark == "vMerge" and depth == 1:
            goes_on = 'w:val="restart"' not in rest
        elif name == "tbl":
            depth += -1 if close else 1
            if depth == 1 and not close:
                tables.append([])
        elif not depth:
            continue
        elif name == "t" and said:
            text.append(html.unescape(said))
        elif name in ("tab", "br") and not close:
            text.append("\t" if name == "tab" else "\n")
        elif depth == 1 and name == "tr" and not close:
            tables[-1].append([])
        elif depth == 1 and name == "tc" and not alone:
            if close and tables[-1]:
                tables[-1][-1].append(Cell("".join(text).strip(), columns, 1, goes_on))
            text, columns, goes_on = [], 1, False
    return tables


class _Tables(HTMLParser):
    """The cells of a page's tables; a table in a cell is text of that cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[Cell]]] = []
        self.depth, self.text, self.spans = 0, [], None

    def close_cell(self) -> None:
        if self.spans:
            self.tables[-1][-1].append(Cell(" ".join("".join(self.text).split()), *self.spans))
        self.text, self.spans = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.close_cell()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.close_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            named = dict(attrs)
            self.spans = _span(named.get("colspan")), _span(named.get("rowspan"))

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.depth and self.spans:
            self.text.append(data)


def html_tables(page: str) -> list[list[list[Cell]]]:
    parser = _Tables()
    parser.feed(page)
    parser.close()
    if parser.depth:
        parser.close_cell()
    return parser.tables


PARSERS = {"docx": docx_tables, "html": html_tables}


def cells(rows: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, table, row, column, rows, columns, text) of every cell of every table; kind: docx (main parts) or html.

    A null text has no tables; a table without cells no rows. Spans end with their table and at a thousand; a cell that would go
    on with one above, where none is, begins anew.
    """
    parse = PARSERS[kind]
    names = ["key", "table", "row", "column", "rows", "columns", "text"]
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.string()]

    def run(batches):
        for batch in batches:
            out = [(k, t, *cell) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, table in enumerate(parse(v or "")) for cell in laid(table)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    found = rows.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, table int, row int, column int, rows int, columns int, text string")
    return found.withColumnRenamed("key", key)


def grid(found: DataFrame) -> DataFrame:
    """Each place of the grid with the text of the cell that covers it; `first`: the cell begins there."""
    down, right = F.explode(F.sequence(F.lit(0), F.col("rows") - 1)), F.explode(F.sequence(F.lit(0), F.col("columns") - 1))
    placed = found.withColumn("down", down).withColumn("right", right)
    keep = [c for c in found.columns if c not in ("row", "column", "rows", "columns", "text")]
    return placed.select(*keep, (F.col("row") + F.col("down")).alias("row"), (F.col("column") + F.col("right")).alias("column"), "text", ((F.col("down") == 0) & (F.col("right") == 0)).alias("first"))


def fields(found: DataFrame, key: str, continued: dict[str, str] | None = None) -> DataFrame:
    """(key, table, row, name, value) of each row with two cells or more that hold something: the first names the others, joined by spaces.

    A cell that spans rows stands in each of them, so the name of a tall cell is carried to the rows beside it; one
    that spans columns stands once. A lone cell gives a value if the row with a name before it, of the same document, has a
    name in `continued`, under the name given there; other lone cells give nothing.
    """
    more = CONTINUED if continued is None else continued
    places = found.filter(F.trim("text") != "").withColumn("row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rows") - 1)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("column", F.trim("text").alias("text")))), lambda x: x["text"])
    rows = places.groupBy(key, "table", "row").agg(listed.alias("t"))
    name = F.when(F.size("t") > 1, F.col("t")[0])
    before = F.last(name, ignorenulls=True).over(Window.partitionBy(key).orderBy("table", "row").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.create_map(*[F.lit(x) for pair in more.items() for x in pair]) if more else F.create_map().cast("map<string,string>")
    named = rows.withColumns({"name": F.coalesce(name, F.try_element_at(carried, before)), "value": F.when(F.size("t") > 1, F.array_join(F.slice("t", 2, WIDEST * WIDEST), " ")).otherwise(F.col("t")[0])})
    return named.filter("name IS NOT NULL").select(key, "table", "row", "name", "value")
