"""HTML and DOCX as rows. Spark reads the bytes; a parser runs on each file's content inside the tasks."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import small_batches

BLOCKS = {"p", "div", "section", "article", "main", "blockquote", "pre"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
# Limits that a DOCX package must keep.
MOST_ENTRIES, MOST_TOTAL, MOST_XML, MOST_RATIO = 10_000, 512 << 20, 16 << 20, 1000


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and table rows of a page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, str]] = []
        self.text: list[str] = []
        self.kind, self.level, self.skip = "paragraph", 0, 0
        self.lists: list[str] = []
        self.cells: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.found.append((self.kind, self.level, f"• {text}" if self.kind == "item" and self.lists and self.lists[-1] == "ul" else text))
        self.kind, self.level = "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.text = []
        elif self.cells is None and (tag in BLOCKS or tag in HEADINGS or tag in ("li", "ul", "ol")):
            self.flush()
            if tag in HEADINGS:
                self.kind, self.level = "heading", HEADINGS[tag]
            elif tag == "li":
                self.kind = "item"
            elif tag in ("ul", "ol"):
                self.lists.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.found.append(("row", 0, "|".join(self.cells)))
            self.cells, self.text = None, []
        elif self.cells is None and (tag in BLOCKS or tag in HEADINGS or tag in ("li", "ul", "ol")):
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse_html(text: str | None) -> list[tuple[str, int, str]]:
    """(kind, level, text) of each block; kinds: heading, paragraph, item, row (cells joined by |)."""
    parser = _Blocks()
    parser.feed(text or "")
    parser.close()
    parser.flush()
    return parser.found


def _rows(df: DataFrame, parse, columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """(key, idx, parsed columns): parse gives tuples for each value of df's second column."""
    names = ["key", "idx", *columns]
    kinds = [pa.int64(), pa.int32(), *[k for _, k in columns.values()]]
    schema = ", ".join(["key long", "idx int", *[f"{n} {t}" for n, (t, _) in columns.items()]])

    def run(batches):
        for batch in batches:
            out = [(k, i, *row) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, row in enumerate(parse(v))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

    return small_batches(df).mapInArrow(run, schema)


def html_blocks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, kind, level, text) of every block of every page."""
    found = _rows(pages.select(F.col(key).cast("long"), text), parse_html, {"kind": ("string", pa.string()), "level": ("int", pa.int32()), "text": ("string", pa.string())})
    return found.withColumnRenamed("key", key)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files, as Spark's own reader lists them."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def unsafe(package: bytes | None) -> str:
    """Why a DOCX package is rejected; empty if it may be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(package or b"")) as z:
            entries = z.infolist()
            names = {e.filename for e in entries}
            if not entries or len(entries) > MOST_ENTRIES:
                return "entries"
            if sum(e.file_size for e in entries) > MOST_TOTAL or any(e.file_size > MOST_XML for e in entries if e.filename.endswith(".xml")):
                return "size"
            if any(e.file_size > 10 << 20 and e.file_size > MOST_RATIO * max(e.compress_size, 1) for e in entries):
                return "ratio"
            if any(n.startswith("/") or ".." in n.split("/") or "\\" in n for n in names):
                return "path"
            if any("vbaproject" in n.lower() or "activex" in n.lower() for n in names):
                return "active content"
            if not {"[Content_Types].xml", "word/document.xml"} <= names:
                return "missing part"
            if any(re.search(rb"<!(DOCTYPE|ENTITY)", z.read(n)) for n in names if n.endswith(".xml")):
                return "entity"
    except (zipfile.BadZipFile, OSError, EOFError):
        return "not a package"
    return ""


def docx_parts(package: bytes | None) -> Iterator[tuple[str, str]]:
    """(name, content) of the XML parts of a package, by name."""
    if not unsafe(package):
        with zipfile.ZipFile(io.BytesIO(package)) as z:
            for name in sorted(z.namelist()):
                if name.endswith((".xml", ".rels")):
                    yield name, z.read(name).decode("utf-8", "replace")


def docx_elements(document: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the paragraphs and tables of a body; deleted runs are dropped, inserted ones kept."""
    body = re.search(r"(?s)<w:body>(.*)</w:body>", document)
    live = re.sub(r"(?s)<w:(del|moveFrom)\b[^>]*>.*?</w:\1>", "", body.group(1)) if body else ""
    depth = 0
    piece: list[str] = []
    for tag in re.finditer(r"(?s)<(/?)w:(tbl|p|t|tab|br)\b([^>]*?)(/?)>(?:([^<]*)(?=</w:t>))?", live):
        close, name, _, alone, text = tag.groups()
        if name == "tbl":
            depth += -1 if close else 1
            if not depth and close:
                yield "tbl", "".join(piece)
            if depth <= 1 and not (depth == 1 and close):
                piece = []
        elif name == "p" and not depth:
            if close or alone:
                yield "p", "".join(piece)
            piece = []
        elif name == "t" and text:
            piece.append(html.unescape(text))
        elif name in ("tab", "br") and not close:
            piece.append("\t" if name == "tab" else "\n")


def parse_docx(package: bytes | None) -> list[tuple[str, str]]:
    return [x for name, content in docx_parts(package) if name == "word/document.xml" for x in docx_elements(content)]


def docx_paragraphs(packages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, idx, kind, text) of the body elements of DOCX packages, as binary."""
    found = _rows(packages.select(F.col(key).cast("long"), content), parse_docx, {"kind": ("string", pa.string()), "text": ("string", pa.string())})
    return found.withColumnRenamed("key", key)


def docx_part_rows(packages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, idx, part_name, content) of the XML parts of DOCX packages."""
    found = _rows(packages.select(F.col(key).cast("long"), content), lambda x: list(docx_parts(x)), {"part_name": ("string", pa.string()), "content": ("string", pa.string())})
    return found.withColumnRenamed("key", key)


def body_elements(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, idx, kind, text) of the body elements of the main parts of packages, as text."""
    found = _rows(documents.select(F.col(key).cast("long"), document), lambda x: list(docx_elements(x or "")), {"kind": ("string", pa.string()), "text": ("string", pa.string())})
    return found.withColumnRenamed("key", key)
