"""Formats of files by what their first bytes show, each with a parser that gives the elements of a body."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.markup import parse_docx, parse_html

#: Gives (kind, text) of the elements of a file, in order.
Parser = Callable[[bytes], Iterable[tuple[str, str]]]


def parse_lines(content: bytes) -> list[tuple[str, str]]:
    """The lines of a plain text that hold something, as paragraphs."""
    return [("p", line.strip()) for line in content.decode("utf-8", "replace").splitlines() if line.strip()]


PARSERS: dict[str, Parser] = {
    "docx": parse_docx,
    "html": lambda content: [(kind, text) for kind, _, text in parse_html(content.decode("utf-8", "replace"))],
    "rtf": parse_lines,
    "": parse_lines,
}


def elements(files: DataFrame, key: str, content: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(key, format, idx, kind, text) of every file by the parser of its format; content is binary.

    parsers: more formats, or others in the place of known ones, by the name that `sniffed` gives them. Files of a format without
    a parser (doc, pdf) have no rows; files under four bytes and unknown ones are plain text; null contents have no rows.
    RTF becomes plain text in the engine first. All formats are read in one pass.
    """
    known = PARSERS | (parsers or {})
    kind = F.coalesce(T.sniffed(F.col(content)), F.lit(""))
    plain = F.encode(T.rtf_text(F.decode(F.col(content), "UTF-8")), "UTF-8")
    rows = files.filter(F.col(content).isNotNull()).select(F.col(key).cast("string").alias("key"), kind.alias("format"), F.when(kind == "rtf", plain).otherwise(F.col(content)).alias("content"))
    names = ["key", "format", "idx", "kind", "text"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            out = [
                (k, f, i, *found)
                for k, f, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                if f in known
                for i, found in enumerate(known[f](c))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    found = rows.filter(F.col("format").isin(*known)).mapInArrow(run, "key string, format string, idx int, kind string, text string")
    return found.withColumn("key", F.col("key").cast(files.schema[key].dataType)).withColumnRenamed("key", key)
