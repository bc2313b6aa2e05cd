"""The office source and sink, the registry of formats, and the verifier's rules of content types."""

import io
import random
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import packages
from quire.plans.office import document_parts
from quire.sources import office, registry

PARTS = {"[Content_Types].xml": b"<Types/>", "word/document.xml": b"<w:document/>", "word/styles.xml": b"<w:styles/>", "word/media/a.png": bytes(range(256)) * 40}


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    for i in range(5):
        (tmp_path / f"{i}.docx").write_bytes(package(PARTS | {f"word/media/{k}.bin": rng.randbytes(5000) for k in range(i)}))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "5.docx").write_bytes(package(PARTS))
    (tmp_path / "broken.docx").write_bytes(b"no zip at all")
    (tmp_path / "empty.docx").write_bytes(b"")
    (tmp_path / "bare.docx").write_bytes(package({"word/document.xml": b"<x/>"}))
    (tmp_path / "entity.docx").write_bytes(package(PARTS | {"word/styles.xml": b"<!DOCTYPE x>"}))
    (tmp_path / "_writing-1").write_bytes(b"left by a task that was lost")
    return str(tmp_path)


def test_parts_that_are_not_asked_for_are_not_inflated(folder):
    reader = office.OfficeReader({"path": folder, "parts": "word/document.xml, word/styles.xml"})
    found = [r for p in reader.partitions() for r in reader.rows(p.pieces)]
    assert reader.inflated == 14 and len([r for r in found if r[3] is not None]) == 13
    assert {r[0].rpartition("/")[2]: r[4] for r in found if r[4]} == {"broken.docx": "not a package", "empty.docx": "not a package", "bare.docx": "missing part", "entity.docx": "entity"}
    listing = office.OfficeReader({"path": folder, "content": "false"})
    assert sum(r[1] is not None for p in listing.partitions() for r in listing.rows(p.pieces)) == 7 * 4 + 10 and listing.inflated == 0


@pytest.mark.parametrize("size", [1, 700, 6000, 1 << 20])
def test_pieces_of_files_hold_each_part_once(folder, size):
    reader = office.OfficeReader({"path": folder, "rangebytes": str(size)})
    partitions = reader.partitions()
    every = [(r[0], r[1]) for p in partitions for r in reader.rows(p.pieces)]
    assert len(every) == len(set(every)) == 7 * 4 + 10 + 3
    assert (len(partitions) == 1) == (size == 1 << 20) and all(b - a <= size for p in partitions for _, a, b in p.pieces)


def test_source_and_filters(spark, folder):
    found = office.read(spark, folder)
    assert found.filter("fault IS NULL").count() == 7 * 4 + 10 - 1 and found.filter("part = 'word/media/a.png'").select("content").distinct().first()[0] == PARTS["word/media/a.png"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = office.read(spark, folder).filter("part = 'word/document.xml'")
        assert some.count() == 7 and "PushedFilters: [IsNotNull" in some._jdf.queryExecution().toString() or some.count() == 7
        assert office.read(spark, folder).filter("part LIKE 'word/media/%'").count() == 17
        assert office.read(spark, folder).filter("part IN ('word/styles.xml', 'nothing')").count() == 7
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_packages_are_written_whole_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    parts = spark.range(40).selectExpr("concat(cast(id % 10 AS string), '.docx') AS package", "concat('word/p', id, '.xml') AS part", "encode(repeat('x', int(id) * 100), 'UTF-8') AS content")
    office.write(parts, path)
    found = office.read(spark, path, strict="false")
    assert {(r["part"], r["size"]) for r in found.collect()} == {(f"word/p{i}.xml", 100 * i) for i in range(40)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{i}.docx" for i in range(10))
    office.write(parts.filter("package = '3.docx'"), path, mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["3.docx"]
    assert office.read(spark, path, strict="false").count() == 4


def test_a_write_renames_a_folder_a_task_and_what_is_not_done_is_not_read(spark, tmp_path):
    path = tmp_path / "out"
    parts = spark.range(900).selectExpr("concat('a/', cast(id % 300 AS string), '.docx') AS package", "concat('word/p', id, '.xml') AS part", "encode(repeat('x', int(id)), 'UTF-8') AS content")
    office.write(parts, str(path), folders=True)
    assert 1 <= len(list(path.iterdir())) <= 4 and all(p.name.startswith("part-") for p in path.iterdir())
    (path / "_writing-lost").mkdir()
    (path / "_writing-lost" / "0.docx").write_bytes(package(PARTS))
    found = {(r["package"].rpartition("/")[2], r["part"], bytes(r["content"])) for r in office.read(spark, str(path), strict="false").collect()}
    assert found == {(f"{i % 300}.docx", f"word/p{i}.xml", b"x" * i) for i in range(900)}
    office.write(parts.filter("part = 'word/p7.xml'"), str(path), mode="overwrite", folders=True)
    assert [r["part"] for r in office.read(spark, str(path), strict="false").collect()] == ["word/p7.xml"]


def test_a_commit_renames_each_folder_and_makes_no_folder_twice(tmp_path, monkeypatch):
    calls, (files, _) = [], office._files(str(tmp_path))

    class Told:
        def __getattr__(self, name):
            return lambda *a, **k: (calls.append(name), getattr(files, name)(*a, **k))[1]

    monkeypatch.setattr(office, "_files", lambda path: (Told(), path))
    for folders, moves in (("true", 1), ("false", 50)):
        writer = office.OfficeWriter({"path": str(tmp_path / folders), "folders": folders}, False)
        own = tmp_path / folders / f"_writing-{writer.job}-0"
        own.mkdir(parents=True)
        for i in range(50):
            (own / f"{i}").write_bytes(package(PARTS))
        names = [] if folders == "true" else [(str(own / f"{i}"), str(tmp_path / folders / f"{i}.docx")) for i in range(50)]
        calls.clear()
        writer.commit([office.Written(str(own), names, str(tmp_path / folders / "part-0") if folders == "true" else None), None])
        assert calls.count("move") == moves and calls.count("create_dir") <= 1 and not own.exists()
        listing = office.OfficeReader({"path": str(tmp_path / folders), "content": "false"})
        assert sum(1 for p in listing.partitions() for _ in listing.rows(p.pieces)) == 200


def test_packages_are_dealt_out_to_folders_that_tasks_list(tmp_path, monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        taskAttemptId = partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext", Task)
    monkeypatch.setattr(office, "RANGE", 4 * office.OPENED)
    monkeypatch.setattr(office, "HELD", 50_000, raising=False)
    noise = random.Random(1).randbytes(200_000)
    large = {"big.docx": [noise, b"small", noise[:40_000]], "deep/big.docx": [noise[:100_000]]}
    small = {f"{'deep/' * (i % 2)}{i:02}.docx": [b"x" * i, noise[:i], noise[: 300 * i]] for i in range(41)}
    rows = [(package, f"word/p{i}.bin", content) for package, contents in [*small.items(), *large.items()] for i, content in enumerate(contents)]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["package", "part", "content"])
    writer = office.OfficeWriter({"path": str(tmp_path), "folders": "true"}, False)
    writer.commit([writer.write(iter([whole.slice(0, 50), whole.slice(50)]))])
    (part,) = tmp_path.iterdir()
    (part / "dealt-0" / "_notes").write_bytes(b"not a package")
    reader = office.OfficeReader({"path": str(tmp_path), "strict": "false", "rangebytes": str(office.RANGE)})
    partitions = reader.partitions()
    folders = [x for p in partitions for x in p.pieces if x[2] is None]
    assert len(folders) == 11 and all(len(p.pieces) == 1 for p in partitions if p.pieces[0][2] is None)
    assert {x[0][len(str(part)) + 1 :] for p in partitions for x in p.pieces if x[2] is not None} == set(large)
    assert all(len(list(reader._opened([x]))) <= 4 for x in folders)
    found = sorted((r[0][len(str(part)) + 1 :], r[1], r[3]) for p in partitions for r in reader.rows(p.pieces))
    assert sorted((re.sub(r"^dealt-\d+/", "", a), b, c) for a, b, c in found) == sorted(rows)


def test_a_small_package_is_one_write(tmp_path):
    calls, (files, _) = [], office._files(str(tmp_path))

    class Sink:
        def __init__(self, sink):
            self.sink = sink

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.sink.close()

        def __getattr__(self, name):
            return lambda *a: (calls.append(name), getattr(self.sink, name)(*a))[1]

    class Told:
        open_output_stream = staticmethod(lambda name: Sink(files.open_output_stream(name)))

    out = office._Closing(Told, str(tmp_path / "0.docx"), (2026, 1, 1, 0, 0, 0))
    for part, content in PARTS.items():
        out.add(part, content)
    out.close()
    assert calls.count("write") == 1
    with zipfile.ZipFile(tmp_path / "0.docx") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == PARTS


def test_lines_that_end_in_a_carriage_return_are_not_printable(spark, tmp_path):
    spark.createDataFrame([(1, "one\r\ntwo & three\n\nfünf\n", "en"), (2, "", None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["package"]: bytes(r["content"]).decode() for r in document_parts(spark, str(tmp_path)).filter("part = 'word/document.xml'").collect()}
    assert found["1.docx"].endswith('<w:body><w:p><w:r><w:t xml:space="preserve">two &amp; three</w:t></w:r></w:p></w:body></w:document>') and found["2.docx"].endswith("<w:body></w:body></w:document>")


def test_small_files_count_for_the_time_that_opening_them_takes():
    found = office.cut([(f"{i:05}", 1000) for i in range(10_000)], office.RANGE)
    assert len(found) == 5 and sorted(x for p in found for x in p.pieces) == [(f"{i:05}", 0, 1000) for i in range(10_000)]


def test_registry(spark):
    rows = [(1, package(PARTS | {"word/document.xml": b"<w:body><w:p><w:r><w:t>one</w:t></w:r></w:p></w:body>"})), (2, b"<html><h1>Head</h1><p>two"), (3, rb"{\rtf1 three\par four}"), (4, "  fünf \n\n six".encode()), (5, b"%PDF-1.4"), (6, None), (7, b"ab")]
    df = spark.createDataFrame(rows, "key long, body binary").repartition(2)
    found = {(r["key"], r["format"], r["idx"], r["kind"], r["text"]) for r in registry.elements(df, "key", "body").collect()}
    assert found == {(1, "docx", 0, "p", "one"), (2, "html", 0, "heading", "Head"), (2, "html", 1, "paragraph", "two"), (3, "rtf", 0, "p", "three"), (3, "rtf", 1, "p", "four"), (4, "", 0, "p", "fünf"), (4, "", 1, "p", "six"), (7, "", 0, "p", "ab")}
    more = registry.elements(df, "key", "body", {"pdf": lambda content: [("page", content[:4].decode())]})
    assert more.filter("format = 'pdf'").first()["text"] == "%PDF"
    assert registry.elements(df.limit(0), "key", "body").count() == 0


@pytest.mark.parametrize(
    ("types", "media", "flagged"),
    [
        ('<Override PartName="/word/media/a.png" ContentType="image/png"/>', "word/media/a.png", False),
        ('<Default Extension="PNG"/>', "word/media/a.png", False),
        ('<Default Extension="png"/>', "word/media/A.PNG", False),
        ('<Default Extension="gif"/>', "word/media/a.png", True),
        ('<Default Extension="png"/>', "word/media/png", True),
        ("", "customXml/media/a.png", False),
    ],
)
def test_media_types(spark, types, media, flagged):
    df = spark.createDataFrame([(1, "[Content_Types].xml", types), (1, media, ""), (1, media + ".gif", "") if flagged else (1, "word/document.xml", "")], "doc_id long, part_name string, content string")
    found = [r for r in packages.verify(df).collect() if r["kind"] == "media_content_type_missing"]
    assert [r["target"] for r in found] == ["[Content_Types].xml"] * flagged


def test_headers_and_footers_are_declared_once_each(spark):
    links = '<Relationship Id="a" Type="x/relationships/header" Target="header1.xml"/><Relationship Id="b" Type="x/relationships/footer" Target="/word/footer1.xml"/>'
    types = '<Override PartName="/word/header1.xml" ContentType="wordprocessingml.header+xml"/>'
    rows = [(i, n, c) for i, t in ((1, types), (2, types + '<Override PartName="/word/footer1.xml" ContentType="wordprocessingml.footer+xml"/>'), (3, "")) for n, c in (("[Content_Types].xml", t), ("word/_rels/document.xml.rels", links), ("word/header1.xml", ""), ("word/footer1.xml", ""))]
    found = packages.verify(spark.createDataFrame(rows, "doc_id long, part_name string, content string")).filter(F.col("kind") == "header_footer_content_type_missing")
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]
