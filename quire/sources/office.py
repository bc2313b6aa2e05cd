"""Office packages as a Spark source and sink: `spark.read.format("office")`, a row for each part of each package.

Register it once a session: `spark.dataSource.register(office.OfficeSource)`.
"""

from __future__ import annotations

import io
import re
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from quire.sources.markup import MOST_ENTRIES, MOST_RATIO, MOST_TOTAL, MOST_XML

#: Bytes of files that one partition reads, and rows of a batch; a package's directory is read by each partition that has a piece of it.
RANGE, BATCH = 32 << 20, 4096
#: Bytes that a file counts for at least, as opening a small one takes longer than reading it; files up to that size are read in one piece.
OPENED = 16 << 10
#: Parts of fewer bytes are stored as they are: deflating them takes long and saves little. Level 6 makes prose a tenth smaller and takes twice as long.
DEFLATED, LEVEL = 256, 1
#: Bytes of parts of a package up to which it is made in memory.
HELD = 1 << 20
#: How folders begin that a task writes; they hold nothing that is done.
WRITING = "_writing-"
#: How folders begin that a task fills with packages for one partition of a reader, which lists them itself.
DEALT = "dealt-"
SCHEMA = "package string, part string, size long, content binary, fault string"
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())


def _files(path: str):
    """(file system, path in it) of a path or URI, as pyarrow names them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def directory_fault(entries: list[zipfile.ZipInfo]) -> str:
    """Why a package is rejected by its directory alone; empty if it may be read."""
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
    return "" if {"[Content_Types].xml", "word/document.xml"} <= names else "missing part"


@dataclass
class Pieces(InputPartition):
    """(file, first byte, byte behind the last) of the pieces of files that a task reads; of a folder, all files of which it reads, (folder, 0, None)."""

    pieces: list[tuple[str, int, int | None]]


def cut(files: list[tuple[str, int]], size: int) -> list[Pieces]:
    """Partitions of about `size` bytes: small files together, each as OPENED bytes at least, a large one in several pieces."""
    found, held, room = [], [], size
    for path, length in sorted(files):
        for begin in range(0, max(length, 1), size):
            end = min(begin + size, max(length, 1))
            cost = max(end - begin, min(OPENED, size))
            if held and cost > room:
                found.append(Pieces(held))
                held, room = [], size
            held.append((path, begin, end))
            room -= cost
    return [*found, Pieces(held)] if held else found


def _is_done(file, path: str) -> bool:
    """Whether a file found under path holds a package, and not notes or what a task has not finished."""
    return file.is_file and not file.base_name.startswith(("_", ".")) and f"/{WRITING}" not in file.path[len(path) :]


class OfficeReader(DataSourceReader):
    """Reads the parts whose entries begin in its pieces of files; parts that are not asked for are not inflated.

    Folders that a writer dealt out for readers are listed by the tasks that read them, all others by the driver.

    Options: `path`, a file or a folder, read to all depths; `parts`, names of parts, separated by commas; `content`, false
    to list parts without their content; `strict`, false to read packages that their directory would reject; `rangeBytes`,
    bytes of files that one partition reads, unless they were dealt out.
    """

    pushed = False

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("rangebytes") or options.get("rangeBytes") or RANGE)
        self.content = options.get("content", "true").lower() != "false"
        self.strict = options.get("strict", "true").lower() != "false"
        self.tests: list[tuple[str, tuple[str, ...]]] = []
        if parts := options.get("parts"):
            self.tests.append(("in", tuple(p.strip() for p in parts.split(","))))
        self.inflated = 0

    def wanted(self, part: str) -> bool:
        by = {"in": part.__eq__, "begins": part.startswith, "ends": part.endswith}
        return all(any(by[kind](v) for v in values) for kind, values in self.tests)

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        files, path = _files(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return cut([(info.path, info.size)] if _is_done(info, path) else [], self.size) or [Pieces([])]
        found, folders, dealt = [], [path], []
        while folders:
            for f in files.get_file_info(fs.FileSelector(folders.pop())):
                if f.is_file and _is_done(f, path):
                    found.append((f.path, f.size))
                elif f.type == fs.FileType.Directory and not f.base_name.startswith(WRITING):
                    (dealt if re.fullmatch(rf"{DEALT}\d+", f.base_name) else folders).append(f.path)
        return [*cut(found, self.size), *(Pieces([(folder, 0, None)]) for folder in sorted(dealt))] or [Pieces([])]

    def _opened(self, pieces: list[tuple[str, int, int | None]]) -> Iterator[tuple[str, int, int]]:
        files, _ = _files(self.path)
        for path, begin, end in pieces:
            if end is None:
                yield from sorted((f.path, 0, max(f.size, 1)) for f in files.get_file_info(_selector(path)) if _is_done(f, path))
            else:
                yield path, begin, end

    def rows(self, pieces: list[tuple[str, int, int | None]]) -> Iterator[tuple]:
        """(package, part, size, content, fault) of entries in the pieces; a rejected package is one row with its fault, in its first piece."""
        files, _ = _files(self.path)
        for path, begin, end in self._opened(pieces):
            with files.open_input_file(path) as file:
                try:
                    z = zipfile.ZipFile(io.BytesIO(file.read()) if begin == 0 and end <= OPENED else file)
                except (zipfile.BadZipFile, pa.ArrowInvalid, OSError, EOFError):
                    if begin == 0 and not self.pushed:
                        yield path, None, None, None, "not a package"
                    continue
                if self.strict and (fault := directory_fault(z.infolist())):
                    if begin == 0 and not self.pushed:
                        yield path, None, None, None, fault
                    continue
                for entry in z.infolist():
                    if begin <= entry.header_offset < end and not entry.is_dir() and self.wanted(entry.filename):
                        yield path, entry.filename, entry.file_size, *self._content(z, entry)

    def _content(self, z: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        if not self.content:
            return None, None
        self.inflated += 1
        try:
            found = z.read(entry)
        except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError):
            return None, "unreadable part"
        if entry.filename.endswith(".xml") and re.search(rb"<!(DOCTYPE|ENTITY)", found):
            return None, "entity"
        return found, None

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        size = 0
        for row in self.rows(partition.pieces):
            held.append(row)
            size += len(row[3] or b"")
            if len(held) == BATCH or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names)


class FilteringReader(OfficeReader):
    """Takes filters on `part`: equality, IN, prefix and suffix. Rows of rejected packages have no part, so they go with any."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("part",):
                self.tests.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("part",):
                self.tests.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("part",):
                self.tests.append(("begins", (f.value,)))
            elif isinstance(f, StringEndsWith) and f.attribute == ("part",):
                self.tests.append(("ends", (f.value,)))
            else:
                yield f
                continue
            self.pushed = True


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its own folder, and (file in it, real name) of packages that are renamed one by one."""

    folder: str
    names: list[tuple[str, str]]
    real: str | None


class OfficeWriter(DataSourceArrowWriter):
    """Writes packages from rows with package, part and content; a package's rows come together to one task, in any order of parts.

    A task writes to a folder of its own; packages get their real names when all tasks are done, so a task that runs again, or one
    that is lost, leaves nothing half written. `deal` puts rows in the order that this needs.

    Options: `path`; `folders`, true to leave each task's packages in one folder, which the file system must be able to
    rename: the driver then renames a folder a task and not each package, and a package that is appended again is there twice.
    In it they are dealt out to folders of as much as one partition of a reader takes; larger packages lie beside these.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.folders = options.get("folders", "false").lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written | None:
        from pyspark import TaskContext

        files, folder = _files(self.path)
        context, names, out, current = TaskContext.get(), [], None, None
        own, made, now = f"{folder}/{WRITING}{self.job}-{context.taskAttemptId()}", set(), time.localtime()[:6]
        dealt, room = 0, RANGE

        def place(name: str) -> str:
            if (above := name.rpartition("/")[0]) not in made:
                files.create_dir(above, recursive=True)
                made.add(above)
            return name

        def close() -> None:
            nonlocal dealt, room
            out.close()
            if not self.folders:
                return
            if out.size > RANGE:
                files.move(out.name, place(f"{own}/{current}"))
            else:
                room -= max(out.size, OPENED)
            if room <= 0:
                dealt, room = dealt + 1, RANGE

        try:
            for batch in batches:
                for package, part, content in zip(*(batch.column(c).to_pylist() for c in ("package", "part", "content")), strict=True):
                    if package != current:
                        if out:
                            close()
                        name = place(f"{own}/{DEALT}{dealt}/{package}" if self.folders else f"{own}/{len(names)}")
                        if not self.folders:
                            names.append((name, f"{folder}/{package}"))
                        out, current = _Closing(files, name, now), package
                    out.add(part, content or b"")
        finally:
            if out:
                close()
        return Written(own, names, f"{folder}/part-{self.job}-{context.partitionId()}" if self.folders else None) if made else None

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _files(self.path)
        written, made = [m for m in messages if m], set()
        if self.overwrite:
            kept = {m.folder for m in written}
            for info in files.get_file_info(_selector(folder)):
                if info.is_file and "/".join((folder, info.path[len(folder) + 1 :].split("/")[0])) not in kept:
                    files.delete_file(info.path)
        for m in written:
            for name, real in m.names:
                if (above := real.rpartition("/")[0]) not in made:
                    files.create_dir(above, recursive=True)
                    made.add(above)
                files.move(name, real)
            if m.real:
                files.move(m.folder, m.real)
            else:
                files.delete_dir(m.folder)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _files(self.path)
        for m in messages:
            if m:
                files.delete_dir(m.folder)


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, recursive=True, allow_not_found=True)


class _Closing:
    """A package whose parts are held up to HELD bytes; a larger one is written to a stream which can't be rewound. now: the time that its parts bear."""

    def __init__(self, files, name: str, now: tuple):
        self.files, self.name, self.now = files, name, now
        self.held: list[tuple[str, bytes]] = []
        self.room, self.size, self.sink, self.zip = HELD, 0, None, None

    def add(self, part: str, content: bytes) -> None:
        if self.zip:
            self._put(self.zip, part, content)
            return
        self.held.append((part, content))
        self.room -= len(part) + len(content)
        if self.room < 0:
            self.sink = self.files.open_output_stream(self.name)
            self.zip = zipfile.ZipFile(self.sink, "w")
            self._put_held(self.zip)

    def _put(self, package: zipfile.ZipFile, part: str, content: bytes) -> None:
        entry = zipfile.ZipInfo(part, self.now)
        entry.external_attr = 0o600 << 16
        package.writestr(entry, content, zipfile.ZIP_DEFLATED if len(content) >= DEFLATED else zipfile.ZIP_STORED, LEVEL)

    def _put_held(self, package: zipfile.ZipFile) -> None:
        for part, content in self.held:
            self._put(package, part, content)
        self.held.clear()

    def close(self) -> None:
        if self.zip:
            self.zip.close()
            self.size = self.sink.tell()
            self.sink.close()
            return
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w") as package:
            self._put_held(package)
        self.size = whole.tell()
        with self.files.open_output_stream(self.name) as sink:
            sink.write(whole.getbuffer())


class OfficeSource(DataSource):
    """format("office"); see OfficeReader and OfficeWriter."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OfficeReader:
        return (FilteringReader if self.options.get("pushfilters", "").lower() == "true" else OfficeReader)(self.options)

    def writer(self, schema, overwrite: bool) -> OfficeWriter:
        return OfficeWriter(self.options, overwrite)


def read(spark, path: str, **options):
    """(package, part, size, content, fault) of the packages under path; options are OfficeReader's.

    Filters on `part` reach the reader where the session lets Python sources take any (spark.sql.python.filterPushdown.enabled).
    """
    spark.dataSource.register(OfficeSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("office").options(pushFilters=push, **options).load(path)


def write(parts, path: str, mode: str = "append", folders: bool = False) -> None:
    """Writes packages; parts: package (the file's name), part, content (binary). A package's parts meet in one task.

    folders: leave each task's packages in a folder, see OfficeWriter.
    """
    parts.sparkSession.dataSource.register(OfficeSource)
    dealt = parts.select("package", "part", "content").repartition("package").sortWithinPartitions("package", "part")
    dealt.write.format("office").mode(mode).option("folders", str(folders).lower()).save(path)
