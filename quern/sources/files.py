"""Library files and entry folders as Spark data sources.

`library` reads block-structured library files by ranges of blocks: a large file is many partitions, each of
which finds the directory blocks of its range and follows their entries' data by random access, so that no
task holds a file. `entry_folder` writes entries as raw files with a manifest, committed in two phases: tasks
put their files and their part of the manifest into folders of their own, and only the job's commit writes
the manifest that names them. Readers follow the manifest, so that failed and aborted attempts are never seen;
no file is renamed, which suits object stores too.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.functions.bytesio import FormatError, entry_file, object_type, u16_at
from quern.sources.container import _BLOCKS, BLOCK, DIRECTORY, HEADER, MAX_ENTRIES, NODE, _entry, find_header, read_chain

#: Rows of the library source. `at` is the place of an entry in its file's directory, which orders entries.
LIBRARY_ROWS = f"library string, at long, name string, object_type string, size long, offset long, data binary, data_blocks {_BLOCKS}, error string, error_offset long"
_ARROW = pa.schema([
    ("library", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("object_type", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()),
    ("data_blocks", pa.list_(pa.struct([("offset", pa.int64()), ("next_offset", pa.int64()), ("payload_offset", pa.int64()), ("payload_length", pa.int32())]))), ("error", pa.string()), ("error_offset", pa.int64()),
])
MANIFEST, LINES = "manifest.json", "entries.jsonl"
#: Bytes of entries in a batch, and of a page of a file that is read by places.
BATCH, PAGE, PAGES = 8 << 20, 1 << 18, 64


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class Paged:
    """A file's bytes by slices, from pages of which the last ones used are kept."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.pages = file, file.size(), {}

    def __len__(self) -> int:
        return self.size

    def _page(self, k: int) -> bytes:
        page = self.pages.pop(k, None)
        if page is None:
            page = self.file.read_at(min(PAGE, self.size - k * PAGE), k * PAGE)
            if len(self.pages) == PAGES:
                del self.pages[next(iter(self.pages))]
        self.pages[k] = page
        return page

    def __getitem__(self, where: slice) -> bytes:
        a, z, _ = where.indices(self.size)
        if a >= z:
            return b""
        first, last = a // PAGE, (z - 1) // PAGE
        return b"".join(self._page(k) for k in range(first, last + 1))[a - first * PAGE : z - first * PAGE]


@dataclass
class Range(InputPartition):
    """Blocks of a file that begin from `start` up to `end`; the whole file where `end` is None."""

    path: str
    start: int
    end: int | None


def library_rows(data: Paged | bytes, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """Entries whose directory block begins in the range, and errors. The first range reports a file that has no
    header or no directory."""
    none = dict.fromkeys(_ARROW.names)
    whole = end is None
    if whole and (len(data) < 40 or find_header(data) is None):
        yield none | {"name": "<header>", "error": "a header has 40 bytes at least" if len(data) < 40 else f"no library header; the file starts with {data[:4]!r}"}
        return
    found = False
    last = max(0, len(data) - 32)
    for node in range(start, last if whole else min(end, last), BLOCK):
        if data[node : node + 4] != DIRECTORY:
            continue
        n, at = u16_at(data, node + 20), node + 32
        if n > MAX_ENTRIES:
            yield none | {"at": node, "name": "<node>", "error": f"{n} entries in a directory block", "error_offset": node}
            continue
        for _ in range(n):
            try:
                head, after = _entry(data, at, node + NODE)
            except FormatError as e:
                yield none | {"at": at, "name": "<entry>", "error": str(e), "error_offset": e.offset}
                break
            found, at = True, after
            try:
                content, blocks = read_chain(data, head["first"], head["size"])
            except FormatError as e:
                yield none | {"at": head["at"], "name": head["name"], "error": str(e), "error_offset": head["at"]}
                continue
            chain = [dict(zip(("offset", "next_offset", "payload_offset", "payload_length"), b, strict=True)) for b in blocks]
            yield none | {"at": head["at"], "name": head["name"], "object_type": object_type(head["name"]), "size": len(content), "offset": head["first"], "data": content, "data_blocks": chain}
    if not found and start == 0 and (whole or not any(_begins(data, node) for node in range(end, last, BLOCK))):
        yield none | {"name": "<directory>", "error": "the library has no entries"}


def _begins(data: Paged | bytes, node: int) -> bool:
    """A directory block that has an entry."""
    if data[node : node + 4] != DIRECTORY or not 0 < u16_at(data, node + 20) <= MAX_ENTRIES:
        return False
    try:
        return bool(_entry(data, node + 32, node + NODE))
    except FormatError:
        return False


class LibraryReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        self.paths, self.split_bytes = paths, max(BLOCK, split_bytes // BLOCK * BLOCK)

    def partitions(self) -> list[Range]:
        """By sizes; a file is opened only if it is large enough to be cut, to see that it begins with a header."""
        out: list[Range] = []
        for path in self.paths:
            fs, inner = _opened(path)
            info = fs.get_file_info(inner)
            every = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
            for f in sorted((f for f in every if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
                # The place of a library behind another file is searched for, by one task.
                if f.size <= self.split_bytes or fs.open_input_file(f.path).read_at(4, 0) != HEADER:
                    out.append(Range(self._uri(path, f.path), 0, None))
                else:
                    out += [Range(self._uri(path, f.path), a, a + self.split_bytes) for a in range(0, f.size, self.split_bytes)]
        return out or [Range("", 0, 0)]

    @staticmethod
    def _uri(path: str, inner: str) -> str:
        scheme, found, rest = path.partition("://")
        return inner if not found or scheme == "file" else f"{scheme}://{rest.split('/')[0]}{inner}" if inner.startswith("/") else f"{scheme}://{inner}"

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, inner = _opened(partition.path)
        rows, size = [], 0
        for row in library_rows(Paged(fs.open_input_file(inner)), partition.start, partition.end):
            rows.append(row | {"library": partition.path})
            size += row["size"] or 0
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class LibrarySource(DataSource):
    """Options: path (a file or folder), or paths (a JSON list of them); splitBytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return LIBRARY_ROWS

    def reader(self, schema: StructType) -> LibraryReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return LibraryReader(paths, int(self.options.get("splitBytes", 64 << 20)))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: a folder under the target, and how much is in it."""

    folder: str
    entries: int
    size: int


class EntryWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path.rstrip("/"), columns, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        """One attempt's files, in a folder that no other attempt has."""
        context = TaskContext.get()
        folder = f"objects/{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}"
        fs, inner = _opened(self.path)
        fs.create_dir(f"{inner}/{folder}", recursive=True)
        n = size = 0
        with fs.open_output_stream(f"{inner}/{folder}/{LINES}") as lines:
            for row in rows:
                content = bytes(row["data"] or b"")
                file = f"{n:06d}-{entry_file(row['entry_index'] or 0, row['name'] or '')}"
                with fs.open_output_stream(f"{inner}/{folder}/{file}") as out:
                    out.write(content)
                kept = {k: row[k] for k in self.columns if k not in ("data", "file", "sha256")}
                blocks = kept.get("data_blocks")
                kept |= {"data_blocks": [b.asDict() for b in blocks]} if blocks else {}
                lines.write((json.dumps(kept | {"size": len(content), "file": f"{folder}/{file}", "sha256": hashlib.sha256(content).hexdigest()}) + "\n").encode())
                n, size = n + 1, size + len(content)
        return Written(folder, n, size)

    def _leave(self, keep: set[str]) -> None:
        fs, inner = _opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(f"{inner}/objects", allow_not_found=True)):
            if f.base_name.startswith(self.job) and f"objects/{f.base_name}" not in keep:
                fs.delete_dir(f.path)

    def commit(self, messages: list[Written | None]) -> None:
        """One small line a task; the manifest appears whole and last."""
        done = [m for m in messages if m]
        self._leave({m.folder for m in done})
        fs, inner = _opened(self.path)
        fs.create_dir(inner, recursive=True)
        manifest = {"entries": sum(m.entries for m in done), "bytes": sum(m.size for m in done), "parts": [{"folder": m.folder, "entries": m.entries, "bytes": m.size} for m in sorted(done, key=lambda m: m.folder)]}
        with fs.open_output_stream(f"{inner}/{MANIFEST}") as out:
            out.write(json.dumps(manifest).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._leave(set())


class ManifestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Range]:
        fs, inner = _opened(self.path)
        with fs.open_input_stream(f"{inner}/{MANIFEST}") as f:
            parts = json.loads(f.read())["parts"]
        return [Range(p["folder"], 0, p["entries"]) for p in parts if p["entries"]] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """file, size, sha256, content, and the entry's other columns as JSON; an entry at a time."""
        if not partition.path:
            return
        fs, inner = _opened(self.path)
        with fs.open_input_stream(f"{inner}/{partition.path}/{LINES}") as f:
            lines = f.read().splitlines()
        if len(lines) != partition.end:
            raise ValueError(f"{partition.path} has {len(lines)} of {partition.end} entries")
        for line in lines:
            row = json.loads(line)
            with fs.open_input_stream(f"{inner}/{row['file']}") as f:
                content = f.read()
            if hashlib.sha256(content).hexdigest() != row["sha256"]:
                raise ValueError(f"{row['file']} is not what was written")
            yield f"{self.path}/{row['file']}", len(content), row["sha256"], content, json.dumps({k: v for k, v in row.items() if k not in ("file", "sha256")})


class EntryFolder(DataSource):
    """Option: path. Writing takes rows with entry_index, name, data, and what else the manifest is to hold (values
    that JSON has); a folder that holds anything is refused."""

    @classmethod
    def name(cls) -> str:
        return "entry_folder"

    def schema(self) -> str:
        return "file string, size long, sha256 string, content binary, entry string"

    def reader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> EntryWriter:
        fs, inner = _opened(self.options["path"])
        if fs.get_file_info(inner).type != pafs.FileType.NotFound and fs.get_file_info(pafs.FileSelector(inner)):
            raise FileExistsError(f"{self.options['path']} is not empty")
        return EntryWriter(self.options["path"], schema.names)


def _registered(spark: SparkSession) -> SparkSession:
    for source in (LibrarySource, EntryFolder):
        spark.dataSource.register(source)
    return spark


def read_libraries(spark: SparkSession, *paths: str, split_bytes: int = 64 << 20) -> DataFrame:
    """LIBRARY_ROWS of library files and folders of them; entries have no error, errors are rows."""
    return _registered(spark).read.format("library").option("paths", json.dumps(paths)).option("splitBytes", split_bytes).load()


def numbered(rows: DataFrame) -> DataFrame:
    """The entries with entry_index, counted from 0 in the order of their library's directory."""
    index = F.row_number().over(Window.partitionBy("library").orderBy("at")) - 1
    return rows.where("error IS NULL").withColumn("entry_index", index).drop("at", "error", "error_offset")


def write_entry_folder(entries: DataFrame, path: str) -> None:
    """Entries as raw files and a manifest, all or nothing."""
    _registered(entries.sparkSession)
    entries.write.format("entry_folder").mode("append").save(path)


def read_entry_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, size, sha256, content, entry (the manifest's line) of a folder's committed entries."""
    return _registered(spark).read.format("entry_folder").load(path)
