"""Block-structured library files as rows: entries, and errors beside them.

A library is a header block, directory blocks with entries, and chains of data blocks. One file is one
task's work; a damaged entry becomes a row with an error and the rest is read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.bytesio import FormatError, object_type, u16_at, u32_at, utf16_lossy

BLOCK, NODE, PAYLOAD, MAX_ENTRIES = 512, 3072, 502, 2048
HEADER, DIRECTORY, ENTRY, DATA = b"HDR*", b"NOD*", b"ENT*", b"DAT*"

_BLOCKS = "array<struct<offset: long, next_offset: long, payload_offset: long, payload_length: int>>"
ROWS = f"library string, entry_index int, name string, object_type string, size long, offset long, data binary, data_blocks {_BLOCKS}, error string, error_offset long"


def find_header(data: bytes) -> int | None:
    """Where the library starts: at 0, or at a block boundary of a file that it is appended to."""
    if data[:4] == HEADER:
        return 0
    for at in range(BLOCK, len(data) - 40, BLOCK):
        if data[at : at + 4] == HEADER and utf16_lossy(data[at + 4 : at + 30]) == "PowerBuilder" and re.fullmatch("[0-9a-fA-F]{4}", utf16_lossy(data[at + 32 : at + 40])):
            return at
    return None


def read_header(data: bytes) -> dict:
    """format_version (the number in the header's four hex digits, 0 if they are none) and runtime_version
    (the first dotted number after them, or None)."""
    if len(data) < 40:
        raise FormatError("a header has 40 bytes at least")
    at = find_header(data)
    if at is None:
        raise FormatError(f"no library header; the file starts with {data[:4]!r}")
    digits = utf16_lossy(data[at + 32 : at + 40])
    return {"offset": at, "format_version": int(digits, 16) if re.fullmatch("[0-9a-fA-F]+", digits) else 0, "runtime_version": runtime_version(data[at + 40 : at + 1024])}


def runtime_version(data: bytes) -> str | None:
    """The first run of digits and dots in UTF-16, of three characters at least and with a dot."""
    for m in re.finditer(rb"(?:[0-9.]\x00){3,}", data):
        text = m[0][::2].decode()
        if "." in text and text[0] != ".":
            return text
    return None


def _entry(data: bytes, at: int, end: int) -> tuple[dict, int]:
    if at + 28 > min(end, len(data)):
        raise FormatError("an entry runs past its directory block", at)
    if data[at : at + 4] != ENTRY:
        raise FormatError(f"an entry starts with {data[at : at + 4]!r}", at)
    if not re.fullmatch("[0-9a-fA-F]{4}", utf16_lossy(data[at + 4 : at + 12])):
        raise FormatError("an entry's version is not four hex digits", at)
    first, size, n = u32_at(data, at + 12), u32_at(data, at + 16), u16_at(data, at + 26)
    after = at + 28 + n  # the comment, whose length stands at 24, is kept elsewhere
    if n < 2 or n % 2 or after > min(end, len(data)):
        raise FormatError(f"an entry's name of {n} bytes", at)
    name = utf16_lossy(data[at + 28 : after])
    if not name or not name.isprintable():
        raise FormatError(f"an entry's name is {name!r}", at)
    if first % BLOCK or data[first : first + 4] != DATA or first + 10 > len(data):
        raise FormatError(f"{name}: no data block at {first}", at)
    if size > len(data):
        raise FormatError(f"{name}: {size} bytes declared, more than the file has", at)
    return {"name": name, "size": size, "first": first, "at": at}, after


def read_directory(data: bytes) -> tuple[list[dict], list[tuple[str, str, int]]]:
    """Entries of all directory blocks, and errors (name, message, offset). A damaged entry ends its block."""
    entries, errors = [], []
    for node in range(0, max(0, len(data) - 32), BLOCK):
        if data[node : node + 4] != DIRECTORY:
            continue
        n = u16_at(data, node + 20)
        if n > MAX_ENTRIES:
            errors.append(("<node>", f"{n} entries in a directory block", node))
            continue
        at = node + 32
        try:
            for _ in range(n):
                entry, at = _entry(data, at, node + NODE)
                entries.append(entry)
        except FormatError as e:
            errors.append(("<entry>", str(e), e.offset))
    return entries, errors


def read_chain(data: bytes, first: int, size: int) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """An entry's bytes, and its blocks (offset, next, payload's offset and length). The chain must give
    exactly the declared size."""
    out, blocks, at, seen = bytearray(), [], first, set()
    while len(out) < size:
        if at in seen:
            raise FormatError(f"the data chain comes back to {at}", at)
        seen.add(at)
        if at % BLOCK or at + 10 > len(data) or data[at : at + 4] != DATA:
            raise FormatError(f"no data block at {at}", at)
        after, n = u32_at(data, at + 4), u16_at(data, at + 8)
        if n > PAYLOAD or at + 10 + n > len(data):
            raise FormatError(f"a data block of {n} bytes at {at}", at)
        if n > size - len(out):
            raise FormatError(f"more data than the {size} bytes declared, at {at}", at)
        blocks.append((at, after, at + 10, n))
        out += data[at + 10 : at + 10 + n]
        if len(out) < size and not after:
            raise FormatError(f"the data chain ends after {len(out)} of {size} bytes", at)
        at = after
    return bytes(out), blocks


def read_library(data: bytes) -> Iterator[dict]:
    """Rows of ROWS without `library`: entries with a null error, and errors."""
    none = {"entry_index": None, "object_type": None, "size": None, "offset": None, "data": None, "data_blocks": None}
    try:
        read_header(data)
    except FormatError as e:
        yield none | {"name": "<header>", "error": str(e), "error_offset": None}
        return
    entries, errors = read_directory(data)
    if not entries:
        errors.append(("<directory>", "the library has no entries", None))
    index = 0
    for e in entries:
        try:
            content, blocks = read_chain(data, e["first"], e["size"])
        except FormatError as x:
            errors.append((e["name"], str(x), e["at"]))
            continue
        keys = ("offset", "next_offset", "payload_offset", "payload_length")
        yield {"entry_index": index, "name": e["name"], "object_type": object_type(e["name"]), "size": len(content), "offset": e["first"], "data": content, "data_blocks": [dict(zip(keys, b, strict=True)) for b in blocks], "error": None, "error_offset": None}
        index += 1
    for name, message, at in errors:
        yield none | {"name": name, "error": message, "error_offset": at}


def build_library(entries: list[tuple[str, bytes]], format_version: int = 0x0600, runtime: str = "22.1.0.2819", base: int = 0) -> bytes:
    """A library file of these entries, after `base` bytes (whole blocks) of another file."""
    wide = lambda s: s.encode("utf-16-le")
    heads = [struct.pack("<4s8s", ENTRY, wide("0600")) + struct.pack("<IIIHH", 0, len(d), 0, 0, 2 * len(n)) + wide(n) for n, d in entries]
    nodes: list[list[int]] = [[]]
    room = NODE - 32
    for i, head in enumerate(heads):
        if len(head) > room:
            nodes.append([])
            room = NODE - 32
        nodes[-1].append(i)
        room -= len(head)
    at = base + BLOCK * 3 + NODE * len(nodes)
    data, firsts = bytearray(), []
    for _, content in entries:
        parts = [content[k : k + PAYLOAD] for k in range(0, len(content), PAYLOAD)] or [b""]
        firsts.append(at)
        for k, part in enumerate(parts):
            data += (DATA + struct.pack("<IH", at + BLOCK if k + 1 < len(parts) else 0, len(part)) + part).ljust(BLOCK, b"\0")
            at += BLOCK
    header = (HEADER + wide("PowerBuilder").ljust(28, b"\0") + wide(f"{format_version:04X}") + b"\0\0" + wide(runtime)).ljust(BLOCK * 3, b"\0")
    directory = bytearray()
    for node in nodes:
        block = (DIRECTORY.ljust(20, b"\0") + struct.pack("<H", len(node))).ljust(32, b"\0")
        for i in node:
            block += heads[i][:12] + struct.pack("<I", firsts[i]) + heads[i][16:]
        directory += block.ljust(NODE, b"\0")
    return b"\0" * base + header + bytes(directory) + bytes(data)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in batches:
        for library, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = [{"library": library} | r for r in read_library(content.as_py() or b"")]
            schema = schema or pa.schema([("library", pa.string()), ("entry_index", pa.int32()), ("name", pa.string()), ("object_type", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("data_blocks", pa.list_(pa.struct([("offset", pa.int64()), ("next_offset", pa.int64()), ("payload_offset", pa.int64()), ("payload_length", pa.int32())]))), ("error", pa.string()), ("error_offset", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema)


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """Library files under a path: library (the file's path), content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("library"), "content")


def parse_libraries(files: DataFrame) -> DataFrame:
    """All rows (ROWS) of library files (library, content)."""
    return files.select("library", "content").mapInArrow(_rows, ROWS)


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").drop("error", "error_offset")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("library", F.col("name").alias("entry_name"), F.col("error").alias("message"), F.col("error_offset").alias("offset"))


def blocks(parsed: DataFrame) -> DataFrame:
    """One row per data block."""
    return entries(parsed).select("library", "entry_index", F.posexplode("data_blocks").alias("seq", "block")).select("library", "entry_index", "seq", "block.*")


def wide_strings(data: bytes, least: int = 3) -> list[str]:
    """Printable ASCII texts of at least `least` characters stored as UTF-16, each up to its NUL word."""
    out, at = [], 0
    while at < len(data) - 1:
        if data[at] and not data[at + 1]:
            end = at
            while end < len(data) - 1 and (data[end] or data[end + 1]):
                end += 2
            try:
                text = data[at:end].decode("utf-16-le")
            except UnicodeDecodeError:
                text = ""
            if len(text) >= least and all("!" <= c <= "~" or c.isspace() for c in text):
                out.append(text)
            at = end + 2
        else:
            at += 1
    return out
