"""Compiled objects of a library: types, variables, constants, functions and their code, as nested rows."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bytesio import MISSING, FormatError, Reader, array_shape, type_name, typed_value, u16_at, u32_at, utf16_at

VERSIONS = (0x0152, 0x0153)
SYSTEM_ENTRY = 0x00010000
#: A place that is none, as it is written.
NONE = 0xFFFF

_VARIABLE = "struct<index: int, name: string, type_ref: int, type_name: string, array: string, flags: int, is_shared: boolean, is_referenced_global: boolean, is_instance: boolean, is_indirect: boolean, is_constant: boolean, raw: long>"
_PARAMETER = "struct<index: int, name: string, type_ref: int, type_name: string, array: string, is_read_only: boolean, is_reference: boolean>"
_FUNCTION = f"struct<index: int, name: string, return_type_ref: int, return_type_name: string, flags: int, global_index: int, reference_index: int, event_code: int, parameters: array<{_PARAMETER}>, library: string, alias: string>"
_VALUE = "struct<kind: string, i: long, s: string>"
OBJECT = (
    "struct<version: int, flags: int, entry_type: long, types: array<struct<index: int, type_ref: int, name: string, is_referenced_object: boolean>>, "
    "enum_values: array<struct<enum_type_ref: int, enum_type_name: string, item_index: int, name: string>>, "
    f"global_variables: array<{_VARIABLE}>, "
    f"objects: array<struct<index: int, type_ref: int, type_name: string, inherit_type_ref: int, inherit_type_name: string, parent_type_ref: int, parent_type_name: string, all_variable_count: int, properties: array<{_VARIABLE}>, functions: array<{_FUNCTION}>>>, "
    f"constants: array<struct<owner: string, owner_ref: int, name: string, type_ref: int, type_name: string, raw: long, value: {_VALUE}>>, "
    f"regions: array<struct<object_index: int, function_index: int, pcode_offset: int, pcode: string, debug: string, stack_buffer: string, variables: array<{_VARIABLE}>, referenced_functions: array<struct<index: int, name: string, global_index: int, is_global: boolean>>, definition: {_FUNCTION}>>>"
)


def _name(buffer: bytes, offset: int, what: str, at: int) -> str:
    name = utf16_at(buffer, offset)
    if name is None:
        raise FormatError(f"{what}: no name at 0x{offset:08X}", at)
    return name


def _shape(buffer: bytes, offset: int, what: str, at: int) -> str:
    shape = array_shape(buffer, offset)
    if shape is None:
        raise FormatError(f"{what}: no array shape at 0x{offset:08X}", at)
    return shape


def _variables(r: Reader, types: dict[int, str]) -> list[dict]:
    r.take(6)
    strings = r.buffer()
    out = []
    for i, (at, rec) in enumerate(r.records(20, "variables")):
        ref = u16_at(rec, 18)
        out.append({
            "index": i, "name": _name(strings, u32_at(rec, 8), "variable", at), "type_ref": ref, "type_name": type_name(ref, types), "array": _shape(strings, u32_at(rec, 4), "variable", at),
            "flags": rec[17], "is_shared": bool(rec[17] & 2), "is_referenced_global": bool(rec[16] & 64), "is_instance": rec[0] & 15 <= 1, "is_indirect": bool(rec[0] & 2), "is_constant": bool(rec[0] & 4), "raw": u32_at(rec, 12),
        })
    return out


def _types(r: Reader, system: bool) -> list[dict]:
    r.take(6)
    strings = r.buffer()
    return [{"index": i, "type_ref": (0x4000 if system else 0x8000) | i, "name": _name(strings, u32_at(rec, 8), "type", at), "is_referenced_object": rec[16] == 0x40} for i, (at, rec) in enumerate(r.records(20, "types"))]


def _referenced(r: Reader) -> list[dict]:
    r.take(6)
    strings = r.buffer()
    return [{"index": i, "name": _name(strings, u32_at(rec, 8), "function reference", at), "global_index": u16_at(rec, 12), "is_global": rec[16] == 2} for i, (at, rec) in enumerate(r.records(20, "function references"))]


def _function(i: int, rec: bytes, at: int, names: bytes, parameters: bytes, types: dict[int, str]) -> dict:
    name = _name(names, u32_at(rec, 0), "function", at).removeprefix("+")
    start, n = u32_at(rec, 8), rec[30]
    found = []
    if start in MISSING and n:
        raise FormatError(f"{name}: {n} parameters and no table of them", at)
    for k in range(0 if start in MISSING else n):
        p = parameters[(start & 0x7FFFFFFF) + 12 * k :][:12]
        if len(p) < 12:
            raise FormatError(f"{name}: parameter {k} is out of range", at)
        ref = u16_at(p, 8)
        found.append({"index": k, "name": _name(names, u32_at(p, 0), "parameter", at), "type_ref": ref, "type_name": type_name(ref, types), "array": _shape(names, u32_at(p, 4), "parameter", at), "is_read_only": bool(p[10] & 4), "is_reference": bool(p[10] & 2)})
    external = u32_at(rec, 12) not in MISSING
    back = u16_at(rec, 28)
    return {
        "index": i, "name": name, "return_type_ref": back, "return_type_name": type_name(back, types), "flags": rec[31], "global_index": u16_at(rec, 20), "reference_index": u16_at(rec, 22), "event_code": u16_at(rec, 32), "parameters": found,
        "library": utf16_at(names, u32_at(rec, 16)) if external else None, "alias": utf16_at(names, u32_at(rec, 12)) if external else None,
    }


def _object(r: Reader, i: int, head: bytes, base: bytes, names: bytes, parameters: bytes, types: dict[int, str]) -> tuple[dict, list[dict]]:
    regions = []
    for k in [u16_at(r.take(4), 2) for _ in range(r.u16())]:
        at = r.at
        n, debug, _ = r.u16(), r.u16(), r.u16()
        if n % 2:
            raise FormatError(f"code of {n} bytes is not in words", at)
        start = r.at
        code, lines = r.take(n), r.take(4 * debug)
        local = _variables(r, types)
        regions.append({"object_index": i, "function_index": k, "pcode_offset": start, "pcode": code.hex(), "debug": lines.hex(), "variables": local, "stack_buffer": r.buffer().hex()})
    r.take(6 * u16_at(base, 24) + 4 * u16_at(base, 22))
    referenced = _referenced(r)
    properties = _variables(r, types)
    r.take(8 * u16_at(base, 28) + 16 * u16_at(base, 26))
    functions = []
    for k in range(u16_at(base, 4)):
        at = r.at
        functions.append(_function(k, r.take(48), at, names, parameters, types))
    for region in regions:
        k = region["function_index"]
        region |= {"definition": functions[k] if k < len(functions) else None, "referenced_functions": referenced}
    refs = {"type": u16_at(head, 2), "inherit_type": u16_at(base, 0), "parent_type": u16_at(base, 2)}
    named = {f"{k}_ref": v for k, v in refs.items()} | {f"{k}_name": type_name(v, types) for k, v in refs.items()}
    return {"index": i, **named, "all_variable_count": u16_at(base, 28), "properties": properties, "functions": functions}, regions


def is_compiled(data: bytes) -> bool:
    return len(data) >= 8 and u16_at(data, 0) in VERSIONS


def parse_object(data: bytes) -> dict:
    """A compiled object as a row of OBJECT; FormatError if anything is left over, missing or out of range."""
    r = Reader(data)
    version = r.u16()
    if version not in VERSIONS:
        raise FormatError(f"version 0x{version:04X}")
    flags, entry_type = r.u16(), r.u32()
    r.take(4 + 8 + 8 + 4)  # a field, the times of change and compilation, a field
    r.take(12 * r.u16())
    values = r.buffer()
    globals_ = _variables(r, {})
    n_objects, n_bases = r.u16(), r.u16()
    names, parameters = r.buffer(), r.buffer()
    own = _types(r, entry_type == SYSTEM_ENTRY)
    types = {t["type_ref"]: t["name"] for t in reversed(own)}
    for v in globals_:
        v["type_name"] = type_name(v["type_ref"], types)
    enums = [{"enum_type_ref": v["type_ref"], "enum_type_name": v["type_name"], "item_index": v["raw"] & 0xFFFF, "name": v["name"]} for v in _variables(r, types)]
    heads, bases = [r.take(16) for _ in range(n_objects)], [r.take(32) for _ in range(n_bases)]
    objects, regions, used = [], [], 0
    for i, head in enumerate(heads):
        kind = head[0] >> 1 & 7
        if kind == 0:
            if used == len(bases):
                raise FormatError("an object without its base record", r.at)
            made, code = _object(r, i, head, bases[used], names, parameters, types)
            used += 1
            objects.append(made)
            regions += code
        elif kind == 1:
            r.take(8 * u16_at(head, 4))
    if used != len(bases):
        raise FormatError(f"{used} of {len(bases)} base records are used", r.at)
    if r.at != len(data):
        raise FormatError(f"{len(data) - r.at} bytes are left over", r.at)
    owned = [("", 0, v) for v in globals_] + [(o["type_name"], o["type_ref"], v) for o in objects for v in o["properties"]]
    constants = [{"owner": owner, "owner_ref": ref, "name": v["name"], "type_ref": v["type_ref"], "type_name": v["type_name"], "raw": v["raw"], "value": typed_value(v["type_ref"], v["raw"], values)} for owner, ref, v in owned if v["is_constant"]]
    return {"version": version, "flags": flags, "entry_type": entry_type, "types": own, "enum_values": enums, "global_variables": globals_, "objects": objects, "constants": constants, "regions": regions}


class _Strings:
    """A buffer of UTF-16 texts that end with a NUL word, by their places."""

    def __init__(self):
        self.data = bytearray()

    def place(self, text: str) -> int:
        at = len(self.data)
        self.data += text.encode("utf-16-le") + b"\0\0"
        return at

    def bytes(self) -> bytes:
        return struct.pack("<II", len(self.data), 0) + bytes(self.data)


def _table(strings: _Strings, records: list[bytes]) -> bytes:
    return b"\0" * 6 + strings.bytes() + struct.pack("<H", 20 * len(records)) + b"".join(records)


def _variable_table(variables: list[tuple[str, int, int, int]]) -> bytes:
    """(name, type_ref, raw, head): the head's bit 4 makes a constant."""
    strings = _Strings()
    return _table(strings, [struct.pack("<B3xIIIBBH", head, NONE, strings.place(name), raw & 0xFFFFFFFF, 0, 0, ref) for name, ref, raw, head in variables])


def build_object(type_name: str, base_name: str, constants: list[tuple[str, int, int | str]], functions: list[dict], version: int = 0x0153) -> bytes:
    """A compiled object with one type: constants (name, type_ref, a number or a text), and functions: name, return_ref,
    flags, parameters (name, type_ref, 2 for reference or 4 for read only), code, locals (name, type_ref), lines
    (line, offset). What `parse_object` reads again."""
    values, names, parameters = _Strings(), _Strings(), bytearray()
    raws = [(n, ref, 0x80000000 | values.place(v) if isinstance(v, str) else v, 4) for n, ref, v in constants]
    records, regions = [], []
    for k, f in enumerate(functions):
        start = len(parameters) if f["parameters"] else NONE
        record = bytearray(48)
        record[0:4] = struct.pack("<I", names.place("+" + f["name"]))
        record[8:16] = struct.pack("<II", start if start == NONE else 0x80000000 | start, NONE)
        record[28:32] = struct.pack("<HBB", f["return_ref"], len(f["parameters"]), f["flags"])
        for name, ref, mode in f["parameters"]:
            parameters += struct.pack("<IIHBB", names.place(name), NONE, ref, mode, 0)
        records.append(bytes(record))
        lines = b"".join(struct.pack("<HH", *x) for x in f["lines"])
        regions.append((k, struct.pack("<HHH", len(f["code"]), len(f["lines"]), 0) + f["code"] + lines + _variable_table([(n, ref, 0, 0) for n, ref in f["locals"]]) + _Strings().bytes()))
    own = _Strings()
    types = [struct.pack("<8xI4xB3x", own.place(type_name), 0x40), struct.pack("<8xI4xB3x", own.place(base_name), 0)]
    out = struct.pack("<HHI", version, 0, 0) + b"\0" * 24 + struct.pack("<H", 0) + values.bytes() + _variable_table([]) + struct.pack("<HH", 1, 1)
    out += names.bytes() + struct.pack("<II", len(parameters), 0) + bytes(parameters) + _table(own, types) + _variable_table([])
    out += struct.pack("<BxH12x", 0, 0x8000) + struct.pack("<HHH", 0x8001, 0, len(records)).ljust(28, b"\0") + struct.pack("<HH", len(raws), 0)
    out += struct.pack("<H", len(regions)) + b"".join(struct.pack("<HH", 0, k) for k, _ in regions) + b"".join(r for _, r in regions)
    return out + _variable_table([]) + _variable_table(raws) + b"\0" * (8 * len(raws)) + b"".join(records)


def text_strings(data: bytes, limit: int = 512) -> dict:
    """Printable texts with their places: ASCII of four characters, UTF-16 of three, mostly letters and
    digits; the first `limit` by place, and whether there are more."""

    def good(text: str) -> bool:
        return any(c.isalnum() for c in text) and 4 * sum(c.isalnum() or c in " _.,:;()/\\-" for c in text) >= 3 * len(text)

    found = [(m.start(), 0, m[0].decode().strip(), 4) for m in re.finditer(rb"[\x20-\x7e]+", data)]
    found += [(m.start(), 1, m[0][::2].decode().strip(), 3) for m in re.finditer(rb"(?:[\x20-\x7e]\x00)+", data)]
    kept = sorted((at, wide, text) for at, wide, text, least in found if len(text) >= least and good(text))
    return {"strings": [{"offset": at, "encoding": "utf-16le" if wide else "ascii", "text": text} for at, wide, text in kept[:limit]], "truncated": len(kept) > limit}


def string_sections(strings: list[dict], gap: int = 64) -> list[dict]:
    """Clusters of texts at most `gap` bytes apart, of two texts or one of eight characters."""
    out: list[dict] = []
    for s in strings:
        end = s["offset"] + len(s["text"]) * (2 if s["encoding"] == "utf-16le" else 1)
        if out and s["offset"] <= out[-1]["end"] + gap:
            out[-1] |= {"end": max(out[-1]["end"], end), "n": out[-1]["n"] + 1}
        else:
            out.append({"start": s["offset"], "end": end, "n": 1, "first": len(s["text"])})
    return [{k: c[k] for k in ("start", "end", "n")} for c in out if c["n"] >= 2 or c["first"] >= 8]


def inspect(data: bytes) -> dict:
    """format (compiled, datawindow, unknown), tag, texts and their clusters, share of zero bytes, and the
    compiled object or why it could not be read."""
    kind = "compiled" if is_compiled(data) else "datawindow" if data[:3] == b"PDW" else "unknown"
    texts = text_strings(data)
    layout, error = None, None
    if kind == "compiled":
        try:
            layout = parse_object(data)
        except FormatError as e:
            error = str(e)
    return {"format": kind, "tag": data[:8].hex(" ").upper() if kind == "unknown" else data[:4].decode("latin-1"), **texts, "sections": string_sections(texts["strings"]), "zero_ratio": data.count(0) / len(data) if data else 0.0, "object": layout, "error": error}


_INSPECTION = f"format string, tag string, strings array<struct<offset: long, encoding: string, text: string>>, truncated boolean, sections array<struct<start: long, end: long, n: int>>, zero_ratio double, object string, error string"


def inspect_entries(entries: DataFrame) -> DataFrame:
    """library, entry_index, name and an inspection of every entry; `object` is a row of OBJECT or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = inspect(row["data"] or b"")
                found["object"] = json.dumps(found["object"]) if found["object"] else None
                rows.append({k: row[k] for k in ("library", "entry_index", "name")} | found)
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("library", pa.string()), ("entry_index", pa.int32()), ("name", pa.string()), ("format", pa.string()), ("tag", pa.string()), ("strings", pa.list_(pa.struct([("offset", pa.int64()), ("encoding", pa.string()), ("text", pa.string())]))), ("truncated", pa.bool_()), ("sections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n", pa.int32())]))), ("zero_ratio", pa.float64()), ("object", pa.string()), ("error", pa.string())])
    found = entries.select("library", "entry_index", "name", "data").mapInArrow(run, f"library string, entry_index int, name string, {_INSPECTION}")
    return found.withColumn("object", F.from_json("object", OBJECT))


def exploded(inspected: DataFrame, child: str) -> DataFrame:
    """One row per element of a child table of the compiled objects: types, enum_values, global_variables,
    objects, constants or regions, with library, entry_index and its position."""
    return inspected.where("object IS NOT NULL").select("library", "entry_index", F.posexplode(f"object.{child}").alias("position", "row")).select("library", "entry_index", "position", "row.*")
