"""Containers, compiled objects, code and previews, on artifacts built here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from quern.functions.bytesio import FormatError, array_shape, decimal_at, double_at, entry_file, escaped, object_type, object_type_by_content, safe_name, type_name, typed_value, utf16_at
from quern.operators import flow, scan
from quern.operators.preview import Catalogue, Context, catalogue_of, preview, preview_regions, signature
from quern.plans.artifacts import SOME_OPCODES
from quern.sources import container, executables, objects, sinks

wide = lambda s: s.encode("utf-16-le") + b"\0\0"


@pytest.mark.parametrize("base", [0, 1024])
def test_library(spark, base, tmp_path):
    data = container.build_library([("app.apl", b"x" * 21), ("window.win", bytes(range(250)) * 3), ("empty.str", b"")], base=base)
    assert container.read_header(data) == {"offset": base, "format_version": 0x600, "runtime_version": "22.1.0.2819"}
    (tmp_path / "a.pbd").write_bytes(data)
    (tmp_path / "b.pbd").write_bytes(b"no library at all, but long enough to be one")
    parsed = container.parse_libraries(container.libraries(spark, str(tmp_path)))
    rows = container.entries(parsed).orderBy("entry_index").collect()
    assert [(r.name, r.object_type, r["size"]) for r in rows] == [("app.apl", "application", 21), ("window.win", "window", 750), ("empty.str", "structure", 0)]
    assert rows[1].data == bytes(range(250)) * 3 and [b.payload_length for b in rows[1].data_blocks] == [502, 248]
    assert container.blocks(parsed).count() == 3
    assert [r.entry_name for r in container.errors(parsed).collect()] == ["<header>"]
    sinks.write_entries(container.entries(parsed), str(tmp_path / "out"))
    manifest = spark.read.json(str(tmp_path / "out" / "manifest")).orderBy("entry_index").collect()
    assert manifest[1].file == "0001_window.win.bin" == entry_file(1, "window.win")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_json(container.errors(parsed), str(tmp_path / "out" / "manifest"))


def test_damaged_library():
    data = bytearray(container.build_library([("app.apl", b"x" * 21), ("window.win", b"y" * 600)]))
    first = data.index(b"DAT*")
    second = first + 512
    cut = bytearray(data)
    cut[second + 4 : second + 8] = b"\0" * 4
    rows = list(container.read_library(bytes(cut)))
    assert [(r["name"], r["error"] is None) for r in rows] == [("app.apl", True), ("window.win", False)]
    ring = bytearray(data)
    ring[second + 4 : second + 8] = struct.pack("<I", second)
    assert "comes back" in list(container.read_library(bytes(ring)))[1]["error"]
    many = bytearray(data)
    node = many.index(b"NOD*")
    many[node + 20 : node + 22] = struct.pack("<H", 3000)
    assert [r["name"] for r in container.read_library(bytes(many))] == ["<node>", "<directory>"]
    long = bytearray(data)
    long[first + 8 : first + 10] = struct.pack("<H", 100)
    assert "more data" in list(container.read_library(bytes(long)))[1]["error"]
    assert [r["name"] for r in container.read_library(b"")] == ["<header>"]
    big = [(f"w_{i:04d}.win", bytes([i % 256]) * i) for i in range(400)]
    assert [(r["name"], r["data"]) for r in container.read_library(container.build_library(big))] == big
    assert container.wide_strings(b"\1\2" + wide("hello") + wide("ab") + wide("there x")) == ["hello", "there x"]


def table(records, strings=b""):
    return b"\0" * 6 + struct.pack("<II", len(strings), 0) + strings + struct.pack("<H", 20 * len(records)) + b"".join(records)


def variable(name_at, type_ref, raw=0, flags=0, head=0, state=0, shape=0xFFFF):
    return struct.pack("<B3xIIIBBH", head, shape, name_at, raw, state, flags, type_ref)


def compiled(code=b"\0\0", system=False):
    """One object n_cache with a constant CACHE_ID = "cache" and a function of_get(ref long al_key)."""
    out = struct.pack("<HHI", 0x0153, 0, 0x10000 if system else 0) + b"\0" * 24 + struct.pack("<H", 0)
    values = wide("cache")
    out += struct.pack("<II", len(values), 0) + values + table([])
    out += struct.pack("<HH", 1, 1)
    names = wide("+of_get") + wide("al_key")
    parameters = struct.pack("<IIHBB", 16, 0xFFFF, 2, 2, 0)
    out += struct.pack("<II", len(names), 0) + names + struct.pack("<II", len(parameters), 0) + parameters
    own = wide("n_cache") + wide("n_base")
    out += table([struct.pack("<8xI4xB3x", 0, 0x40), struct.pack("<8xI4xB3x", 16, 0)], own)
    out += table([])
    out += struct.pack("<BxH12x", 0, 0x8000) + struct.pack("<HHH", 0x8001, 0x4005, 1).ljust(22, b"\0") + struct.pack("<HHHHH", 0, 0, 0, 1, 0)
    out += struct.pack("<H", 1) + struct.pack("<HH", 0, 0)
    local = wide("al_key")
    out += struct.pack("<HHH", len(code), 1, 0) + code + struct.pack("<HH", 7, 0) + table([variable(0, 2)], local) + struct.pack("<II", 2, 0) + b"\0\0"
    out += table([])
    shown = wide("CACHE_ID")
    out += table([variable(0, 6, raw=0x80000000, head=4)], shown) + b"\0" * 8
    record = bytearray(48)
    record[8:16] = struct.pack("<II", 0x80000000, 0xFFFF)
    record[28:32] = struct.pack("<HBB", 6, 1, 0)
    return out + bytes(record)


def test_compiled_object(spark):
    data = compiled()
    found = objects.parse_object(data)
    assert found["constants"] == [{"owner": "n_cache", "owner_ref": 0x8000, "name": "CACHE_ID", "type_ref": 6, "type_name": "string", "raw": 0x80000000, "value": {"kind": "string", "i": None, "s": "cache"}}]
    assert found["objects"][0]["inherit_type_name"] == "n_base" and found["objects"][0]["parent_type_name"] == "system_type_4005"
    assert signature(found["regions"][0]["definition"]) == "public function string of_get(ref long al_key)"
    for wrong in (data[:-1], data + b"\0", b"\x54\x01" + data[2:]):
        with pytest.raises(FormatError):
            objects.parse_object(wrong)
    assert objects.parse_object(compiled(system=True))["types"][0]["type_ref"] == 0x4000
    libs = spark.createDataFrame([("l", bytearray(container.build_library([("n_cache.udo", data), ("bad.udo", data[:60]), ("d.dwo", b"PDW1abc"), ("x.str", b"")])))], "library string, content binary")
    inspected = objects.inspect_entries(container.entries(container.parse_libraries(libs)))
    rows = {r.name: r for r in inspected.collect()}
    assert rows["n_cache.udo"].format == "compiled" and rows["bad.udo"].error and rows["d.dwo"].format == "datawindow" and rows["x.str"].zero_ratio == 0.0
    assert [r.value.s for r in objects.exploded(inspected, "constants").collect()] == ["cache"]
    assert catalogue_of([found]).parents == {"n_cache": "n_base"}


def test_built_object_is_read_again():
    functions = [
        {"name": "of_a", "return_ref": 6, "flags": 0, "parameters": [("al_key", 2, 2), ("as_name", 6, 4), ("ab", 7, 0)], "code": b"\x32\0\1\0\0\0", "locals": [("ll_x", 2), ("ls_é", 6)], "lines": [(1, 0), (2, 4)]},
        {"name": "of_b", "return_ref": 0, "flags": 0x20, "parameters": [], "code": b"\0\0", "locals": [], "lines": []},
    ]
    found = objects.parse_object(objects.build_object("n_own", "n_base", [("A", 2, -5), ("B", 6, "tèxt"), ("C", 7, 1)], functions))
    assert [(c["name"], c["owner"], c["value"]["i"], c["value"]["s"]) for c in found["constants"]] == [("A", "n_own", -5, None), ("B", "n_own", None, "tèxt"), ("C", "n_own", 1, None)]
    assert [signature(f) for f in found["objects"][0]["functions"]] == ["public function string of_a(ref long al_key, readonly string as_name, boolean ab)", "private subroutine of_b()"]
    assert [(r["function_index"], bytes.fromhex(r["pcode"]), len(r["debug"]) // 8, [v["name"] for v in r["variables"]]) for r in found["regions"]] == [(0, functions[0]["code"], 2, ["ll_x", "ls_é"]), (1, b"\0\0", 0, [])]
    assert objects.parse_object(objects.build_object("n", "m", [], []))["regions"] == []


def test_values():
    assert [typed_value(t, r, b"")["i"] for t, r in ((1, 0xFFFF), (2, 0xFFFFFFFE), (7, 1), (9, 0x1FFFF), (10, 0xFFFFFFFF), (18, 65), (21, 300))] == [-1, -2, 1, 0xFFFF, 0xFFFFFFFF, 65, 44]
    assert typed_value(7, 2, b"")["kind"] == typed_value(5, 2, b"")["kind"] == typed_value(6, 0xFFFF, b"")["kind"] == "unresolved"
    assert utf16_at(wide("ab"), 0) == "ab" and utf16_at(b"a\0", 0) is None and utf16_at(wide("ab"), 1) is None and utf16_at(b"\0\xd8\0\0", 0) is None
    dims = struct.pack("<B3xIIIIII", 3, 1, 5, 2, 3, 0, 0)
    assert array_shape(dims, 0) == "[5,2 to 3,]" and array_shape(dims[:9], 0) is None and array_shape(b"", 0xFFFF) == ""
    assert [type_name(r, {0x8001: "x"}) for r in (6, 17, 0x8001, 0x8002, 0x4002)] == ["string", "type_0011", "x", "type_8002", "system_type_4002"]
    dec = lambda v, sign, scale: v.to_bytes(7, "little") + b"\0" * 7 + bytes([sign, scale])
    assert [decimal_at(dec(*x), 0) for x in ((1250, 0, 2), (5, 1, 3), (7, 0, 0))] == ["12.50", "-0.005", "7"]
    for bad in (dec(0, 1, 0), dec(1, 2, 0), dec(1, 0, 15), b"\0" * 15):
        with pytest.raises(FormatError):
            decimal_at(bad, 0)
    assert [double_at(struct.pack("<d", v), 0) for v in (1.0, 0.1, 1e22, 1e-7)] == ["1", "0.1", "1" + "0" * 22, "0.0000001"]
    with pytest.raises(FormatError):
        double_at(struct.pack("<d", -0.0), 0)
    assert escaped('a~"\n') == 'a~~~"~n' and safe_name('a<b>:c. ') == "a_b__c" and safe_name("...") == "object" and len(safe_name("x" * 300)) == 160
    assert object_type("W.WIN") == "window" and object_type("a") == "unknown" and object_type_by_content(b"a Menu function") == "menu"


def test_scan(spark):
    s = lambda b, v=12, **k: scan.scan(bytes.fromhex(b), v, SOME_OPCODES, **k)
    assert s("1E 00 05 00 00 00 00 00")["complete"] and len(s("1E 00 05 00 00 00 00 00")["instructions"]) == 2
    assert (s("FF FF 00 00")["stop"], s("FF FF 00 00")["consumed"]) == ("unknown_opcode", 0)
    assert s("1E 00 05")["stop"] == "incomplete_operand" and s("00")["stop"] == "incomplete_opcode" and s("")["complete"]
    assert s("04 00 04 00 00 00")["branches"] == [{"offset": 0, "target": 4, "valid": True}]
    assert s("51 02 00 00", 19)["stop"] == "unsupported_for_version" and s("51 02 00 00", 22)["instructions"][0]["operand_words"] == 1
    assert [r["mnemonic"] for r in s("FF FF 00 00", tolerant=True)["instructions"]] == ["UNKNOWN", "RETURN"]
    assert scan.debug_map(bytes.fromhex("07000000"), s("00 00")["instructions"])["valid"]
    assert not scan.debug_map(bytes.fromhex("0700020000"), s("00 00")["instructions"])["valid"]
    rows = spark.createDataFrame([(1, bytearray(b"\0\0")), (2, None), (3, bytearray(b"\xff\xff"))], "k long, pcode binary")
    assert sorted((r.k, r.complete) for r in scan.scan_regions(rows, ["k"], SOME_OPCODES, 12).collect()) == [(1, True), (2, True), (3, False)]
    dim = spark.createDataFrame([(k, *v) for k, v in SOME_OPCODES.items()], "opcode int, mnemonic string, words_old int, words int, rule string")
    assert scan.opcodes(dim) == SOME_OPCODES


def op(offset, opcode, *operands):
    return {"offset": offset, "opcode": opcode, "mnemonic": f"OP{opcode:X}", "operand_words": len(operands), "operands": list(operands)}


def test_control_flow():
    rows = [op(0, 0x1E, 0, 0), op(6, 3, 16), op(10, 0x14), op(12, 4, 0), op(16, 0)]
    found = flow.control_flow(rows, 18)
    assert [(b["start"], b["end"]) for b in found["blocks"]] == [(0, 10), (10, 16), (16, 18)]
    assert {(e["from"], e["to"], e["kind"]) for e in found["edges"]} == {(0, 2, "taken"), (0, 1, "fallthrough"), (1, 0, "jump")}
    assert flow.loops(found) == [(0, 1)] and found["valid"]
    assert not flow.control_flow([op(0, 4, 7)], 4)["valid"] and flow.control_flow([], 0)["valid"]
    tried = [op(0, 0x1E5, 14, 40), op(6, 0x14), op(10, 4, 40), op(14, 0x1A9, 1), op(18, 0x1E7), op(20, 3, 40), op(24, 0x14), op(40, 0x1E6), op(42, 0)]
    found = flow.control_flow(tried, 44)
    assert found["valid"] and found["exceptions"][0]["handlers"][0]["variable"] == 1
    assert flow.scaffolding(found) == {0, 40, 10, 14, 18, 20}
    assert "exception" in {e["kind"] for e in found["edges"]}


RULES = {1: "local-var", 2: "const-i16", 3: "cond-jump", 4: "jump", 5: "binary +", 6: "binary *", 7: "assign", 8: "return-value", 9: "const-enum", 10: "array-index", 11: "member-access", 12: "and", 13: "or", 14: "not", 15: "len()", 16: "array-literal", 17: "binary -"}


def folded(*ops, **more):
    rows = [op(4 * i, o, *x) for i, (o, *x) in enumerate(ops)]
    context = Context([{"name": n, "type_name": "long", "array": "", "is_referenced_global": False, "raw": 0} for n in "abc"], **more)
    return preview(rows, 4 * len(rows), True, RULES, context)


def test_fold():
    assert folded((1, 0), (1, 1), (2, 3), (5,), (7,))["statements"] == ["a = b + 3"]
    product = ((1, 0), (1, 1), (2, 3), (5,), (2, 2), (6,), (7,))
    assert folded(*product)["statements"] == ["a = (b + 3) * 2"]
    assert folded(*product, corrected=False)["statements"] == ["a = b + 3 * 2"]
    assert folded((1, 0), (1, 1), (1, 2), (1, 0), (17,), (17,), (7,))["statements"] == ["a = b - (c - a)"]
    gap = folded((1, 0), (99, 7), (7,))
    assert [g["reason"] for g in gap["gaps"]] == ["semantic rule not implemented", "assigned value is missing"] and not gap["complete"] and gap["coverage"] == pytest.approx(100 / 3)
    assert folded((1, 0), (9, 1, 0x402F), (7,))["statements"] == ["a = stopsign!"] and folded((9, 99, 0x402F))["gaps"]
    assert folded((1, 0), (2, 1), (2, 2), (16, 0, 0, 2), (7,))["statements"] == ["a = {1, 2}"]
    assert folded()["coverage"] == 100.0 and folded()["complete"]
    assert folded((1, 9))["gaps"][0]["reason"] == "local-variable index 9 is out of bounds"
    assert not folded((1, 0))["complete"]
    chain = Catalogue({"base": {3: ("ib", "n_x")}}, {"child": "base", "base": "child"})
    assert chain.member("CHILD", 3) == ("ib", "n_x") and chain.member("child", 9) is None and chain.parent("child", 2) == "child"


def test_preview_of_regions(spark):
    from quern.plans import artifacts

    code = struct.pack("<HHH", 0x1E, 0, 0) + struct.pack("<HH", 0x03, 16) + struct.pack("<Hi", 0x34, -5) + struct.pack("<H", 0)
    region = {"pcode": code.hex(), "variables": [{"name": "lb", "type_name": "boolean", "array": "", "is_referenced_global": False, "raw": 0}], "definition": {"name": "of_x", "flags": 0x10, "return_type_name": "", "parameters": []}}
    rows = spark.createDataFrame([(1, json.dumps(region), None)], "k long, region string, context string")
    (found,) = preview_regions(rows, ["k"], artifacts.SOME_OPCODES, 12).collect()
    assert found.signature == "protected subroutine of_x()" and found.statements == ["if lb then", "end if", "return"] and not found.complete


def test_executable(spark):
    reference = [(k * k // 3 + k // 7) % 5 for k in range(100)]
    pe = bytearray(0x400)
    pe[:2], pe[0x3C:0x40], pe[0x80:0x84] = b"MZ", struct.pack("<I", 0x80), b"PE\0\0"
    pe[0x84:0x98] = struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 0xE0, 0)
    pe[0x98:0x9A], pe[0xA8:0xAC], pe[0xB4:0xB8] = struct.pack("<H", 0x10B), struct.pack("<I", 0x1000), struct.pack("<I", 0x400000)
    pe[0x178:0x1A0] = b".data\0\0\0" + struct.pack("<IIII12xI", 0x4000, 0x2000, 0x4000, 0x400, 7)
    rows = b"".join(struct.pack("<III", 0x402010, w, k) for k, w in enumerate([*reference, *[1] * 600]))
    data = bytes(pe) + b"\xff" * 8 + rows
    (found,) = executables.width_tables(data, reference, 3)
    assert (found["encoding"], found["stride"], found["matched"], found["offset"], found["address"]) == ("u32", 12, 100, 0x40C, 0x200C)
    assert found["records"][0]["opcode"] == 0x247 and found["records"][0]["handler_offset"] == 0x410
    assert executables.width_tables(bytes(pe) + bytes(reference), reference, 3)[0]["encoding"] == "bytes"
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"no")), ("c", None)], "library string, content binary")
    out = {r.library: r for r in executables.analyse(files, reference, 3).collect()}
    assert out["a"].bitness == 32 and out["b"].error and out["c"].error
    assert sinks.html_report("<script>__REPORT__</script>", '{"a": "</script>"}').count("</script>") == 1
    assert spark.range(1).select(sinks.safe(F.lit(" .")).alias("n")).first().n == "object"


def test_scan_looks_an_opcode_up_once(monkeypatch):
    """the table is asked for an opcode once a region, not once an instruction."""
    from quern.operators import scan

    asked = []
    monkeypatch.setattr(scan, "operand_words", lambda opcode, major, table: asked.append(opcode) or table[opcode][1])
    found = scan.scan(struct.pack("<HHH", 5, 1, 2) * 50 + b"\1", 12, {5: ("x", 2, None, "")})
    assert asked == [5] and len(found["instructions"]) == 50 and found["instructions"][-1]["operands"] == [1, 2]
    assert (found["complete"], found["consumed"], found["stop"]) == (False, 300, "incomplete_opcode")
