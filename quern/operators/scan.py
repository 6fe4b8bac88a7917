"""Instructions of code regions, by an opcode table that the caller gives.

The table has opcode, mnemonic, words_old (operand words before version 11), words (from 11 on), and
optionally rule (see quern.operators.preview). It is bounded (an opcode has 16 bits) and goes to every
task. Regions are independent; a region is read by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bytesio import u16_at

#: Opcode -> (mnemonic, words before 11, words from 11 on, rule).
Opcodes = dict[int, tuple[str, int, int | None, str]]


def opcodes(table: DataFrame) -> Opcodes:
    rows = table.select("opcode", "mnemonic", "words_old", "words", *(["rule"] if "rule" in table.columns else [F.lit("").alias("rule")])).limit(1 << 16).collect()
    return {r[0]: (r[1], r[2], r[3], r[4] or "") for r in rows}


def last_opcode(major: int) -> int:
    return 0xFF if major <= 6 else 0x266 if major >= 22 else 0x246


def is_valid(opcode: int, major: int, table: Opcodes) -> bool:
    return opcode in table and opcode <= last_opcode(major)


def operand_words(opcode: int, major: int, table: Opcodes) -> int:
    """From version 22 on, opcodes beyond the old range have one width in the table's old column."""
    _, old, new, _ = table[opcode]
    return old if major < 11 or (major >= 22 and opcode > 0x246) or new is None else new


def scan(code: bytes, major: int, table: Opcodes, tolerant: bool = False) -> dict:
    """complete, consumed, stop (reason, or None), instructions, branches (targets and whether they are
    instructions; none unless complete). A strict scan ends at the first instruction that it cannot
    read; a tolerant one notes an unknown opcode as UNKNOWN and goes on two bytes later."""
    rows, at, stop = [], 0, None
    # Instructions stand at even offsets: the code is one run of words.
    words, known = struct.unpack_from(f"<{len(code) // 2}H", code), {}
    while at < len(code):
        if at + 2 > len(code):
            stop = "incomplete_opcode"
            break
        opcode = words[at // 2]
        if opcode not in known:
            valid = is_valid(opcode, major, table)
            known[opcode] = (table[opcode][0], operand_words(opcode, major, table)) if valid else None
        if known[opcode] is None:
            if tolerant:
                rows.append({"offset": at, "opcode": opcode, "mnemonic": "UNKNOWN", "operand_words": 0, "operands": []})
                at += 2
                continue
            stop = "unsupported_for_version" if opcode in table else "unknown_opcode"
            break
        mnemonic, n = known[opcode]
        if at + 2 + 2 * n > len(code):
            stop = "incomplete_operand"
            break
        rows.append({"offset": at, "opcode": opcode, "mnemonic": mnemonic, "operand_words": n, "operands": list(words[at // 2 + 1 : at // 2 + 1 + n])})
        at += 2 + 2 * n
    starts = {r["offset"] for r in rows}
    branches = [] if stop else [{"offset": r["offset"], "target": r["operands"][0], "valid": r["operands"][0] in starts} for r in rows if 2 <= r["opcode"] <= 4 and r["operands"]]
    return {"complete": stop is None, "consumed": at, "stop": stop, "instructions": rows, "branches": branches}


def debug_map(debug: bytes, instructions: list[dict]) -> dict:
    """Whether each 4-byte record's second word is an instruction's offset, and nothing is left over."""
    starts = {r["offset"] for r in instructions}
    targets = [u16_at(debug, k + 2) for k in range(0, len(debug) - 3, 4)]
    wrong = [t for t in targets if t not in starts]
    return {"records": len(debug) // 4, "trailing": len(debug) % 4, "invalid": wrong, "valid": not wrong and len(debug) % 4 == 0}


SCANNED = (
    "complete boolean, consumed long, stop string, instructions array<struct<offset: long, opcode: int, mnemonic: string, operand_words: int, operands: array<int>>>, "
    "branches array<struct<offset: long, target: long, valid: boolean>>, debug struct<records: long, trailing: long, invalid: array<long>, valid: boolean>"
)
_ARROW = [
    ("complete", pa.bool_()), ("consumed", pa.int64()), ("stop", pa.string()),
    ("instructions", pa.list_(pa.struct([("offset", pa.int64()), ("opcode", pa.int32()), ("mnemonic", pa.string()), ("operand_words", pa.int32()), ("operands", pa.list_(pa.int32()))]))),
    ("branches", pa.list_(pa.struct([("offset", pa.int64()), ("target", pa.int64()), ("valid", pa.bool_())]))),
    ("debug", pa.struct([("records", pa.int64()), ("trailing", pa.int64()), ("invalid", pa.list_(pa.int64())), ("valid", pa.bool_())])),
]


def scan_regions(regions: DataFrame, keys: list[str], table: Opcodes, major: int | str, tolerant: bool = False, code: str = "pcode", debug: str | None = None) -> DataFrame:
    """`keys` and SCANNED of every region; code and debug columns are binary. A null region is empty. `major` is a
    version's, or the name of a column that has each region's (a null one is read as 12)."""
    own = F.coalesce(F.col(major), F.lit(12)) if isinstance(major, str) else F.lit(major)
    source = regions.select(*keys, F.col(code).alias("_code"), (F.col(debug) if debug else F.lit(None)).cast("binary").alias("_debug"), own.cast("int").alias("_major"))
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, m in zip(*[batch.column(len(keys) + k).to_pylist() for k in range(3)], strict=True):
                found = scan(a or b"", m, table, tolerant)
                rows.append(found | {"debug": debug_map(b or b"", found["instructions"])})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array([r[n] for r in rows], t) for n, t in _ARROW]], [*keys, *[n for n, _ in _ARROW]])

    return source.mapInArrow(run, f"{schema}, {SCANNED}")


def instructions(scanned: DataFrame, keys: list[str]) -> DataFrame:
    return scanned.select(*keys, F.explode("instructions").alias("i")).select(*keys, "i.*")
