"""The parsers over synthetic artifacts made of the driver's tables."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import scan as S
from quern.operators.compare import differences
from quern.operators.opcodes import assemble
from quern.operators.preview import preview_regions
from quern.sources.container import build_library, entries, parse_libraries
from quern.streaming.events import windows

#: Some opcodes, for synthetic code: mnemonic, operand words before version 11 and from it on, rule.
# Fixed values of the format.
SOME_OPCODES: S.Opcodes = {
    0x0000: ("RETURN", 0, 0, "return"), 0x0002: ("JUMPTRUE", 1, 1, "cond-jump"), 0x0003: ("JUMPFALSE", 1, 1, "cond-jump"), 0x0004: ("JUMP", 1, 1, "jump"),
    0x001E: ("PUSH_LOCAL_VAR", 1, 2, "local-var"), 0x0032: ("PUSH_CONST_INT", 1, 1, "const-i16"), 0x0034: ("PUSH_CONST_LONG", 2, 2, "const-i32"), 0x0251: ("PB2022_OP_0251", 1, None, ""),
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the entries of libraries (a thousand each), packed and parsed again."""
    rows = _t(spark, sf_dir, "supplier")
    packed = rows.select(F.floor(F.col("s_suppkey") / 1000).alias("k"), F.format_string("s%09d.win", "s_suppkey").alias("name"), F.to_json(F.struct(*rows.columns)).alias("body"))

    def pack(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("name").to_pylist(), table.column("body").to_pylist(), strict=True))
        return pa.table({"library": pa.array([f"lib{table.column('k')[0].as_py()}"]), "content": pa.array([build_library([(n, b.encode() * 3) for n, b in own])], pa.binary())})

    files = packed.groupBy("k").applyInArrow(pack, "library string, content binary")
    body = F.col("data").cast("string")
    own = entries(parse_libraries(files)).select(F.from_json(F.left(body, (F.length(body) / 3).cast("int")), rows.schema).alias("r"), "object_type", F.size("data_blocks").alias("n_blocks"), "size")
    return own.select("r.*", "object_type", (F.col("n_blocks") == F.ceil(F.col("size") / 502)).alias("whole"))


def _coded(lines: DataFrame) -> DataFrame:
    """Order lines as code: per order, a 32-bit constant (part), a 16-bit one (quantity) per line, a return."""
    part, quantity = F.col("l_partkey"), F.col("l_quantity").cast("int")
    # A line is one row, its first opcode and all words after it: equal lines stay apart.
    words = F.array(*[x.cast("int") for x in (part % 65536, F.floor(part / 65536), F.lit(0x32), quantity)])
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(0x34).alias("opcode"), words.alias("operands"))
    return assemble(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"]).select("l_orderkey", F.concat("pcode", F.unhex(F.lit("0000"))).alias("pcode"))


def pcode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines encoded as instructions, scanned, and their operands decoded."""
    lines = _t(spark, sf_dir, "lineitem")
    found = S.instructions(S.scan_regions(_coded(lines), ["l_orderkey"], SOME_OPCODES, 12), ["l_orderkey"])
    word = lambda k: F.get("operands", F.lit(k)).cast("long")
    return found.where("opcode = 52").select("l_orderkey", (F.floor(F.col("offset") / 10) + 1).alias("position"), (word(0) + word(1) * 65536).alias("l_partkey"))


def preview_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per supplier: `if x then return k` as code, folded to statements."""

    def region(key: int, value: float) -> str:
        code = struct.pack("<HHH", 0x1E, 0, 0) + struct.pack("<HH", 0x03, 20) + struct.pack("<Hi", 0x34, int(value)) + struct.pack("<HH", 0x04, 20) + struct.pack("<H", 0)
        variables = [{"name": "lb_ok", "type_name": "boolean", "array": "", "is_referenced_global": False, "raw": 0}]
        return json.dumps({"pcode": code.hex(), "variables": variables, "definition": {"name": f"of_{key}", "flags": 0, "return_type_name": "", "parameters": []}})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([region(k, v) for k, v in zip(keys, values, strict=True)]), pa.array(["{}"] * len(keys))], ["s_suppkey", "region", "context"])

    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").mapInArrow(make, "s_suppkey long, region string, context string")
    return preview_regions(rows, ["s_suppkey"], SOME_OPCODES, 12).select("s_suppkey", "signature", F.array_join("statements", "; ").alias("statements"), "coverage", F.size("gaps").alias("gaps"))


def lcs_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document against those of the document before it, by id, that begins with the same five words:
    copies and near copies of whole texts. A frequent beginning is a chain, not all of its pairs."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    docs = _t(spark, sf_dir, "documents").select("doc_id", words.alias("a")).withColumn("head", F.xxhash64(F.slice("a", 1, 5)))
    # The ids alone find their partners; texts are joined to them.
    before = docs.select("doc_id", F.lag("doc_id").over(Window.partitionBy("head").orderBy("doc_id")).alias("other")).where("other IS NOT NULL")
    pairs = docs.select("doc_id", "a").join(before, "doc_id").join(docs.select(F.col("doc_id").alias("other"), F.col("a").alias("b")), "other")
    return differences(pairs, ["doc_id", "other"], "a", "b").select("doc_id", "other", F.size("only_a").alias("only_a"), F.size("only_b").alias("only_b"), "matched")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and day: the stream's projection over a table."""
    return windows(_t(spark, sf_dir, "events"), length="1 day")


QUERIES = {f.__name__: f for f in (container_roundtrip, pcode_roundtrip, preview_fold, lcs_alignment, event_windows)}

ORACLE_SQL = {
    "container_roundtrip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'window' AS object_type, true AS whole FROM supplier",
    "pcode_roundtrip": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS position, l_partkey FROM lineitem",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL",
}
