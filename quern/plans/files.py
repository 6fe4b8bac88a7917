"""The file sources and sinks bound to the driver's tables: what is written is read back."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.decode import decode_regions
from quern.plans.artifacts import SOME_OPCODES
from quern.plans.queries import _t, registry
from quern.sources.container import build_library
from quern.sources.files import numbered, read_entry_folder, read_libraries, write_entry_folder
from quern.sources.objects import build_object, inspect_entries
from quern.sources.places import scratch, stored

QUERIES, ORACLE_SQL, bound = registry()

#: Customers in a library file, and bytes of a file in a partition of the source: files are cut.
PER_FILE, SPLIT = 2000, 64 << 10


def _packed(rows: DataFrame, key: str, per_file: int) -> DataFrame:
    """entry_index, name, data: library files with an entry, its row as JSON, for each row. A file is made by one task."""
    named = rows.select(F.floor(F.col(key) / per_file).cast("int").alias("k"), F.format_string("w%09d.win", key).alias("name"), F.to_json(F.struct(*rows.columns)).alias("body"))

    def pack(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("name").to_pylist(), table.column("body").to_pylist(), strict=True))
        k = table.column("k")[0].as_py()
        return pa.table({"entry_index": pa.array([k], pa.int32()), "name": [f"lib{k}.pbd"], "data": pa.array([build_library([(n, b.encode() * 4) for n, b in own])], pa.binary())})

    return named.groupBy("k").applyInArrow(pack, "entry_index int, name string, data binary")


@bound("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'window' AS object_type, (row_number() OVER (PARTITION BY c_custkey // 2000 ORDER BY c_custkey) - 1)::INT AS entry_index, true AS whole FROM customer""")
def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of library files, written to a folder, and read by ranges of blocks."""
    rows = _t(spark, sf_dir, "customer")
    folder = scratch(spark, "libraries")
    write_entry_folder(_packed(rows, "c_custkey", PER_FILE), folder)
    found = numbered(read_libraries(spark, f"{folder}/objects", split_bytes=SPLIT).where("library NOT LIKE '%.jsonl'"))
    body = F.col("data").cast("string")
    own = found.select(F.from_json(F.left(body, (F.length(body) / 4).cast("int")), rows.schema).alias("r"), "object_type", "entry_index", F.size("data_blocks").alias("n"), "size")
    return own.select("r.*", "object_type", "entry_index", (F.col("n") == F.ceil(F.col("size") / 502)).alias("whole"))


@bound("""SELECT s_suppkey::INT AS entry_index, s_name || '.txt' AS name, sha256(s_name || ':' || s_nationkey) AS sha256, length(s_name || ':' || s_nationkey) AS size, s_acctbal AS balance FROM supplier""")
def entry_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as raw files with a manifest, read back from there."""
    rows = _t(spark, sf_dir, "supplier")
    folder = scratch(spark, "entries")
    body = F.concat_ws(":", "s_name", "s_nationkey").cast("binary")
    write_entry_folder(rows.select(F.col("s_suppkey").cast("int").alias("entry_index"), F.concat("s_name", F.lit(".txt")).alias("name"), body.alias("data"), F.col("s_acctbal").alias("balance")), folder)
    line = F.from_json("entry", "entry_index int, name string, balance double")
    return read_entry_folder(spark, folder).withColumn("line", line).select("line.entry_index", "line.name", "sha256", "size", "line.balance")


@bound("""SELECT s_suppkey, 'n_' || s_suppkey AS type_name, 'n_supplier' AS inherits, s_nationkey::BIGINT AS nation, trunc(s_acctbal)::BIGINT AS balance, s_name AS name, s_nationkey % 2 = 0 AS even,
    'public function string of_get(ref long al_key, readonly string as_name)' AS signature, true AS complete, 3::BIGINT AS instructions, 12::BIGINT AS consumed, 1::BIGINT AS debug_records, true AS debug_valid, (s_suppkey % 1000)::INT AS entry_index FROM supplier""")
def object_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as compiled objects with constants and a function, in library files (a thousand each) that are written,
    read by ranges of blocks, inspected and decoded."""
    suppliers = _t(spark, sf_dir, "supplier")
    packed = suppliers.select(F.floor(F.col("s_suppkey") / 1000).cast("int").alias("k"), "s_suppkey", "s_nationkey", F.col("s_acctbal").cast("long").alias("balance"), "s_name").groupBy("k").applyInArrow(_suppliers, "entry_index int, name string, data binary")
    folder = scratch(spark, "objects")
    write_entry_folder(packed, folder)
    inspected = stored(inspect_entries(numbered(read_libraries(spark, f"{folder}/objects", split_bytes=SPLIT).where("library NOT LIKE '%.jsonl'"))), "inspected")
    value = lambda name, of: F.get(F.filter("object.constants", lambda c: c["name"] == name), F.lit(0))["value"][of]
    own = F.get("object.objects", F.lit(0))
    objects = inspected.select(
        "library", "entry_index", F.substring("name", 3, 9).cast("long").alias("s_suppkey"), own["type_name"].alias("type_name"), own["inherit_type_name"].alias("inherits"),
        value("NATION", "i").alias("nation"), value("BALANCE", "i").alias("balance"), value("NAME", "s").alias("name"), (value("EVEN", "i") == 1).alias("even"),
    )
    decoded = decode_regions(inspected, SOME_OPCODES, 12)
    regions = decoded.select("library", "entry_index", "signature", F.col("scanned").alias("complete"), F.col("n_instructions").alias("instructions"), "consumed", "debug_records", "debug_valid")
    return objects.join(regions, ["library", "entry_index"]).drop("library")


def _suppliers(table: pa.Table) -> pa.Table:
    entries = []
    for r in sorted(table.to_pylist(), key=lambda r: r["s_suppkey"]):
        constants = [("NATION", 2, r["s_nationkey"]), ("BALANCE", 2, r["balance"]), ("NAME", 6, r["s_name"]), ("EVEN", 7, int(r["s_nationkey"] % 2 == 0))]
        # A 32-bit constant, a 16-bit one, a return.
        code = struct.pack("<HiHhH", 0x34, r["s_suppkey"], 0x32, r["s_nationkey"], 0)
        function = {"name": "of_get", "return_ref": 6, "flags": 0, "parameters": [("al_key", 2, 2), ("as_name", 6, 4)], "code": code, "locals": [("ll_row", 2)], "lines": [(1, 6)]}
        entries.append((f"n_{r['s_suppkey']:09d}.udo", build_object(f"n_{r['s_suppkey']}", "n_supplier", constants, [function])))
    k = table.column("k")[0].as_py()
    return pa.table({"entry_index": pa.array([k], pa.int32()), "name": [f"lib{k}.pbd"], "data": pa.array([build_library(entries)], pa.binary())})
