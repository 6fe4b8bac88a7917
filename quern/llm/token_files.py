"""Token ids as flat binary files that readers map into memory.

A folder holds, for each shard, ``<shard>.bin`` (unsigned little-endian ids, 16 bits where the
vocabulary allows it, else 32), ``<shard>.idx`` (64-bit offsets: ids of all documents of all shards
before each document, and one more for the end), ``<shard>.key`` (64-bit document ids) and
``<shard>.null`` (one byte a document, 1 where that id is null), and ``manifest.json`` with each
shard's first offset. Shards are in the order of the documents.

Shards are written by one task each, under a temporary name that is then renamed: a task that runs
again writes the same bytes to the same place. What the driver sees is one row per shard, from which
it takes the prefix sums that are the shards' bases.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import shared_encoder, tokenizer

_DOCS = 2_000  # documents of a batch that readers return
#: Bytes of input (as its files are, compressed) for each shard.
SHARD = 8 << 20


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _put(fs: pafs.FileSystem, path: str, parts) -> None:
    """Write a file whole, then give it its name."""
    with fs.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as out:
        for part in parts:
            out.write(part)
    fs.move(tmp, path)


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array, mapped where it is a local file."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.empty(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int | None, kind: str) -> Iterator[pa.RecordBatch]:
    shard, encoder = TaskContext.get().partitionId(), shared_encoder(path)
    fs, inner = _place(folder)
    name = f"{inner}/{shard:08d}"
    counts, keys, nulls = array("Q"), array("q"), bytearray()
    end = np.array([] if end_id is None else [end_id], kind).tobytes()
    with fs.open_output_stream(tmp := f"{name}.bin.{uuid.uuid4().hex}") as out:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "")
                out.write(ids.astype(kind).tobytes() + end)
                counts.append(len(ids) + (end_id is not None))
                keys.append(key or 0)
                nulls.append(key is None)
    if not counts:
        fs.delete_file(tmp)
        return
    fs.move(tmp, f"{name}.bin")
    _put(fs, f"{name}.len", [np.array(counts, "<u8").tobytes()])
    _put(fs, f"{name}.key", [np.array(keys, "<i8").tobytes()])
    _put(fs, f"{name}.null", [bytes(nulls)])
    yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([sum(counts)], pa.int64())], ["shard", "n_docs", "n_ids"])


def _write_offsets(batches: Iterator[pa.RecordBatch], folder: str, bases: dict[int, int]) -> Iterator[pa.RecordBatch]:
    fs, inner = _place(folder)
    for batch in batches:
        for i in batch.column(0).to_pylist():
            shard = sorted(bases)[i]
            counts = _mapped(fs, f"{inner}/{shard:08d}.len", "<u8")
            at = np.zeros(len(counts) + 1, "<u8")
            np.cumsum(counts, out=at[1:])
            _put(fs, f"{inner}/{shard:08d}.idx", [(at + np.uint64(bases[shard])).tobytes()])
        yield batch


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encode every text and write the ids to `folder` (a new folder that all executors reach), in
    ascending order of `key`. Returns the manifest's shards.

    A null text is empty; a null key comes first; rows with equal keys stand in the order of their
    texts' hashes and are all kept. `end_id` (None: none) follows each document. Other columns are not
    read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    kind = "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else "<u4"
    fs, inner = _place(folder)
    fs.create_dir(inner, recursive=True)
    order = (F.col("key").asc_nulls_first(), F.xxhash64("text"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # A shard a core at least. A table that Spark cannot size counts as endless there; then the session's partitions hold.
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD)) if size < 1 << 62 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    write = functools.partial(_write_shard, path=path, folder=folder, end_id=end_id, kind=kind)
    found = sorted(tuple(r) for r in sorted_rows.mapInArrow(write, "shard int, n_docs long, n_ids long").collect())
    bases, total = {}, 0
    for shard, _, n_ids in found:
        bases[shard] = total
        total += n_ids
    if found:
        spark.range(0, len(found), 1, len(found)).mapInArrow(functools.partial(_write_offsets, folder=folder, bases=bases), "id long").count()
    manifest = [{"shard": s, "n_docs": d, "n_ids": n, "base": bases[s], "kind": kind} for s, d, n in found]
    _put(fs, f"{inner}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def _read_shard(batches: Iterator[pa.RecordBatch], folder: str, manifest: list[dict], ids: bool) -> Iterator[pa.RecordBatch]:
    fs, inner = _place(folder)
    for batch in batches:
        for i in batch.column(0).to_pylist():
            shard = manifest[i]
            name = f"{inner}/{shard['shard']:08d}"
            tokens, at, keys, nulls = (_mapped(fs, f"{name}.{x}", k) for x, k in (("bin", shard["kind"]), ("idx", "<u8"), ("key", "<i8"), ("null", "u1")))
            for a in range(0, len(keys), _DOCS):
                z = min(a + _DOCS, len(keys))
                starts = at[a : z + 1].astype("i8")
                base = int(at[0])
                parts = [tokens[x - base : y - base].astype("<u4") for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                columns = [
                    pa.array(np.array(keys[a:z]), pa.int64(), mask=np.array(nulls[a:z], bool)),
                    pa.array(starts[:-1]),
                    pa.array(np.diff(starts)),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([p.astype("i4").tolist() for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), and with
    `ids` the ids themselves, of every document in the folder; one task maps one shard."""
    fs, inner = _place(folder)
    with fs.open_input_file(f"{inner}/manifest.json") as f:
        manifest = json.loads(f.readall())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    if not manifest:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(functools.partial(_read_shard, folder=folder, manifest=manifest, ids=ids), schema)
