"""Questions that every split of a table asks of the whole table, by packed sorted keys.

A split sends its distinct 64-bit keys, sorted, cut to buckets by their leading bits and packed (key
differences and one value a key). A bucket merges what all splits sent and answers each split with
one byte a key. The answers are stored by split; a later pass over the same splits reads its own.
Keys travel once a split however often they occur in it, so a key that a third of all rows hold costs
no bucket more than one entry a split.

Passes must see the same splits: `splits_of` settles them once. Every answer names the number and the sum
of the keys it is for; a pass whose keys differ stops the job rather than use it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.shared import entering, release, shared_path, stored

_SENT = "bucket int, split int, n long, total long, keys binary, values binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("split", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_ANSWERED = "split int, bucket int, n long, total long, answer binary"


def splits_of(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(df with splits that are the same each time it is read, number of buckets for its keys). A table's files
    are read as they are; anything else is written to the shared folder first. Spark cuts files by the number
    of cores it has just then: that number is held in spark.sql.files.minPartitionNum, unless it is set, so that
    executors may be lost between passes. A bucket for each half megabyte of the files; a power of two."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.child()
    if not node.nodeName().startswith(("LogicalRelation", "Relation")):
        df = stored(df, name)
    spark, pinned = df.sparkSession, "spark.sql.files.minPartitionNum"
    if not spark.conf.get(pinned, None):
        spark.conf.set(pinned, str(spark.sparkContext.defaultParallelism))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df, 1 << max(6, (size >> 19).bit_length())


def pack(numbers: np.ndarray) -> bytes:
    """Compressed byte planes of an unsigned array, leading zero planes left out."""
    width = next((w for w in (1, 2, 3, 4, 5, 6, 7, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w), 8)
    planes = numbers.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), "u1")
    planes[:, : data[0]] = np.frombuffer(zstandard.decompress(data[1:]), "u1").reshape(data[0], n).T
    return planes.reshape(-1).view("<u8")


def _lows(n_buckets: int, bits: int) -> np.ndarray:
    """The smallest key of each bucket."""
    return np.arange(n_buckets, dtype=np.uint64) * np.uint64((1 << bits) // n_buckets)


def _total(keys: np.ndarray) -> int:
    return int(np.add.reduce(keys, dtype=np.uint64).view(np.int64)) if len(keys) else 0


def _send(batches: Iterator[pa.RecordBatch], ask: Callable, n_buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    entering("exchange")
    split = TaskContext.get().partitionId()
    keys, values = ask(batches)
    release()
    lows = _lows(n_buckets, bits)
    cuts = [*np.searchsorted(keys, lows).tolist(), len(keys)]
    rows: list[tuple] = []
    for bucket in range(n_buckets):
        a, z = cuts[bucket], cuts[bucket + 1]
        if a < z:
            part = keys[a:z]
            gaps = np.concatenate([part[:1] - lows[bucket], np.diff(part)])
            rows.append((bucket, split, z - a, _total(part), pack(gaps), pack(values[a:z])))
        if rows and (len(rows) == 64 or bucket == n_buckets - 1):
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW)
            rows = []


def _answer(table: pa.Table, merge: Callable, n_buckets: int, bits: int) -> pa.Table:
    rows = table.to_pylist()
    low = _lows(n_buckets, bits)[rows[0]["bucket"]]
    keys = [np.cumsum(unpack(r["keys"], r["n"]), dtype=np.uint64) + low for r in rows]
    values = [unpack(r["values"], r["n"]) for r in rows]
    where = np.cumsum([0, *(len(k) for k in keys)])
    answers = merge(np.concatenate(keys), np.concatenate(values)).astype("u1")
    packed = [zstandard.compress(answers[a:z].tobytes(), 1) for a, z in zip(where[:-1], where[1:], strict=True)]
    return pa.table({"split": pa.array([r["split"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int64()), "total": pa.array([r["total"] for r in rows], pa.int64()), "answer": pa.array(packed, pa.binary())})


def exchange(splits: DataFrame, n_buckets: int, ask: Callable, merge: Callable, name: str, bits: int = 64) -> str:
    """Folder with the answers to every split of `splits`.

    ask(batches) returns a split's sorted distinct keys (uint64, below 2 ** bits) and one unsigned value for each;
    merge(keys, values) gets those of all splits in a bucket (a split's keys are sorted, the whole is
    not; a key occurs once a split) and returns one byte for each.
    """
    spark = splits.sparkSession
    sent = splits.mapInArrow(functools.partial(_send, ask=ask, n_buckets=n_buckets, bits=bits), _SENT)
    # Sixteen buckets a partition, whatever the session's number of partitions is.
    answered = sent.repartition(max(1, n_buckets // 16), "bucket").groupBy("bucket").applyInArrow(lambda rows: _answer(rows, merge, n_buckets, bits), _ANSWERED)
    folder = shared_path(spark, name)
    answered.repartition("split").write.option("compression", "none").partitionBy("split").parquet(folder)
    return folder


def answers(folder: str, keys: np.ndarray) -> np.ndarray:
    """This split's answers, in the order of its keys. Raises RuntimeError if they are for other keys."""
    if not len(keys):
        return np.empty(0, "u1")
    split = TaskContext.get().partitionId()
    fs, inner = pafs.FileSystem.from_uri(f"{folder}/split={split}")
    rows = [] if fs.get_file_info(inner).type == pafs.FileType.NotFound else ds.dataset(inner, filesystem=fs, format="parquet", ignore_prefixes=["_", "."]).to_table().to_pylist()
    rows.sort(key=lambda r: r["bucket"])
    if sum(r["n"] for r in rows) != len(keys) or sum(r["total"] for r in rows) % (1 << 64) != _total(keys) % (1 << 64):
        raise RuntimeError(f"split {split} has other rows than when it asked")
    return np.frombuffer(b"".join(zstandard.decompress(r["answer"]) for r in rows), "u1")


def merged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first positions in that order, group of each sorted entry) of equal keys."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    return order, np.flatnonzero(new), np.cumsum(new) - 1
