"""Places and small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings for texts of some kilobytes, where the session has none: rows that a Python worker gets at a time.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder. Only where both are unset and
    all tasks run in the driver's process (tests) is a temporary folder taken, and set for the context; on a
    cluster that raises ValueError, since executors would not see it.
    """
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if not context.getCheckpointDir():
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call returns. All of an application's paths are in one
    folder, which goes when the driver ends."""
    folder = f"{checkpoint_root(spark)}/quern-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that outlive executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name based on `wanted` that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


_resident: dict[tuple[str, str], tuple[Hashable, Any]] = {}


def entering(use: str) -> None:
    """Lets go of what a worker keeps for other uses."""
    if any(other != use for other, _ in _resident):
        _resident.clear()
        release()


def resident(use: str, name: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """A large object that a Python worker keeps from task to task, one for each name. The objects of one use
    stay together; another use takes their place, so that what one stage needed does not weigh on the next."""
    if (held := _resident.get((use, name))) and held[0] == key:
        return held[1]
    _resident.pop((use, name), None)
    entering(use)
    _resident[use, name] = key, make()
    return _resident[use, name][1]


def release() -> None:
    """Give freed memory back to the system; workers live on and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
