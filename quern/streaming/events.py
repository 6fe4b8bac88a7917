"""Projections of an event log, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def totals(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Events by kind; of a stream, the counts so far (complete mode)."""
    return events.groupBy(kind).agg(F.count("*").alias("n"))


def windows(events: DataFrame, time: str = "ts", kind: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window of event time. Events later than `late` are left out of a stream, which lets
    it forget windows; a table has them all."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def latest(events: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Each key's last event's columns; of a stream, so far."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, *columns)).alias("_l")).select(key, "_l.*")
