"""Symbols and their places as a stored multi-map: bucketed by name, so that lookups do not shuffle it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATION = "struct<file: string, line: long, column: long>"


def write_index(symbols: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """The rows (name, file, line, column) as a table of so many buckets by name, each sorted by name. A frequent
    name's places stay rows: nothing collects them. A null name is left out. An existing table is refused."""
    out = symbols.where("name IS NOT NULL").select("name", "file", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"))
    # Dealt by the bucket's own hash, a bucket is one file.
    writer = out.repartition(buckets, "name").write.format("parquet").bucketBy(buckets, "name").sortBy("name")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def places(spark: SparkSession, table: str, names: DataFrame) -> DataFrame:
    """A row for each row of `names` (name and what else there is) and each place of it, file, line and column null for
    names without. Only the names are shuffled, to the index's buckets; small ones are broadcast."""
    return names.join(spark.table(table).select("name", "file", "line", "column"), "name", "left")


def locations(spark: SparkSession, table: str, names: DataFrame) -> DataFrame:
    """name and the sorted array of its places for each distinct name, empty for names without: for names whose places
    fit a row."""
    wanted = names.select("name").distinct()
    found = places(spark, table, wanted)
    place = F.when(F.col("file").isNotNull() | F.col("line").isNotNull(), F.struct("file", "line", "column"))
    return found.groupBy("name").agg(F.array_sort(F.collect_list(place)).alias("locations"))
