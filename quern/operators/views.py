"""Columns and figures that a report's reader sees, over decoded regions (quern.operators.decode) and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "—"
#: Header figures by the summary's counter and what stands for it where a report has none.
HEADER = [("object_containers", "entries"), ("semantic_previews", "regions"), ("semantically_complete_previews", None), ("reconstructed_exception_regions", None)]


def hex_text(number: Column) -> Column:
    """0x and at least four upper-case digits of an integer from 0 on."""
    digits = F.hex(number.cast("long"))
    return F.coalesce(F.concat(F.lit("0x"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)), F.lit(MISSING))


def percent_text(number: Column) -> Column:
    """Two decimals and a percent sign; of null and non-finite numbers the sign for missing ones."""
    value = number.cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.format_string("%.2f%%", value)).otherwise(MISSING)


def basename(path: Column, default: str = "PBD") -> Column:
    """What follows the last slash of either kind; the default if that is nothing."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"[^/\\]*\z", 0), F.lit("")), F.lit(default))


def object_kind(object_type: Column, format: Column) -> Column:
    """The type by an entry's name, else by its content, else unknown; an empty one is none."""
    return F.coalesce(F.nullif(object_type, F.lit("")), F.nullif(format, F.lit("")), F.lit("unknown"))


def region_view(decoded: DataFrame, inspected: DataFrame, types: DataFrame) -> DataFrame:
    """library, entry_index, region_index, entry_name, object_type, function, unresolved, complete, cfg_valid of each decoded
    region; types: library, entry_index and object_type of the entries."""
    kinds = inspected.select("library", "entry_index", "format").join(types.select("library", "entry_index", "object_type"), ["library", "entry_index"], "left")
    rows = decoded.join(kinds, ["library", "entry_index"], "left")
    return rows.select(
        "library", "entry_index", "region_index", "entry_name", object_kind(F.col("object_type"), F.col("format")).alias("object_type"), F.col("signature").alias("function"),
        F.coalesce(F.size("gaps"), F.lit(0)).alias("unresolved"), F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("flow_valid", F.lit(False)).alias("cfg_valid"),
    )


def header(counted: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """One row of figures: those of `summary` (a row, whose counters may be null or missing), else those counted from
    rows with entries and regions, else 0; and the coverage as text."""
    have = summary.columns if summary is not None else []
    names = [*[k for k, _ in HEADER], "semantic_coverage_percent"]
    base = counted.agg(F.coalesce(F.sum("entries"), F.lit(0)).cast("long").alias("entries"), F.coalesce(F.sum("regions"), F.lit(0)).cast("long").alias("regions"))
    one = summary.agg(*[F.max(k).alias(k) for k in names if k in have]) if any(k in have for k in names) else None
    rows = base.join(F.broadcast(one)) if one is not None else base
    known = lambda k: F.col(k) if k in have else F.lit(None)
    figures = [F.coalesce(known(k).cast("long"), F.col(other) if other else F.lit(0).cast("long")).alias(k) for k, other in HEADER]
    return rows.select(*figures, percent_text(known("semantic_coverage_percent")).alias("coverage"))
