"""Outputs. All of them refuse a place that is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.files import write_entry_folder


def safe(name) -> object:
    """A name for files: control and reserved characters as `_`, 160 characters, no blank or dot at the end."""
    cut = F.regexp_replace(F.left(F.regexp_replace(name, r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "_"), F.lit(160)), r"[ .]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("object"))


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries with their content, file name and SHA-256, as Parquet; a manifest without content beside it."""
    named = entries.withColumns({"file": F.concat(F.lpad(F.col("entry_index").cast("string"), 4, "0"), F.lit("_"), safe(F.col("name")), F.lit(".bin")), "sha256": F.sha2("data", 256)})
    named.write.mode("errorifexists").parquet(f"{path}/objects")
    named.drop("data").write.mode("errorifexists").json(f"{path}/manifest")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Plain columns with a header line."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def write_functions(previews: DataFrame, path: str) -> None:
    """One text per function, by partition: its head, declarations and statements, indented by block."""
    text = F.array_join(F.concat(F.array("signature"), F.transform(F.concat("declarations", "statements"), lambda s: F.concat(F.lit("    "), s)), F.array(F.lit("end"))), "\n")
    previews.select(text.alias("value"), "file").write.mode("errorifexists").partitionBy("file").text(path)


def write_decode(decoded: DataFrame, summary: DataFrame, path: str) -> None:
    """A decode (quern.operators.decode): the summary of all levels as JSON, the regions as JSON by library, and each
    function's text as a file of an entry folder, named by entry, region and function. Three writes; the
    functions' manifest comes last and says that the decode is whole."""
    summary.write.mode("errorifexists").json(f"{path}/summary")
    decoded.drop("identifiers").write.mode("errorifexists").partitionBy("library").json(f"{path}/regions")
    head = F.coalesce("signature", F.lit(""))
    text = F.array_join(F.concat(F.array(head), F.transform(F.concat("declarations", "statements"), lambda s: F.concat(F.lit("    "), s)), F.array(F.lit("end"))), "\n")
    name = F.concat_ws("_", F.lpad(F.col("region_index").cast("string"), 4, "0"), F.coalesce("object_type_name", F.lit("object")), F.lit("powerscript.txt"))
    functions = decoded.select("entry_index", name.alias("name"), text.cast("binary").alias("data"), "library", "region_index", head.alias("signature"))
    write_entry_folder(functions, f"{path}/functions")


def write_gap_groups(opcodes: DataFrame, path: str) -> None:
    """The groups of `quern.operators.gaps.opcodes` as JSON, and without their examples as one CSV with a header."""
    opcodes.write.mode("errorifexists").json(f"{path}/groups")
    opcodes.drop("examples").select("opcode", "mnemonic", "reason", "family", "occurrences", "functions").write.mode("errorifexists").option("header", True).csv(f"{path}/groups_csv")


def html_report(template: str, report_json: str, mark: str = "__REPORT__") -> str:
    """A template with a report in a script element; `</` is escaped so that the element does not end."""
    return template.replace(mark, report_json.replace("</", "<\\/"))
