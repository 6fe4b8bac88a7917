"""The decode of library files from end to end, and its summary.

Entries are inspected, the code regions of compiled objects scanned and folded to statements, in one pass each.
What is counted becomes one narrow row an entry and a region (`facts`); the summary of any level is sums of
these, so that totals come from the entries' sums and regions are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.operators.preview import Catalogue, preview_regions
from quern.operators.scan import Opcodes
from quern.sources.objects import OBJECT

KEYS = ["library", "entry_index", "region_index"]
FACTS = (
    "library string, entry_index int, region_index int, kind string, format string, constants long, string_constants long, unresolved_constants long, length long, scanned boolean, "
    "instructions long, consumed long, branches long, invalid_branches long, debug_records long, debug_valid boolean, preview boolean, complete boolean, supported long, flow_valid boolean, "
    "try_catch long, oracle boolean, constructs_verified long, constructs_mismatched long, fragments long, result string, basis string"
)

_REGION, _ENTRY = "kind = 'region'", "kind = 'entry'"


def _if(condition: str) -> str:
    return f"count_if({condition})"


def _sum(column: str) -> str:
    return f"coalesce(sum({column}), 0)"


# The names of the summary's counters, in the report's order.
COUNTERS = {
    "object_containers": _if(_ENTRY), "compiled_constants": _sum("constants"), "compiled_string_constants": _sum("string_constants"), "compiled_unresolved_constants": _sum("unresolved_constants"),
    "compiled_object_envelopes": _if("format = 'compiled'"), "datawindow_envelopes": _if("format = 'datawindow'"),
    "validated_pcode_regions": _if(_REGION), "validated_pcode_bytes": _sum("length"), "regions_scanned_to_end": _if("scanned"), "known_instructions_before_stop": _sum("instructions"), "bytes_consumed_without_guessing": _sum("consumed"),
    "branch_targets_checked": _sum("branches"), "invalid_branch_targets": _sum("invalid_branches"), "debug_records_checked": _sum("debug_records"), "invalid_debug_maps": _if("NOT debug_valid"),
    "semantic_previews": _if("preview"), "semantically_complete_previews": _if("preview AND complete"), "semantically_supported_instructions": _sum("CASE WHEN preview THEN supported END"), "valid_semantic_cfgs": _if("preview AND flow_valid"),
    "reconstructed_exception_regions": _sum("CASE WHEN preview THEN try_catch END"), "known_source_oracle_matches": _if("oracle"), "known_source_semantically_complete_matches": _if("oracle AND complete"),
    "known_source_constructs_verified": _sum("constructs_verified"), "known_source_construct_mismatches": _sum("constructs_mismatched"), "known_source_body_fragments_compared": _sum("fragments"),
    "function_comparisons": _if("result IS NOT NULL"), "function_reconstructions_verified": _if("result = 'verified'"), "function_reconstructions_verified_normalized": _if("basis = 'normalized_equality'"),
    "function_reconstructions_verified_safe_canonicalization": _if("basis = 'safe_semantic_canonicalization'"), "function_reconstructions_verified_compiled_symbol_equivalence": _if("basis = 'compiled_symbol_equivalence'"),
    "function_reconstruction_mismatches": _if("result = 'normalized_body_mismatch'"), "function_comparisons_semantic_rules_incomplete": _if("result = 'semantic_rules_incomplete'"), "function_source_files_missing": _if("result = 'source_file_not_found'"),
    "function_source_routines_missing": _if("result = 'source_routine_not_found'"), "function_source_routines_ambiguous": _if("result = 'ambiguous_source_routine'"),
}

#: Counters that follow from others.
DERIVED = {
    "regions_stopped": "validated_pcode_regions - regions_scanned_to_end",
    "invalid_semantic_cfgs": "semantic_previews - valid_semantic_cfgs",
    "semantic_coverage_percent": "CASE WHEN known_instructions_before_stop = 0 THEN 100D ELSE semantically_supported_instructions * 100D / known_instructions_before_stop END",
}


def decode_regions(inspected: DataFrame, table: Opcodes, major: int, catalogue: Catalogue | None = None) -> DataFrame:
    """KEYS, entry_name, object_type_name, identifiers (name, type_name, shadows, rank) and a measured preview of
    each code region of inspected entries. Identifiers are what names mean in the region: its object's
    properties, globals, locals, parameters; of equal names the highest rank holds."""
    own = inspected.where("object IS NOT NULL").select("library", "entry_index", F.col("name").alias("entry_name"), "object", F.posexplode("object.regions").alias("region_index", "r"))
    holder = F.get("object.objects", F.col("r.object_index"))
    named = lambda column, rank, shadows: F.transform(F.coalesce(column, F.array().cast("array<struct<name: string, type_name: string, is_constant: boolean>>") if column is None else column), lambda v: F.struct(v["name"].alias("name"), v["type_name"].alias("type_name"), shadows(v).alias("shadows"), F.lit(rank).alias("rank")))
    lists = [named(c, rank, shadows) for rank, (c, shadows) in enumerate([(holder["properties"], lambda v: ~v["is_constant"]), (F.col("object.global_variables"), lambda v: ~v["is_constant"]), (F.col("r.variables"), lambda v: ~v["is_constant"]), (F.col("r.definition.parameters"), lambda v: F.lit(True))])]
    context = F.struct(F.col("object.global_variables").alias("globals"), F.col("object.types").alias("types"), F.col("object.enum_values").alias("enums"), holder["type_name"].alias("owner"), holder["parent_type_name"].alias("parent"))
    empty = F.array().cast("array<struct<name: string, type_name: string, shadows: boolean, rank: int>>")
    regions = own.select(
        "library", "entry_index", "region_index", "entry_name", holder["type_name"].alias("object_type_name"),
        F.concat(*[F.coalesce(x, empty) for x in lists]).alias("identifiers"), F.to_json("r").alias("region"), F.to_json(context).alias("context"),
    )
    return preview_regions(regions, [*KEYS, "entry_name", "object_type_name", "identifiers"], table, major, catalogue, measured=True)


def facts(inspected: DataFrame, decoded: DataFrame, comparisons: DataFrame | None = None, constructs: DataFrame | None = None) -> DataFrame:
    """FACTS: a row an entry and a region. comparisons: KEYS, result, basis of regions compared with source;
    constructs: KEYS and status, fragments of each construct that a known source declares."""
    kinds = lambda kind: F.size(F.filter("object.constants", lambda c: c["value"]["kind"] == kind))
    counted = {"constants": F.size("object.constants"), "string_constants": kinds("string"), "unresolved_constants": kinds("unresolved")}
    held = F.col("object").isNotNull()
    entries = inspected.select("library", "entry_index", F.lit("entry").alias("kind"), "format", *[F.when(held, c).cast("long").alias(k) for k, c in counted.items()])
    regions = decoded.select(
        *KEYS, F.lit("region").alias("kind"), "length", "scanned", F.col("n_instructions").alias("instructions"), "consumed", "branches", "invalid_branches", "debug_records", "debug_valid",
        F.col("signature").isNotNull().alias("preview"), "complete", F.col("n_supported").alias("supported"), "flow_valid", F.size("try_catch").cast("long").alias("try_catch"),
    )
    if comparisons is not None:
        regions = regions.join(comparisons.select(*KEYS, "result", "basis"), KEYS, "left")
    if constructs is not None:
        per = constructs.groupBy(*KEYS).agg(F.lit(True).alias("oracle"), F.count_if(F.col("status") == "verified").alias("constructs_verified"), F.count_if(F.col("status") == "mismatch").alias("constructs_mismatched"), F.sum(F.when(F.col("status") == "verified", F.col("fragments"))).cast("long").alias("fragments"))
        regions = regions.join(per, KEYS, "left")
    every = entries.unionByName(regions, allowMissingColumns=True)
    return every.select(*[(F.col(n) if n in every.columns else F.lit(None)).cast(t).alias(n) for n, t in (f.strip().split(" ") for f in FACTS.split(","))])


def summary(rows: DataFrame) -> DataFrame:
    """level (all, library, entry), library, entry_index, COUNTERS and DERIVED of FACTS: regions are summed by entry,
    and the entries' sums by library and over all. Without rows, one row of zeros."""
    per = rows.groupBy("library", "entry_index").agg(*[F.expr(e).alias(k) for k, e in COUNTERS.items()])
    sums = [F.expr(_sum(k)).cast("long").alias(k) for k in COUNTERS]
    keys = [F.col("library"), F.col("entry_index")]
    sets = per.groupingSets([keys[:1], keys], *keys).agg(F.grouping_id().alias("_g"), *sums)
    parts = sets.select(F.when(F.col("_g") == 0, "entry").otherwise("library").alias("level"), "library", "entry_index", *COUNTERS)
    # A grouping set without keys would give no row for no rows. The exchange below both is shared.
    total = per.agg(*sums).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("library"), F.lit(None).cast("int").alias("entry_index"), *COUNTERS)
    return total.unionByName(parts).selectExpr("*", *[f"{e} AS {k}" for k, e in DERIVED.items()])


def observed(rows: DataFrame, name: str = "decode") -> tuple[DataFrame, Observation]:
    """FACTS that give the counters over all of them to an observation as they pass, in whatever action reads them:
    a job that stores facts has its totals without another pass."""
    seen = Observation(name)
    return rows.observe(seen, *[F.expr(e).alias(k) for k, e in COUNTERS.items()]), seen


def catalogue_counts(inspected: DataFrame) -> DataFrame:
    """One row: entries, object definitions, functions of system types and values of system enumerations in a runtime's
    inspected entries."""
    system = lambda ref: ref.bitwiseAND(F.lit(0xF000)) == 0x4000
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    functions = F.aggregate(F.filter("object.objects", lambda o: system(o["type_ref"])), F.lit(0), lambda n, o: n + F.size(o["functions"]))
    return inspected.agg(
        F.count("*").alias("runtime_entry_count"), total(F.size("object.objects")).alias("runtime_object_definition_count"), total(functions).alias("runtime_system_function_count"),
        total(F.size(F.filter("object.enum_values", lambda e: system(e["enum_type_ref"])))).alias("runtime_system_enum_value_count"),
    )


__all__ = ["COUNTERS", "DERIVED", "FACTS", "KEYS", "OBJECT", "catalogue_counts", "decode_regions", "facts", "observed", "summary"]
