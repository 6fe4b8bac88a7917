"""Decode reports as rows of functions and of their gaps, and the classes of gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the analytics read of a report.
SCHEMA = """entries array<struct<index: int, name: string, pcode_regions: array<struct<region_index: int, owner: string,
    scan: struct<instructions: array<struct<offset: long, opcode: int, mnemonic: string>>>,
    semantic_preview: struct<signature: string, unresolved: array<struct<offset: long, opcode: int, mnemonic: string, reason: string>>,
        evidence: struct<semantic_rules_complete: boolean, function_reconstruction: string,
            function_comparison: struct<verification_basis: string, result: string, source_reference: string>>>>>>>"""

# Families of opcodes by their mnemonics, in order; a name that ends in * is a beginning.
FAMILIES = [
    ("sql_and_embedded_sql", ["DB*", "ENTER_EMBEDDED", "EXIT_EMBEDDED"]),
    ("increment_operations", ["INCR_*"]),
    ("decrement_operations", ["DECR_*"]),
    ("addassign_operations", ["ADDASSIGN_*"]),
    ("other_compound_assignments", ["SUBASSIGN_*", "MULTASSIGN_*", "DIVASSIGN_*"]),
    ("modulo_operations", ["MOD_*"]),
    ("int_intrinsic", ["INT"]),
    ("call_protocol", ["CLASS_CALL*", "DOTFUNCCALL*", "FREE_INV_METH_ARGS"]),
    ("exception_handling", ["THROW_EXCEPTION", "POP_TRY"]),
    ("dup_stacked_lvalue", ["DUP_STACKED_LVALUE"]),
    ("array_bound_info", ["ARRAY_BOUND_INFO"]),
    ("create_using", ["CREATE_USING"]),
    ("typed_member_access", ["DOT_DEC", "DOT_DOUBLE", "DOT_LONGLONG"]),
    ("any_indexing", ["INDEX_ANY", "INDEX_ERR_CHK_ANY"]),
    ("array_shape_transform", ["TRANSFORM_*", "CALC_COMPLEX_ARRAY_BOUND"]),
    ("intrinsic_or_unary_operations", ["ABS_DEC", "ABS_LONG", "BLOB", "COS", "MAX_LONG", "MIN_LONG", "NEGATE", "SIN", "SQRT", "UPPER"]),
    ("typed_float_constant", ["PUSH_CONST_FLOAT"]),
    ("generic_assignment", ["ASSIGN"]),
    ("unknown_pb2022_opcode", ["PB2022_OP_*"]),
]
NO_RULE = "semantic rule not implemented"
METADATA = ["unknown PB 2022 system-function reference", "unknown system-function reference", "unknown enum constant", "member name is external", "member name is missing", "global function name is missing", "local-variable index"]


def _cases(cases: list[tuple[Column, str]], default: str) -> Column:
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), F.lit(default))


def direct_family(mnemonic: Column) -> Column:
    """The first family that a mnemonic is in."""
    test = lambda names: reduce(lambda a, b: a | b, [mnemonic.startswith(n[:-1]) if n.endswith("*") else mnemonic == n for n in names])
    return _cases([(test(names), family) for family, names in FAMILIES], "other_direct_semantic_gap")


def gap_kind(reason: Column) -> Column:
    """A missing rule, missing names, or a consequence of another gap."""
    lacking = reduce(lambda a, b: a | b, [reason.contains(m) for m in METADATA])
    return _cases([(reason == NO_RULE, "direct_rule_absent"), (lacking, "artifact_or_metadata_resolution_gap")], "dependent_stack_or_context_failure")


def read_reports(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """functions of the reports (JSON, one a file) under a path."""
    return functions(spark.read.schema(SCHEMA).option("multiLine", True).json(path), corpus)


def functions(reports: DataFrame, corpus: str) -> DataFrame:
    """One row per function with a preview: function (corpus, entry's and region's index), corpus, entry,
    signature, complete, verification, result, basis, n_instructions, unresolved (by offset)."""
    regions = reports.select(F.explode("entries").alias("e")).select("e.index", "e.name", F.explode("e.pcode_regions").alias("r")).where("r.semantic_preview IS NOT NULL")
    p = "r.semantic_preview"
    return regions.select(
        F.concat_ws("|", F.lit(corpus), "index", "r.region_index").alias("function"),
        F.lit(corpus).alias("corpus"),
        F.col("name").alias("entry"),
        F.col(f"{p}.signature").alias("signature"),
        F.coalesce(f"{p}.evidence.semantic_rules_complete", F.lit(False)).alias("complete"),
        F.col(f"{p}.evidence.function_reconstruction").alias("verification"),
        F.col(f"{p}.evidence.function_comparison.result").alias("result"),
        F.col(f"{p}.evidence.function_comparison.verification_basis").alias("basis"),
        F.coalesce(F.size("r.scan.instructions"), F.lit(0)).alias("n_instructions"),
        F.array_sort(F.coalesce(f"{p}.unresolved", F.from_json(F.lit("[]"), "array<struct<offset: long, opcode: int, mnemonic: string, reason: string>>"))).alias("unresolved"),
    )


def gaps(found: DataFrame) -> DataFrame:
    """One row per gap with its function's columns, kind, family and direct."""
    rows = found.select("function", "corpus", "entry", "signature", "complete", F.explode("unresolved").alias("u")).select("function", "corpus", "entry", "signature", "complete", "u.*")
    kind = gap_kind(F.col("reason"))
    direct = kind == "direct_rule_absent"
    return rows.withColumns({"kind": kind, "direct": direct, "family": F.when(direct, direct_family(F.col("mnemonic"))).otherwise(kind)})
