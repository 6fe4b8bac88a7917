"""Classes of functions whose statements differ from their source.

Rows have source and rebuilt (arrays of comparable statements), source_only and rebuilt_only (what an
alignment leaves on either side). Classes are ordered rules; the first that holds names the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.source_text import DECLARED

# Patterns of statements, and names of the classes.
DECLARATION = r"^(any|blob|boolean|byte|char|date|datetime|decimal|double|integer|long|real|string|time|uint|ulong|n_[a-z0-9_]+|w_[a-z0-9_]+|u_[a-z0-9_]+|datawindow|datastore|powerobject)"
CONTROL = [r"^(if|elseif|else$|endif$|choosecase|case|endchoose|for|next$|do$|loop|try$|catch|finally$|endtry$)", r"\bgoto\b"]
KINDS = [
    ("condition_expression", r"^(if|elseif).+then$"),
    ("control_flow", r"^(else|endif|choosecase|case|endchoose)"),
    ("control_flow", r"goto"),
    ("return_expression", r"^return"),
    ("object_lifecycle", r"(^|=)create\b"),
    ("object_lifecycle", r"^destroy\b"),
    ("assignment", r"="),
    ("call_or_event", r"\("),
    ("call_or_event", r"\bevent\b"),
    ("call_or_event", r"^call"),
    ("declaration", r"^[a-z_][a-z0-9_]*(\[\])?[a-z_][a-z0-9_]*(\[.*\])?$"),
]
# A list holds whole statements or mnemonics, a text is a pattern.
SHAPE = [("ifs", [r"^(if|elseif).+then$"]), ("elses", [["else"], r"^elseif"]), ("endifs", [["endif"]]), ("chooses", [r"^(choosecase|case|endchoose)"]), ("gotos", [r"goto"])]
# Classes of open opcodes, by mnemonic, and of differing functions, by the fields named. A class
# may have several rows; a test says whether its pattern is to be found. Case does not matter.
OLD_FAMILIES = [
    ("sql_and_embedded_sql", r"^DB"),
    ("sql_and_embedded_sql", ["ENTER_EMBEDDED", "EXIT_EMBEDDED"]),
    ("exception_handling", ["THROW_EXCEPTION", "POP_TRY"]),
    ("typed_numeric_constants", r"^PUSH_CONST_(DEC|DOUBLE)$"),
    ("call_protocol", r"^(CLASS_CALL|DOTFUNCCALL|FREE_INV_METH_ARGS)"),
    ("numeric_and_compound_operations", r"^(INCR_|ADDASSIGN_|MOD_)"),
    ("numeric_and_compound_operations", ["INT"]),
    ("lvalue_array_and_creation", ["DUP_STACKED_LVALUE", "ARRAY_BOUND_INFO", "CREATE_USING"]),
    ("unknown_pb2022_opcode", r"^PB2022_OP_"),
]
_DECLARED = (("source", DECLARATION, True), ("rebuilt", DECLARATION, True))
FIRST_FAMILIES = [
    ("implicit_this_event_receiver", (("source", r"^triggerevent\(this,", True), ("rebuilt", r"^triggerevent\(", True))),
    ("event_return_scaffolding", (("rebuilt", r"ancestorreturnvalue|^n_msg(?:::)?message$", True),)),
    ("event_return_scaffolding", (("rebuilt_only", r"ancestorreturnvalue|::message\.returnvalue", True), ("source", r"^(callsuper::|call[a-z0-9_]+::)", True))),
    ("choose_case_lowering", (("rebuilt", "\u0001case", True),)),
    ("choose_case_lowering", (("source", r"^choosecase", True),)),
    ("structured_if_not_recovered", (("source", r"^if", True), ("rebuilt", r"^if", True), ("every_rebuilt", r"\bgoto", True))),
    ("compiled_symbol_resolution_boundary", (("source", r"\b(invo_constants|lnvo_constants)\.", True), ("rebuilt", r"\d", True))),
    ("compiled_symbol_resolution_boundary", (("source", r"^return[a-z_][a-z0-9_]*$", True), ("rebuilt", r"^return-?\d+$", True))),
    ("compiled_symbol_resolution_boundary", (("source", r"\bcst_[a-z0-9_]+", True), ("rebuilt", r"\d", True))),
    ("compiled_symbol_resolution_boundary", (("source", r"is_msgsrc=(database|file)then", True), ("rebuilt", r'="(database|file)"then', True))),
    ("source_initializer_not_preserved", (*_DECLARED, ("source", r"=", True), ("rebuilt", r"=", False))),
    ("array_or_grouped_declaration_form", (*_DECLARED, ("source", r",", True))),
    ("array_or_grouped_declaration_form", (*_DECLARED, ("source", r"\[\]", True), ("rebuilt", r"\[\]", False))),
    ("array_marker_not_preserved", (("source", r"\[\]", True), ("rebuilt", r"\[\]", False))),
    ("array_marker_not_preserved", (("source", r"item\[\]", True), ("rebuilt", r"^item=", True))),
    ("compiled_accessor_not_collapsed", (("rebuilt", r"__get_attribute_item|getclassdefinition\(\)|getis(userdefined|systemtype)|getsystemfunction", True),)),
    ("receiver_qualification_or_member_mapping", (("rebuilt", r"\bparent\.", True), ("source", r"\bparent\.", False))),
    ("source_super_call_absent_from_pcode", (("source", r"^callsuper::", True), ("rebuilt", r"^returnof_", True))),
    ("ancestor_dispatch_spelling", (("source", r"^call[a-z0-9_]+::", True), ("rebuilt", r"^callsuper::", True))),
    ("ancestor_dispatch_spelling", (("source", r"^callsuper::", True), ("rebuilt", r"^callsuper::", True))),
    ("compiler_temporary_or_declaration_placement", (("rebuilt", DECLARATION, True),)),
    ("powerbuilder_quote_escape_equivalence", (("sizes", r"^0 0$", True),)),
    ("extra_or_missing_statement", (("sides", r"^both$", False),)),
    ("return_expression_mapping", (("source", r"^return", True), ("rebuilt", r"^return", True))),
    ("other_control_flow_mismatch", (("source", r"^if", True),)),
    ("other_control_flow_mismatch", (("source", r"^(else|endif|for|do|loop|choosecase|case)", True),)),
    ("call_or_receiver_mapping", (("source", r"\(", True),)),
    ("call_or_receiver_mapping", (("rebuilt", r"\(", True),)),
]
ROOT_CAUSES = [
    ("single_quote_literal_normalization", (("sizes", r"^0 0$", True),)),
    ("datawindow_attribute_lowering", (("rebuilt_only", r"__get_attribute_item", True),)),
    ("classdefinition_accessor_mapping", (("rebuilt_only", r"getclassdefinition\(\)", True),)),
    ("compiler_scaffolding_not_collapsed", (("rebuilt_only", r"ancestorreturnvalue", True),)),
    ("symbolic_constant_elided", (("source_only", r"invo_constants\.color_", True),)),
    ("symbolic_constant_elided", (("source_only", r"cst_filetype_(reg|ini|xml)", True),)),
    ("symbolic_constant_elided", (("source_only", r"=database", True), ("rebuilt_only", r'="(database|file)"', True))),
    ("symbolic_constant_elided", (("source_only", r"=file", True), ("rebuilt_only", r'="(database|file)"', True))),
    ("source_construct_optimized_away", (("source_only", r"^(long|boolean)[a-z0-9_]+=(0|false)( \|\| |$)", True), ("sizes", r" 0$", False))),
    ("source_construct_optimized_away", (("source_only", r"^callsuper::", True), ("sizes", r" 0$", True))),
    ("inline_if_vs_block_form", (("residual", r"^true$", True), ("source_lines", r"(?m)^if.+then.+", True))),
    ("equivalent_expression_spelling", (("primary_family", r"^condition_expression$", True),)),
    ("grouped_vs_split_declaration", (("source_only", r"^[a-z_][a-z0-9_]+[a-z_][a-z0-9_]+,[a-z_][a-z0-9_]+$", True),)),
]
BLOCKERS = [
    ("resolved_by_safe_form_canonicalization", (("same_loose", r"^true$", True),)),
    ("symbolic_constant_elided", (("root_cause", r"^symbolic_constant_elided$", True),)),
    ("symbolic_constant_elided", (("source_only", r"(\bcache_id\b|\bis_pfckey\b|returnfailure)", True), ("rebuilt_only", r'("pfc listview"|"pfc_lvi_key"|-1)', True))),
]
#: Which kind names a function that differs in several.
MIXED = [("assignment", "mixed_with_assignment"), ("call_or_event", "mixed_with_call_or_event"), ("return_expression", "mixed_with_return")]


def _first(rules: list[tuple[str, Column]], default: str | Column) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules], F.lit(default) if isinstance(default, str) else default)


def _fits(value: Column, test: str | list[str]) -> Column:
    """Whether a value is one of a list's, or has a pattern, without regard to case."""
    return F.lower(value).isin(*[t.lower() for t in test]) if isinstance(test, list) else value.rlike("(?i)" + test)


def _class(table: list, fields: dict[str, Column], default: str | Column) -> Column:
    """The class of the first row of `table` whose tests all hold; null fields are empty texts."""
    found = lambda field, test: _fits(F.coalesce(fields[field].cast("string"), F.lit("")), test)
    return _first([(name, reduce(lambda x, y: x & y, [found(f, p) == F.lit(wanted) for f, p, wanted in tests])) for name, tests in table], default)


def is_declaration(statement: Column) -> Column:
    return statement.rlike("(?i)" + DECLARATION)


def control_statements(statements: Column) -> Column:
    return F.filter(statements, lambda s: reduce(lambda x, y: x | y, [_fits(s, t) for t in CONTROL]))


def kinds(statements: Column) -> Column:
    """Sorted distinct kinds of statements."""
    return F.array_sort(F.array_distinct(F.transform(statements, lambda s: _first([(k, _fits(s, t)) for k, t in KINDS], "other_statement"))))


def shape(statements: Column) -> Column:
    """Counts of ifs, elses, endifs, choose markers and gotos."""
    count = lambda tests: F.size(F.filter(statements, lambda s: reduce(lambda x, y: x | y, [_fits(s, t) for t in tests])))
    return F.struct(*[count(tests).alias(n) for n, tests in SHAPE])


def old_family(mnemonic: Column, reason: Column) -> Column:
    """The older, coarser families of gaps."""
    dependent = ("dependent_stack_or_context_failure", (("reason", "semantic rule not implemented", False),))
    return _class([dependent, *[(f, (("mnemonic", p, True),)) for f, p in OLD_FAMILIES]], {"mnemonic": mnemonic, "reason": reason}, "other_direct_semantic_gap")


def loose_body(statements: Column) -> Column:
    """A cruder canonical form: conditions lose every parenthesis, return and destroy their outer ones,
    inline ifs become blocks and grouped declarations single ones. Only for older figures."""
    types = "|".join(sorted(DECLARED, key=len, reverse=True))
    inline, grouped = r"^if(.+)then(.+)$", rf"^({types})([a-z_][a-z0-9_]*(?:,[a-z_][a-z0-9_]*)+)$"

    def expand(s: Column) -> Column:
        names = F.transform(F.split(F.regexp_extract(s, grouped, 2), ","), lambda n: F.concat(F.regexp_extract(s, grouped, 1), n))
        block = F.array(F.concat(F.lit("if"), F.regexp_extract(s, inline, 1), F.lit("then")), F.regexp_extract(s, inline, 2), F.lit("endif"))
        return F.when(s.rlike(inline), block).when(s.rlike(grouped), names).otherwise(F.array(s))

    def plain(s: Column) -> Column:
        return F.when(s.rlike(r"^if.*then$"), F.translate(s, "()", "")).otherwise(F.regexp_replace(s, r"^(return|destroy)\((.*)\)$", "$1$2"))

    return F.transform(F.flatten(F.transform(statements, expand)), plain)


def first_difference(source: Column, rebuilt: Column) -> Column:
    """The index of the first statement that differs, or the length of the shorter."""
    shorter = F.least(F.size(source), F.size(rebuilt))
    at = F.array_position(F.zip_with(F.slice(source, F.lit(1), shorter), F.slice(rebuilt, F.lit(1), shorter), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at > 0, at.cast("int") - 1).otherwise(shorter)


def _sizes() -> Column:
    return F.concat_ws(" ", F.size("source_only"), F.size("rebuilt_only"))


def first_family(rows: DataFrame) -> Column:
    """The class of the first statements that differ."""
    at = first_difference(F.col("source"), F.col("rebuilt"))
    own = {side: F.when(at < F.size(side), F.get(side, at)) for side in ("source", "rebuilt")}
    fields = own | {
        "rebuilt_only": F.array_join("rebuilt_only", " || "),
        "every_rebuilt": F.array_join("rebuilt", " || "),
        "sizes": _sizes(),
        "sides": F.when(own["source"].isNotNull() & own["rebuilt"].isNotNull(), "both").otherwise("one"),
    }
    return _class(FIRST_FAMILIES, fields, "other_statement_mapping")


def analyse(rows: DataFrame) -> DataFrame:
    """rows with first_family, kinds (of what differs), residual (control structures differ), primary
    family, root cause, and blocker (what is left if both loose forms are equal or not)."""
    source, rebuilt = shape(F.col("source")), shape(F.col("rebuilt"))
    unlike = reduce(lambda x, y: x | y, [source[n] != rebuilt[n] for n, _ in SHAPE if n != "gotos"])
    out = rows.withColumns({"first_family": first_family(rows), "kinds": kinds(F.concat("source_only", "rebuilt_only")), "same_loose": loose_body(F.col("source")) == loose_body(F.col("rebuilt")), "residual": unlike | (rebuilt["gotos"] > 0)})
    has = lambda k: F.array_contains("kinds", k)
    only = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0)))
    mixed = _first([(name, has(kind)) for kind, name in MIXED], "mixed_or_other")
    out = out.withColumn("primary_family", _first([("residual_control_flow", F.col("residual")), ("condition_expression", has("condition_expression"))], F.coalesce(only, mixed)))
    joined = {c: F.array_join(c, " || ") for c in ("source_only", "rebuilt_only")}
    fields = joined | {"sizes": _sizes(), "residual": F.col("residual"), "source_lines": F.array_join("source_only", "\n"), "primary_family": F.col("primary_family")}
    out = out.withColumn("root_cause", _class(ROOT_CAUSES, fields, "unclassified"))
    return out.withColumn("blocker", _class(BLOCKERS, joined | {"same_loose": F.col("same_loose"), "root_cause": F.col("root_cause")}, F.col("root_cause")))


def counts(analysed: DataFrame, column: str) -> DataFrame:
    """Rows per class, most first; kinds are counted one by one."""
    value = F.explode(column) if dict(analysed.dtypes)[column].startswith("array") else F.col(column)
    return analysed.select(value.alias("family")).groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


def examples(analysed: DataFrame, family: str, corpus: str, order: list[str], n: int = 3) -> DataFrame:
    """Per class: rows, corpora, and the first examples by `order`."""
    from quern.operators.relational import top_per_group

    some = top_per_group(analysed, [family], [F.asc(c) for c in order], n).groupBy(family).agg(F.array_sort(F.collect_list(F.struct("rank", *order))).alias("examples"))
    return analysed.groupBy(family).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(corpus)).alias("corpora")).join(some, family).orderBy(F.desc("n"), family)


def opportunities(mismatched: DataFrame, previous: DataFrame) -> DataFrame:
    """Functions (corpus, entry, signature) of `mismatched` with exactly one function of that name in the
    previous generation, which was not complete: these are new candidates."""
    key = ["corpus", "entry", "signature"]
    one = previous.groupBy(*key).agg(F.count("*").alias("_n"), F.bool_or("complete").alias("_c")).where("_n = 1 AND NOT _c").drop("_n", "_c")
    return mismatched.join(one, key, "left_semi")


def search(rows: DataFrame, text: str = "", **equal) -> DataFrame:
    """Rows with these column values, where the text (in any case) is in one of the string columns."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    strings = [c for c, t in rows.dtypes if t == "string"]
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *strings)), F.lit(text.lower()))) if text else rows


def identifiers(properties: DataFrame, globals_: DataFrame, locals_: DataFrame, parameters: DataFrame) -> DataFrame:
    """(function, name, type_name, shadows) of all names that a function sees: the later source's type holds;
    a name shadows constants if any source says it is a parameter or no constant. Rows have function,
    name, type_name, is_constant."""
    sources = [df.select("function", F.lower("name").alias("name"), "type_name", F.col("is_constant"), F.lit(i).alias("at")) for i, df in enumerate((properties, globals_, locals_, parameters))]
    every = reduce(DataFrame.unionByName, sources).where("name <> ''")
    shadows = F.bool_or((F.col("at") == 3) | ~F.coalesce("is_constant", F.lit(False)))
    return every.groupBy("function", "name").agg(F.max_by("type_name", F.struct("at", "type_name")).alias("type_name"), shadows.alias("shadows"))


def unambiguous(constants: DataFrame) -> DataFrame:
    """Constants (owner, type_ref, name, value) with whether their value names only them, by owner (in any
    ASCII case) and type."""
    from quern.operators.relational import ascii_lower

    keyed = constants.withColumn("_owner", ascii_lower("owner"))
    many = keyed.groupBy("_owner", "type_ref", "value").agg(F.count_distinct("name").alias("_n"))
    return keyed.join(many, ["_owner", "type_ref", "value"]).withColumn("unique", F.col("_n") == 1).drop("_owner", "_n")


def intervals_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether half-open intervals share a point."""
    return (a_start < b_end) & (b_start < a_end)
