"""Classes of differing functions."""

import pytest
from pyspark.sql import functions as F

from quern.operators import mismatches as m

SCHEMA = "k long, source array<string>, rebuilt array<string>, source_only array<string>, rebuilt_only array<string>"
CASES = [
    (["triggerevent(this,1)"], ["triggerevent(1)"], "implicit_this_event_receiver", "unclassified"),
    (["a=1", "choosecasex"], ["a=1", "b=2"], "choose_case_lowering", "unclassified"),
    (["ifx=1theny=2"], ["ifx=1then", "y=2", "endif"], "other_control_flow_mismatch", "inline_if_vs_block_form"),
    (["longll_a,ll_b"], ["longll_a", "longll_b"], "array_or_grouped_declaration_form", "grouped_vs_split_declaration"),
    (["longll_a=0"], ["longll_a"], "source_initializer_not_preserved", "source_construct_optimized_away"),
    (["returnfailure"], ["return-1"], "compiled_symbol_resolution_boundary", "unclassified"),
    (["a=1"], ["a=1", "b=2"], "extra_or_missing_statement", "unclassified"),
    (["returnx+1"], ["returnx+2"], "return_expression_mapping", "unclassified"),
    (["f(a)"], ["f(b)"], "call_or_receiver_mapping", "unclassified"),
    (["x=a"], ["x=b"], "other_statement_mapping", "unclassified"),
]


def test_families(spark):
    rows = [(i, s, r, [x for x in s if x not in r], [x for x in r if x not in s]) for i, (s, r, _, _) in enumerate(CASES)]
    found = {r.k: r for r in m.analyse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(found[i].first_family, found[i].root_cause) for i in range(len(CASES))] == [(f, c) for _, _, f, c in CASES]
    assert found[2].residual and found[2].blocker == found[3].blocker == "resolved_by_safe_form_canonicalization"
    assert found[5].blocker == "symbolic_constant_elided" and found[9].primary_family == "assignment"


def test_statements(spark):
    row = spark.sql("SELECT array('if(a=1)and(b)then', 'return(x)', 'x=createn_y', 'else', 'gotol1', 'choosecasex', 'endif') AS s")
    out = row.select(m.kinds(F.col("s")).alias("k"), m.shape(F.col("s")).alias("c"), m.loose_body(F.col("s")).alias("l"), m.control_statements(F.col("s")).alias("x")).first()
    assert out.k == ["condition_expression", "control_flow", "object_lifecycle", "return_expression"] or out.k == ["assignment", "condition_expression", "control_flow", "return_expression"]
    assert tuple(out.c) == (1, 1, 1, 1, 1) and out.l[:2] == ["ifa=1andbthen", "returnx"] and len(out.x) == 4


@pytest.mark.parametrize(("mnemonic", "family"), [("DBOPEN", "sql_and_embedded_sql"), ("INT", "numeric_and_compound_operations"), ("POP_TRY", "exception_handling"), ("X", "other_direct_semantic_gap")])
def test_old_families(spark, mnemonic, family):
    row = spark.sql(f"SELECT '{mnemonic}' AS m, 'semantic rule not implemented' AS r, 'stack is empty' AS q")
    assert tuple(row.select(m.old_family(F.col("m"), F.col("r")), m.old_family(F.col("m"), F.col("q"))).first()) == (family, "dependent_stack_or_context_failure")


def test_lookups(spark):
    names = lambda rows: spark.createDataFrame(rows, "function string, name string, type_name string, is_constant boolean")
    found = {r.name: (r.type_name, r.shadows) for r in m.identifiers(names([("f", "A", "long", True)]), names([("f", "b", "long", True)]), names([("f", "a", "string", True)]), names([("f", "c", "any", True)])).collect()}
    assert found == {"a": ("string", False), "b": ("long", False), "c": ("any", True)}
    constants = spark.createDataFrame([("N_C", 2, "x", 20), ("n_c", 2, "y", 20), ("n_c", 1, "z", 20)], "owner string, type_ref int, name string, value long")
    assert {r.name: r.unique for r in m.unambiguous(constants).collect()} == {"x": False, "y": False, "z": True}
    rows = spark.createDataFrame([("c", "e", "s", "Hello")], "corpus string, entry string, signature string, note string")
    assert m.search(rows, "HELL", corpus="c").count() == 1 and m.search(rows, "x").count() == 0 and m.search(rows, corpus="d").count() == 0
    previous = spark.createDataFrame([("c", "e", "s", False)], "corpus string, entry string, signature string, complete boolean")
    assert m.opportunities(rows, previous).count() == 1 and m.opportunities(rows, previous.union(previous)).count() == 0
    assert [(r.family, r.n) for r in m.counts(spark.sql("SELECT array('a', 'b') AS k UNION ALL SELECT array('a')"), "k").collect()] == [("a", 2), ("b", 1)]
    assert m.examples(rows, "note", "corpus", ["signature"]).first().corpora == ["c"]
    assert [bool(x) for x in spark.range(1).select(m.intervals_overlap(*map(F.lit, (0, 4, 4, 5))), m.intervals_overlap(*map(F.lit, (0, 5, 4, 5)))).first()] == [False, True]
