"""Source text, comparison, reports and streams."""

import json
import random

import pytest

from quern.functions import source_text as s
from quern.operators import compare, gaps
from quern.sources import reports
from quern.streaming import events

SOURCE = """forward prototypes
public function integer of_a ();
end prototypes
type variables
public function integer of_a (int ai_x, readonly string as_y);// say ; 'it'
long ll_a, ll_b
IF ( ai_x > 1 ) THEN RETURN (ai_x)
ls = "A ~" B" + & // more
  'c;d'
return
end function
event clicked;call super::clicked
end event
on w_main.create
this.x = 1
end on
public subroutine of_lost (long al)
;x = 1
"""


def test_routines():
    found = s.source_routines(SOURCE, "a.sru")
    assert [(r["name"], r["parameter_types"], r["source_reference"]) for r in found] == [("of_a", ["integer", "string"], "a.sru:5"), ("clicked", [], "a.sru:12"), ("create", [], "a.sru:14")]
    assert found[0]["body"] == ["longll_a,ll_b", "if(ai_x>1)thenreturn(ai_x)", "ls=\"a ~\" b\"+'c;d'"]
    assert found[2]["body"] == ["x=1"]
    assert s.canonical_body(found[0]["body"]) == ["longll_a", "longll_b", "ifai_x>1then", "returnai_x", "endif", 'ls="a ~" b"+"c;d"']


@pytest.mark.parametrize(
    ("condition", "stripped"),
    [("(a=1)", "a=1"), ("(a=1)and(b=2)", "a=1andb=2"), ("(a=1orb=2)andc=3", "(a=1orb=2)andc=3"), ("(a=1andb=2)andc=3", "a=1andb=2andc=3"), ("f(x)=1", "f(x)=1"), ("(a)", "(a)"), ("x=')('and(b=2)", "x=')('andb=2")],
)
def test_groups(condition, stripped):
    assert s.strip_groups(condition) == stripped


def test_text_pieces():
    assert s.strip_comments("a /* b\nc */ d // e\n'//f'") == "a \n d \n'//f'"
    assert s.split_statements("a;'b;c'\r\n;d") == ["a", "'b;c'", "d"] and s.split_statements("") == []
    assert s.normalise_statement("This.X = 'THIS. ~T' + Int(y)") == "x=' ~T'+integer(y)"
    assert s.routine_identity("event type string pfc_value(int a)") == ("pfc_value", ["integer"]) and s.routine_identity("nothing") is None
    assert s.parameter_types("f(ref)") is None and s.parameter_types("f()") == []
    values = {"n_c.max": "20", ".all": "1", "n_c.all": "2"}
    assert s.symbol_body(["x=max+n_c.max+all+max(1)+'max'"], values, {"all"}, {}, "n_c") == (["x=20+20+all+max(1)+'max'"], 2)
    assert s.symbol_body(["inv.max"], values, set(), {"inv": "n_c"}) == (["20"], 1)
    assert [s.constant_literal(v) for v in ({"kind": "signed", "i": -1}, {"kind": "boolean", "i": 0}, {"kind": "string", "s": "Ab"}, {"kind": "string", "s": "a~"}, {"kind": "character", "i": 1})] == ["-1", "false", '"ab"', None, None]
    assert s.alignment(list("abcd"), list("bxd")) == (["a", "c"], ["x"], 2)


def table_alignment(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = matched = 0
    left, right = [], []
    while i < n and j < m:
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            left.append(a[i])
            i += 1
        else:
            right.append(b[j])
            j += 1
    return left + a[i:], right + b[j:], matched


def test_alignment_is_that_of_the_whole_table():
    rng = random.Random(5)
    for k in range(400):
        a, b = ([rng.choice("abcdefgh"[: 1 + k % 8]) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        if k % 3 == 0:
            b = [x for x in a if rng.random() < 0.8] + b[:3]
        assert s.alignment(a, b) == table_alignment(a, b)
    long = [str(rng.randrange(500)) for _ in range(20_000)]
    other = [x for x in long if rng.random() < 0.95]
    left, right, matched = s.alignment(long, other)
    assert matched == len(other) and len(left) == len(long) - matched and not right


def test_comparison(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "W_MAIN.SRW").write_text(SOURCE + "event clicked;beep(1)\nend event\n")
    (tmp_path / "notes.txt").write_text("event x;\nend event")
    known = compare.routines(compare.read_sources(spark, str(tmp_path)))
    assert known.count() == 4
    rows = [
        (1, "w_main.win", "event clicked()", ["call super::clicked"], True),
        (2, "w_main.win", "event clicked()", ["beep(2)"], True),
        (3, "w_main.win", "event clicked()", ["beep(1)"], True),
        (4, "w_other.win", "event clicked()", [], True),
        (5, "W_MAIN.win", "public function integer of_a(integer a, string b)", ["long ll_a", "long ll_b", "if ai_x > 1 then", "return ai_x", "end if", "ls = \"A ~\" B\" + \"c;d\""], True),
        (6, "w_main.win", "public function integer of_a(long a)", [], True),
        (7, "w_main.win", "on create()", ["x = 1"], False),
        (8, "w_main.win", "event create()", ["x = 1"], False),
    ]
    previews = spark.createDataFrame(rows, "k long, entry_name string, signature string, statements array<string>, complete boolean")
    found = {r.k: (r.result, r.basis) for r in compare.compare(previews, known, ["k"], ["k"]).collect()}
    assert found[1] == ("verified", "normalized_equality") and found[2][0] == "normalized_body_mismatch" and found[3][0] == "ambiguous_source_routine"
    assert found[4][0] == "source_file_not_found" and found[5] == ("verified", "safe_semantic_canonicalization") and found[6][0] == "source_routine_not_found" and found[7][0] == "source_routine_not_found"
    assert found[8][0] == "semantic_rules_incomplete"
    manifest = spark.createDataFrame([("o2", "W_main.win", "EVENT clicked()", ["beep (1)"]), ("o1", "w_main.win", "event clicked()", ["BEEP(1)"])], "oracle_id string, entry_name string, signature string, fragments array<string>")
    held = {r.k: (r.oracle_id, r.verified) for r in compare.oracle_constructs(previews, manifest, ["k"]).collect()}
    assert held == {1: ("o1", False), 2: ("o1", False), 3: ("o1", True)}
    pairs = spark.createDataFrame([(1, ["a", "b"], None)], "k long, a array<string>, b array<string>")
    assert compare.differences(pairs, ["k"], "a", "b").first().only_a == ["a", "b"]


def gap(offset, mnemonic, reason=reports.NO_RULE, opcode=1):
    return {"offset": offset, "opcode": opcode, "mnemonic": mnemonic, "reason": reason}


def report(*functions):
    regions = [{"region_index": i, "scan": {"instructions": [{"offset": 0, "opcode": 1, "mnemonic": "X"}] * 4}, "semantic_preview": None if f is None else {"signature": f"f{i}", "unresolved": f, "evidence": {"semantic_rules_complete": not f, "function_reconstruction": "not_assessed" if f else "verified", "function_comparison": None if f else {"verification_basis": "normalized_equality", "result": "verified"}}}} for i, f in enumerate(functions)]
    return {"entries": [{"index": 0, "name": "w.win", "pcode_regions": regions}]}


def test_reports(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for place in (old, new):
        place.mkdir()
    context = "member stack is empty"
    (old / "r.json").write_text(json.dumps(report([gap(8, "INCR_X"), gap(2, "MOD_INT")], [gap(1, "MOD_LONG", opcode=2), gap(2, "X", context)], [], None, [gap(3, "Y", "unknown enum constant 1:2")])))
    (new / "r.json").write_text(json.dumps(report([], [gap(1, "MOD_LONG", opcode=2)], [gap(0, "INT")], None)))
    a, b = (reports.read_reports(spark, str(p), "c") for p in (old, new))
    assert gaps.summary(a).first().asDict() | {} == {"functions": 4, "complete_functions": 1, "instructions": 16, "unresolved": 5, "coverage": 68.75, "verified": 1, "normalized_equality": 1, "safe_semantic_canonicalization": 0, "compiled_symbol_equivalence": 0}
    assert gaps.summary(a.where("function = ''")).first().coverage == 100.0
    ga, gb = reports.gaps(a), reports.gaps(b)
    rows = {r.family: r for r in gaps.families(ga).collect()}
    assert (rows["modulo_operations"].occurrences, rows["modulo_operations"].functions, rows["modulo_operations"].first_functions, rows["modulo_operations"].sole_functions, rows["modulo_operations"].other_failures_sole) == (2, 2, 2, 1, 1)
    assert rows["increment_operations"].sole_functions == 0 and rows["artifact_or_metadata_resolution_gap"].first_direct_functions == 0
    assert [(r.profile, r.functions) for r in gaps.profiles(ga).collect()] == [("artifact_or_metadata_resolution_gap", 1)]
    assert gaps.opcodes(ga).first().examples[0].function == "c|0|0" or gaps.opcodes(ga).count() == 5
    assert {(r.family, r.known_rows, r.known_functions) for r in gaps.known_overlap(gb, ga).collect()} == {("modulo_operations", 1, 1), ("int_intrinsic", 0, 0)}
    moves = {r.function: r for r in gaps.generations(a, b).collect()}
    assert moves["c|0|0"].completeness == "promotion" and moves["c|0|2"].verification == "regression" and not moves["c|0|4"].in_new
    changes = sorted((r.change, r.cause or "", r.mnemonic) for r in gaps.gap_changes(ga, gb, [1]).collect())
    assert ("added", "", "INT") in changes and ("gone", "direct", "INCR_X") in changes
    assert gaps.comparison_histogram(a).count() == 2
    flat = spark.createDataFrame([("l", 0, 0, 4, 2, "B"), ("l", 0, 0, 0, 1, "A"), ("l", 1, 0, 0, 1, "A")], "library string, entry_index int, region_index int, offset long, opcode int, mnemonic string")
    nested = gaps.nested_report(flat).orderBy("index").collect()
    assert [[i.mnemonic for i in r.instructions] for e in nested for r in e.regions] == [["A", "B"], ["A"]] and [e["index"] for e in nested] == [0, 1]
    kinds = spark.sql("SELECT array('if a then', 'goto L_1', 'end if') AS s").select(gaps.statement_kinds("s").alias("k")).first().k
    assert (kinds.ifs, kinds.endifs, kinds.gotos) == (1, 1, 1)


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp_seconds(id * 1800) AS ts, concat('t', id % 3) AS event_type FROM range(20)")
    for i in range(2):
        rows.where(f"id % 2 = {i}").write.parquet(str(tmp_path / "in" / str(i)))
    source = events.read_events(spark, str(tmp_path / "in" / "*"), "id long, ts timestamp, event_type string")
    query = events.totals(source).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("totals").collect()} == {tuple(r) for r in events.totals(rows).collect()}
    assert events.windows(rows).agg({"n": "sum"}).first()[0] == 20
    assert {r.event_type: r.id for r in events.latest(rows, "event_type", "ts", ["id"]).collect()} == {"t0": 18, "t1": 19, "t2": 17}
