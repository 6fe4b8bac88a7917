"""The report operators bound to the driver's tables, each with the same query in SQL.

Order lines stand for gaps (a line is an open instruction of the function that is its order), orders for functions,
parts for catalogue entries. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import compare as C
from quern.operators import gaps as G
from quern.operators import mismatches as M
from quern.plans.queries import _t, registry

QUERIES, ORACLE_SQL, bound = registry()

_GAPS = "SELECT l_orderkey AS fn, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS off, (l_quantity::INT % 6)::INT AS opcode, 'OP_' || (l_quantity::INT % 6) AS mnemonic, l_linestatus AS kind, l_returnflag AS family, l_returnflag <> 'N' AS direct, 'c' || (l_suppkey % 3) AS corpus FROM lineitem"


def _offset() -> Column:
    """A place that no other line of the order has."""
    return F.col("l_linenumber") * F.lit(1_000_000_000_000) + F.col("l_partkey") * 100_000 + F.col("l_suppkey")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    opcode = F.col("l_quantity").cast("int") % 6
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("function"), _offset().alias("offset"), opcode.alias("opcode"), F.concat(F.lit("OP_"), opcode).alias("mnemonic"), F.col("l_linestatus").alias("kind"),
        F.col("l_linestatus").alias("reason"), F.col("l_returnflag").alias("family"), (F.col("l_returnflag") != "N").alias("direct"), F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("corpus"),
    )


@bound(f"""WITH g AS ({_GAPS}), per AS (SELECT fn, family, count(*) AS n, any_value(direct) AS d FROM g GROUP BY ALL),
    whole AS (SELECT fn, sum(n) AS every, count(*) FILTER (d) AS nd FROM per GROUP BY fn),
    f AS (SELECT family, count(*) AS c FROM (SELECT family, row_number() OVER (PARTITION BY fn ORDER BY off, opcode) AS r FROM g) WHERE r = 1 GROUP BY 1),
    fd AS (SELECT family, count(*) AS c FROM (SELECT family, row_number() OVER (PARTITION BY fn ORDER BY off, opcode) AS r FROM g WHERE direct) WHERE r = 1 GROUP BY 1),
    cs AS (SELECT family, string_agg(DISTINCT corpus, ',' ORDER BY corpus) AS corpora FROM g GROUP BY 1)
    SELECT family, sum(n)::BIGINT AS occurrences, count(*) AS functions, sum(every - n)::BIGINT AS other_failures, count(*) FILTER (d AND nd = 1) AS sole_functions,
        coalesce(sum(every - n) FILTER (d AND nd = 1), 0)::BIGINT AS other_failures_sole, any_value(corpora) AS corpora, coalesce(any_value(f.c), 0) AS first_functions, coalesce(any_value(fd.c), 0) AS first_direct_functions
    FROM per JOIN whole USING (fn) JOIN cs USING (family) LEFT JOIN f USING (family) LEFT JOIN fd USING (family) GROUP BY family""")
def gap_families(spark, sf_dir):
    return G.families(_gaps(spark, sf_dir)).withColumn("corpora", F.array_join("corpora", ","))


@bound(f"""WITH g AS ({_GAPS}), r AS (SELECT opcode, mnemonic, kind, fn, off, row_number() OVER (PARTITION BY opcode, mnemonic, kind ORDER BY fn, off) AS r FROM g)
    SELECT g.opcode, g.mnemonic, g.kind AS reason, min(family) AS family, count(*) AS occurrences, count(DISTINCT fn) AS functions,
        (SELECT string_agg(r.fn || ':' || r.off, ' ' ORDER BY r.r) FROM r WHERE r.r <= 3 AND r.opcode = g.opcode AND r.kind = g.kind) AS examples FROM g GROUP BY ALL""")
def gap_opcodes(spark, sf_dir):
    found = G.opcodes(_gaps(spark, sf_dir))
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["function"], x["offset"])), " "))


@bound(f"""WITH g AS ({_GAPS}), s AS (SELECT fn, bool_or(direct) AS d, string_agg(DISTINCT kind, '+' ORDER BY kind) AS profile FROM g GROUP BY fn)
    SELECT profile, count(*) AS functions FROM s WHERE NOT d GROUP BY profile""")
def gap_profiles(spark, sf_dir):
    return G.profiles(_gaps(spark, sf_dir))


@bound(f"""WITH g AS ({_GAPS}), p AS (SELECT DISTINCT family, opcode, mnemonic FROM g), k AS (SELECT (o_orderkey % 9)::INT AS opcode, 'OP_' || (o_orderkey % 9) AS mnemonic, o_custkey AS fn FROM orders)
    SELECT family, count(k.fn) AS known_rows, count(DISTINCT k.fn) AS known_functions FROM p LEFT JOIN k USING (opcode, mnemonic) GROUP BY family""")
def gap_known_overlap(spark, sf_dir):
    code = (F.col("o_orderkey") % 9).cast("int")
    known = _t(spark, sf_dir, "orders").select(code.alias("opcode"), F.concat(F.lit("OP_"), code).alias("mnemonic"), F.col("o_custkey").alias("function"))
    return G.known_overlap(_gaps(spark, sf_dir), known)


@bound("""WITH a AS (SELECT l_orderkey AS function, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS "offset", (l_quantity::INT % 6)::INT AS opcode, l_returnflag AS mnemonic, l_linestatus AS reason, l_tax > 0.04 AS same FROM lineitem)
    SELECT function, "offset", opcode, mnemonic, reason, 'gone' AS change, CASE WHEN opcode IN (1, 3) THEN 'direct' ELSE 'cascade' END AS cause FROM a WHERE NOT same
    UNION ALL SELECT function, "offset", opcode, 'X', reason, 'added', NULL FROM a WHERE NOT same""")
def gap_changes(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("function"), _offset().alias("offset"), (F.col("l_quantity").cast("int") % 6).alias("opcode"), F.col("l_returnflag").alias("mnemonic"), F.col("l_linestatus").alias("reason"), "l_tax")
    return G.gap_changes(rows, rows.withColumn("mnemonic", F.when(F.col("l_tax") > 0.04, F.col("mnemonic")).otherwise("X")), [1, 3])


@bound("""WITH o AS (SELECT o_custkey AS function, bool_or(o_orderstatus = 'F') AS c, bool_and(o_orderstatus <> 'O') AS v FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY 1),
    n AS (SELECT o_custkey AS function, bool_or(o_orderstatus = 'F') AS c, bool_and(o_orderstatus <> 'O') AS v FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1)
    SELECT function, o.c IS NOT NULL AS in_old, n.c IS NOT NULL AS in_new, CASE WHEN NOT o.c AND n.c THEN 'promotion' WHEN o.c AND NOT n.c THEN 'regression' END AS completeness,
        CASE WHEN NOT o.v AND n.v THEN 'promotion' WHEN o.v AND NOT n.v THEN 'regression' END AS verification FROM o FULL JOIN n USING (function)""")
def report_generations(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    verified = F.when(F.bool_and(F.col("o_orderstatus") != "O"), "verified").otherwise("not_assessed")
    half = lambda k: orders.where(F.year("o_orderdate") % 2 == k).groupBy(F.col("o_custkey").alias("function")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("complete"), verified.alias("verification"))
    return G.generations(half(0), half(1))


_FUNCTIONS = """SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, count(l_linenumber) AS n, count(l_linenumber) FILTER (l_linestatus = 'O') AS open FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("unresolved"))
    both = _t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    basis = F.when(F.col("o_orderpriority") < "2", "normalized_equality").when(F.col("o_orderpriority") < "3", "safe_semantic_canonicalization").when(F.col("o_orderpriority") < "4", "compiled_symbol_equivalence")
    verification = F.when(F.col("o_orderstatus") == "F", "verified").otherwise("mismatch")
    return both.select(F.coalesce("n", F.lit(0)).alias("n_instructions"), F.coalesce("unresolved", F.array().cast("array<int>")).alias("unresolved"), (F.coalesce(F.size("unresolved"), F.lit(0)) == 0).alias("complete"), verification.alias("verification"), basis.alias("basis"), F.col("o_orderstatus").alias("result"))


@bound(f"""WITH f AS ({_FUNCTIONS})
    SELECT count(*) AS functions, count(*) FILTER (open = 0) AS complete_functions, sum(n)::BIGINT AS instructions, sum(open)::BIGINT AS unresolved, round((sum(n) - sum(open)) * 100.0 / sum(n), 3)::DOUBLE AS coverage, count(*) FILTER (status = 'F') AS verified,
        count(*) FILTER (priority < '2') AS normalized_equality, count(*) FILTER (priority >= '2' AND priority < '3') AS safe_semantic_canonicalization, count(*) FILTER (priority >= '3' AND priority < '4') AS compiled_symbol_equivalence FROM f""")
def report_summary(spark, sf_dir):
    return G.summary(_functions(spark, sf_dir))


@bound("""SELECT o_orderstatus AS result, CASE WHEN o_orderpriority < '2' THEN 'normalized_equality' WHEN o_orderpriority < '3' THEN 'safe_semantic_canonicalization' WHEN o_orderpriority < '4' THEN 'compiled_symbol_equivalence' END AS basis, count(*) AS functions FROM orders GROUP BY ALL""")
def comparison_histogram(spark, sf_dir):
    return G.comparison_histogram(_functions(spark, sf_dir))


@bound("""SELECT 'lib' || (l_suppkey % 50) AS library, count(DISTINCT l_orderkey) AS entries, count(DISTINCT (l_orderkey, l_linestatus)) AS regions, count(*) AS instructions, min(l_orderkey) AS first_entry,
    arg_min(l_linenumber, (l_orderkey, l_linestatus, l_linenumber))::BIGINT AS first_offset FROM lineitem GROUP BY 1""")
def nested_report(spark, sf_dir):
    """Instructions nested to libraries, entries and regions, and read from there again."""
    lines = _t(spark, sf_dir, "lineitem")
    flat = lines.select(F.concat(F.lit("lib"), F.col("l_suppkey") % 50).alias("library"), F.col("l_orderkey").alias("entry_index"), F.col("l_linestatus").alias("region_index"), F.col("l_linenumber").cast("long").alias("offset"), F.lit(1).alias("opcode"), F.col("l_returnflag").alias("mnemonic"))
    entries = G.nested_report(flat)
    sizes = F.aggregate("regions", F.lit(0).cast("long"), lambda n, r: n + F.size(r["instructions"]))
    first = F.get(F.get("regions", F.lit(0))["instructions"], F.lit(0))["offset"]
    return entries.groupBy("library").agg(F.count("*").alias("entries"), F.sum(F.size("regions")).alias("regions"), F.sum(sizes).alias("instructions"), F.min("index").alias("first_entry"), F.min_by(first, "index").alias("first_offset"))


#: Statements of a function, those rebuilt, and the classes that they are to get: first family, root cause, blocker.
_PAIRS = [
    (["triggerevent(this,1)"], ["triggerevent(1)"], "implicit_this_event_receiver", "unclassified", "unclassified"),
    (["a=1", "choosecasex"], ["a=1", "b=2"], "choose_case_lowering", "unclassified", "unclassified"),
    (["ifx=1theny=2"], ["ifx=1then", "y=2", "endif"], "other_control_flow_mismatch", "inline_if_vs_block_form", "resolved_by_safe_form_canonicalization"),
    (["longll_a,ll_b"], ["longll_a", "longll_b"], "array_or_grouped_declaration_form", "grouped_vs_split_declaration", "resolved_by_safe_form_canonicalization"),
    (["longll_a=0"], ["longll_a"], "source_initializer_not_preserved", "source_construct_optimized_away", "source_construct_optimized_away"),
    (["returnfailure"], ["return-1"], "compiled_symbol_resolution_boundary", "unclassified", "symbolic_constant_elided"),
    (["callsuper::x"], ["b=__get_attribute_item(c)"], "compiled_accessor_not_collapsed", "datawindow_attribute_lowering", "datawindow_attribute_lowering"),
    (["f(a)"], ["f(b)"], "call_or_receiver_mapping", "unclassified", "unclassified"),
    (["callw_a::x"], ["callsuper::x"], "ancestor_dispatch_spelling", "unclassified", "unclassified"),
    (["RETURNx+1"], ["returnx+2"], "return_expression_mapping", "unclassified", "unclassified"),
    (["x=a"], ["x=b"], "other_statement_mapping", "unclassified", "unclassified"),
]
_PAIRS_SQL = ", ".join(f"({i}, '{f}', '{r}', '{b}')" for i, (_, _, f, r, b) in enumerate(_PAIRS))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, s, r, [x for x in s if x not in r], [x for x in r if x not in s]) for i, (s, r, *_) in enumerate(_PAIRS)], "k long, source array<string>, rebuilt array<string>, source_only array<string>, rebuilt_only array<string>")
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % len(_PAIRS)).alias("k"))
    return M.analyse(parts.join(F.broadcast(rows), "k"))


@bound(f"""SELECT p_partkey, f AS first_family, r AS root_cause, b AS blocker FROM part JOIN (VALUES {_PAIRS_SQL}) AS t(k, f, r, b) ON p_partkey % {len(_PAIRS)} = k""")
def mismatch_classes(spark, sf_dir):
    return _analysed(spark, sf_dir).select("p_partkey", "first_family", "root_cause", "blocker")


@bound(f"""SELECT f AS family, count(*) AS n FROM part JOIN (VALUES {_PAIRS_SQL}) AS t(k, f, r, b) ON p_partkey % {len(_PAIRS)} = k GROUP BY f""")
def mismatch_counts(spark, sf_dir):
    return M.counts(_analysed(spark, sf_dir), "first_family")


@bound(f"""WITH a AS (SELECT r, p_brand, p_partkey, row_number() OVER (PARTITION BY r ORDER BY p_partkey) AS i FROM part JOIN (VALUES {_PAIRS_SQL}) AS t(k, f, r, b) ON p_partkey % {len(_PAIRS)} = k)
    SELECT r AS root_cause, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS corpora, string_agg(CASE WHEN i <= 3 THEN p_partkey::VARCHAR END, ',' ORDER BY i) AS examples FROM a GROUP BY r""")
def mismatch_examples(spark, sf_dir):
    found = M.examples(_analysed(spark, sf_dir), "root_cause", "p_brand", ["p_partkey"])
    return found.withColumns({"corpora": F.array_join("corpora", ","), "examples": F.array_join(F.transform("examples", lambda x: x["p_partkey"]), ",")})


_MNEMONICS = "DBOPEN ENTER_EMBEDDED POP_TRY PUSH_CONST_DEC CLASS_CALL_X ADDASSIGN_INT INT CREATE_USING PB2022_OP_0251 DUP_STACKED_LVALUE PUSH_TRY JUMP".split()


@bound(f"""WITH m AS (SELECT p_partkey, ['{"', '".join(_MNEMONICS)}'][(p_partkey % {len(_MNEMONICS)})::INT + 1] AS m, p_size % 3 = 0 AS dependent FROM part)
    SELECT p_partkey, CASE WHEN dependent THEN 'dependent_stack_or_context_failure' WHEN m IN ('DBOPEN', 'ENTER_EMBEDDED') THEN 'sql_and_embedded_sql' WHEN m = 'POP_TRY' THEN 'exception_handling' WHEN m = 'PUSH_CONST_DEC' THEN 'typed_numeric_constants'
        WHEN m = 'CLASS_CALL_X' THEN 'call_protocol' WHEN m IN ('ADDASSIGN_INT', 'INT') THEN 'numeric_and_compound_operations' WHEN m IN ('CREATE_USING', 'DUP_STACKED_LVALUE') THEN 'lvalue_array_and_creation' WHEN m = 'PB2022_OP_0251' THEN 'unknown_pb2022_opcode'
        ELSE 'other_direct_semantic_gap' END AS family FROM m""")
def older_families(spark, sf_dir):
    mnemonic = F.get(F.array(*map(F.lit, _MNEMONICS)), (F.col("p_partkey") % len(_MNEMONICS)).cast("int"))
    reason = F.when(F.col("p_size") % 3 == 0, "stack is empty").otherwise("semantic rule not implemented")
    return _t(spark, sf_dir, "part").select("p_partkey", M.old_family(mnemonic, reason).alias("family"))


_LINES = r"list_transform(string_split(lower(text), chr(10)), lambda x: regexp_replace(x, '[ \t\n\r\f\v]+', '', 'g'))"
_HITS = lambda pattern: f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{pattern}')))::INT"


@bound(f"SELECT doc_id, {_HITS('^(if|elseif).+then$')} AS ifs, {_HITS('^else$|^elseif')} AS elses, {_HITS('^endif$')} AS endifs, {_HITS('^(choosecase|case|endchoose)')} AS chooses, {_HITS('goto')} AS gotos FROM documents")
def statement_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("s")).select("doc_id", G.statement_kinds("s").alias("k")).select("doc_id", "k.*")


_KIND = r"""CASE WHEN regexp_matches(x, '^(if|elseif).+then$') THEN 'condition_expression' WHEN regexp_matches(x, '^(else|endif|choosecase|case|endchoose)|goto') THEN 'control_flow' WHEN regexp_matches(x, '^return') THEN 'return_expression'
    WHEN regexp_matches(x, '(^|=)create\b|^destroy\b') THEN 'object_lifecycle' WHEN regexp_matches(x, '=') THEN 'assignment' WHEN regexp_matches(x, '\(|\bevent\b|^call') THEN 'call_or_event'
    WHEN regexp_matches(x, '^[a-z_][a-z0-9_]*(\[\])?[a-z_][a-z0-9_]*(\[.*\])?$') THEN 'declaration' ELSE 'other_statement' END"""


@bound(f"SELECT item_id, list_aggregate(list_sort(list_distinct(list_transform(string_split(lower(text), ' '), lambda x: {_KIND}))), 'string_agg', ',') AS kinds FROM benchmark")
def statement_classes(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(M.kinds(F.split(F.lower("text"), " ")), ",").alias("kinds"))


@bound("""WITH s AS (SELECT l_suppkey AS f, lower(l_returnflag) AS name, 't' || l_linenumber AS t, l_tax > 0.02 AS c, 0 AS pos FROM lineitem UNION ALL SELECT p_size, lower(p_brand), p_type, true, 1 FROM part
        UNION ALL SELECT c_nationkey, lower(c_mktsegment), c_name, c_acctbal > 0, 2 FROM customer UNION ALL SELECT c_nationkey, 'a', c_mktsegment, true, 3 FROM customer)
    SELECT f::BIGINT AS function, name, max({'pos': pos, 't': t}).t AS type_name, bool_or(pos = 3 OR NOT c) AS shadows FROM s GROUP BY ALL""")
def identifier_types(spark, sf_dir):
    """What names a function sees: properties, globals, locals, parameters."""
    row = lambda df, f, name, kind, constant: df.select(F.col(f).cast("long").alias("function"), name.alias("name"), kind.alias("type_name"), constant.alias("is_constant"))
    customer, true = _t(spark, sf_dir, "customer"), F.lit(True)
    lines = row(_t(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag"), F.concat(F.lit("t"), F.col("l_linenumber")), F.col("l_tax") > 0.02)
    return M.identifiers(lines, row(_t(spark, sf_dir, "part"), "p_size", F.col("p_brand"), F.col("p_type"), true), row(customer, "c_nationkey", F.col("c_mktsegment"), F.col("c_name"), F.col("c_acctbal") > 0), row(customer, "c_nationkey", F.lit("A"), F.col("c_mktsegment"), true))


@bound("""SELECT p_partkey, count(DISTINCT p_name) OVER (PARTITION BY lower(p_brand), p_size, floor(p_retailprice / 100)) = 1 AS "unique" FROM part""")
def constant_uniqueness(spark, sf_dir):
    constants = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("owner"), F.col("p_size").alias("type_ref"), F.col("p_name").alias("name"), F.floor(F.col("p_retailprice") / 100).alias("value"))
    return M.unambiguous(constants).select("p_partkey", "unique")


@bound("""WITH p AS (SELECT o_orderstatus AS corpus, o_custkey, count(*) AS n, bool_or(o_totalprice > 200000) AS c FROM orders GROUP BY ALL)
    SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM p WHERE p.corpus = o_orderstatus AND p.o_custkey = orders.o_custkey AND n = 1 AND NOT c)""")
def new_candidates(spark, sf_dir):
    """Rows whose function occurs once in the previous generation, and not complete."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("corpus"), F.col("o_custkey").alias("entry"), F.lit("f").alias("signature"), (F.col("o_totalprice") > 200000).alias("complete"))
    return M.opportunities(rows, rows).select("o_orderkey")


@bound("SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND contains(lower(c_name || ' ' || c_mktsegment), 'in')")
def report_search(spark, sf_dir):
    return M.search(_t(spark, sf_dir, "customer"), "IN", c_nationkey=7).select("c_custkey")


@bound("""SELECT l_orderkey, l_linenumber, name FROM lineitem, (VALUES ('code', 1, 11), ('data', 10, 20), ('rest', 20, 51)) AS s(name, lo, hi) WHERE l_quantity < hi AND lo < l_quantity + l_linenumber""")
def section_overlap(spark, sf_dir):
    """Half-open spans and the sections that they share a point with: three rows of sections."""
    sections = spark.sql("SELECT * FROM VALUES ('code', 1, 11), ('data', 10, 20), ('rest', 20, 51) AS s(name, lo, hi)")
    lines = _t(spark, sf_dir, "lineitem")
    return lines.join(F.broadcast(sections), M.intervals_overlap(F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber"), F.col("lo"), F.col("hi"))).select("l_orderkey", "l_linenumber", "name")


@bound("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 3 THEN 'source_file_not_found' WHEN 4 THEN 'semantic_rules_incomplete' WHEN 2 THEN 'normalized_body_mismatch' ELSE 'verified' END AS result,
    CASE s_suppkey % 5 WHEN 0 THEN 'normalized_equality' WHEN 1 THEN 'safe_semantic_canonicalization' END AS basis FROM supplier""")
def source_comparison(spark, sf_dir):
    """Previews against known source: equal, equal in canonical form, unlike, without a file, incomplete."""
    key = F.col("s_suppkey")
    own = _t(spark, sf_dir, "supplier").withColumns({"k": key % 5, "object": F.concat(F.lit("s"), key)})
    inline, block = ["event clicked;if a > 1 then beep(1)", "end event", ""], ["if a > 1 then", "beep(1)", "end if"]
    text = F.when(F.col("k") == 1, "\n".join(inline)).otherwise("event clicked;beep(1)\nend event\n")
    sources = own.where("k <> 3").select("object", F.concat("object", F.lit(".srw")).alias("path"), text.alias("text"))
    statements = F.when(F.col("k") == 1, F.array(*map(F.lit, block))).when(F.col("k") == 2, F.array(F.lit("beep(2)"))).otherwise(F.array(F.lit("beep(1)")))
    previews = own.select("s_suppkey", F.concat("object", F.lit(".win")).alias("entry_name"), F.lit("event clicked()").alias("signature"), statements.alias("statements"), (F.col("k") != 4).alias("complete"))
    return C.compare(previews, C.routines(sources), ["s_suppkey"], ["s_suppkey"]).select("s_suppkey", "result", "basis")


@bound("""SELECT s_suppkey, 'o' || (s_suppkey % 3) AS oracle_id, s_suppkey % 2 = 0 AS verified FROM supplier WHERE s_suppkey % 3 <> 2""")
def construct_oracle(spark, sf_dir):
    """Previews that a manifest names, and whether they hold its fragments; white space in strings counts."""
    key = F.col("s_suppkey")
    statements = F.array(F.when(key % 2 == 0, 'Beep( "a b" )').otherwise('Beep( "ab" )'))
    previews = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), key % 3).alias("entry_name"), F.lit("event CLICKED()").alias("signature"), statements.alias("statements"))
    manifest = spark.createDataFrame([(f"o{i}", f"s{i}", "event clicked()", ['beep("a b")']) for i in (0, 1)] + [("o9", "s0", "event clicked()", ["x"])], "oracle_id string, entry_name string, signature string, fragments array<string>")
    return C.oracle_constructs(previews, manifest, ["s_suppkey"])
