"""The relational operators bound to the driver's tables, each with the same query in SQL.

A binding shows an operator's shape on data at hand; the operators' own inputs are decode reports and
catalogues (quern.sources, quern.operators). Ties are broken by keys, doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.streaming.events import totals


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry():
    """(queries, their SQL, a decorator that adds a query with its SQL)."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sqls: dict[str, str] = {}

    def bound(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return queries, sqls, bound


QUERIES, ORACLE_SQL, bound = registry()


@bound("""
    WITH d AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    per AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
    sole AS (SELECT user_id, min(event_type) AS event_type FROM per GROUP BY user_id HAVING count(*) = 1)
    SELECT event_type AS family, sum(c)::BIGINT AS occurrences, count(*) AS functions,
        coalesce((SELECT count(*) FROM d WHERE n = 1 AND d.event_type = per.event_type), 0) AS first_functions,
        coalesce((SELECT count(*) FROM sole WHERE sole.event_type = per.event_type), 0) AS sole_functions
    FROM per GROUP BY event_type""")
def blocker_report(spark, sf_dir):
    """Per family: occurrences, functions, functions it blocks first, and functions it blocks alone."""
    events = _t(spark, sf_dir, "events")
    sole = R.sole_family(events, "user_id", "event_type").drop("sole_occurrences")
    first = R.first_blocker(events, "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("functions", "first_functions")
    return sole.join(first, "event_type", "left").na.fill(0, ["first_functions"]).withColumnRenamed("event_type", "family").select("family", "occurrences", "functions", "first_functions", "sole_functions")


@bound("""SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_linestatus = 'F') AS n_covered, count(*) - count(*) FILTER (l_linestatus = 'F') AS n_open,
    round(coalesce(count(*) FILTER (l_linestatus = 'F') * 100.0 / nullif(count(*), 0), 100.0), 4)::DOUBLE AS coverage FROM lineitem GROUP BY l_returnflag""")
def coverage_summary(spark, sf_dir):
    return R.coverage(_t(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "F", "l_returnflag")


@bound("SELECT 0::BIGINT AS n_rows, 0::BIGINT AS n_covered, 0::BIGINT AS n_open, 100.0::DOUBLE AS coverage")
def coverage_empty(spark, sf_dir):
    """An empty report is fully covered."""
    return R.coverage(_t(spark, sf_dir, "lineitem").where("l_orderkey < 0"), F.col("l_linestatus") == "F")


@bound("""SELECT event_type, count(*) AS occurrences, count(DISTINCT user_id) AS functions, string_agg(DISTINCT strftime(ts, '%Y-%m'), ',' ORDER BY strftime(ts, '%Y-%m')) AS corpora
    FROM events GROUP BY event_type""")
def family_aggregate(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("corpus", F.date_format("ts", "yyyy-MM"))
    return R.family_aggregate(events, "event_type", "user_id", "corpus")


_KIND_SQL = "CASE WHEN starts_with(p_type, 'STANDARD') THEN 'direct' WHEN starts_with(p_type, 'PROMO') OR starts_with(p_type, 'ECONOMY') THEN 'metadata' ELSE 'dependent' END"


@bound(f"SELECT {_KIND_SQL} AS kind, count(*) AS occurrences, count(DISTINCT p_brand) AS functions FROM part GROUP BY 1")
def kind_histogram(spark, sf_dir):
    kind = F.when(F.col("p_type").startswith("STANDARD"), "direct").when(F.col("p_type").startswith("PROMO") | F.col("p_type").startswith("ECONOMY"), "metadata").otherwise("dependent")
    return R.kind_histogram(_t(spark, sf_dir, "part"), kind, "p_brand")


@bound("""WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT event_type, count(*) AS functions FROM f WHERE n = 1 GROUP BY event_type""")
def first_blocker(spark, sf_dir):
    return R.first_blocker(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@bound("""WITH p AS (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS profile FROM events GROUP BY user_id)
    SELECT profile, count(*) AS functions FROM p GROUP BY profile""")
def kind_profile(spark, sf_dir):
    return R.kind_profile(_t(spark, sf_dir, "events"), "user_id", "event_type")


@bound("""WITH per AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    sole AS (SELECT l_orderkey, min(l_returnflag) AS f, sum(n) AS n FROM per GROUP BY l_orderkey HAVING count(*) = 1),
    s AS (SELECT f, count(*) AS c, sum(n) AS n FROM sole GROUP BY f)
    SELECT l_returnflag, sum(per.n)::BIGINT AS occurrences, count(*) AS functions, coalesce(any_value(s.c), 0) AS sole_functions, coalesce(any_value(s.n), 0)::BIGINT AS sole_occurrences
    FROM per LEFT JOIN s ON s.f = l_returnflag GROUP BY l_returnflag""")
def sole_family(spark, sf_dir):
    return R.sole_family(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@bound("""WITH pairs AS (SELECT DISTINCT l_returnflag AS family, l_linenumber, l_linestatus FROM lineitem),
    known AS (SELECT (o_orderkey % 9)::INT AS l_linenumber, o_orderstatus AS l_linestatus, o_orderkey AS l_orderkey FROM orders),
    hits AS (SELECT family, count(*) AS known_rows, count(DISTINCT l_orderkey) AS known_functions FROM known JOIN pairs USING (l_linenumber, l_linestatus) GROUP BY family)
    SELECT family, count(*) AS pairs, coalesce(any_value(known_rows), 0) AS known_rows, coalesce(any_value(known_functions), 0) AS known_functions FROM pairs LEFT JOIN hits USING (family) GROUP BY family""")
def exact_overlap(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    known = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).cast("int").alias("l_linenumber"), F.col("o_orderstatus").alias("l_linestatus"), F.col("o_orderkey").alias("l_orderkey"))
    return R.overlap(lines.withColumnRenamed("l_returnflag", "family"), known, "family", ["l_linenumber", "l_linestatus"], "l_orderkey")


@bound("""SELECT source, doc_id, n_chars, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3""")
def top_examples(spark, sf_dir):
    return R.top_per_group(_t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@bound("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 5")
def ranked_candidates(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(5)


@bound("""WITH k AS (SELECT DISTINCT p_brand, p_size FROM part UNION SELECT 'Brand#none', 1),
    c AS (SELECT p_brand, p_size, count(*) AS n, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY ALL)
    SELECT k.p_brand, k.p_size, coalesce(n, 0) AS n_matches, CASE coalesce(n, 0) WHEN 0 THEN 'zero' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, names FROM k LEFT JOIN c USING (p_brand, p_size)""")
def constant_resolution(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    keys = part.select("p_brand", "p_size").union(spark.range(1).select(F.lit("Brand#none"), F.lit(1))).distinct()
    return R.resolve(keys, part, ["p_brand", "p_size"], "p_name").withColumn("names", F.array_join("names", "|"))


@bound("""SELECT p_partkey FROM part WHERE (p_brand, p_name) IN (SELECT p_brand, p_name FROM part GROUP BY ALL HAVING count(*) = 1)
    AND (p_brand, p_type, p_size) IN (SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) = 1)""")
def unique_two_key(spark, sf_dir):
    return R.unique_by_both(_t(spark, sf_dir, "part"), ["p_brand", "p_name"], ["p_brand", "p_type", "p_size"]).select("p_partkey")


@bound("""SELECT c_custkey, coalesce(CASE WHEN n_name LIKE '%A%' THEN n_name END, r_name, 'unknown') AS name FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def fallback_lookup(spark, sf_dir):
    """Local catalogue, then the wider one, then a constant."""
    nation = _t(spark, sf_dir, "nation")
    named = _t(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("c_custkey", F.coalesce(F.when(F.col("n_name").contains("A"), F.col("n_name")), "r_name", F.lit("unknown")).alias("name"))


@bound("""WITH RECURSIVE e(c, p) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL),
    up(node, ancestor, depth) AS (SELECT c, c, 0 FROM e UNION ALL SELECT node, p, depth + 1 FROM up JOIN e ON ancestor = c WHERE p IS NOT NULL),
    m(owner, k, v) AS (SELECT 'root', 'a', 'base' UNION ALL SELECT 'r' || r_regionkey, 'a', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'b', n_name FROM nation)
    SELECT node, k, min_by(v, depth) AS v, min(depth) AS depth FROM up JOIN m ON owner = ancestor GROUP BY node, k""")
def inherited_lookup(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    n, r = F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey"))
    own = F.concat(F.lit("r"), F.col("r_regionkey"))
    root = spark.range(1)
    edges = nation.select(n.alias("c"), r.alias("p")).union(region.select(own, F.lit("root"))).union(root.select(F.lit("root"), F.lit(None).cast("string")))
    members = root.select(F.lit("root").alias("owner"), F.lit("a").alias("k"), F.lit("base").alias("v")).union(region.select(own, F.lit("a"), "r_name")).union(nation.select(n, F.lit("b"), "n_name"))
    return R.inherited(R.ancestors(edges, "c", "p"), members, "owner", "k", "v")


@bound("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'O'),
    b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'F')
    SELECT a.o_custkey, a.o_orderkey, a.n::INT AS occurrence, b.o_orderkey AS matched FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.n = b.n""")
def occurrence_match(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    number = lambda status: R.occurrence(orders.where(F.col("o_orderstatus") == status), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    other = number("F").select("o_custkey", "occurrence", F.col("o_orderkey").alias("matched"))
    return number("O").select("o_custkey", "o_orderkey", "occurrence").join(other, ["o_custkey", "occurrence"], "left")


@bound("SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def identifier_shadow(spark, sf_dir):
    scope = _t(spark, sf_dir, "customer").where("c_acctbal > 9900").withColumnRenamed("c_nationkey", "n_nationkey")
    return R.shadowed(_t(spark, sf_dir, "nation"), scope, "n_nationkey").select("n_nationkey", "n_name")


@bound("""SELECT a.l_orderkey, a.l_linenumber, (a.l_quantity::INT % 7) + 1 AS target, b.l_linenumber IS NOT NULL AS valid FROM lineitem a
    LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = (a.l_quantity::INT % 7) + 1""")
def branch_targets(spark, sf_dir):
    """A branch's target must be an instruction of its own region."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 7 + 1).alias("target"))
    known = lines.select("l_orderkey", F.col("l_linenumber").alias("target"), F.lit(True).alias("valid")).distinct()
    return lines.join(known, ["l_orderkey", "target"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


@bound("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2)")
def debug_map_anti(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@bound("""WITH m AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)),
    b AS (SELECT user_id, block, min(event_id) AS block_start, count(*) AS n_rows FROM m GROUP BY ALL)
    SELECT user_id, block::BIGINT AS block, block_start, n_rows, lead(block_start) OVER (PARTITION BY user_id ORDER BY block) AS block_end FROM b""")
def basic_blocks(spark, sf_dir):
    return R.blocks(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase")


@bound("""WITH e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 60000000 AS f, event_id FROM events),
    m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
    c AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(s) AS cluster_start, max(f) AS cluster_end, count(*) AS n FROM c GROUP BY user_id, k HAVING count(*) >= 2""")
def gap_clusters(spark, sf_dir):
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return R.gap_clusters(_t(spark, sf_dir, "events").withColumn("s", start), ["user_id"], F.col("s"), F.col("s") + 60_000_000, ["s", "event_id"], 86_400_000_000)


@bound("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 1 AND l_quantity < 11 THEN 'small' WHEN l_quantity >= 11 AND l_quantity < 31 THEN 'middle' WHEN l_quantity >= 31 AND l_quantity < 46 THEN 'large' END AS band FROM lineitem""")
def interval_lookup(spark, sf_dir):
    """Addresses to half-open sections: a range join to a table of three rows."""
    bands = spark.sql("SELECT * FROM VALUES ('small', 1.0D, 11.0D), ('middle', 11.0D, 31.0D), ('large', 31.0D, 46.0D) AS t(band, lo, hi)")
    lines = _t(spark, sf_dir, "lineitem")
    return lines.join(F.broadcast(bands), (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi")), "left").select("l_orderkey", "l_linenumber", "band")


@bound("""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS v FROM lineitem WHERE l_linenumber < 6)
    SELECT l_orderkey, min(l_linenumber) AS first_difference FROM a LEFT JOIN b USING (l_orderkey, l_linenumber) WHERE a.v IS DISTINCT FROM b.v GROUP BY l_orderkey""")
def first_difference(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    other = lines.where("l_linenumber < 6").withColumn("v", F.when(F.col("l_linestatus") == "O", "N").otherwise("R"))
    return R.first_difference(lines.withColumn("v", F.col("l_returnflag")), other, ["l_orderkey"], "l_linenumber", "v")


@bound("""WITH o AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ok FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ok FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN n.o_custkey IS NULL THEN 'gone' WHEN o.o_custkey IS NULL THEN 'added' WHEN NOT o.ok AND n.ok THEN 'promoted' WHEN o.ok AND NOT n.ok THEN 'regressed' ELSE 'same' END AS change
    FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""")
def generation_diff(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    half = lambda k: orders.where(F.year("o_orderdate") % 2 == k).groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ok"))
    return R.generation_diff(half(0), half(1), ["o_custkey"], "ok")


@bound("SELECT DISTINCT lower(p_brand) AS owner, p_type, lower(p_name) AS name FROM part")
def dedupe_catalogue(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(R.ascii_lower("p_brand").alias("owner"), "p_type", R.ascii_lower("p_name").alias("name")).distinct()


@bound(r"SELECT doc_id, replace(regexp_replace(lower(text), '[ \t\n\r\f\v]+', '', 'g'), 'this.', '') AS normal FROM documents")
def text_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.replace(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", ""), F.lit("this."), F.lit("")).alias("normal"))


@bound(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9]') AND length(regexp_replace(text, '[^A-Za-z0-9 _.,:;()/\\-]', '', 'g')) * 4 >= length(text) * 3 AS is_text FROM documents""")
def text_like(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", R.text_like(F.col("text")).alias("is_text"))


@bound(r"SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[\x20-\x7e]+'), lambda x: trim(x)), lambda x: length(x) >= 4))::INT AS runs FROM documents")
def ascii_runs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(R.ascii_runs(F.col("text"), 4)).alias("runs"))


@bound("SELECT p_partkey, printf('0x%04X', p_size) || ' ' || printf('0x%04X', (p_partkey % 65536)::INT) AS words, regexp_replace(hex(p_brand), '(..)', '\\1 ', 'g') AS bytes FROM part".replace("regexp_replace(hex(p_brand), '(..)', '\\1 ', 'g')", "trim(regexp_replace(hex(p_brand), '(..)', '\\1 ', 'g'))"))
def operand_hex(spark, sf_dir):
    words = F.array(F.col("p_size"), (F.col("p_partkey") % 65536).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", R.hex_words(words).alias("words"), R.hex_bytes(F.encode("p_brand", "UTF-8")).alias("bytes"))


@bound("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY event_type")
def report_nested(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@bound("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_projection(spark, sf_dir):
    return totals(_t(spark, sf_dir, "events")).select("event_type", "n")
