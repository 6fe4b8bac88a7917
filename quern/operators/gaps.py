"""Analytics over decode reports (rows of quern.sources.reports)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.mismatches import shape
from quern.operators.relational import first_per_group, percent, top_per_group


def summary(functions: DataFrame) -> DataFrame:
    """One row: functions, complete ones, instructions, open ones, coverage (100 of nothing), verified
    functions by basis."""
    return functions.agg(
        F.count("*").alias("functions"),
        F.count_if("complete").alias("complete_functions"),
        F.coalesce(F.sum("n_instructions"), F.lit(0)).alias("instructions"),
        F.coalesce(F.sum(F.size("unresolved")), F.lit(0)).alias("unresolved"),
        F.round(percent(F.sum(F.col("n_instructions") - F.size("unresolved")), F.sum("n_instructions")), 3).alias("coverage"),
        F.count_if(F.col("verification") == "verified").alias("verified"),
        *[F.count_if(F.col("basis") == b).alias(b) for b in ("normalized_equality", "safe_semantic_canonicalization", "compiled_symbol_equivalence")],
    )


def comparison_histogram(functions: DataFrame) -> DataFrame:
    return functions.groupBy("result", "basis").agg(F.count("*").alias("functions"))


def families(gaps: DataFrame) -> DataFrame:
    """Per family: occurrences, functions, corpora; functions where it is the first gap, the first direct
    gap, and the only direct family; other failures in its functions, and in those it is alone in."""
    per = gaps.groupBy("function", "family").agg(F.count("*").alias("n"), F.first("direct").alias("direct"))
    first = first_per_group(gaps, ["function"], ["offset", "opcode"], ["family"]).groupBy("family").agg(F.count("*").alias("first_functions"))
    first_direct = first_per_group(gaps.where("direct"), ["function"], ["offset", "opcode"], ["family"]).groupBy("family").agg(F.count("*").alias("first_direct_functions"))
    whole = per.groupBy("function").agg(F.sum("n").alias("all_n"), F.min(F.when(F.col("direct"), F.col("family"))).alias("lo"), F.max(F.when(F.col("direct"), F.col("family"))).alias("hi"))
    sole = F.col("direct") & (F.col("lo") == F.col("hi"))
    joined = per.join(whole, "function").groupBy("family").agg(
        F.sum("n").alias("occurrences"),
        F.count("*").alias("functions"),
        F.sum(F.col("all_n") - F.col("n")).alias("other_failures"),
        F.count_if(sole).alias("sole_functions"),
        F.sum(F.when(sole, F.col("all_n") - F.col("n")).otherwise(0)).alias("other_failures_sole"),
    )
    corpora = gaps.groupBy("family").agg(F.array_sort(F.collect_set("corpus")).alias("corpora"))
    out = joined.join(corpora, "family").join(first, "family", "left").join(first_direct, "family", "left")
    return out.na.fill(0, ["first_functions", "first_direct_functions"]).orderBy(F.desc("occurrences"), "family")


def opcodes(gaps: DataFrame, examples: int = 3) -> DataFrame:
    """Per (opcode, mnemonic, reason): family, occurrences, functions and the first examples."""
    key = ["opcode", "mnemonic", "reason"]
    counts = gaps.groupBy(*key).agg(F.min("family").alias("family"), F.count("*").alias("occurrences"), F.count_distinct("function").alias("functions"))
    some = top_per_group(gaps.select(*key, "function", "offset"), key, [F.asc("function"), F.asc("offset")], examples)
    listed = some.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "function", "offset"))).alias("examples"))
    return counts.join(listed, key).orderBy(F.desc("occurrences"), "mnemonic", "reason")


def profiles(gaps: DataFrame) -> DataFrame:
    """Functions without a direct gap, by the set of their kinds."""
    sets = gaps.groupBy("function").agg(F.bool_or("direct").alias("any"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("profile"))
    return sets.where("NOT any").groupBy("profile").agg(F.count("*").alias("functions"))


def known_overlap(target: DataFrame, known: DataFrame) -> DataFrame:
    """Per family of the target's gaps: gaps and functions of `known` with one of its (opcode, mnemonic)."""
    pairs = target.select("family", "opcode", "mnemonic").distinct()
    index = known.groupBy("opcode", "mnemonic").agg(F.count("*").alias("rows"))
    functions = known.select("opcode", "mnemonic", "function").join(pairs, ["opcode", "mnemonic"]).groupBy("family").agg(F.count_distinct("function").alias("known_functions"))
    rows = pairs.join(index, ["opcode", "mnemonic"], "left").groupBy("family").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("known_rows"))
    return rows.join(functions, "family", "left").na.fill(0, ["known_functions"])


def generations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per function: in_old, in_new, and whether completeness and verification came or went."""
    side = lambda df, x: df.select("function", F.col("complete").alias(f"{x}_complete"), (F.col("verification") == "verified").alias(f"{x}_verified"), F.lit(True).alias(f"in_{x}"))
    both = side(old, "old").join(side(new, "new"), "function", "full").na.fill(False, ["in_old", "in_new"])
    move = lambda k: F.when(~F.col(f"old_{k}") & F.col(f"new_{k}"), "promotion").when(F.col(f"old_{k}") & ~F.col(f"new_{k}"), "regression")
    return both.select("function", "in_old", "in_new", move("complete").alias("completeness"), move("verified").alias("verification"))


def gap_changes(old: DataFrame, new: DataFrame, direct: list[int]) -> DataFrame:
    """Gaps of one generation only: change (gone, added), and for gone ones whether their opcode is one of
    those now handled (direct) or they went along (cascade)."""
    key = ["function", "offset", "opcode", "mnemonic", "reason"]
    gone = old.select(key).join(new.select(key), key, "left_anti").withColumn("change", F.lit("gone"))
    added = new.select(key).join(old.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return gone.withColumn("cause", F.when(F.col("opcode").isin(direct), "direct").otherwise("cascade")).unionByName(added.withColumn("cause", F.lit(None).cast("string")))


def statement_kinds(statements: str) -> Column:
    """Counts of control statements in an array column: ifs, elses, endifs, chooses, gotos."""
    return shape(F.transform(F.col(statements), lambda s: F.regexp_replace(F.lower(s), r"\s+", "")))


def nested_report(instructions: DataFrame) -> DataFrame:
    """library, index, regions (region_index, instructions by offset) of instruction rows: a row an entry. A region,
    and an entry's regions, are one task's work; a library is as many rows as it has entries, for a report
    written by library (`partitionBy`)."""
    region = instructions.groupBy("library", "entry_index", "region_index").agg(F.array_sort(F.collect_list(F.struct("offset", "opcode", "mnemonic"))).alias("instructions"))
    return region.groupBy("library", F.col("entry_index").alias("index")).agg(F.array_sort(F.collect_list(F.struct("region_index", "instructions"))).alias("regions"))
