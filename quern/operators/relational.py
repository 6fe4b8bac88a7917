"""Query shapes over decode reports and catalogues, generic over columns.

Ties are always broken by stated columns, so that results do not depend on partitions. Aggregations
combine before they shuffle; lookups are left joins whose strategy is left to the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: str | Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 100 where there is nothing to cover."""
    return F.coalesce(part * 100.0 / F.nullif(whole, F.lit(0)), F.lit(100.0))


def coverage(df: DataFrame, covered: Column, *by: str) -> DataFrame:
    """n_rows, n_covered, n_open, coverage, over all rows or by columns. An empty input has 100 percent."""
    made = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(covered).alias("n_covered"))
    return made.withColumn("n_open", F.col("n_rows") - F.col("n_covered")).withColumn("coverage", F.round(percent(F.col("n_covered"), F.col("n_rows")), 4))


def family_aggregate(df: DataFrame, family: str, function: str, corpus: str) -> DataFrame:
    """Per family: occurrences, distinct functions, and its corpora as a sorted list; most frequent first."""
    counts = df.groupBy(family).agg(F.count("*").alias("occurrences"), F.count_distinct(function).alias("functions"), F.array_join(F.array_sort(F.collect_set(corpus)), ",").alias("corpora"))
    return counts.orderBy(F.desc("occurrences"), family)


def kind_histogram(df: DataFrame, kind: Column, function: str) -> DataFrame:
    """Occurrences and distinct functions of each kind."""
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("occurrences"), F.count_distinct(function).alias("functions")).orderBy(F.desc("occurrences"), "kind")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`columns` of the first row of each group. An aggregate, so a large group never sits in one task."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*by).agg(first.alias("_first")).select(*by, *[F.col("_first")[c].alias(c) for c in columns])


def first_blocker(df: DataFrame, function: str, order: Sequence[str], family: str) -> DataFrame:
    """How many functions each family is the first gap of."""
    return first_per_group(df, [function], order, [family]).groupBy(family).agg(F.count("*").alias("functions"))


def kind_profile(df: DataFrame, function: str, kind: str) -> DataFrame:
    """How many functions have each set of kinds."""
    sets = df.groupBy(function).agg(F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("profile"))
    return sets.groupBy("profile").agg(F.count("*").alias("functions"))


def sole_family(df: DataFrame, function: str, family: str) -> DataFrame:
    """Per family: occurrences, functions, functions where it is the only family, and occurrences there."""
    per = df.groupBy(function, family).agg(F.count("*").alias("n"))
    alone = per.groupBy(function).agg(F.min(family).alias(family), F.max(family).alias("_last"), F.sum("n").alias("n"))
    alone = alone.where(F.col(family) == F.col("_last")).groupBy(family).agg(F.count("*").alias("sole_functions"), F.sum("n").alias("sole_occurrences"))
    every = per.groupBy(family).agg(F.sum("n").alias("occurrences"), F.count("*").alias("functions"))
    return every.join(alone, family, "left").na.fill(0, ["sole_functions", "sole_occurrences"])


def overlap(target: DataFrame, known: DataFrame, family: str, pair: Sequence[str], function: str) -> DataFrame:
    """Per family of `target`: how many rows and functions of `known` have one of its distinct pairs."""
    pairs = target.select(family, *pair).distinct()
    hits = known.select(*pair, function).join(pairs, list(pair))
    found = hits.groupBy(family).agg(F.count("*").alias("known_rows"), F.count_distinct(function).alias("known_functions"))
    return pairs.groupBy(family).agg(F.count("*").alias("pairs")).join(found, family, "left").na.fill(0, ["known_rows", "known_functions"])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked. Spark drops later rows before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def resolve(keys: DataFrame, catalogue: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Each key's matches in the catalogue: n_matches, status (zero, unique, ambiguous), and the sorted
    distinct names. Keys keep their rows: the catalogue is grouped before it is joined."""
    names = catalogue.groupBy(*on).agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_set(name)).alias("names"))
    found = keys.join(names, list(on), "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    status = F.when(F.col("n_matches") == 0, "zero").when(F.col("n_matches") == 1, "unique").otherwise("ambiguous")
    return found.withColumn("status", status)


def unique_by_both(df: DataFrame, one: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Rows that are the only one with their `one` key and the only one with their `other` key."""
    single = lambda key: df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(single(one), list(one), "left_semi").join(single(other), list(other), "left_semi")


def ancestors(parents: DataFrame, child: str, parent: str, max_depth: int = 64) -> DataFrame:
    """(child, ancestor, depth): each node itself at depth 0 and all above it, by recursion over the edges,
    at most max_depth up. Cycles end at that bound and give each pair's least depth."""
    edges = parents.select(F.col(child).alias("c"), F.col(parent).alias("p"))
    return parents.sparkSession.sql(
        """WITH RECURSIVE up(node, ancestor, depth) AS (
            SELECT c, c, 0 FROM {edges}
            UNION ALL SELECT up.node, e.p, up.depth + 1 FROM up JOIN {edges} e ON up.ancestor = e.c
            WHERE e.p IS NOT NULL AND up.depth < {most})
        SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY node, ancestor""",
        edges=edges, most=int(max_depth),
    )


def inherited(closure: DataFrame, members: DataFrame, owner: str, key: str, value: str) -> DataFrame:
    """(node, key, value, depth): for each node the value of the nearest ancestor that has the key."""
    found = closure.join(members.select(F.col(owner).alias("ancestor"), key, value), "ancestor")
    return found.groupBy("node", key).agg(F.min_by(value, F.struct("depth", "ancestor")).alias(value), F.min("depth").alias("depth"))


def occurrence(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "occurrence") -> DataFrame:
    """A running number from 0 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def shadowed(names: DataFrame, scope: DataFrame, on: str) -> DataFrame:
    """Names that no entry of the scope hides."""
    return names.join(scope.select(on).distinct(), on, "left_anti")


def gap_clusters(df: DataFrame, by: Sequence[str], start: Column, end: Column, order: Sequence[str], gap: int, least: int = 2) -> DataFrame:
    """Clusters of intervals whose start is at most `gap` after the furthest end so far, of at least
    `least` rows: the group, cluster_start, cluster_end, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumns({"_start": start, "_end": end}).withColumn("_new", F.when(reach.isNull() | (F.col("_start") > reach + gap), 1).otherwise(0))
    numbered = marked.withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_cluster").agg(F.min("_start").alias("cluster_start"), F.max("_end").alias("cluster_end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_cluster")


def first_difference(a: DataFrame, b: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """Groups whose sequences differ, with the first position where they do (a missing value differs)."""
    on = [*by, position]
    both = a.select(*on, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(*on, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), on, "full")
    differs = ~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return both.where(differs).groupBy(*by).agg(F.min(position).alias("first_difference"))


def generation_diff(old: DataFrame, new: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """One row per key with its change: gone, added, promoted (flag false to true), regressed, same."""
    both = old.select(*key, F.col(flag).alias("_old"), F.lit(1).alias("_o")).join(new.select(*key, F.col(flag).alias("_new"), F.lit(1).alias("_n")), list(key), "full")
    change = F.when(F.col("_n").isNull(), "gone").when(F.col("_o").isNull(), "added").when(~F.col("_old") & F.col("_new"), "promoted").when(F.col("_old") & ~F.col("_new"), "regressed").otherwise("same")
    return both.select(*key, change.alias("change"))


def blocks(df: DataFrame, by: Sequence[str], position: str, leader: Column) -> DataFrame:
    """[start, end) blocks from each leader to the next, with the number of rows in them. The first row of
    a group leads."""
    w = Window.partitionBy(*by).orderBy(position)
    marked = df.withColumn("_block", F.sum(F.when(leader | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = marked.groupBy(*by, "_block").agg(F.min(position).alias("block_start"), F.count("*").alias("n_rows"))
    return made.withColumn("block_end", F.lead("block_start").over(Window.partitionBy(*by).orderBy("_block"))).withColumnRenamed("_block", "block")


def text_like(text: Column) -> Column:
    """Whether a text has a letter or digit and at least three quarters of it are meaningful."""
    kept = F.length(F.regexp_replace(text, r"[^A-Za-z0-9 _.,:;()/\\-]", ""))
    return text.rlike("[A-Za-z0-9]") & (kept * 4 >= F.length(text) * 3)


def ascii_runs(text: Column, least: int) -> Column:
    """Maximal runs of printable ASCII, trimmed, of at least `least` characters."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]+"), F.lit(0)), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def hex_words(words: Column) -> Column:
    """0x%04X of each word, joined by spaces."""
    return F.array_join(F.transform(words, lambda w: F.format_string("0x%04X", w)), " ")


def hex_bytes(data: Column) -> Column:
    """Upper-case hex, a space between bytes."""
    return F.regexp_replace(F.hex(data), "(..)(?=.)", "$1 ")
