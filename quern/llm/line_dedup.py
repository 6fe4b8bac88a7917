"""Removal of repeated runs of lines, by prefix doubling over sequences of line ids.

Documents are sequences of lines. A suffix's rank at depth 2^k names the block of 2^k lines that it
starts with: the place (document, line) where that block occurs first. Ranks at depth 1 come from the
lines themselves, ranks at depth 2^(k+1) from the pairs of ranks at i and i + 2^k. Suffixes whose rank
nobody else has, the larger part, leave at each step, and doubling ends when none is left. In the order
of their ranks the suffixes that stay form the intervals of the suffix array whose longest common prefix
reaches the depth; the maximal repeated runs, with their sources, are read from them, and what these
cover is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.shared import fresh, stored

_PLACE = ("doc", "print", "seq")


def _place():
    return F.struct(*_PLACE)


def _ranked(blocks: DataFrame, names: list[str]) -> DataFrame:
    """Blocks that occur more than once, with their first place as `rank`. Blocks are grouped by `names`;
    what is sent for a group is one row a task. The groups are written before they are joined: both sides
    are then dealt out for the join alone, and Spark splits a block that very many places have."""
    first = blocks.groupBy(*names).agg(F.min(_place()).alias("rank"), F.max(_place()).alias("last")).where("rank < last").drop("last")
    return blocks.join(stored(first, "first"), names).drop(*names)


def _pairs(x: DataFrame, y: DataFrame, step: int) -> DataFrame:
    """Blocks of x with the rank in y of the block `step` lines on."""
    on = y.select("doc", "print", (F.col("seq") - step).alias("seq"), F.col("rank").alias("second"))
    return x.withColumnRenamed("rank", "first").join(on, list(_PLACE))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, print, seq and line of every line that is not blank."""
    own = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return own.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("print"), F.posexplode(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\S"))).alias("seq", "line"))


def _single(lines: DataFrame, *more) -> DataFrame:
    """Ranks at depth 1, by two hashes of the line."""
    named = lines.select(*_PLACE, F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(7), "line").alias("l2"), *more)
    return stored(_ranked(named, ["l1", "l2"]).distinct(), "ranks")


def _deeper(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks `step` lines deeper; step is at most the depth of `ranks`."""
    return stored(_ranked(_pairs(ranks, ranks, step), ["first", "second"]), "ranks")


def _maximal(ranks: DataFrame, min_lines: int) -> DataFrame:
    """doc, print, seq, n_lines and rank (the source's place) of the maximal runs of at least `min_lines` lines
    that begin earlier, from the ranks at depth 1."""
    depth, levels = 1, []
    while not ranks.isEmpty():
        levels.append((depth, ranks))
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        ranks, depth = _deeper(ranks, step), depth + step
    own = ranks.select(*_PLACE, "rank", F.lit(0).alias("n_lines"))  # none
    for depth, ranks in levels:
        if depth >= min_lines:
            own = own.unionByName(ranks.where(_place() > F.col("rank")).select(*_PLACE, "rank", F.lit(depth).alias("n_lines")))
    runs = stored(own.groupBy(*_PLACE).agg(F.max_by("rank", "n_lines").alias("rank"), F.max("n_lines").alias("n_lines")), "runs")
    for depth, ranks in reversed(levels):
        after = ranks.select("doc", "print", (F.col("seq")).alias("at"), F.col("rank").alias("own"))
        theirs = ranks.select(F.col("doc").alias("d2"), F.col("print").alias("p2"), F.col("seq").alias("a2"), F.col("rank").alias("their"))
        both = runs.withColumns({"at": F.col("seq") + F.col("n_lines"), "d2": F.col("rank.doc"), "p2": F.col("rank.print"), "a2": F.col("rank.seq") + F.col("n_lines")})
        both = both.join(after, ["doc", "print", "at"], "left").join(theirs, ["d2", "p2", "a2"], "left")
        more = F.when(F.col("own") == F.col("their"), depth).otherwise(0)
        runs = stored(both.select(*_PLACE, "rank", (F.col("n_lines") + more).alias("n_lines")), "runs")
    above = runs.select("doc", "print", (F.col("seq") + 1).alias("seq"), F.struct(F.col("rank.doc").alias("doc"), F.col("rank.print").alias("print"), (F.col("rank.seq") + 1).alias("seq")).alias("rank"))
    return runs.join(above, [*_PLACE, "rank"], "left_anti")


def repeated_runs(docs: DataFrame, min_lines: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of at least `min_lines` lines that begin earlier: doc, seq, n_lines, from_doc, from_seq
    (line numbers count lines that are not blank). A run's source is the first place of the longest block,
    by doublings, that starts with it; from there it is as long as both go on alike, and it is not part of
    a run from one line above with the source one line above. Otherwise as repeated_lines.
    """
    runs = _maximal(_single(_lines(docs, key, text)), min_lines)
    return runs.select("doc", "seq", "n_lines", F.col("rank.doc").alias("from_doc"), F.col("rank.seq").alias("from_seq"))


def repeated_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, print, seq) of each line to delete: its document's id and text hash, and its number among
    the document's lines that are not blank.

    A line goes if it lies in a run of at least `min_lines` lines, or is a line of at least `min_chars`
    characters, that also begins earlier: in a document with a smaller id, or further up in its own
    (the two may overlap). Runs are judged on the input. Blank lines are not lines. Rows that repeat
    both id and text are one document; equal ids with unlike texts are ordered by their texts' hashes.
    Null ids and null texts have no lines here.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    ranks = _single(_lines(docs, key, text), (F.char_length("line") >= min_chars).alias("long"))
    ones = ranks.where("long").where(_place() > F.col("rank")).select(*_PLACE, F.col("seq").alias("end"))
    spans = _maximal(ranks.drop("long"), min_lines).select(*_PLACE, (F.col("seq") + F.col("n_lines") - 1).alias("end")).unionByName(ones)
    # Runs of a document may overlap, in a text of equal lines each with each: of every run, what those that
    # begin before it do not reach.
    before = Window.partitionBy("doc", "print").orderBy("seq", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("seq", F.greatest("seq", F.coalesce(F.max("end").over(before) + 1, "seq"))).where("seq <= end")
    return spans.select("doc", "print", F.explode(F.sequence("seq", "end")).alias("seq"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the lines of `repeated_lines` taken out of `text`, and two more columns: n_lines (lines
    that are not blank) and n_removed (named with leading underscores if docs has such columns).

    Lines end with a line feed; what stays is joined by line feeds. A null text stays null, with no
    lines. Every row stays, also one that has lost all its lines.
    """
    gone = repeated_lines(docs, min_lines, min_chars, key, text).groupBy("doc", "print").agg(F.collect_set("seq").alias("gone"))
    names = {x: fresh(docs, x) for x in ("n_lines", "n_removed", "__lines", "__solid", "__id", "__print", "__gone")}
    gone = gone.select(F.col("doc").alias(names["__id"]), F.col("print").alias(names["__print"]), F.col("gone").alias(names["__gone"]))
    lines, solid = F.col(names["__lines"]), F.col(names["__solid"])
    own = docs.withColumns({names["__lines"]: F.split(text, "\n", -1), names["__id"]: F.col(key).cast("long"), names["__print"]: F.xxhash64(text)})
    own = own.withColumn(names["__solid"], F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull()))
    both = own.drop(text).join(gone, [names["__id"], names["__print"]], "left")
    at = F.transform(F.coalesce(names["__gone"], F.array().cast("array<int>")), lambda s: F.get(solid, s))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at)
    both = both.withColumns({names["n_lines"]: F.coalesce(F.size(solid), F.lit(0)).cast("long"), names["n_removed"]: F.coalesce(F.size(names["__gone"]), F.lit(0)).cast("long"), text: F.when(lines.isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))})
    return both.select(*docs.columns, names["n_lines"], names["n_removed"])
