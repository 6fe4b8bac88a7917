"""Connected components by contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of `edges` (columns a, b; undirected): the smallest id that links reach.

    Each round, every node points to the smallest of itself and its neighbours, pointers are followed
    once more, and the edges are rewritten between what the nodes point to. Nodes only ever point to
    smaller ones, so what is left of a component is its smallest id. Edges between nodes that have met
    disappear; rounds are logarithmic in a component's size. The state is written to the shared folder
    each round. Rows with nulls and loops (a = b) are left out; repeated edges do no harm.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        to = stored(to, "pointers")
        up = to.select(F.col("id").alias("to"), F.col("to").alias("up"))
        to = stored(to.join(up, "to").select("id", F.col("up").alias("to")), "pointers")
        at_a, at_b = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = left.join(at_a, "a").join(at_b, "b").where("x <> y")
        left = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if found is None:
            found = to.withColumnRenamed("to", "component")
        else:
            follow = to.select(F.col("id").alias("component"), "to")
            found = stored(found.join(follow, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")
    if found is None:
        return left.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return found
