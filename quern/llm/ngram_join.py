"""N-gram Jaccard join over count vectors.

A document is a set of word shingles; its point counts how many of them fall to each group of a hash.
The sum of the smaller coordinates of two points is at least their sets' overlap, and the sum of the
smaller upper bounds of two boxes is at least that of any points in them: an R-tree over the points
skips what cannot reach the overlap that the threshold asks for. What is left is verified on the sets.

Boxes of unlike documents overlap in nearly every coordinate, so one tree over a corpus would compare
all its leaves. Points are therefore dealt to trees by shared shingles: two sets over the threshold share
one of the first `n - ceil(t n) + 1` shingles of each, in any order that both use; here the rarest come
first, by counts over the whole corpus (kept by hash cells: cells that collide change the order, not
the result). Shingles of a single document lead nowhere and are not dealt out, and of shingles that lead
to the same documents one is.

Every tree is first contracted: each document is verified against the tree's first one, which joins a
group of copies in a linear number of steps. Trees whose documents are then all joined are done. The rest
are packed into tiles by set size, at most TILE points or WEIGHT shingles each; boxes of tiles that cannot
reach the threshold do not meet; tiles that do are joined by the tree over their points; a pair that shares several trees is looked at in the first
that the sketches of both name. Documents that it leaves over take their sets there, are
verified, and each of their components answers with the smallest that it is linked with: a row a component,
not a pair.
Documents with equal sets are one document throughout.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.exchange import answers, exchange, merged, splits_of
from quern.llm.shared import entering, release, stored
from quern.llm.shingles import mix, shingle_set

#: Cells that counts are kept by; groups of the count vectors, of those of tiles' boxes; most points and
#: shingles of a tile; entries of a leaf; trees that a sketch names.
CELL_BITS, GROUPS, COARSE, TILE, WEIGHT, LEAF, SKETCH = 36, 256, 16, 1024, 1 << 20, 32, 32


def needed_overlap(a, b, percent: int):
    """The least overlap of sets of a and b elements with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def groups_of(n: int) -> int:
    """Groups of the count vector of n shingles: with many shingles in a group, unlike large sets would look
    alike. A multiple of GROUPS; more groups are folded to fewer."""
    return max(GROUPS, 1 << max(0, n // 2 - 1).bit_length())


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(20)) % np.uint64(groups), minlength=groups).astype(np.uint16 if len(shingles) < 1 << 16 else np.uint32)


def vector_bytes(vector: np.ndarray) -> bytes:
    return vector.astype(np.uint8 if vector.max(initial=0) < 256 else np.uint32).tobytes()


def vector_of(data: bytes, n: int) -> np.ndarray:
    """The count vector of n shingles."""
    return np.frombuffer(data, np.uint8 if len(data) == groups_of(n) else np.uint32)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The count vector by fewer groups."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> list[np.ndarray]:
    return [shingle_set(text, width) for batch in batches for text in batch.column(batch.num_columns - 1).to_pylist()]


def _cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - CELL_BITS)
    return np.unique(every, return_counts=True)


def _ask(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = _cells(_sets(batches, width))
    return cells, counts.astype(np.uint64)


def _ranks(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 for a cell of one shingle, else growing with the logarithm of its count."""
    order, first, group = merged(cells)
    total = np.add.reduceat(counts[order], first)
    rank = np.where(total < 2, 0, np.minimum(255, 1 + 5 * np.log2(total.astype(float)))).astype("u1")
    out = np.empty(len(cells), "u1")
    out[order] = rank[group]
    return out


_POINT = "doc_id long, n long, d1 long, d2 long, tokens array<long>, point array<int>, vector binary, shingles binary"


def _points(batches: Iterator[pa.RecordBatch], folder: str, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    entering("ngrams")
    ids, sets = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        sets += _sets(iter([batch]), width)
    cells, _ = _cells(sets)
    rank = answers(folder, cells)
    for a in range(0, len(ids), 500):
        rows = []
        for shingles in sets[a : a + 500]:
            n = len(shingles)
            own = rank[np.searchsorted(cells, shingles >> np.uint64(64 - CELL_BITS))]
            prefix = np.lexsort((shingles, own))[: n - (percent * n + 99) // 100 + 1] if n else np.empty(0, int)
            tokens = shingles[prefix[own[prefix] > 0]]
            vector = count_vector(shingles, groups_of(n))
            point = fold(vector, COARSE).astype(np.int32) if len(tokens) else None
            rows.append((n, int(shingles.sum(dtype=np.uint64).view(np.int64)) if n else 0, int(mix(shingles + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)) if n else 0, tokens.view(np.int64), point, *((vector_bytes(vector), shingles.tobytes()) if len(tokens) else (None, None))))
        n, d1, d2, tokens, points, vectors, blobs = zip(*rows, strict=True)
        columns = [pa.array(ids[a : a + 500], pa.int64()), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(tokens, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int32())), pa.array(vectors, pa.binary()), pa.array(blobs, pa.binary())]
        yield pa.record_batch(columns, ["doc_id", "n", "d1", "d2", "tokens", "point", "vector", "shingles"])
    del ids, sets, cells, rank
    release()


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) that are linked: first by the bound of their count vectors, then by their sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            need = needed_overlap(len(x), len(y), percent)
            keep.append(min(len(x), len(y)) >= need and int(np.minimum(count_vector(x), count_vector(y)).sum()) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of `pairs` that are linked."""
    at_a, at_b = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(functools.partial(_verified, percent=percent), "a long, b long")


class _Node:
    """A box: rows a to z of the sorted points, the largest count of each group, sizes from low to high."""

    __slots__ = ("a", "below", "high", "low", "top", "z")

    def __init__(self, a: int, z: int, sizes: np.ndarray, points: np.ndarray, fan: int = 4):
        self.a, self.z = a, z
        self.low, self.high = int(sizes[a:z].min()), int(sizes[a:z].max())
        self.top = points[a:z].max(axis=0)
        step = -(-(z - a) // fan)
        self.below = [_Node(i, min(i + step, z), sizes, points, fan) for i in range(a, z, step)] if z - a > LEAF else []


def tree_pairs(sizes: np.ndarray, points: np.ndarray, groups: np.ndarray, first: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose bound reaches the overlap they need, in different groups. With `first`, only
    pairs of a row inside and a row outside that mask."""
    order = np.lexsort((points[:, 1], points[:, 0], sizes))
    sizes, points, groups = sizes[order], points[order], groups[order]
    side = None if first is None else first[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(x: _Node, y: _Node) -> None:
        need = needed_overlap(x.low, y.low, percent)
        if min(x.high, y.high) < need or 100 * x.high < percent * y.low or 100 * y.high < percent * x.low or int(np.minimum(x.top, y.top).sum()) < need:
            return
        if x.below or y.below:
            if x is y:
                for i, u in enumerate(x.below):
                    for v in x.below[i:]:
                        meet(u, v)
            else:
                for u in x.below or [x]:
                    for v in y.below or [y]:
                        meet(u, v)
            return
        i, j = np.meshgrid(np.arange(x.a, x.z), np.arange(y.a, y.z), indexing="ij")
        i, j = i.ravel(), j.ravel()
        keep = groups[i] != groups[j]
        if x is y:
            keep &= i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        if len(i):
            keep = np.minimum(points[i], points[j]).sum(axis=1, dtype=np.int64) >= needed_overlap(sizes[i], sizes[j], percent)
            found.append((order[i[keep]], order[j[keep]]))

    if len(sizes):
        root = _Node(0, len(sizes), sizes, points)
        meet(root, root)
    return tuple(np.concatenate([f[k] for f in found] or [np.empty(0, int)]) for k in (0, 1))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of rows with equal tree, t0 and t1, which stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("tree", "t0", "t1")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(key[:, a]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, z - a))
            last = tuple(key[:, a])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(rows: pa.Table, vectors: list[np.ndarray], component: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, overlap they need) of what the tree over the vectors leaves over, and then all the groups of the
    vectors: the smaller of the two numbers of groups. Rows whose sketches name an earlier tree that both are in
    meet there."""
    sizes, tree = rows.column("n").to_numpy(), rows.column("tree")[0].as_py()
    sketches = rows.column("sketch").to_pylist()
    known = [set(s) for s in sketches]
    tile = rows.column("tile").to_numpy()
    points = np.stack([fold(v, GROUPS) for v in vectors])
    i, j = tree_pairs(sizes, points, component, None if rows.column("t0")[0] == rows.column("t1")[0] else tile == tile.min(), percent)
    need = needed_overlap(sizes[i], sizes[j], percent)
    for i, j, need in zip(i.tolist(), j.tolist(), need.tolist(), strict=True):
        if next((t for t in sketches[i] if t in known[j]), tree) != tree:
            continue
        x, y = vectors[i], vectors[j]
        groups = min(len(x), len(y))
        if groups == GROUPS or int(np.minimum(fold(x, groups), fold(y, groups)).sum()) >= need:
            yield i, j, need


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group that some row of another component may be linked with, by their count vectors;
    without these."""
    for rows in _groups(batches):
        vectors = [vector_of(v, n) for n, v in zip(rows.column("n").to_pylist(), rows.column("vector").to_pylist(), strict=True)]
        found = np.zeros(len(rows), bool)
        for i, j, _ in _pairs(rows, vectors, rows.column("component").to_numpy(), percent):
            found[[i, j]] = True
        if found.any():
            yield from rows.drop_columns(["vector"]).filter(pa.array(found)).to_batches()
    release()


def _joined(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, smallest components that links join them to) of a tile, or of two that meet."""
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles").combine_chunks()]
    names, group = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    low = list(range(len(names)))  # a forest: of two joined components the smaller is above the larger

    def top(x: int) -> int:
        while low[x] != x:
            low[x] = x = low[low[x]]
        return x

    for i, j, need in _pairs(rows, [count_vector(s, groups_of(len(s))) for s in sets], group, percent):
        x, y = top(group[i]), top(group[j])
        if x != y and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need:
            low[max(x, y)] = min(x, y)
    moved = np.array([k for k in range(len(names)) if low[k] != k], int)
    return names[moved], names[[top(k) for k in moved.tolist()]]


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components: at most one for each component of a group."""
    for rows in _groups(batches):
        ids, reached = _joined(rows, percent)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(reached, pa.int64())], ["a", "b"])
    release()


def ngram_groups(docs: DataFrame, percent: int = 75, width: int = 5, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    A document's set is its distinct `width`-word shingles (words are runs of characters other than
    ASCII white space, A-Z in lower case); with fewer words, the whole sequence as one. Two documents
    are linked when 100 * overlap >= percent * union. A null text or one without words has an empty
    set, links with nothing and is its own component. Rows that repeat an id are one node with all
    their links; a null id has a null component and no links. Other columns are not read. An empty
    table gives an empty one.
    """
    rows, buckets = splits_of(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "texts")
    folder = exchange(rows, buckets, functools.partial(_ask, width=width), _ranks, "cells", CELL_BITS)
    points = stored(rows.mapInArrow(functools.partial(_points, folder=folder, width=width, percent=percent), _POINT), "points")
    shared = points.where("shingles IS NOT NULL AND doc_id IS NOT NULL")
    alike = stored(shared.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "classes")
    copies = shared.select("doc_id", "n", "d1", "d2").join(alike.where("first < last"), ["n", "d1", "d2"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    sets = shared.join(alike.select(F.col("first").alias("doc_id"), "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "n", "d1", "d2"])
    sets = stored(sets.select("doc_id", "n", "d1", "tokens", "point", "vector", "shingles"), "sets")

    dealt = sets.select("doc_id", "n", "d1", F.explode("tokens").alias("tree"))
    # What is grouped by tree is written before it is joined by tree, so that Spark can split a large one.
    marks = F.xxhash64("doc_id", "n", "d1")
    trees = dealt.groupBy("tree").agg(F.count("*").alias("held"), F.sum("n").alias("weight"), F.min(F.struct("doc_id", "n")).alias("head"), F.bit_xor(marks).alias("mark")).where("held > 1")
    trees = trees.groupBy("held", "weight", "head", "mark").agg(F.min("tree").alias("tree"))
    dealt = stored(dealt.join(stored(trees.select("tree", "held", "weight", "head"), "heads"), "tree"), "trees")
    heads = dealt.where(f"n * 100 >= head.n * {percent} AND head.n * 100 >= n * {percent}").select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).where("a < b").distinct()
    links = stored(copies.where("a < b").unionByName(_links(heads, sets, percent)), "links")
    found = components(links)

    # A tree of two is done: its one pair was verified.
    left = dealt.where("held > 2").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = stored(left.groupBy("tree").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("tree"), "apart")
    # Sizes of linked sets differ by two bands at most.
    band = F.floor(F.log("n") / max(1e-3, math.log(100 / percent) / 2 * 1.0001))
    left = stored(left.join(apart, "tree"), "apart")
    own, place = ["doc_id", "n", "d1"], ["tree", "t0", "t1"]
    # A document's largest trees, in an order that all documents use.
    order = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("held")).alias("held"), "tree"))), 1, SKETCH)
    sketches = left.groupBy(*own).agg(F.transform(order, lambda x: x["tree"]).alias("sketch"))
    left = left.withColumn("band", F.when((F.col("held") <= tile) & (F.col("weight") <= WEIGHT), F.lit(0)).otherwise(band))
    parts = left.groupBy("tree", "band").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / WEIGHT)).alias("parts"))
    left = left.join(stored(parts, "parts"), ["tree", "band"]).join(sets.select("doc_id", "n", "d1", "point"), ["doc_id", "n", "d1"])
    left = stored(left.select("tree", (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), "parts")).alias("tile"), "doc_id", "n", "d1", "component", "point"), "points")
    tops = F.array(*[F.max(F.get("point", F.lit(i))) for i in range(COARSE)])
    boxes = stored(left.groupBy("tree", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("lo"), F.max("component").alias("hi"), tops.alias("top")), "boxes")
    x, y = boxes.alias("x"), boxes.alias("y")
    bound = F.aggregate(F.zip_with("x.top", "y.top", lambda p, q: F.least(p, q)), F.lit(0), lambda total, v: total + v)
    near = F.col("y.high") * 100 >= F.col("x.low") * percent
    near &= (F.col("x.high") * 100 >= F.col("y.low") * percent) & (bound * (100 + percent) >= (F.col("x.low") + F.col("y.low")) * percent)
    apart = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    meeting = x.join(y, F.col("x.tree") == F.col("y.tree")).where((F.col("x.tile") <= F.col("y.tile")) & near & apart)
    meeting = stored(meeting.select("x.tree", F.col("x.tile").alias("t0"), F.col("y.tile").alias("t1")), "meeting")
    sides = [left.join((meeting.where("t0 < t1") if i else meeting).withColumn("tile", F.col(f"t{i}")), ["tree", "tile"]) for i in (0, 1)]
    sides = sides[0].unionByName(sides[1]).select(*place, "tile", "component", *own).join(sets.join(stored(sketches, "sketches"), own).select(*own, "vector", "sketch"), own)
    sides = sides.select(*place, "tile", "component", *own, "sketch", "vector").repartition(*place).sortWithinPartitions(*place)
    # Only what a tree leaves over takes its set along.
    near = stored(sides.mapInArrow(functools.partial(_near, percent=percent), sides.drop("vector").schema), "near")
    near = near.join(sets.select(*own, "shingles"), own).repartition(*place).sortWithinPartitions(*place)
    more = stored(near.mapInArrow(functools.partial(_linked, percent=percent), "a long, b long"), "links")
    # The trees' links are between components: what these become is carried over to their documents.
    up = components(more).select(F.col("id").alias("component"), F.col("component").alias("up"))
    found = found.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")).unionByName(up.select(F.col("component").alias("id"), F.col("up").alias("component")))
    found = found.groupBy("id").agg(F.min("component").alias("component"))
    answer = points.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("id"), "left")
    return answer.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
