"""Near-duplicate embeddings by quantised tile products.

Vectors of one label are dealt to tiles; two tiles at a time are multiplied in 8-bit integers. Each
vector's quantisation error is known exactly, so a product and the two errors bound the cosine from
above: pairs that stay below the threshold are settled, the others are computed anew in double
precision. Vectors with equal components are one vector with a count.

A task holds two tiles, whatever the label's size. What it returns is per vector (how many others it
met, and one of those it is connected with), never per pair.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.components import components
from quern.llm.shared import stored

#: int8 products up to 127 * 127 * 1040 stay exact in the 24 bits of a float's fraction.
_EXACT = 1040


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, errors): |row - scale * int8 row| is at most the row's error."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - scale[:, None] * q, axis=1) + 1e-12
    return q.astype(np.int8), scale, error


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, by single-precision blocks of at most _EXACT columns."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y (None: of x, i < j) with cosine >= threshold in double precision."""
    same = y is None
    y = x if same else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    found_i, found_j = [], []
    for a in range(0, len(x), block):
        z = slice(a, a + block)
        # |<x, y> - <x', y'>| <= |x - x'| |y'| + |x| |y - y'|, with |y'| <= 1 + error of y.
        bound = int8_products(qx[z], qy) * np.outer(sx[z], sy) + ex[z, None] * (1 + ey)[None, :] + ey[None, :]
        i, j = np.nonzero(bound >= threshold - 1e-9)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v]) >= threshold
            found_i.append(u[hit])
            found_j.append(v[hit])
    return np.concatenate(found_i or [np.empty(0, int)]), np.concatenate(found_j or [np.empty(0, int)])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links i-j reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(table: pa.Table, threshold: float) -> pa.Table:
    """Rows of two tiles (or of one) to (vec_id, links, reached)."""
    table = table.combine_chunks()
    tile = table.column("tile").to_numpy()
    first = tile == tile.min()
    ids, counts = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
    vectors = table.column("embedding").combine_chunks()
    vectors = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
    order = np.lexsort((ids, ~first))
    ids, counts, vectors, first = ids[order], counts[order], vectors[order], first[order]
    n = int(first.sum())
    one = table.column("one").to_numpy()[0]
    i, j = tile_links(vectors, None, threshold) if one else tile_links(vectors[:n], vectors[n:], threshold)
    if not one:
        j = j + n
    links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), int)
    rank[by_id] = np.arange(len(ids))
    reached = ids[by_id][_roots(len(ids), rank[i], rank[j])[rank]]
    met = links > 0
    return pa.table({"vec_id": ids[met], "links": links[met].astype(np.int64), "reached": reached[met]})


def near_duplicate_embeddings(vectors: DataFrame, threshold: float = 0.93, tile: int = 1024, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null, by cosine in double precision; pairs
    at or above `threshold` are linked. A vector that is null, empty, zero, or holds a null or a
    non-finite component links with nothing, and is its own component; so do vectors of unlike
    lengths among themselves. Rows with equal labels and components link with each other (they are told by
    two 64-bit hashes). A row with a null id links with nothing, has no component and is kept; rows that repeat
    an id are compared as rows of that id. Other columns are not read. An empty table gives an empty one.
    """
    kind = vectors.schema[embedding].dataType
    # Single-precision components travel as they are; everything else as double.
    own = F.col(embedding) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), own.alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")})
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    classes = rows.where(sound).groupBy("label", "h1", "h2", F.size("embedding").alias("size")).agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = stored(classes, "vectors")
    sizes = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = classes.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, ["label", "size"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meeting = pairs.select("label", "size", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), "tile", (F.col("tile") == F.col("other")).alias("one"), "vec_id", "copies", "embedding")
    schema = T.StructType().add("vec_id", "long").add("links", "long").add("reached", "long")
    met = stored(meeting.groupBy("label", "size", "t0", "t1").applyInArrow(lambda rows: _meet(rows, threshold), schema), "links")
    found = components(met.select(F.col("vec_id").alias("a"), F.col("reached").alias("b")))
    links = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "vec_id", "left").join(found, classes["vec_id"] == found["id"], "left")
    per_class = per_class.select("label", "h1", "h2", "size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    asked = rows.select("vec_id", *(F.when(sound, F.col(c)).alias(c) for c in ("label", "h1", "h2")), F.size("embedding").alias("size"))
    answer = asked.join(per_class, ["label", "h1", "h2", "size"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return answer.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
