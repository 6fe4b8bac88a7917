"""Whitening of embeddings by the covariance of their distinct quantised vectors.

The covariance comes from one aggregation with a generated Spark SQL expression for each pair of dimensions
of the upper triangle, the sum of their centred products; the partial sums of partitions are drawn together
to `GROUPS` rows at most. The driver adds these, assembles the symmetric matrix and decomposes it by LAPACK.
Vectors never leave the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import fresh, stored

#: Pairs of dimensions in one aggregation; 90 dimensions have fewer, more dimensions take several aggregations.
PAIRS = 4096
#: Rows of partial sums that the driver gets, of PAIRS sums at most each.
GROUPS = 64


@dataclass
class Whitening:
    """What `fit_whitening` learns. axes: for each component the unit eigenvector over the root of its eigenvalue,
    falling eigenvalues; none where an eigenvalue is 0 to double precision."""

    dims: int
    scale: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    axes: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0
    #: Whether n * x - sum, squared and summed over the dimensions, is sure to fit a long.
    small: bool = True


def _total(terms: list[str]) -> str:
    """The sum, as a balanced tree."""
    while len(terms) > 1:
        terms = [f"({' + '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)]
    return terms[0]


def _quantised(vectors: DataFrame, column: str, scale: int) -> tuple[DataFrame, str]:
    """The rows with a vector that has no null or non-finite entry, and the name of its quantised form: longs."""
    x = fresh(vectors, "x")
    vector = F.col(column)
    sound = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(sound).withColumn(x, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))), x


def _entries(x: str, dims: int, kind: str) -> list[str]:
    # get, since filters may be pushed past that on the length.
    return [f"CAST(get(`{x}`, {i}) AS {kind})" for i in range(dims)]


def _double(value: float) -> str:
    return f"({float(value)!r}D)"


def _centred(x: str, model: Whitening) -> list[str]:
    return [f"({e} - {_double(s / model.n)})" for e, s in zip(_entries(x, model.dims, "double"), model.sums, strict=True)]


def _named(expressions: list[str], name: str) -> list[str]:
    return [f"{e} AS {name}{i}" for i, e in enumerate(expressions)]


def _sums(rows: DataFrame, terms: list[str]) -> list:
    """The sums of SQL expressions over all rows: one aggregation, to a bounded number of rows. As text, since a
    column object for each of thousands of them would take longer to make than to run."""
    sums = ", ".join(_named([f"sum({t})" for t in terms], "s"))
    parts = rows.sparkSession.sql(f"SELECT {sums} FROM {{rows}} GROUP BY spark_partition_id() % {GROUPS}", rows=rows).collect()
    return [math.fsum(column) if isinstance(column[0], float) else sum(column) for column in zip(*parts, strict=True)]


def covariance(rows: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """The covariance matrix (divisor n) of centred columns: one aggregation over the upper triangle."""
    dims = len(columns)
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    out = np.zeros((dims, dims))
    for a in range(0, len(pairs), PAIRS):
        found = _sums(rows, [f"{columns[i]} * {columns[j]}" for i, j in pairs[a : a + PAIRS]])
        for (i, j), total in zip(pairs[a : a + PAIRS], found, strict=True):
            out[i, j] = out[j, i] = total / n
    return out


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = 4, scale: int = 256) -> Whitening:
    """Principal components of the distinct vectors floor(scale * entry), each counted once.

    Vectors that are null, or hold null or non-finite entries, are left out; so are those of another length
    than most of them (of equally frequent lengths, the longest counts). Quantised entries beyond 64 bits
    stand at their ends. No vectors, or none that differ, give no components.
    """
    rows, x = _quantised(vectors.select(column), column, scale)
    lengths = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("dims")).agg(F.count("*").alias("n"), F.min(F.array_min(x)).alias("low"), F.max(F.array_max(x)).alias("high"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return Whitening(0, scale)
    # The narrowest type that holds all entries: the distinct vectors are what is shuffled.
    width = max(abs(most.low), abs(most.high) + 1)
    kind = "smallint" if width <= 1 << 15 else "int" if width <= 1 << 31 else "bigint"
    fit = stored(rows.where(F.size(column) == most.dims).select(F.col(x).cast(f"array<{kind}>").alias("x")).distinct(), "whitening")
    exact = "long" if width * most.n < 1 << 62 else "decimal(20,0)"
    n, *sums = _sums(fit, ["1", *_entries("x", most.dims, exact)])
    model = Whitening(most.dims, scale, int(n), [int(s) for s in sums])
    model.small = most.dims * (model.n * (most.high - most.low)) ** 2 < 1 << 63
    matrix = covariance(fit.selectExpr(*_named(_centred("x", model), "c")), [f"c{i}" for i in range(most.dims)], model.n)
    values, columns = np.linalg.eigh(matrix)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(components, int((values > max(values[0], 0) * most.dims * np.finfo(float).eps).sum()))
    model.axes = (columns[:, :k] / np.sqrt(values[:k])).T
    model.explained = (values[:k] / np.trace(matrix)).tolist() if k else []
    if k:
        names = [f"w{i}" for i in range(k)]
        white = stored(fit.selectExpr(*_named(_projected("x", model), "w")), "white")
        means = [total / model.n for total in _sums(white, names)]
        spread = covariance(white.selectExpr(*_named([f"{name} - {_double(m)}" for name, m in zip(names, means, strict=True)], "w")), names, model.n)
        model.identity_error = float(np.abs(spread - np.eye(k)).max())
    return model


def _projected(x: str, model: Whitening) -> list[str]:
    centred = _centred(x, model)
    return [_total([f"{c} * {_double(w)}" for c, w in zip(centred, axis, strict=True)]) for axis in model.axes]


def _deviation(x: str, model: Whitening) -> str:
    entries = _entries(x, model.dims, "long")
    if model.small:
        return _total([f"({model.n}L * {e} - ({s}L)) * ({model.n}L * {e} - ({s}L))" for e, s in zip(entries, model.sums, strict=True)])
    parts = [f"try_subtract(try_multiply({model.n}L, {e}), try_cast('{s}' AS long))" for e, s in zip(entries, model.sums, strict=True)]
    terms = [f"try_multiply({d}, {d})" for d in parts]
    while len(terms) > 1:
        terms = [f"try_add({', '.join(terms[i : i + 2])})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows of `vectors` that have a vector of the model's length without null or non-finite entries, with
    the columns deviation long (the sum of (n * x - sum) ** 2 over the dimensions; null where that is beyond
    64 bits) and whitened array<double>, one a component. If `vectors` has columns of these names, the
    new ones begin with `_`; they come last. A model without components leaves the array empty."""
    rows, x = _quantised(vectors, column, model.scale)
    deviation, whitened = fresh(vectors, "deviation"), fresh(vectors, "whitened")
    if not model.dims:
        return vectors.where("false").select("*", F.lit(0).cast("long").alias(deviation), F.array().cast("array<double>").alias(whitened))
    rows = rows.where(F.size(column) == model.dims)
    return rows.select(*vectors.columns, F.expr(_deviation(x, model)).alias(deviation), F.expr(f"CAST(array({', '.join(_projected(x, model))}) AS array<double>)").alias(whitened))


def whitened_components(vectors: DataFrame, components: int = 4, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row of `vectors`
    that `whiten` keeps and each component. Rows with equal or null ids count as they are; other columns
    are not read. Equal eigenvalues leave their components' order open, as they leave their directions."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("vector"))
    model = fit_whitening(rows, "vector", components, scale)
    white = whiten(rows, model, "vector")
    if not model.explained:
        white = white.where("false")
    # stack, since an explode has the optimizer compute its array once more in a filter.
    each = [x for k, e in enumerate(model.explained or [0.0]) for x in (F.lit(k + 1), F.get("whitened", F.lit(k)), F.lit(float(e)))]
    long = white.select("vec_id", "deviation", F.stack(F.lit(len(each) // 3), *each).alias("component", "whitened", "explained"))
    return long.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).alias("identity_error"))
