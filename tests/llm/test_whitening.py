"""Whitening against numpy, with exact integers."""

import math
import random

import numpy as np
import pytest

from quern.llm import whitening
from quern.llm.whitening import fit_whitening, whiten, whitened_components

SCHEMA = "vec_id long, embedding array<float>, x string, component int, deviation long, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], SCHEMA).repartition(5)


def quantised(v):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def sound(v):
    return v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)


def vectors(seed=0, n=300, dims=6):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + 3
    return [(i, v.tolist()) for i, v in enumerate(mixed)]


@pytest.mark.parametrize("pairs", [4096, 5])
def test_components_equal_numpy(spark, pairs, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", pairs)
    rows = vectors()
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(200)] + [(7, hot), (None, rows[3][1])]
    rows += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0, 2.0]), (2005, [])]
    good = [(i, v) for i, v in rows if sound(v) and len(v) == 6]
    fit = np.array(sorted({quantised(v) for _, v in good}))
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    got = whitened_components(frame(spark, rows)).collect()
    assert len(got) == 4 * len(good)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, v in good:
        x = quantised(v)
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(4):
            want = (np.array(x) - np.array(sums) / n) @ axes[:, k] / math.sqrt(values[k])
            for r in by[i, k + 1]:
                assert r.n == n and r.deviation == deviation and r.identity_error <= 1e-9
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
                assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-8)
                if abs(want) > 1e-3:
                    signs.setdefault(k, set()).add(r.whitened * want > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_degenerate_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitened_components(frame(spark, rows))
        assert got.columns == columns and got.collect() == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    got = whitened_components(frame(spark, line)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_large_entries(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e30, 1e30), rng.uniform(-1, 1) * 1e15]) for i in range(20)]
    got = whitened_components(frame(spark, rows)).collect()
    assert got and all(r.deviation is None for r in got) and got[0].identity_error < 1e-6
    rows = [(i, [float(rng.randrange(1 << 20)), float(rng.randrange(1 << 20))]) for i in range(300)]
    fit = sorted({quantised(v) for _, v in rows})
    sums = [sum(c) for c in zip(*fit, strict=True)]
    want = {i: sum((len(fit) * a - s) ** 2 for a, s in zip(quantised(v), sums, strict=True)) for i, v in rows}
    got = {r.vec_id: r.deviation for r in whitened_components(frame(spark, rows)).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()}


def test_clashing_names_stay(spark):
    table = frame(spark, vectors(n=20))
    white = whiten(table, fit_whitening(table, components=2))
    assert white.columns == [*table.columns, "_deviation", "whitened"]
    assert {r.deviation for r in white.collect()} == {2} and {len(r.whitened) for r in white.collect()} == {2}
