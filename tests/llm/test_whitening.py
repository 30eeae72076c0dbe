"""Whitening against numpy's dense eigenvectors, and LOBPCG on spectra that are hard."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rollcall.llm.whitening import Centred, leading_eigenvectors, whiten


def plain(vectors, k=8):
    """x, deviations, and |projections| of each vector by a dense decomposition."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = ((n * x - s) ** 2).sum(axis=1)
    return deviation, centred @ basis / np.sqrt(values), values / (centred**2).sum() * n


def spread_vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, d)) @ (np.diag(1 / np.arange(1, d + 1)) @ rng.standard_normal((d, d)))
    return (mixed * 0.2).astype(np.float32)


@pytest.mark.parametrize("n,d", [(300, 40), (50, 5), (9, 20)])
def test_equals_dense_eigenvectors(spark, n, d):
    vectors = spread_vectors(n, d)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, component int, x string")
    got = whiten(rows.repartition(5)).collect()
    k = min(8, d, n - 1)
    assert len(got) == n * k
    deviation, projected, explained = plain(vectors, k)
    found = np.zeros((n, k))
    for r in got:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9 and r["residual"] < 1e-9
    signs = np.sign((found * projected).sum(axis=0))
    assert np.abs(found * signs - projected).max() < 1e-8


def test_nulls_and_non_finite_entries_are_dropped(spark):
    good = [(i, v.tolist()) for i, v in enumerate(spread_vectors(40, 6, 3))]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5), (105, [1.0, 2.0]), (106, [1e38] * 6)]
    more = [(None, good[0][1]), (3, good[3][1])]  # a null id, and a repeated row
    rows = good + bad + more
    random.Random(1).shuffle(rows)
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), components=4).collect()
    assert {r["vec_id"] for r in got} == {*range(40), None} and {r["n"] for r in got} == {42}
    assert sum(r["vec_id"] == 3 for r in got) == 8
    deviation, projected, _ = plain([v for _, v in good + more], 4)
    assert {r["vec_id"]: r["deviation"] for r in got}[7] == deviation[7]


def test_tables_without_variance_have_no_components(spark):
    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.5, 2.0])], kind)).count() == 0
    assert whiten(spark.createDataFrame([(i, [0.5, 2.0]) for i in range(4)], kind)).count() == 0
    flat = whiten(spark.createDataFrame([(i, [0.1 * i, 2.0, -0.2 * i]) for i in range(4)], kind)).collect()
    assert {r["component"] for r in flat} == {1, 2}  # rounded to whole numbers the line has a second direction
    assert {r["component"] for r in whiten(spark.createDataFrame([(i, [1.0 * i, 2.0, -2.0 * i]) for i in range(4)], kind)).collect()} == {1}


@pytest.mark.parametrize("name", ["close", "equal", "steep", "flat"])
def test_lobpcg_on_hard_spectra(name):
    d = 120
    spectrum = {
        "close": np.linspace(1.0, 0.9, d),
        "equal": np.repeat([3.0, 2.0, 1.0], d // 3),
        "steep": 10.0 ** -np.arange(d),
        "flat": np.append(5.0, np.full(d - 1, 1e-3)),
    }[name]
    turn, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))
    matrix = (turn * spectrum) @ turn.T
    values, basis, residual = leading_eigenvectors(lambda b: matrix @ b, d, 8)
    assert np.allclose(values, np.sort(spectrum)[::-1][:8], rtol=0, atol=1e-11 * spectrum.max()) and residual <= 1e-9
    assert np.abs(basis.T @ basis - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(matrix @ basis - basis * values, axis=0).max() <= 1e-9 * spectrum.max()


def test_deviations_are_exact_or_null():
    x = np.array([[100_000, 99_000], [100_003, 101_000], [3, 5]], np.int64)
    centre = Centred(3, [int(s) for s in x.sum(axis=0)])
    assert centre.deviations(x) == [sum((3 * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    many = 10**9  # as if the rows came so often
    centre = Centred(3 * many, [int(s) * many for s in x.sum(axis=0)])
    assert centre.deviations(x) == [None] * 3
