"""Smooth trends, conditions and paths against dense algebra and loops."""

import math

import numpy as np
import pytest

from sliceloom.operators import cells as C
from sliceloom.operators import trends as T


def _penalised(x, y):
    """Of the natural cubic splines with least sum of squares + p times the integral of the squared second derivative: (curve of p, generalised cross-validation of p), from their basis."""
    n = len(x)
    up = lambda v, k, e: np.maximum(v - k, 0) ** e
    last, one = x[-1], x[-2]
    knots = lambda t: np.stack([np.ones(len(t)), t, *[(up(t, k, 3) - up(t, last, 3)) / (last - k) - (up(t, one, 3) - up(t, last, 3)) / (last - one) for k in x[:-2]]], axis=1)
    fine = np.linspace(x[0], x[-1], 20001)
    bend = np.stack([0 * fine, 0 * fine, *[6 * (up(fine, k, 1) - up(fine, last, 1)) / (last - k) - 6 * (up(fine, one, 1) - up(fine, last, 1)) / (last - one) for k in x[:-2]]], axis=1)
    weight = np.full(len(fine), fine[1] - fine[0])
    weight[[0, -1]] /= 2
    b, omega = knots(x), (bend.T * weight) @ bend
    fit = lambda p: np.linalg.solve(b.T @ b + p * omega, b.T)
    gcv = lambda p: n * float(((y - b @ fit(p) @ y) ** 2).sum()) / (n - np.trace(b @ fit(p))) ** 2
    return (lambda p, t: knots(t) @ fit(p) @ y), gcv


def test_spline_is_the_penalised_one_with_the_best_validation():
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 24))
    y = np.sin(x) + rng.normal(0, 0.4, 24)
    curve, gcv = _penalised(x, y)
    grid = np.linspace(-9, 9, 601)
    best = grid[np.argmin([gcv(np.exp(p)) for p in grid])]
    assert grid[0] < best < grid[-1]
    for step in (2e-3, 1e-4):  # closer and closer
        near = best + step * np.arange(-15, 16)
        best = near[np.argmin([gcv(np.exp(p)) for p in near])]
    at = np.linspace(x[0], x[-1], 40)
    np.testing.assert_allclose(T.smoothing_spline(x, y, at), curve(np.exp(best), at), atol=1e-3)
    line = 3 * x - 2
    np.testing.assert_allclose(T.smoothing_spline(x, line, at), 3 * at - 2, atol=1e-6)
    np.testing.assert_allclose(T.smoothing_spline(np.array([0.0, 1, 3]), np.array([1.0, 3, 3]), np.array([0.5, 2.0])), [2, 3])


def test_trend_of_groups(spark):
    rows = [("a", float(i), float(2 * i + j)) for i in range(6) for j in (0, 2)] + [("b", 4.0, 7.0), ("b", 4.0, 9.0), ("c", None, 1.0), ("a", 1.0, None)]
    got = T.smooth_trend(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", 11).collect()
    a = sorted((r["x"], r["y"]) for r in got if r["g"] == "a")
    assert len(a) == 11 and all(y == pytest.approx(2 * x + 1, abs=1e-5) for x, y in a)
    assert [(r["x"], r["y"]) for r in got if r["g"] == "b"] == [(4.0, 8.0)] and not [r for r in got if r["g"] == "c"]


def test_condition(spark):
    rows = [("good", i, j, float(i == j)) for i in range(3) for j in range(3)] + [("bad", i, j, [[1.0, 1.0 - 1e-9], [1.0 - 1e-9, 1.0]][i][j]) for i in range(2) for j in range(2)] + [("none", 0, 0, 0.0)]
    frame = spark.createDataFrame(rows, "g string, s1 int, s2 int, k double")
    got = {r["g"]: (r["size"], r["status"], r["condition"]) for r in T.kernel_condition(frame, ["g"]).collect()}
    assert got["good"] == (3, "well-conditioned", pytest.approx(1.0)) and got["bad"][:2] == (2, "ill-conditioned") and got["none"][1:] == ("ill-conditioned", math.inf)
    assert T.kernel_condition(frame.where("g = 'good'")).first()["size"] == 3


def test_paths_branch_at_the_middle_and_times_grow_along_them(spark):
    centres = {"root": (0, 0), "mid": (4, 0), "up": (8, 4), "down": (8, -4)}
    assert T.spanning_paths(np.array(list(centres.values()), float), 0) == [[0, 1, 2], [0, 1, 3]] and T.spanning_paths(np.zeros((1, 2)), 0) == [[0]]
    rng = np.random.default_rng(1)
    rows = [(i, name, [float(v) for v in np.array(c) + rng.normal(0, 0.3, 2)]) for i, (name, c) in enumerate(x for x in centres.items() for _ in range(40))]
    cells = spark.createDataFrame([*rows, (999, None, [0.0, 0.0])], "cell long, label string, v array<double>").repartition(3)
    got = T.path_times(cells, "label", "v").collect()
    assert len(got) == 320 and {r["lineage"] for r in got} == {1, 2}
    mean = {n: np.mean([v for _, m, v in rows if m == n], axis=0) for n in centres}
    by = {(r["cell"], r["lineage"]): r for r in got}
    for (cell, label, v), lineage in ((row, k) for row in rows[::7] for k in (1, 2)):
        path = [mean["root"], mean["mid"], mean["down" if lineage == 1 else "up"]]
        fine = [(sum(np.linalg.norm(b - a) for a, b in zip(path, path[1 : s + 1])) + t * np.linalg.norm(path[s + 1] - path[s]), np.linalg.norm(v - (path[s] + t * (path[s + 1] - path[s])))) for s in (0, 1) for t in np.linspace(0, 1, 4001)]
        time, distance = min(fine, key=lambda f: f[1])
        r = by[cell, lineage]
        assert r["distance"] == pytest.approx(distance, abs=1e-3) and r["time"] == pytest.approx(time, abs=0.02)
        assert r["on_path"] == (label in ("root", "mid", "down" if lineage == 1 else "up"))
    order = [np.mean([r["unified"] for r in got if r["label"] == n]) for n in ("root", "mid", "up")]
    assert order[0] < order[1] < order[2]
    assert T.path_times(cells.limit(0), "label", "v").count() == 0


def test_normalised_values_and_ages(spark):
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 5, (30, 6)) * (rng.random((30, 6)) < 0.6)
    dense[:, 5] = 0
    counts = spark.createDataFrame([(i, g, float(v)) for i, row in enumerate(dense) for g, v in enumerate(row) if v], "cell long, gene long, value double")
    cells = spark.createDataFrame([(i, i % 3) for i in range(30)], "cell long, slice int")
    stored, zero = C.gene_zscores(counts, cells)
    z0 = {r["gene"]: r["zero"] for r in zero.collect()}
    sd = dense.std(axis=0, ddof=1)
    want = (dense - dense.mean(axis=0)) / np.where(sd < 1e-12, 1, sd)
    full = np.array([[z0.get(g, 0.0) for g in range(6)] for _ in range(30)])
    for r in stored.collect():
        full[r["cell"], r["gene"]] = r["z"]
    np.testing.assert_allclose(full[:, :5], want[:, :5], atol=1e-9)
    library = dense.sum(axis=1, keepdims=True)
    scaled = np.log1p(dense * np.minimum(np.median(library[library > 0]) / np.maximum(library, 1e-12), 10))
    centre = np.mean([scaled[s::3].mean(axis=0) for s in range(3)], axis=0)
    values, centres = C.balanced_values(counts, cells)
    assert {r["gene"]: r["centre"] for r in centres.collect()} == pytest.approx({g: centre[g] for g in range(5)})
    for r in values.collect():
        assert r["value"] == pytest.approx(scaled[r["cell"], r["gene"]] - centre[r["gene"]])
    check = C.centering(counts, cells).first()
    assert check["largest"] == pytest.approx(dense.mean(axis=0).max()) and not check["centred"]
    ages = lambda *a: sorted(r["z"] for r in C.standard_ages(spark.createDataFrame([(i, v) for i, v in enumerate(a)], "slice int, age double")).collect())
    assert ages(3.0) == [0.0] and ages(2.0, 2.0, 2.0) == [0.0] * 3 and ages(1.0, 3.0) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
