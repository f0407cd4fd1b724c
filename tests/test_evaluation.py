"""Recovery, domains, simulation and the spatial factor model against brute force and dense algebra."""

import numpy as np
import pytest

from sliceloom.operators import domains as D
from sliceloom.operators import recovery as R
from sliceloom.plans import evaluation as E
from sliceloom.plans import fit as M
from sliceloom.plans import simulate as Z
from sliceloom.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("targets", [[], [3.0], [3.0, 3.0, 4.0, 20.0], [100.0] * 5, [0.0] * 9])
def test_closest_slices(spark, targets):
    ages = [1.0, 2.0, 3.0, 3.0, 5.0, 9.0, 30.0]
    got = D.closest_slices(spark.createDataFrame([(f"s{i}", a) for i, a in enumerate(ages)] + [("none", None)], "slice string, age double"), targets).collect()
    used, want = set(), []
    for t in targets:
        free = sorted((abs(a - t), a, f"s{i}") for i, a in enumerate(ages) if f"s{i}" not in used)
        if free:
            used.add(free[0][2])
            want.append((free[0][2], free[0][1], t))
    assert sorted(map(tuple, got)) == sorted(want)


def test_align_over_time_follows_moving_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(5):
        names = rng.permutation(3)
        for k in range(3):
            rows += [(t, float(t), int(names[k]), 10.0 * k + 0.5 * t + rng.normal(0, 0.1), rng.normal(), k + 1) for _ in range(6)]
    cells = spark.createDataFrame(rows, "slice long, age double, label long, x double, y double, truth int")
    got = cells.join(D.align_over_time(cells, ["x", "y"]), ["slice", "label"])
    assert got.where("aligned <> truth").count() == 0 and got.count() == len(rows)


def test_align_over_time_restarts_where_the_number_of_labels_changes(spark):
    rows = [(0, 0.0, 0, 5.0), (0, 0.0, 1, 1.0), (1, 1.0, 0, 9.0), (1, 1.0, 1, 2.0), (1, 1.0, 2, 4.0)]
    got = D.align_over_time(spark.createDataFrame(rows, "slice long, age double, label long, x double"), ["x"])
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {(0, 0): 2, (0, 1): 1, (1, 0): 3, (1, 1): 1, (1, 2): 2}


def test_align_to_truth(spark):
    rows = [("a", "1", "p")] * 5 + [("a", "2", "q")] * 3 + [("a", "1", "r")] * 2 + [("a", None, "s")] + [("b", "2", "p")] * 2 + [("b", "3", None)]
    df = spark.createDataFrame(rows, "slice string, truth string, pred string")
    got = {(r[0], r[1]): r[2] for r in D.align_to_truth(df, "truth", "pred", ["1", "2"], "slice").collect()}
    assert got == {("a", "p"): "1", ("a", "q"): "2", ("a", "r"): "1", ("a", "s"): D.UNASSIGNED, ("b", "p"): "2"}
    with_fallback = D.align_to_truth(df.selectExpr("*", "'2' AS marker"), "truth", "pred", ["1", "2"], "slice", "marker")
    assert {(r[0], r[1]): r[2] for r in with_fallback.collect()}[("a", "s")] == "2"


def test_subspace_similarity():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 9))
    assert R.subspace_similarity(a, rng.normal(size=(3, 3)) @ a) == pytest.approx(1, abs=1e-6)
    assert R.subspace_similarity(np.eye(6)[:3], np.eye(6)[3:]) == pytest.approx(1 - np.pi / 2)


@pytest.mark.parametrize("rank", [0, 2])
def test_low_rank_signal(spark, rank):
    cells = A.spatial_cells(spark, SF)
    n, mean, gram = E._moments(cells)
    got = R.low_rank_signal(cells, gram, mean, n, rank).orderBy("cell").toPandas()
    y = np.stack(cells.orderBy("cell").toPandas()["genes"].to_list())
    u, s, vt = np.linalg.svd(y - y.mean(axis=0), full_matrices=False)
    want = (u[:, :rank] * s[:rank]) @ vt[:rank] + y.mean(axis=0)
    assert np.allclose(np.stack(got["signal"].to_list()), want)


@pytest.mark.parametrize("dispersion", [None, 10.0])
def test_simulated_counts(dispersion):
    data = Z.counts(Z.generate(), dispersion=dispersion, library=500.0, share=0.3)
    assert data["share"] == pytest.approx(0.3, abs=1e-6)
    assert np.mean([s["counts"].sum(axis=1).mean() for s in data["slices"]]) == pytest.approx(500, rel=0.05)
    assert (data["tiers"][(data["w"] > 0).any(axis=0)] == "marker").all() and (data["tiers"] == "housekeeping").sum() == 12
    assert all(s["counts"].shape == s["y"].shape for s in data["slices"])
    with pytest.raises(ValueError):
        Z.counts(Z.generate(), share=1.0)


def test_spatial_factor_model_against_dense_algebra(spark):
    rng = np.random.default_rng(2)
    rows, cell = [], 0
    for t in range(2):
        for _ in range(15):
            rows.append(("f", t, float(t), cell, *rng.normal(size=2).tolist(), rng.normal(size=6).tolist()))
            cell += 1
    cells = spark.createDataFrame(rows, "fit string, slice long, age double, cell long, x double, y double, genes array<double>")
    got = Z.spatial_pca_keys(M.spectral_rows(cells, 2.0), 2, scaled=False).toPandas()
    n, values, kernel = len(rows), np.array([r[6] for r in rows]), np.zeros((len(rows), len(rows)))
    for t in range(2):
        at = [i for i, r in enumerate(rows) if r[1] == t]
        xy = np.array([rows[i][4:6] for i in at])
        xy = (xy - xy.mean(axis=0)) / xy.std(axis=0, ddof=1)
        kernel[np.ix_(at, at)] = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / 2) + 1e-8 * np.eye(len(at))
    one, centre = np.ones((n, 1)), np.eye(n) - np.ones((n, n)) / n

    def dense(x):
        inverse = np.linalg.inv(np.exp(x) * kernel + np.eye(n))
        weight = (one.T @ inverse @ one)[0, 0]
        explained = values.T @ (centre - inverse + inverse @ one @ one.T @ inverse / weight) @ values
        top, vectors = np.linalg.eigh(explained)
        left = np.trace(values.T @ centre @ values) - top[-2:].sum()
        cost = np.log(weight) - np.linalg.slogdet(inverse)[1] + 6 * (n - 1) / 2 * np.log(left)
        return cost, left, vectors[:, ::-1][:, :2], inverse, weight

    tau = got[got.kind == "tau"]["value"].iloc[0]
    grid = np.linspace(-10, 10, 401)
    assert dense(np.log(tau))[0] <= min(dense(x)[0] for x in grid) + 1e-6
    _, left, w, inverse, weight = dense(np.log(tau))
    assert got[got.kind == "error"]["value"].iloc[0] == pytest.approx(left / (6 * (n - 1)))
    scores = tau * kernel @ inverse @ (values - one @ (one.T @ inverse @ values) / weight) @ w
    for j in range(2):
        mine = got[(got.kind == "loading") & (got.program == j)].sort_values("key")["value"].to_numpy()
        assert abs(mine @ w[:, j]) == pytest.approx(1)
        found = got[(got.kind == "score") & (got.program == j)].sort_values("key")["value"].to_numpy()
        assert np.allclose(found * np.sign(mine @ w[:, j]), scores[:, j])
