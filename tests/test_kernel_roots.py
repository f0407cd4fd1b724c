"""Slices beyond a dense kernel: the root of the kernel gives what the matrix gives, in rows that do not grow with the square of the slice."""

import numpy as np
import pytest

from sliceloom.plans import fit as M
from sliceloom.plans import simulate as Z
from sliceloom.plans import spread as S
from sliceloom.plans import synthetic as Y


@pytest.fixture(scope="module")
def cells(spark):
    rng, rows, loadings = np.random.default_rng(4), [], np.abs(np.random.default_rng(1).normal(size=(2, 4)))
    for s, n in enumerate((320, 1, 260, 5)):
        xy = rng.normal(size=(n, 2))
        xy[: n // 10] = xy[0]  # many cells in one place
        score = np.stack([np.full(n, 1.0 + s), np.sin(xy[:, 0] * 2) + 2], axis=1)
        values = score @ loadings + rng.normal(0, 0.2, (n, 4))
        rows += [("f", s, float(s), 1000 * s + i, *map(float, xy[i]), values[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "fit string, slice long, age double, cell long, x double, y double, genes array<double>").repartition(3)


@pytest.fixture(scope="module")
def both(spark, cells):
    """Spectral rows of dense kernels and of roots."""
    out = []
    for whole in (1000, 20):
        M.WHOLE, before = whole, M.WHOLE
        try:
            made = M.spectral_rows(cells, 2.0)
        finally:
            M.WHOLE = before
        out.append(spark.createDataFrame(made.toPandas(), made.schema).repartition(2))
    return out


def _sorted(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def test_rows_of_a_root(both):
    dense, low = (x.toPandas() for x in both)
    assert len(dense) == 586 and dense["times"].sum() == low["times"].sum() == 586
    assert len(low) < 400 and low["vector"].isna().sum() == 2 and low["cells"].notna().sum() < 10
    for s in (0, 2):
        a, b = dense[dense["slice"] == s], low[low["slice"] == s]
        lam = np.sort(np.repeat(b["lam"], b["times"]))
        np.testing.assert_allclose(lam, np.sort(a["lam"]), atol=1e-10)
        v = np.stack(b["vector"].dropna().to_list())
        np.testing.assert_allclose(v @ v.T, np.eye(len(v)), atol=1e-9)
        for c in (1e-3, 1.0):  # sums that the fit takes over rows
            sums = lambda t, c=c: sum(np.outer(y, y) / (c + x) for x, y in zip(t["lam"], np.column_stack((np.stack(t["values"]), t["u"])), strict=True))
            np.testing.assert_allclose(sums(b), sums(a), rtol=1e-6)


@pytest.mark.parametrize("auto", [False, True])
def test_fits_agree(both, auto):
    dense, low = (_sorted(M.fit_keys(x, 2, 3, auto), ["kind", "program", "key"]) for x in both)
    assert (dense[["kind", "program", "key"]] == low[["kind", "program", "key"]]).all().all() and (dense["kind"] == "score").sum() == (dense["kind"] == "field").sum() > 585
    np.testing.assert_allclose(low[["value", "sd"]].astype(float), dense[["value", "sd"]].astype(float), atol=1e-5)
    few = M.fit_keys(both[1].drop("vector", "cells"), 2, 3, auto, scores=False).toPandas()
    assert len(few) == (~dense["kind"].isin(["score", "field"])).sum()


def test_spread_fit_and_components_agree(both):
    dense, low = (_sorted(S.fit_spread(x, "f", 2, 3, most=4, sweeps=1), ["kind", "program", "key"]) for x in both)
    assert (dense[["kind", "program", "key"]] == low[["kind", "program", "key"]]).all().all()
    np.testing.assert_allclose(low[["value", "sd"]].astype(float), dense[["value", "sd"]].astype(float), atol=1e-6)
    dense, low = (_sorted(Z.spatial_pca_keys(x, 2), ["kind", "program", "key"]) for x in both)
    assert len(dense) == 2 + 2 * 4 + 2 * 586
    np.testing.assert_allclose(low["value"], dense["value"], atol=1e-5)


def test_draws_agree(cells, monkeypatch):
    design = Y.Design(genes=6, k=3, age=(3.0, 1.0), space=(2.0, 0.0))
    values = []
    for whole in (1000, 20):
        monkeypatch.setattr(Y, "WHOLE", whole)
        values.append(np.stack(Y.draw(cells, design).orderBy("cell").toPandas()["b"]))
    np.testing.assert_allclose(values[1], values[0], atol=1e-5)
    assert values[0][:, 0].any() and not values[0][:, 1].any()
