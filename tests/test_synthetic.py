"""Synthetic values on given cells: laws of what is drawn, independence of partitions, recovery."""

import numpy as np
import pytest

from sliceloom.plans import synthetic as Z


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), float(3 * s), 100 * s + i, float(rng.uniform(0, 50)), float(rng.uniform(0, 50))) for s in range(5) for i in range((40, 30, 35, 1, 25)[s])]
    return spark.createDataFrame(rows, "slice long, age double, cell long, x double, y double").repartition(3)


def test_loadings_overlap_as_asked():
    for overlap, least in ((0.0, 0), (0.25, 2), (0.5, 4)):
        w = Z.loadings(Z.Design(genes=60, k=8, overlap=overlap))
        assert np.allclose(w.sum(axis=1), 1) and (w[w > 0] >= 1 / 16).all() and ((w > 0).sum(axis=1) <= 8).all()
        if not overlap:
            assert ((w > 0).sum(axis=0) <= 1).all()
    assert (Z.loadings(Z.Design(), 1) != Z.loadings(Z.Design(), 2)).any() and (Z.loadings(Z.Design(), 1) == Z.loadings(Z.Design(), 1)).all()
    assert Z.make_seed("a", 1) == Z.make_seed("a", 1) != Z.make_seed("a", 2) and 0 <= Z.make_seed("x") < 2**31


def test_trajectories_and_zero_variances():
    ages = np.array([1.0, 2, 4, 8])
    a = Z.trajectories(ages, Z.Design(age=(4.0, 0.0), space=(1.0, 1.0)))
    assert a.shape == (2, 4) and a[0].any() and not a[1].any() and not Z.gaussian(np.zeros((3, 3)), np.random.default_rng(0)).any()
    draws = np.array([Z.trajectories(ages, Z.Design(age=(4.0,), space=(1.0,), kind="ar1", rho=0.6), r)[0] for r in range(4000)])
    np.testing.assert_allclose(np.cov(draws.T), 4 * 0.6 ** np.abs(np.subtract.outer(np.arange(4), np.arange(4))), atol=0.4)
    with pytest.raises(ValueError, match="kernel"):
        Z.trajectories(ages, Z.Design(kind="other"))


def test_draws_do_not_depend_on_partitions_and_add_up(cells):
    design = Z.Design(genes=20, k=5, age=(3.0, 1.0), space=(2.0, 0.0), error=1e-12)
    got = {r["cell"]: r for r in Z.draw(cells, design, 2).collect()}
    again = {r["cell"]: r for r in Z.draw(cells.repartition(7), design, 2).collect()}
    assert got == again and len(got) == cells.count()
    w, paths = Z.truth(cells, design, 2)
    alpha = {(int(r["program"]), r["slice"]): r["alpha"] for r in paths.collect()}
    loading = np.zeros((2, 20))
    for r in w.collect():
        loading[int(r["program"]), r["gene"]] = r["weight"]
    for r in got.values():
        np.testing.assert_allclose(r["h"], [alpha[j, r["slice"]] + r["b"][j] for j in (0, 1)])
        np.testing.assert_allclose(r["genes"], np.array(r["h"]) @ loading, atol=1e-4)
        assert r["b"][1] == 0.0
    flat = Z.draw(cells, Z.Design(genes=20, k=5, age=(3.0, 1.0), space=(2.0, 0.0), spatial=False), 2)
    assert flat.where("exists(b, x -> x <> 0)").count() == 0


@pytest.mark.parametrize("dispersion", [None, 10.0])
def test_counts_reach_share_and_library(cells, dispersion):
    design = Z.Design(genes=30, k=6, age=(1.0, 0.5), space=(0.5, 0.5))
    drawn, w = Z.draw(cells, design), Z.loadings(design)
    rows, tiers, share = Z.draw_counts(drawn, w, dispersion=dispersion, library=400.0, share=0.3)
    got = rows.collect()
    assert share == pytest.approx(0.3, abs=1e-6) and set(tiers) == {"marker", "housekeeping", "mostly_off"}
    h, ids = np.array([r["h"] for r in got]), np.array([r["cell"] for r in got])
    c = Z.offsets(ids, Z.make_seed("counts", 0), 0.4)
    n, h1, h2, ch, c1, c2 = Z.signal_moments(drawn, 2, Z.make_seed("counts", 0), 0.4)
    np.testing.assert_allclose((n, *h1, *h2.ravel(), *ch, c1, c2), (len(h), *h.sum(axis=0), *(h.T @ h).ravel(), *(h.T @ c), c.sum(), c @ c), atol=1e-8)
    totals = np.array([sum(r["counts"]) for r in got])
    assert totals.mean() == pytest.approx(400, rel=0.15) and all(len(r["counts"]) == 30 for r in got)
    assert sorted((r["cell"], r["counts"]) for r in got) == sorted((r["cell"], r["counts"]) for r in Z.draw_counts(drawn.repartition(5), w, dispersion=dispersion, library=400.0, share=0.3)[0].collect())
    big = Z.offsets(np.arange(200_000), 5, 0.4)
    assert big.mean() == pytest.approx(0, abs=0.005) and big.std() == pytest.approx(0.4, rel=0.01)
    with pytest.raises(ValueError, match="share"):
        Z.draw_counts(drawn, w, share=1.0)


def test_share_is_that_of_the_dense_matrix(cells):
    design = Z.Design(genes=25, k=5, age=(1.0, 0.5), space=(0.5, 0.5))
    drawn, w, seed = Z.draw(cells, design), Z.loadings(design), Z.make_seed("counts", 0)
    _, base = Z.gene_baselines(w, seed)
    got = drawn.select("cell", "h").collect()
    signal, c = np.array([r["h"] for r in got]) @ w, Z.offsets(np.array([r["cell"] for r in got]), seed, 0.4)
    want = np.var(signal) / np.var(signal + (base - base.mean()) + (c - c.mean())[:, None])
    assert Z.draw_counts(drawn, w)[2] == pytest.approx(want)


def test_study_recovers_programs(cells):
    design = Z.Design(genes=20, k=5, age=(6.0, 4.0), space=(4.0, 2.0), error=0.05, overlap=0.0)
    rows = Z.study(cells, design, 2).collect()
    assert len(rows) == 2 * 2 * 2 and {(r["method"], r["fit"]) for r in rows} == {(m, f) for m in ("estimator", "components") for f in ("r0", "r1")}
    ours = [r for r in rows if r["method"] == "estimator"]
    assert np.mean([r["cosine"] for r in ours]) > 0.9 and all(0 <= r["hellinger"] <= 1 and 0 <= r["hit_rate"] <= 1 for r in rows)
