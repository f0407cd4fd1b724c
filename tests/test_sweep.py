"""The sweep over kernel widths, and distances to k-th neighbours."""

import math

import numpy as np
import pytest

from sliceloom.operators import spatial
from sliceloom.plans import fit as M
from sliceloom.plans import sweep as W
from sliceloom.plans import synthetic as Z


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(8)
    rows = [(s, float(s), 1000 * s + i, float(rng.uniform(0, 9)), float(rng.uniform(0, 9))) for s in range(4) for i in range(36)]
    bare = spark.createDataFrame(rows, "slice long, age double, cell long, x double, y double")
    design = Z.Design(genes=15, k=4, age=(5.0, 3.0), space=(5.0, 3.0), error=0.02, overlap=0.0)
    drawn = Z.draw(bare, design).toPandas()
    drawn["side"] = np.where(drawn["cell"] % 2, "L", "R")
    return spark.createDataFrame(drawn[["side", "slice", "age", "cell", "x", "y", "genes"]], "side string, slice long, age double, cell long, x double, y double, genes array<double>")


def test_sweep_finds_the_shared_programs_in_every_setting(cells):
    found = W.sweep(cells, ("L", "R"), 2, 5)
    rows = found["aligned"].collect()
    assert len(rows) == 12 * 2 and min(r["cosine"] for r in rows) > 0.9
    assert found["loadings"].select("setting_id", "side").distinct().count() == 24
    assert all(r["complete"] and r["programs"] == 2 for r in found["completion"].collect())
    assert {r["panel"]: r["n"] for r in found["panels"].collect()} == {"temporal": 8, "spatial": 5}


def test_a_setting_is_the_fit_at_its_widths(cells, spark):
    wide = {r["side"]: r for r in W.widths(cells, ["L"]).collect()}["L"]
    grid = W.B.settings(spark, (0.7, 0.6), (0.5, 0.3))
    found = W.sweep_fits(cells, grid, ["L"], 2, 5)
    mine = cells.where("side = 'L'").selectExpr("'f' as fit", "slice", "age", "cell", "x", "y", "genes")
    for t, s, name in ((0.6, 0.5, "temporal_rho_0p60_spatial_rho_0p50"), (0.7, 0.3, "temporal_rho_0p70_spatial_rho_0p30")):
        own = M.fit_keys(M.spectral_rows(mine, wide["reach"] / abs(math.log(s))), 2, 5, gamma_age=wide["gap"] / abs(math.log(t))).where("kind = 'loading'").collect()
        got = found.where(f"setting_id = '{name}'").collect()
        assert sorted((int(r["program"]), r["gene"], round(r["weight"], 9)) for r in got) == sorted((r["program"], r["key"], round(r["value"], 9)) for r in own)


@pytest.mark.parametrize("block", [4096, 16])
def test_kth_distances_by_loops(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(int(s), 100 * s + i, float(rng.integers(0, 6)), float(rng.integers(0, 6))) for s, n in ((0, 70), (1, 2), (2, 1)) for i in range(n)] + [(0, 999, None, 1.0)]
    got = {r["cell"]: r for r in spatial.kth_distances(spark.createDataFrame(rows, "slice long, cell long, x double, y double").repartition(3), 0.1).collect()}
    assert len(got) == 73
    for s, c, x, y in rows[:-1]:
        d = sorted(math.hypot(x - u, y - v) for t, o, u, v in rows[:-1] if t == s and o != c)
        k = min(max(1, math.ceil(0.1 * (len(d) + 1))), len(d))
        assert (got[c]["n"], got[c]["k"], got[c]["d"]) == (len(d) + 1, k, pytest.approx(d[k - 1]) if d else None)
