"""The estimator over many tasks against the same steps in memory."""

import numpy as np
import pytest

from sliceloom.plans import fit as M
from sliceloom.plans import spread as S


@pytest.fixture(scope="module")
def spectral(spark):
    rng = np.random.default_rng(11)
    rows, cell = [], 0
    sizes, loadings = [7, 1, 9, 6], np.abs(rng.normal(size=(2, 5)))
    for s, n in enumerate(sizes):
        score = np.stack([np.full(n, 1.0 + s), rng.normal(2 - s / 2, 0.3, n)], axis=1)
        values = np.abs(score @ loadings + rng.normal(0, 0.2, (n, 5)))
        for y in values:
            rows.append(("f", 10 - s, float(s * s), cell, float(rng.uniform()), float(rng.uniform()), y.tolist()))
            cell += 1
    cells = spark.createDataFrame(rows, "fit string, slice long, age double, cell long, x double, y double, genes array<double>").repartition(3)
    made = M.spectral_rows(cells, 2.0)
    return spark.createDataFrame(made.toPandas(), made.schema).repartition(3)


def _in_memory(spectral):
    """The same rows as arrays."""
    pdf = spectral.toPandas()
    slices = pdf.groupby("slice")["age"].first().sort_values(kind="stable")
    pdf = pdf.assign(at=pdf["slice"].map({s: i for i, s in enumerate(slices.index)})).sort_values(["at", "lam"], kind="stable")
    rows = M.Rows(pdf["at"].to_numpy(), pdf["lam"].to_numpy(), pdf["u"].to_numpy(), M.age_kernel(slices.to_numpy(), 1.0))
    values = np.stack(pdf["values"].to_list())
    return rows, values, pdf


@pytest.mark.parametrize(("p", "auto"), [(2, False), (3, True)])
def test_spread_fit_equals_the_grouped_task(spectral, p, auto):
    most, sweeps = 4, 2
    rows, values, pdf = _in_memory(spectral)
    fs, trace = M.greedy(rows, values, p, 3, 0.05 if auto else -np.inf, inner=most)
    fs = M.backfit(rows, values, fs, 3, sweeps, most)
    while auto and len(kept := M.prune(values, fs)) < len(fs) and kept:
        fs = M.backfit(rows, values, kept, 3, sweeps, most)
    got = S.fit_spread(spectral, "f", p, 3, auto, most=most, sweeps=sweeps).toPandas()
    assert set(got["fit"]) == {"f"} and len(got[got["kind"] == "trial"]) == (len(trace) if auto else 0)
    assert sorted(got["program"][got["kind"] == "loading"].unique()) == list(range(len(fs)))
    for j, f in enumerate(fs):
        own = got[got["program"] == j].sort_values("key")
        of = lambda kind, own=own: own[own["kind"] == kind]["value"].to_numpy()
        np.testing.assert_allclose(of("loading"), f.w, atol=1e-7)
        np.testing.assert_allclose(of("theta"), [f.age, f.space, f.error], rtol=1e-6)
        others = values - sum(np.outer(g.h, g.w) for m, g in enumerate(fs) if m != j)
        alpha, b, spread = M.decompose(rows, others, f, "b_first")
        path = own[own["kind"] == "trajectory"].sort_values("age")
        np.testing.assert_allclose(path["value"], alpha, atol=1e-6)
        np.testing.assert_allclose(path["sd"], spread, rtol=1e-6)
        for kind, v in (("score", f.h), ("field", b)):
            want = {}
            for s, mine in pdf.reset_index(drop=True).groupby("slice"):
                at = mine.index.to_numpy()
                want |= dict(zip(mine["cells"].iloc[0], np.stack(mine["vector"].to_list()).T @ v[at]))
            np.testing.assert_allclose(of(kind), [want[c] for c in sorted(want)], atol=1e-6)


def test_guards_resplit_and_large_fits(spark, spectral, monkeypatch):
    state = S.Spread(spectral, 2)
    with pytest.raises(ValueError, match="at least one"):
        state.greedy(0, 3, 0.0)
    pdf = spectral.toPandas()
    none = spark.createDataFrame(pdf.assign(values=[[0.0] * 5] * len(pdf)), spectral.schema)
    with pytest.raises(ValueError, match="no energy"):
        S.Spread(none, 1).greedy(1, 3, 0.0)
    f, h = state.fit_rank1([], None, most=3)
    twins = [M.Factor(np.zeros(0), f.w, f.age, f.space, f.error) for _ in range(2)]
    half = lambda *x: h(*x) / 2
    for j in (0, 1):
        state.put(j, twins[j], half)
    before = state.energy([0, 1])
    state._resplit(twins, 0, 1, None, 10, 1e-4)
    unit = [t.w / np.linalg.norm(t.w) for t in twins]
    assert unit[0] @ unit[1] < 0.9 and state.energy([0, 1]) < before
    small = S.fit_all(spectral, 1, 3)
    monkeypatch.setattr(S, "SMALL_BYTES", 8)
    monkeypatch.setattr(S, "COLLECTED", 8)  # sums come from the engine
    monkeypatch.setattr(S, "fit_spread", lambda rows, name, *a, **k: spark.createDataFrame([(name, "large", 0, rows.count(), None, 0.0, None)], M.RESULT))
    assert [tuple(r)[:4] for r in S.fit_all(spectral, 1, 3).collect()] == [("f", "large", 0, 23)] and small.count() > 23
    assert state.energy([]) == pytest.approx(sum(float(np.square(v).sum()) for v in pdf["values"]))
