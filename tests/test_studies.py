"""Quality control, label benchmarks and agreement across settings against loops."""

import math
from itertools import permutations

import numpy as np
import pytest

from sliceloom.operators import benchmark as B
from sliceloom.plans.control import Rules, control


def test_control_by_loops(spark):
    rng = np.random.default_rng(5)
    inf, nan = math.inf, math.nan
    cells, counts = [], []
    for i in range(300):
        box = (0.0, float(rng.choice([1.0, 2.0, 50.0, nan])), 0.0, float(rng.uniform(1, 3)))
        cells.append((i, int(i % 3), str(rng.choice(["n", "g", "h", "other"])), float(rng.uniform(0, 200)), float(rng.uniform(0, 200)), *box, float(rng.choice([1.0, 3.0, nan, 9.0]))))
        for g in range(int(rng.integers(0, 6))):
            counts.append((i, f"g{g}", float(rng.integers(1, 30))))
    cells[7] = (*cells[7][:6], inf, *cells[7][7:])
    frame = spark.createDataFrame(cells, "cell long, slice long, celltype string, x double, y double, min_x double, max_x double, min_y double, max_y double, anisotropy double").repartition(3)
    long = spark.createDataFrame(counts, "cell long, gene string, value double")
    rules = Rules(["n", "g", "h"], 5, 1, top=0.95, low=0.05, drop_genes=["g1"], anisotropy=0.6, neurons=["n"], markers=["g0"], most_fraction=0.5, least_distance=9.0)
    own = {c[0]: [v for i, g, v in counts if i == c[0] and g != "g1"] for c in cells}
    rows = [c for c in cells if c[2] != "other"]
    area = {c[0]: (c[6] - c[5]) * (c[8] - c[7]) for c in rows}
    real = lambda v: [x for x in v if not math.isnan(x)]
    top, genes = (np.quantile([f(own[c[0]]) for c in rows], 0.95) for f in (sum, len))
    lo, hi = np.quantile(real(area.values()), [0.05, 0.95])
    most = np.quantile(real([c[9] for c in rows]), 0.6)
    kept = [c for c in rows if 5 <= sum(own[c[0]]) <= top and 1 <= len(own[c[0]]) <= genes and (not math.isfinite(area[c[0]]) or lo <= area[c[0]] <= hi) and (math.isnan(c[9]) or c[9] <= most)]
    share = lambda c: sum(v for i, g, v in counts if i == c[0] and g == "g0") / sum(own[c[0]])
    kept = [c for c in kept if c[2] == "n" or share(c) <= 0.5]
    far = lambda c: all(math.hypot(c[3] - n[3], c[4] - n[4]) >= 9 for n in kept if n[2] == "n" and n[1] == c[1])
    want = {c[0] for c in kept if c[2] == "n" or far(c)}
    got = control(frame, long, rules).collect()
    assert {r["cell"] for r in got} == want and len(got) == len(want) and 0 < len(want) < len(rows)
    assert all(r["total"] == sum(own[r["cell"]]) and r["n_genes"] == len(own[r["cell"]]) for r in got)
    assert control(frame.limit(0), long, rules).count() == 0


def test_best_naming_in_groups_by_enumeration(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 4)), str(rng.integers(0, 3)), None if rng.random() < 0.05 else "abcd"[rng.integers(0, 4)]) for _ in range(400)]
    rows += [(9, "0", "z")] * 3
    frame = spark.createDataFrame(rows, "g int, t string, p string")
    for r in B.matched_accuracy_groups(frame, "t", "p", ["g"]).collect():
        mine = [(t, p) for g, t, p in rows if g == r["g"] and p is not None]
        ps, ts = sorted({p for _, p in mine}), sorted({t for t, _ in mine})
        ts = ts + [None] * max(0, len(ps) - len(ts))
        best = max(sum((t, p) in list(zip(names, ps)) for t, p in mine) for names in permutations(ts, len(ps)))
        assert r["raw_acc"] == pytest.approx(best / len(mine))
    scores = {r["g"]: r for r in B.evaluate_groups(frame, "t", "p", ["g"], 4).collect()}
    assert set(scores) == {0, 1, 2, 3}
    one = B.evaluate_groups(frame.where("g = 9"), "t", "p", ["g"]).first()
    assert (one["raw_ari"], one["raw_nmi"], one["merged_acc"]) == (1.0, 1.0, 1.0)


def test_settings_hold_the_baseline_once(spark):
    rows = B.settings(spark).collect()
    assert len(rows) == 12 and [r["is_baseline"] for r in rows].count(True) == 1
    assert rows[4]["setting_id"] == "temporal_rho_0p70_spatial_rho_0p50" and rows[4]["is_baseline"] and rows[4]["panel"] == "temporal"
    assert [(r["temporal_rho"], r["spatial_rho"]) for r in rows if r["panel"] == "spatial"] == [(0.7, s) for s in (0.2, 0.3, 0.4, 0.6)]
    with pytest.raises(ValueError, match="baseline"):
        B.settings(spark, (0.5,), (0.4,), (0.7, 0.5))


def test_programs_across_settings_by_loops(spark):
    rng = np.random.default_rng(7)
    base = {s: rng.dirichlet(np.ones(12), 3) for s in "LR"}
    base["R"][[2, 0, 1]] = 0.7 * base["L"] + 0.3 * base["R"][[2, 0, 1]]
    w = {}
    for t in range(4):
        for s in "LR":
            if (t, s) != (3, "R"):
                w[t, s] = (0.9 * base[s] + 0.1 * rng.dirichlet(np.ones(12), 3))[rng.permutation(3)] if t else base[s]
    rows = [(f"t{t}", s, f"p{j}", g, float(v)) for (t, s), m in w.items() for j in range(3) for g, v in enumerate(m[j])]
    loadings = spark.createDataFrame(rows, "setting_id string, side string, program string, gene long, weight double")
    grid = spark.createDataFrame([(f"t{t}", "temporal" if t < 2 else "spatial", t == 0) for t in range(4)], "setting_id string, panel string, is_baseline boolean")
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    best = lambda a, b: max(permutations(range(3)), key=lambda o: sum(cos(a[i], b[o[i]]) for i in range(3)))
    pair = best(w[0, "L"], w[0, "R"])
    assert pair == (2, 0, 1)
    want = {}
    for t in range(3):
        l_now, r_now = best(w[0, "L"], w[t, "L"]), best(w[0, "R"], w[t, "R"])
        for i in range(3):
            a, b = l_now[i], r_now[pair[i]]
            want[f"t{t}", f"p{i}"] = (f"p{pair[i]}", f"p{a}", f"p{b}", cos(w[t, "L"][a], w[t, "R"][b]), np.corrcoef(w[t, "L"][a], w[t, "R"][b])[0, 1])
    aligned = B.baseline_aligned(loadings, grid, "L", "R")
    got = {(r["setting_id"], r["baseline_left_program"]): r for r in aligned.collect()}
    assert set(got) == set(want)
    for key, (b, left, right, c, r) in want.items():
        x = got[key]
        assert (x["baseline_right_program"], x["left_program"], x["right_program"]) == (b, left, right)
        assert (x["cosine"], x["pearson"]) == (pytest.approx(c), pytest.approx(r))
    summary = {(r["panel"], r["baseline_left_program"]): r for r in B.panel_summary(aligned).collect()}
    for i in range(3):
        both = [want["t0", f"p{i}"][3], want["t1", f"p{i}"][3]]
        s = summary["temporal", f"p{i}"]
        assert (s["least"], s["median"], s["n"]) == (pytest.approx(min(both)), pytest.approx(np.median(both)), 2)
    done = {(r["setting_id"], r["side"]): (r["complete"], r["programs"]) for r in B.completion(grid, loadings, "LR").collect()}
    assert done["t3", "R"] == (False, 0) and done["t3", "L"] == (True, 3) and len(done) == 8
