"""Proximity tables against loops over cells."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceloom.operators import proximity as X


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s in range(4):
        for _ in range((70, 60, 12, 3)[s]):
            rows.append((len(rows), s, str(rng.choice(["t", "a", "b"], p=[0.5, 0.3, 0.2])), float(rng.uniform(0, 30)), float(rng.uniform(0, 30)), float(rng.normal())))
    rows += [(len(rows) + i, 9, "t", float(i), 0.0, float(i % 5)) for i in range(20)]  # a slice without other types
    cells = spark.createDataFrame(rows, "cell long, slice long, celltype string, x double, y double, b double").repartition(3)
    targets = cells.where("celltype = 't'")
    scores = targets.selectExpr("cell", "stack(2, 'p', b, 'q', -b * b) as (program, b)")
    return rows, targets, scores, cells.where("celltype <> 't'")


def score(program, b):
    return b if program == "p" else -b * b


def nearest(rows, r, kind):
    return min((math.hypot(r[3] - o[3], r[4] - o[4]) for o in rows if o[1] == r[1] and o[2] == kind), default=math.inf)


def corrected(ps):
    order = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    out, low = [None] * len(ps), 1.0
    for k in range(len(order), 0, -1):
        low = min(low, order[k - 1][0] * len(order) / k)
        out[order[k - 1][1]] = low
    return out


def test_effects_by_loops(tables):
    rows, targets, scores, others = tables
    want = {}
    for program in "pq":
        for kind in "ab":
            blocks = []
            for s in range(4):
                mine = [r for r in rows if r[1] == s and r[2] == "t"]
                near = [score(program, r[5]) for r in mine if nearest(rows, r, kind) <= 2.5]
                far = [score(program, r[5]) for r in mine if nearest(rows, r, kind) > 5]
                if any(o[1] == s and o[2] == kind for o in rows) and len(near) >= 3 and len(far) >= 3:
                    blocks.append((np.median(near) - np.median(far), 1 / (np.var(near, ddof=1) / len(near) + np.var(far, ddof=1) / len(far) + 1e-9), len(near), len(far)))
            w = sum(b[1] for b in blocks)
            effect, se = sum(b[0] * b[1] for b in blocks) / w, 1 / math.sqrt(w)
            want[program, kind] = (effect, se, math.erfc(abs(effect / se) / math.sqrt(2)), sum(b[2] for b in blocks), sum(b[3] for b in blocks), len(blocks))
    q = dict(zip(want, corrected([v[2] for v in want.values()])))
    table = X.effect_table(targets, scores, others, 2.5, 5.0, 3)
    got = {(r["program"], r["effector"]): r for r in table.collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        r = got[key]
        np.testing.assert_allclose((r["effect"], r["se"], r["p"], r["n_near"], r["n_far"], r["n_blocks"], r["q_bh"]), (*w, q[key]), rtol=1e-9)
    best = X.significant_effectors(table, 1.1, 1).collect()
    assert {r["program"]: r["effector"] for r in best} == {p: max("ab", key=lambda k: abs(want[p, k][0])) for p in "pq"}
    none = X.effect_table(targets, scores, others, 2.5, 5.0, 1000).collect()
    assert len(none) == 4 and all(r["n_blocks"] == 0 and r["effect"] is None and r["q_bh"] is None for r in none)


@pytest.mark.parametrize("by_slice", [False, True])
def test_shells_keep_groups_that_are_too_small(tables, by_slice):
    rows, targets, scores, others = tables
    got = X.shell_table(targets, scores, others, 1.0, 6.0, by_slice, 6).collect()
    slices = [s for s in (0, 1, 2, 3, 9) if any(r[1] == s and r[2] == "t" for r in rows)] if by_slice else [None]
    assert len(got) == 4 * len(slices) and any(r["valid"] for r in got) and (not by_slice or any(not r["valid"] for r in got))
    for r in got:
        mine = [c for c in rows if c[2] == "t" and (not by_slice or c[1] == r["slice"])]
        b = np.array([score(r["program"], c[5]) for c in mine])
        if by_slice and len(mine) < 12:
            assert (r["hi_threshold"], r["n_hi"], r["n_lo"], r["valid"], r["p"], r["q_bh"]) == (None, 0, 0, False, None, None)
            continue
        n = np.array([sum(1 < math.hypot(c[3] - o[3], c[4] - o[4]) <= 6 for o in rows if o[1] == c[1] and o[2] == r["effector"]) for c in mine])
        high, low = n[b >= np.percentile(b, 75)], n[b <= np.percentile(b, 25)]
        assert (r["n_hi"], r["n_lo"]) == (len(high), len(low)) and r["valid"] == (len(high) >= 6 and len(low) >= 6)
        np.testing.assert_allclose((r["hi_mean"], r["lo_mean"]), (high.mean(), low.mean()))
        assert (r["p"] is None) == (not r["valid"])
    if by_slice:
        for s in slices:
            for p in "pq":
                own = [r for r in got if r["slice"] == s and r["program"] == p]
                np.testing.assert_allclose(np.array([r["q_bh_by_slice"] for r in own], float), np.array(corrected([r["p"] for r in own]), float))


@pytest.mark.parametrize("alternative", ["two-sided", "greater"])
def test_rank_sum_by_enumeration(spark, alternative):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, (m, n) in enumerate([(1, 1), (2, 5), (5, 3), (6, 6), (4, 9)]):
        values = rng.permutation(m + n).astype(float)
        rows += [(g, float(v), i < m) for i, v in enumerate(values)]
        u = lambda chosen, values=values: sum(values[i] > values[j] for i in chosen for j in range(len(values)) if j not in chosen)
        every = [u(c) for c in combinations(range(m + n), m)]
        mine = u(tuple(range(m)))
        upper = lambda x, every=every: np.mean([e >= x for e in every])
        want[g] = min(1.0, 2 * upper(max(mine, m * n - mine))) if alternative == "two-sided" else upper(mine)
    rows += [(50, 1.0, i < 3) for i in range(7)] + [(51, float(i), True) for i in range(4)]  # all equal; one side empty
    got = {r["g"]: r["p"] for r in X.rank_sum_test(spark.createDataFrame(rows, "g int, v double, f boolean"), "v", F.col("f"), ["g"], alternative).collect()}
    assert {g: got[g] for g in want} == pytest.approx(want) and got[50] == 1.0 and got[51] is None


def test_rank_sum_with_ties_is_the_corrected_normal(spark):

    a, b = [1, 2, 2, 3, 3, 3, 4, 5, 6, 6], [2, 3, 3, 4, 4, 5, 5, 7, 7, 8, 9]
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    both = a + b
    ties = sum(c**3 - c for c in (both.count(v) for v in set(both)))
    sd = math.sqrt(len(a) * len(b) / 12 * (22 - ties / (21 * 20)))
    rows = [(float(v), True) for v in a] + [(float(v), False) for v in b]
    got = X.rank_sum_test(spark.createDataFrame(rows, "v double, f boolean").withColumn("g", F.lit(1)), "v", F.col("f"), ["g"]).first()
    assert got["u"] == u and got["p"] == pytest.approx(math.erfc((abs(u - 55) - 0.5) / sd / math.sqrt(2)))


def test_samples_violins_and_summaries(tables, spark):
    rows, targets, scores, others = tables
    pooled = X.near_far_samples(targets, scores, others, 2.5, 5.0, 10, 3).collect()
    for r in pooled:
        d = nearest(rows, rows[r["cell"]], r["effector"])
        assert d <= 2.5 if r["side"] == "near" else d > 5
        assert r["b"] == pytest.approx(score(r["program"], rows[r["cell"]][5]))
    drawn = X.violin_effects(targets, scores, others, 2.5, 5.0, 3).collect()
    for r in drawn:
        mine = [c for c in rows if c[2] == "t" and c[1] == r["slice"]]
        near, far = ([score(r["program"], c[5]) for c in mine if ok(nearest(rows, c, r["effector"]))] for ok in (lambda d: d <= 2.5, lambda d: d > 5))
        assert (r["n_near"], r["n_far"]) == (len(near), len(far)) and r["difference"] == pytest.approx(np.median(near) - np.median(far)) and 0 < r["p"] <= 1
    assert {r["slice"] for r in drawn} <= {0, 1, 2} and drawn and pooled
    both = X.downstream(targets, scores, others, 2.5, 5.0, 1.0, 6.0)
    summary = {r["program"]: r for r in both["summary"].collect()}
    assert set(summary) == {"p", "q"} and all(r["n_effectors_tested"] == 2 and r["n_slices_tested"] == len({c[1] for c in rows if c[2] == "t"}) for r in summary.values())
    effects = spark.createDataFrame([("p", k, e, q) for k, e, q in (("a", 3.0, 0.01), ("b", -4.0, 0.2), ("c", -1.0, 0.04), ("d", 2.0, None), ("e", None, None))], "program string, effector string, effect double, q_bh double")
    null = spark.createDataFrame([("p", "a", 3.0, 0.01), ("p", "c", -1.0, 0.5), ("p", "e", None, 0.0)], "program string, effector string, observed double, p double")
    r = X.program_summary(effects, null, targets).first()
    assert (r["sig_effectors"], r["pro_effectors"], r["anti_effectors"], r["perm_pass_effectors"], r["n_perm_pass"]) == ("a|c", "a|d|c", "b|c|d", "a", 1)
    assert (r["top_pro_effector"], r["top_pro_effect"], r["top_anti_effector"], r["top_anti_effect"], r["n_target_cells"]) == ("a", 3.0, "b", -4.0, targets.count())
