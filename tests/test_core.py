"""Every core query against its SQL, and the estimator against dense algebra."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from sliceloom.functions.text import clean_term
from sliceloom.operators import programs as P
from sliceloom.operators import statistics as T
from sliceloom.plans import fit as M
from sliceloom.plans import simulate as Z
from sliceloom.plans.queries import ORACLES, QUERIES
from sliceloom.sources import tables as IO

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and (abs(a - b) <= 2e-6 * max(1, abs(b)) or math.isnan(a) and math.isnan(b)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.sql(ORACLES[name])
    columns = sorted(result.columns)
    assert sorted(df.columns) == columns
    key = lambda r: tuple((x is None, f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    few = name == "proximity_permutation"  # the smallest tables have too few cells a block for it
    assert (rows or few) and all(not isinstance(v, float) or not math.isinf(v) for r in rows for v in r)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture
def dense():
    """Five small slices with dense kernels over cells."""
    rng = np.random.default_rng(3)
    sizes, g = [5, 8, 6, 9, 7], 6
    ages = np.array([0.0, 1.0, 1.5, 3.0, 4.0])
    k_age = np.exp(-((ages[:, None] - ages[None]) ** 2) / 2)
    blocks, u = [], np.zeros((sum(sizes), 5))
    at = np.repeat(np.arange(5), sizes)
    u[np.arange(len(at)), at] = 1
    k_space = np.zeros((len(at), len(at)))
    for t, n in enumerate(sizes):
        xy = rng.normal(size=(n, 2))
        k = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1))
        blocks.append(np.linalg.eigh(k))
        k_space[np.ix_(at == t, at == t)] = k
    y = rng.normal(size=(len(at), g)) + 1
    v = np.zeros_like(k_space)
    for t, (_, vec) in enumerate(blocks):
        v[np.ix_(at == t, at == t)] = vec
    rows = M.Rows(at, np.concatenate([b[0] for b in blocks]), v.T @ np.ones(len(at)), k_age)
    return rows, y, v, u, k_age, k_space


def test_posterior_is_the_dense_one(dense):
    rows, y, v, u, k_age, k_space = dense
    w, age, space, error = M.project_simplex(np.arange(6.0)), 0.7, 0.4, 0.3
    h, trace = M.posterior(rows, v.T @ y @ w, w @ w, age, space, error)
    prior = age * u @ k_age @ u.T + space * k_space
    cov = np.linalg.inv(np.linalg.inv(prior) + w @ w / error * np.eye(len(y)))
    np.testing.assert_allclose(v @ h, cov @ (y @ w) / error, atol=1e-7)
    assert trace == pytest.approx(np.trace(cov), abs=1e-6)


def test_variance_step_is_the_dense_one(dense):
    rows, y, v, u, k_age, k_space = dense
    w, age, space, error = M.project_simplex(np.array([3.0, 1, 2, 0, 2, 1]) / 4), 0.7, 0.4, 0.3
    new = M.update_variances(rows, v.T @ y @ w, w @ w, (y**2).sum(), 6, age, space, error, False)
    parts = [np.kron(np.outer(w, w), u @ k_age @ u.T), np.kron(np.outer(w, w), k_space), np.eye(y.size)]
    s = np.linalg.inv(sum(a * b for a, b in zip((age, space, error), parts)))
    z = s @ y.T.ravel()
    want = [v0 * np.sqrt(z @ p @ z / np.trace(s @ p)) for v0, p in zip((age, space, error), parts)]
    np.testing.assert_allclose(new, want, rtol=1e-6)


def test_decompose_is_the_dense_one(dense):
    """Trajectory, field and spread of both modes against Gaussian conditioning over cells."""
    rows, y, v, u, k_age, k_space = dense
    w, age, space, error = M.project_simplex(np.arange(6.0)), 0.7, 0.4, 0.3
    rotated = v.T @ y
    h, trace = M.posterior(rows, rotated @ w, w @ w, age, space, error)
    f = M.Factor(h, w, age, space, error, trace)
    z, solve = y @ w / (w @ w), np.linalg.inv(age * u @ k_age @ u.T + space * k_space + error / (w @ w) * np.eye(len(y)))
    alpha, b = age * k_age @ u.T @ solve @ z, space * k_space @ solve @ z
    spread = np.sqrt(np.diag(age * k_age - age * k_age @ u.T @ solve @ u @ k_age * age))
    got = M.decompose(rows, rotated, f, "alpha_first")
    np.testing.assert_allclose(got[0], alpha, atol=1e-6)
    np.testing.assert_allclose(v @ got[1], v @ h - u @ alpha, atol=1e-6)
    np.testing.assert_allclose(got[2], spread, atol=1e-6)
    got = M.decompose(rows, rotated, f, "b_first")
    np.testing.assert_allclose(v @ got[1], b, atol=1e-6)
    np.testing.assert_allclose(got[0], u.T @ (v @ h - b) / u.sum(axis=0), atol=1e-6)


def test_backfit_and_resplit_lower_the_residual(dense):
    rows, y, v, *_ = dense
    values = v.T @ np.abs(y)
    fs, _ = M.greedy(rows, values, 2, improve=-np.inf)
    off = lambda fs: float(((values - sum(np.outer(f.h, f.w) for f in fs)) ** 2).sum())
    done = M.backfit(rows, values, fs)
    assert off(done) <= off(fs) * 1.05 and all(abs(f.w.sum() - 1) < 1e-9 for f in done)
    twins = [M.Factor(fs[0].h / 2, fs[0].w, fs[0].age, fs[0].space, fs[0].error) for _ in range(2)]
    M._resplit(rows, values, twins, 0, 1, None, 100, 1e-4)
    unit = [f.w / np.linalg.norm(f.w) for f in twins]
    assert unit[0] @ unit[1] < 0.9 and off(twins) < off(fs[:1])


def test_gram_and_sums_from_long_values(spark):
    rng = np.random.default_rng(11)
    x, at = rng.integers(0, 5, (30, 4)).astype(float), rng.integers(0, 3, 30)
    values = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(30) for j in range(4) if x[i, j]], "cell long, gene string, value double").repartition(3)
    cells = spark.createDataFrame([(i, int(at[i]), float(at[i])) for i in range(30)], "cell long, slice long, age double")
    ages, n, sums, gram = M.sufficient(values, [f"g{j}" for j in range(4)], cells)
    assert ages.tolist() == [0, 1, 2] and n.tolist() == np.bincount(at).tolist()
    np.testing.assert_allclose(gram, x.T @ x)
    np.testing.assert_allclose(sums, [x[at == t].sum(axis=0) for t in range(3)])


def test_signed_rank_by_enumeration(spark):
    from itertools import product

    rng = np.random.default_rng(12)
    a, b = rng.normal(size=9) + 0.4, rng.normal(size=9)
    rank = np.argsort(np.argsort(np.abs(a - b))) + 1
    w = rank[a > b].sum()
    want = np.mean([np.dot(s, rank) >= w for s in product((0, 1), repeat=9)])
    rows = [("x", float(i), float(j)) for i, j in zip(a, b)] + [("one", 1.0, 0.0), ("same", 1.0, 1.0), ("same", 2.0, 2.0), ("same", None, 2.0)]
    got = {r["k"]: r for r in T.wilcoxon_greater(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", ["k"]).collect()}
    assert got["x"]["w"] == w and got["x"]["p"] == pytest.approx(want)
    assert got["one"]["p"] is None and got["same"]["p"] == 1.0


def test_temporal_fit_equals_rowwise_fit():
    rng = np.random.default_rng(5)
    n, g = np.array([4.0, 6, 5, 7]), 5
    at = np.repeat(np.arange(4), n.astype(int))
    y = np.abs(rng.normal(size=(len(at), g))) + np.array([0.0, 1, 2, 3])[at][:, None] * np.array([1, 0.5, 0, 0, 0.2])
    ages = np.arange(4.0)
    z = (ages - ages.mean()) / ages.std(ddof=1)
    rows = M.Rows(at, np.zeros(len(at)), np.ones(len(at)), np.exp(-((z[:, None] - z[None]) ** 2)), spatial=False)
    whole = M.fit_rank1(rows, y)
    short = M.fit_without_space(ages, n, np.stack([y[at == t].sum(0) for t in range(4)]), y.T @ y, 1)[0]
    np.testing.assert_allclose(short["w"], whole.w, atol=1e-4)
    np.testing.assert_allclose(short["alpha"], [whole.h[at == t].mean() for t in range(4)], rtol=1e-3)


def test_automatic_rank_and_guards():
    data = Z.generate(slices=6, genes=20, k=5, cells=30)
    y = np.concatenate([s["y"] for s in data["slices"]])
    at = np.concatenate([np.full(len(s["y"]), t) for t, s in enumerate(data["slices"])])
    rows = M.Rows(at, np.zeros(len(at)), np.ones(len(at)), np.eye(6), spatial=False)
    fs, trace = M.fit_factors(rows, y, 5, 8, auto=True)
    assert 1 <= len(fs) <= 5 and [t["factor_index"] for t in trace] == list(range(1, len(trace) + 1))
    left = float((y**2).sum())
    for i, t in enumerate(trace):  # every gain is a share of what was left before it
        assert t["residual_norm_before"] == pytest.approx(left)
        assert t["rel_improve_total"] == pytest.approx((left - t["residual_norm_after"]) / left)
        assert t["keep"] == (i == 0 or t["rel_improve_total"] >= 0.05) and (t["stop_reason"] is None) == t["keep"]
        left = t["residual_norm_after"]
    norms = [t["residual_norm_after"] for t in trace if t["keep"]]
    assert norms == sorted(norms, reverse=True)
    assert all(abs(f.w.sum() - 1) < 1e-9 and (f.w >= 0).all() for f in fs)
    with pytest.raises(ValueError):
        M.greedy(rows, y, 0)
    with pytest.raises(ValueError):
        M.greedy(rows, np.zeros_like(y), 1)
    with pytest.raises(ValueError):
        M.decompose(rows, y, fs[0], "both")


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 6), (6, 6)):
        cost = rng.normal(size=(n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert cost[np.arange(n), P.assignment(cost)].sum() == pytest.approx(best)


def test_corrections_with_missing(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "id int, p double")
    skip = {r["id"]: r["q"] for r in T.bh(df, "p").collect()}
    assert skip[3] is None and skip[1] == pytest.approx(0.03) and skip[2] == pytest.approx(0.04)
    assert {r["id"]: r["q"] for r in T.bh(df, "p", missing="one").collect()}[3] == pytest.approx(1.0)
    assert {r["id"]: r["holm"] for r in T.holm(df, "p").collect()}[4] == pytest.approx(0.06)


def test_tables_round_trip(spark, tmp_path):
    loadings = spark.createDataFrame([("a", "x", 0.75), ("a", "y", 0.25), ("b", "x", 1.0)], "program string, gene string, weight double")
    wide = IO.to_wide(loadings, ["x", "y"])
    wide.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "w"))
    back = IO.to_long(spark.read.option("header", True).schema(wide.schema).csv(str(tmp_path / "w")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, loadings.collect()))
    (tmp_path / "s.gmt").write_text("T1\tabout\tA\tB\nT2\tabout\tC\n")
    assert IO.read_gmt(spark, {"c": str(tmp_path / "s.gmt")}).count() == 3
    made = []
    for _ in range(2):
        IO.cached(spark, str(tmp_path / "c"), {"a": 1}, lambda: made.append(1) or loadings).count()
    assert made == [1]
    IO.append_log(spark, str(tmp_path / "log"), [{"run": 1}, {"run": 2}])
    assert IO.read_log(spark, str(tmp_path / "log"), "run int").count() == 2


def test_clean_term(spark):
    rows = spark.createDataFrame([("GOBP_DNA_DNA_REPAIR_UP",), ("complex iii assembly (GO:0001)",)], "t string")
    assert [r[0] for r in rows.select(clean_term(rows["t"])).collect()] == ["DNA repair", "Complex III assembly"]


def test_permutation_query_draws_the_whole_null(monkeypatch):
    """The query runs the 100 draws that are the operator's default and the reference's."""
    import inspect
    from unittest.mock import MagicMock

    from sliceloom.plans import queries

    signature, bound = inspect.signature(queries.T.permutation_null), []
    monkeypatch.setattr(queries.A, "points", MagicMock())
    monkeypatch.setattr(queries, "rounded", lambda df, *_: df)
    monkeypatch.setattr(queries.T, "permutation_null", lambda *a, **k: bound.append(signature.bind(*a, **k)))
    queries.proximity_permutation(None, "")
    bound[0].apply_defaults()
    assert bound[0].arguments["draws"] == 100


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_of_crowded_slices_against_all_pairs(spark, k):
    from sliceloom.operators.spatial import neighbours

    rng = np.random.default_rng(1)
    clusters = [rng.normal(0, 1, (500, 2)), rng.normal(50, 0.01, (150, 2)), np.repeat(rng.normal(-3, 1, (1, 2)), 30, 0), rng.uniform(-100, 100, (40, 2))]
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate(clusters).round(4))]
    rows += [(2, 5000 + i, float(i % 3), 1.0) for i in range(6)] + [(3, 6000, None, 1.0)] + [(4, 7000 + i, 2.0, 2.0) for i in range(300)]
    expected = set()
    for s in (1, 2, 4):
        cells = [r for r in rows if r[0] == s]
        for _, i, x, y in cells:
            near = sorted((float(np.hypot(x - u, y - v)), j) for _, j, u, v in cells if j != i)[:k]
            expected |= {(s, i, j, n + 1) for n, (_, j) in enumerate(near)}
    found = neighbours(spark.createDataFrame(rows, "slice long, cell long, x double, y double"), k).select("slice", "src", "dst", "rank").collect()
    assert set(map(tuple, found)) == expected and len(found) == len(expected)


def _uneven(kind, n=3000):
    rng = np.random.default_rng(3)
    if kind == "even":
        return rng.uniform(0, 100, (n, 2))
    if kind == "stray":
        return np.concatenate((rng.uniform(0, 100, (n - 2, 2)), [[1e7, -1e7], [1e300, 1e300]]))
    if kind == "tight":
        return np.concatenate([rng.normal(c, 1e-6, (n // 4, 2)) for c in ((0, 0), (50, 50), (50, 0), (-9e4, 3))])
    if kind == "nested":
        return np.concatenate([rng.normal(7, 10.0**-i, (n // 10, 2)) for i in range(10)])
    if kind == "line":
        return np.stack((rng.uniform(0, 1, n) ** 9, np.full(n, 2.5)), axis=1)
    return np.concatenate((np.repeat([[1.0, 2.0]], n - 40, 0), rng.uniform(0, 3, (40, 2))))  # "place": nearly all cells in one


@pytest.mark.parametrize("kind", ["even", "stray", "tight", "nested", "line", "place"])
def test_neighbours_of_uneven_slices_are_exact_and_put_out_few_pairs(spark, kind):
    from sliceloom.operators import spatial

    k, places = 6, _uneven(kind)
    cells = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(places)], "slice long, cell long, x double, y double")
    got = {}
    for r in spatial.neighbours(cells, k).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    ids = np.arange(len(places))
    for i, at in enumerate(places):
        d = np.hypot(*(places - at).T)
        order = np.lexsort((ids, d))
        assert [j for _, j in sorted(got[i])] == [j for j in order[: k + 1] if j != i][:k]
    pairs = spatial._searched(cells, k).count()
    assert pairs <= (100 if kind == "nested" else 25) * len(places), pairs / len(places)


def test_permutation_null_draws_the_smallest_hashes(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(i, i % 2, "ab"[int(i % 5 == 0)], float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), float(rng.normal())) for i in range(600)]
    cells = spark.createDataFrame(rows, "cell long, slice long, celltype string, x double, y double, b double")
    targets = cells.where("celltype = 'a'")
    found = T.permutation_null(targets, cells, "b", "b", 3.0, 8.0, draws=5, least=2).first()
    order = Window.partitionBy("draw", "slice").orderBy(F.xxhash64(F.lit(0), "draw", "cell"), "cell")
    drawn = cells.crossJoin(spark.range(5).withColumnRenamed("id", "draw")).withColumn("r", F.row_number().over(order)).where("r <= 60").withColumn("celltype", F.col("draw").cast("string")).drop("r")
    effects = [r["effect"] for r in T.matched_effects(targets, drawn, "b", 3.0, 8.0, 2).collect()]
    assert len(effects) == 5 and found["sd"] == pytest.approx(np.std(effects))
    assert found["p"] == pytest.approx(np.mean([abs(e) >= abs(found["observed"]) for e in effects]))
