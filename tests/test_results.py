"""Kept results, resuming, layouts and cohorts of files."""

import numpy as np
import pytest

from sliceloom.operators import programs as P
from sliceloom.sources import results as K
from sliceloom.sources import tables as IO


@pytest.fixture
def loadings(spark):
    return spark.createDataFrame([("p", "a", 0.25), ("p", "b", 0.75), ("q", "a", 1.0)], "program string, gene string, weight double")


def rows(df):
    return sorted(map(tuple, df.select("program", "gene", "weight").collect()))


def test_results_are_kept_with_parameters_and_resumed(spark, loadings):
    root, done = IO.scratch(spark, "store"), []

    def make(method, seed):
        done.append((method, seed))
        scores = spark.createDataFrame([("p", 1, 0.5)], "program string, cell long, h double") if seed else None
        K.save_result(root, method, seed, {"p": 2, "tol": 1e-4}, loadings, scores, {"seconds": 1.5})

    jobs = [("ours", 0), ("ours", 1), ("other", 0)]
    assert K.resume(spark, root, jobs[:2], make) == jobs[:2] and K.resume(spark, root, jobs, make) == jobs[2:] and done == jobs
    w, scores, record = K.load_result(spark, root, "ours", 1, {"tol": 1e-4, "p": 2})
    assert rows(w) == rows(loadings) and scores.count() == 1 and record["extra"] == {"seconds": 1.5} and record["seed"] == 1
    assert K.load_result(spark, root, "ours", 0)[1] is None
    with pytest.raises(ValueError, match="other parameters: p"):
        K.load_result(spark, root, "ours", 1, {"p": 3, "tol": 1e-4})
    assert K.load_result(spark, root, "ours", 1, {"p": 3}, any_params=True)[2]["params"]["p"] == 2
    with pytest.raises(FileNotFoundError):
        K.load_result(spark, root, "ours", 9)
    IO.discard(spark, f"{root}/method=ours/seed=1/record")  # as if the job had died before its record
    assert not K.is_complete(spark, root, "ours", 1) and K.resume(spark, root, jobs, make) == [("ours", 1)]
    assert sorted({(r["method"], r["seed"]) for r in K.load_all(spark, root).collect()}) == sorted(jobs)


def test_layouts(spark, loadings):
    root = IO.scratch(spark, "layouts")
    IO.write_csv(IO.to_wide(loadings, ["a", "b"]), f"{root}/wide")
    assert rows(K.load_loadings(spark, f"{root}/wide", "wide", "x")) == [("xp", "a", 0.25), ("xp", "b", 0.75), ("xq", "a", 1.0)]
    IO.write_csv(spark.createDataFrame([("a", 0.25, 1.0), ("b", 0.75, None)], "gene string, p double, q double"), f"{root}/t")
    assert rows(K.load_loadings(spark, f"{root}/t", "transposed")) == rows(loadings)
    values = [(c, g, float(c * (2 if g == "a" else -1) + (c % 3 if g == "c" else 0))) for c in range(12) for g in "abc"]
    spark.createDataFrame(values, "cell long, gene string, value double").write.parquet(f"{root}/s/values")
    spark.createDataFrame([("p", c, float(c)) for c in range(12)], "program string, cell long, h double").write.parquet(f"{root}/s/scores")
    spark.createDataFrame([(c, c // 3) for c in range(12)], "cell long, slice long").write.parquet(f"{root}/s/cells")
    got = {g: w for _, g, w in rows(K.load_loadings(spark, f"{root}/s", "scores"))}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(-1.0)
    with pytest.raises(ValueError, match="layout"):
        K.load_loadings(spark, root, "other")


def test_cohorts_of_files_and_order(spark):
    root = IO.scratch(spark, "files")
    spark.createDataFrame([(1, "x")], "cell long, kind string").write.parquet(f"{root}/old_1.parquet")
    spark.createDataFrame([(2,), (3,)], "cell long").write.parquet(f"{root}/old_2.parquet")
    spark.createDataFrame([(4,)], "cell long").write.parquet(f"{root}/new_1.parquet")
    got = sorted((r["cohort"], r["cell"], r["kind"]) for r in K.read_cohort_files(spark, f"{root}/old_*.parquet").collect())
    assert got == [("old_1", 1, "x"), ("old_2", 2, None), ("old_2", 3, None)]
    cells = spark.createDataFrame([(7, 0), (5, 1), (6, 2)], "cell long, row long").repartition(3)
    found = spark.createDataFrame([(6, 0.6), (7, 0.7), (9, 0.9)], "cell long, h double")
    assert [(r["row"], r["cell"], r["h"]) for r in K.in_order(found, cells, "cell", "row").collect()] == [(0, 7, 0.7), (1, 5, None), (2, 6, 0.6)]


def test_absolute_weights_are_cut_and_projected(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(2, 15))
    long = spark.createDataFrame([(f"p{j}", g, float(v)) for j, row in enumerate(w) for g, v in enumerate(row)], "program string, gene int, weight double")
    for share, top, k in ((0.1, None, 2), (0.01, None, 1), (None, 4, 4), (None, None, 15)):
        got = {(r["program"], r["gene"]): r["weight"] for r in P.sparsify_absolute(long, share, top, project=False).collect()}
        for j in range(2):
            cut = np.sort(np.abs(w[j]))[-k]
            assert [got[f"p{j}", g] for g in range(15)] == pytest.approx([abs(v) if abs(v) >= cut else 0.0 for v in w[j]])
        sums = P.sparsify_absolute(long, share, top).groupBy("program").sum("weight").collect()
        assert [r[1] for r in sums] == pytest.approx([1.0, 1.0])


def test_layouts_make_the_loadings_once(spark, monkeypatch):
    from sliceloom.plans import studies

    rows = spark.createDataFrame([(p, g, 0.25) for p in "FO" for g in "wxyz"], "program string, gene string, weight double").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(studies.A, "programs", lambda *_: rows.mapInArrow(counted, rows.schema))
    assert studies.result_layouts(spark, "unused").count() == 32 and seen.value == 8
