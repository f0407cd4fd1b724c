"""Spectral rows without vectors, and distances dealt to many tasks."""

import numpy as np

from sliceloom.operators import spatial as S
from sliceloom.plans.fit import rotated_spectrum, spectrum


def test_rows_without_vectors_are_those_with(spark):
    """The same eigenvalues and, as vectors are free in their sign and where eigenvalues meet, the same sums over them; wide, narrow and whole kernels, many cells in one place."""
    rng = np.random.default_rng(4)
    xy, values = rng.normal(size=(220, 2)), rng.normal(size=(220, 5))
    xy[:40] = xy[0]
    for gamma, whole in ((20.0, 50), (2.0, 50), (1e-4, 50), (2.0, 1000)):
        lam, v, idle = spectrum(xy, values, gamma, 1e-8, whole)
        other, u, rotated, others = rotated_spectrum(xy, values, gamma, 1e-8, whole)
        assert idle == others and np.allclose(lam, other, atol=1e-11) and (idle > 0) == (whole == 50)
        both = np.column_stack((v.T @ values, v.sum(axis=0))), np.column_stack((rotated, u))
        for s in (1e-3, 1.0, 1e4):
            a, b = (m.T @ (m / (1 + s * np.maximum(w, 0))[:, None]) for m, w in zip(both, (lam, other), strict=True))
            assert np.allclose(a, b, rtol=1e-7, atol=1e-7)


def test_kth_distances_are_made_in_many_tasks(spark, monkeypatch):
    """Blocks of a slice are few bytes and much work: left to the sizes of partitions one task had them all."""
    monkeypatch.setattr(S, "BLOCK", 50)
    cells = spark.range(400, numPartitions=2).selectExpr("'s' as slice", "id as cell", "double(id * id % 97) as x", "double(id % 13) as y")
    got = S.kth_distances(cells, 0.1)
    parts = got.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 400 and len(parts) > 2
    at = np.array([(i * i % 97, i % 13) for i in range(400)], float)
    want = np.sort(np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)), axis=1)[:, 40]
    assert all(abs(r["d"] - want[r["cell"]]) < 1e-9 and r["k"] == 40 for r in got.collect())
    assert S.kth_distances(cells.limit(0), 0.1).count() == 0
