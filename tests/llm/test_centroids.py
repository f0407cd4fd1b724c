"""Centroid clustering against exact integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from sliceloom.llm import centroids


def grid(vector):
    if vector is None or len(vector) != 64 or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [max(-centroids.FARTHEST, min(centroids.FARTHEST, math.floor(64 * x))) for x in vector]


def brute(rows, k=16, rounds=3):
    kept = [(i, v) for i, x in rows if (v := grid(x)) is not None]
    key = lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        mine = [near(v)[0] for _, v in kept]
        for c in range(len(at)):
            own = [v for (_, v), m in zip(kept, mine) if m == c]
            if own:
                at[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    total = lambda rows: sum(r[2] for r in rows)
    fits = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, c, d, fits(total([r for r in found if r[1] == c])), fits(total(found)), digest[c]) for i, c, d in found]


def vectors(n=300, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (9, 64)) * np.linspace(2, 0.1, 64)
    rows = [(i, (middles[i % 9] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]  # a third of all rows is one vector
    rows += [rows[0], rows[0], (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.1] * 63 + [None]), (905, [0.1] * 63 + [math.nan]), (906, [-math.inf] * 64)]
    return rows + [(907, [0.0] * 64), (908, [-0.0] * 64), (None, rows[5][1]), (None, None), (-4, [-0.015] * 64)]


SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, _cluster int"


@pytest.mark.parametrize("extreme", [False, True])
def test_clusters_by_brute_force(spark, extreme):
    rows = vectors() + ([(909, [3e38] * 64), (910, [-3e38] * 64)] if extreme else [])
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = centroids.with_inertia(*centroids.cluster(table))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(7, [1.0] * 64), (8, [1.0] * 64), (9, [-2.0] * 64)]
    got = centroids.with_inertia(*centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
    for none in ([], [(1, None)]):
        assert centroids.with_inertia(*centroids.cluster(spark.createDataFrame(none, "vec_id long, embedding array<double>"))).count() == 0


def test_partial_distances_find_the_nearest_and_skip_most_components():
    rng = np.random.default_rng(3)
    c = rng.integers(-90, 90, (40, 64))
    c[[11, 30]] = c[4]  # ties go to the smaller number
    x = np.concatenate((c[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 64)), rng.integers(-90, 90, (500, 64)), c))
    which, best, compared = centroids.nearest(x, c, rng.permutation(64))
    full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert compared < 0.5 * x.size * len(c)
