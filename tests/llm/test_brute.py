"""Fingerprints and shard trees against brute force, value by value."""

import numpy as np
import pyarrow as pa
import pytest

from sliceloom.llm import fingerprints, sharding

from test_operators import SCHEMA, make, shingles

TOP, SCALE, FLOOR = 2**64 - 1, 8, 32


def hash_of(shingle, known={}):  # noqa: B006
    """The hash of one shingle: that of a text of nothing else."""
    if shingle not in known:
        known[shingle] = int(fingerprints.sketches(pa.array([" ".join(shingle)]))[0][0])
    return known[shingle]


def sketch(text):
    hashes = sorted({hash_of(s) for s in shingles(text)})
    return hashes[: max(sum(h <= TOP // SCALE for h in hashes), min(FLOOR, len(hashes)))]


def alike(a, b):
    if not a or not b:
        return (1.0, 1.0) if not a and not b else (0.0, 0.0)
    most = min(TOP if len(x) < FLOOR else max(x[-1], TOP // SCALE) for x in (a, b))
    a, b = ({h for h in x if h <= most} for x in (a, b))
    return (len(a & b) / len(a | b), len(a & b) / len(a)) if a and b else (0.0, 0.0)


def test_fingerprints_and_likenesses_by_brute_force(spark):
    rows = make(5, 40)
    texts = {r[0]: r[1] or "" for r in rows}
    ids = sorted(texts)
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        text, following = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, new, other = sketch(text), sketch(edited), sketch(following)
        assert [int(h) for h in fingerprints.read(r["fingerprint"])] == own and [int(h) for h in fingerprints.read(r["edited_fingerprint"])] == new
        assert (r["near_edited"], r["contained_edited"]) == pytest.approx(alike(own, new))
        assert (r["near_next"], r["contained_next"]) == pytest.approx(alike(own, other))


def brute_leaves(items, dims, leaves):
    """item number -> leaf, by sorting every node whole."""
    whole = [max(1, max(i[d] for i in items) - min(i[d] for i in items)) for d in range(dims)]

    def split(mine, lo, hi):
        if hi - lo <= 1 or not mine:
            return dict.fromkeys(mine, lo)
        spread = [(max(items[i][d] for i in mine) - min(items[i][d] for i in mine)) / whole[d] for d in range(dims)]
        d = max(range(dims), key=lambda k: (spread[k], -k))
        order, half = sorted(mine, key=lambda i: (items[i][d], items[i][-1])), (hi - lo) // 2
        goal, below = half / (hi - lo) * sum(items[i][dims] for i in mine), 0
        for at, i in enumerate(order):  # noqa: B007
            if below + items[i][dims] >= goal:
                break
            below += items[i][dims]
        at += goal - below > below + items[i][dims] - goal
        return split(order[:at], lo, lo + half) | split(order[at:], lo + half, hi)

    return split(list(range(len(items))), 0, leaves)


@pytest.mark.parametrize("leaves", [2, 7, 16])
def test_every_split_is_the_weighted_median_of_the_widest_dimension(spark, leaves):
    rng = np.random.default_rng(leaves)
    items = [(int(rng.integers(0, 4)), int(rng.integers(0, 50)), int(rng.integers(0, 10**6)), int(rng.integers(1, 2000)), int(t)) for t in rng.permutation(300)]
    items += [(2, 7, 5000, 1, 1000 + t) for t in range(40)]  # alike but for the tie
    frame = spark.createDataFrame([(n, *i) for n, i in enumerate(items)], "n long, a long, b long, c long, weight long, tie long").repartition(3)
    got = {r["n"]: r["leaf"] for r in sharding.kd_leaves(frame, ["a", "b", "c"], leaves, slack=0.0).collect()}
    assert got == brute_leaves(items, 3, leaves)
