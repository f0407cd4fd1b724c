"""The conversation prefix trie against a trie of tuples."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sliceloom.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth int, fp string, n long"


def sequences(rows):
    """conv_id -> its turns, ordered as the operator does."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def rebuilt(given):
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        giver = given.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = giver[:h] + own[h:]
    return out


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(p[-1][1]) * (len(members[p]) - 1) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()]


def conversations(seed=1, n=260):
    rng = np.random.default_rng(seed)
    opening = [("user", "hello"), ("assistant", "Ünïcode 👋 there"), ("user", "")]
    rows = []
    for c in range(n):
        turns = opening[: int(rng.integers(0, 4))] if c % 3 else opening * 2  # a third are one conversation
        turns = turns + [(str(rng.choice(["user", "assistant"])), f"t{rng.integers(0, 3)}") for _ in range(int(rng.integers(0, 5)) if c % 3 else 0)]
        turns = turns or [("user", "only")]
        rows += [(c * 3 - 90, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(5000, i, "user", f"x{i % 2}") for i in range(300)] + [(5001, i, "user", f"x{i % 2}") for i in range(290)]  # long ones that part late
    rows += [(6000, 0, None, None), (6001, 0, "", None), (6001, 1, "a", "b"), (6002, None, "z", "null first"), (6002, 3, "a", "b"), (6002, 3, "a", "c"), (6002, 3, "A", "z"), (6002, 3, "a", "b")]
    rows += [(None, 0, "user", "no conversation"), (2**62, 0, "user", "hello"), (-(2**62), 1, "user", "hello"), (6003, 0, "a" * 70, "p" * 5000)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize(("bits", "block"), [(64, 4096), (64, 7), (3, 16)])
def test_trie_by_brute_force(spark, bits, block):
    """Also with blocks shorter than conversations, and with hashes so short that most groups are mixed and must be split."""
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    got = prefixes.rebuilt_trie(table, bits, block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rebuilt(sequences(rows))), key=str)


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations(2, 60)
    got = prefixes.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), block=16)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(sequences(rows)), key=str)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefixes.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 0


def test_scan_goes_on_between_batches():
    rng = np.random.default_rng(0)
    key, x = np.sort(rng.integers(0, 9, 200)), rng.integers(0, 2**63, (200, 2)).astype(np.uint64)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    whole = prefixes._running(new, x, np.zeros(2, np.uint64))
    cut = 77
    first = prefixes._running(new[:cut], x[:cut], np.zeros(2, np.uint64))
    assert (np.concatenate((first, prefixes._running(new[cut:], x[cut:], first[-1]))) == whole).all()
    assert [int(v) for v in whole[:, 0]] == [sum(int(y) for y, k in zip(x[: i + 1, 0], key) if k == key[i]) % 2**64 for i in range(200)]
