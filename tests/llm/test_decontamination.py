"""Benchmark decontamination against brute force."""

import hashlib
import re

import numpy as np
import pytest

from sliceloom.llm import decontamination as D

WRITTEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, source string, w string, code int, window string, items string"


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WRITTEN.findall(text or "")]


def brute(docs, items, width=10):
    """[(doc_id, words, hit places, item ids)]"""
    windows = [(i, w[k : k + width]) for i, t in items if (w := lowered(t)) for k in range(max(1, len(w) - width + 1))]
    out = []
    for doc_id, text in docs:
        words, hit, ids = lowered(text), set(), set()
        for item, v in windows:
            for k in range(len(words) - len(v) + 1):
                if words[k : k + len(v)] == v:
                    hit |= set(range(k, k + len(v)))
                    ids.add(item)
        out.append((doc_id, len(words), sorted(hit), ids))
    return out


def cut(text, hit):
    spans, out, at = [m.span() for m in WRITTEN.finditer(text)], "", 0
    for k, (i, j) in enumerate(spans):
        if k in hit:
            out += text[at:i] if k - 1 not in hit else ""
            at = j
    return out + text[at:]


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(4)
    vocabulary = ["the", "Of", "ÉTÉ", "été", "x1", "7", "naïve", "数学", "a", "B"] + [f"w{i}" for i in range(60)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, " ".join(draw(int(rng.integers(8, 40))))) for i in range(12)]
    items += [(12, items[0][1]), (13, items[1][1].upper()), (3, "one more text under an id that another item has already, in full"), (14, None), (15, ""), (16, "?! ..."), (17, "rare"), (18, "Rare, word"), (19, items[2][1] + " " + items[3][1]), (None, items[4][1]), (20, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(50):
        words = draw(int(rng.integers(1, 90)))
        for _ in range(int(rng.integers(0, 3))):
            part = (items[int(rng.integers(0, 12))][1]).split()
            k = int(rng.integers(0, max(1, len(part) - 11)))
            words[len(words) // 2 : len(words) // 2] = part[k : k + int(rng.integers(9, 20))]
        docs.append((i, (", " if i % 3 else "\n--\x00 ").join(words)))
    docs += [(50, None), (51, ""), (52, " .,;"), (53, items[0][1].swapcase()), (54, "it is RARE word, rare"), (55, "rarely word"), (56, "w1 " * 500), (57, " ".join(draw(20000)) + " " + items[5][1]), (58, items[6][1] + "\n" + items[7][1]), (None, items[8][1]), (None, "clean")]
    return docs, items


@pytest.mark.parametrize("slices", [False, True])
def test_contamination_by_brute_force(spark, tables, slices):
    docs, items = tables
    docs = [*docs, docs[3], docs[3]]  # repeated rows stay rows
    table = spark.createDataFrame([(*d, "s", "x", 1, "y", "z") for d in docs], DOCS).repartition(5)
    bench = spark.createDataFrame([(*i, "x", 2) for i in items], "item_id long, text string, words string, key int").repartition(3)
    got = D.contamination(table, bench, broadcast_bytes=3000 if slices else D.BROADCAST_BYTES).collect()
    want = [(i, n, len(hit), hit, sorted(str(x) for x in ids if x is not None) + [None] * (None in ids)) for i, n, hit, ids in brute(docs, items)]
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["covered"], r["items"]) for r in got], key=str) == sorted(want, key=str)
    if not slices:
        digest = lambda ids: hashlib.sha256(",".join(x for x in ids if x is not None).encode()).hexdigest()
        assert sorted(map(tuple, D.report(table, bench).collect()), key=str) == sorted([(i, n, k, len(ids), digest(ids), k > 0) for i, n, k, _, ids in want], key=str)


def test_decontaminate_cuts_spans_or_documents(spark, tables):
    docs, items = tables
    table = spark.createDataFrame([(*d, "s", "x", 1, "y", "z") for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {(i, t): set(h) for (i, t), (_, _, h, _) in zip(docs, brute(docs, items))}
    clean = D.decontaminate(table, bench)
    assert clean.columns == table.columns
    assert sorted([(r["doc_id"], r["text"]) for r in clean.collect()], key=str) == sorted([(i, t if not h else cut(t, h)) for (i, t), h in hit.items()], key=str)
    kept = D.decontaminate(table, bench, whole=True)
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted([k for k, h in hit.items() if not h], key=str)


def test_empty_tables(spark, tables):
    docs, items = tables
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.report(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), no_items).collect()
    assert len(got) == len(docs) and not any(r["n_hit"] or r["n_items"] or r["contaminated"] for r in got)
