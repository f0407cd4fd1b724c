"""Evaluation and merging of labels from their contingency table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.operators.programs import align


def majority(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """cluster, label: its commonest truth, ties to the smallest."""
    n = df.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), truth)
    return n.withColumn("r", F.row_number().over(order)).where("r = 1").select(cluster, F.col(truth).alias("label"))


def _pairs(c):
    return c * (c - 1) / 2.0


def evaluate(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: ari, nmi (arithmetic mean), accuracy after majority merge, balanced accuracy and macro F1 of the merged labels, labels."""
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = cells.groupBy(truth).agg(F.sum("n").alias("a"))
    b = cells.groupBy(pred).agg(F.sum("n").alias("b"))
    whole = cells.agg(F.sum("n").alias("total"), F.sum(_pairs(F.col("n"))).alias("ij"))
    ra = a.agg(F.sum(_pairs(F.col("a"))).alias("i"), F.sum(F.col("a") * F.ln("a")).alias("ea"))
    rb = b.agg(F.sum(_pairs(F.col("b"))).alias("j"), F.sum(F.col("b") * F.ln("b")).alias("eb"), F.count(F.lit(1)).alias("labels"))
    mutual = cells.agg(F.sum(F.col("n") * F.ln("n")).alias("em"))
    named = df.select(truth, F.col(pred).alias("_pred")).join(majority(df, pred, truth).toDF("_pred", "_label"), "_pred").select(F.col(truth).alias("t"), F.col("_label").alias("l"))
    hits = named.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == F.col("l")).alias("tp"))
    said = named.groupBy(F.col("l").alias("t")).agg(F.count(F.lit(1)).alias("m"))
    f1 = hits.join(said, "t", "left").agg((F.sum("tp") / F.sum("n")).alias("accuracy"), F.avg(F.col("tp") / F.col("n")).alias("balanced"), F.avg(2 * F.col("tp") / (F.col("n") + F.coalesce("m", F.lit(0)))).alias("macro_f1"))
    row = whole
    for part in (ra, rb, mutual, f1):
        row = row.crossJoin(part)  # one row each
    expected = F.col("i") * F.col("j") / _pairs(F.col("total"))
    t = F.col("total")
    ha, hb = F.ln(t) - F.col("ea") / t, F.ln(t) - F.col("eb") / t
    mi = F.ln(t) + F.col("em") / t - F.col("ea") / t - F.col("eb") / t
    return row.select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected)).alias("ari"), (mi / ((ha + hb) / 2)).alias("nmi"), "accuracy", "balanced", "macro_f1", "labels")


def _kmeans(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Lloyd's algorithm from farthest points, the first the one nearest to the mean; deterministic."""
    chosen = [int(((x - x.mean(axis=0)) ** 2).sum(1).argmin())]
    for _ in range(1, k):
        chosen.append(int(np.min([((x - x[c]) ** 2).sum(1) for c in chosen], axis=0).argmax()))
    centres, labels = x[chosen], np.zeros(len(x), int)
    for step in range(rounds):
        fresh = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        if step and (fresh == labels).all():
            break
        labels = fresh
        centres = np.array([x[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
    return labels


#: Cells of a slice up to which its Laplacian is a matrix; beyond, only its links are held.
DENSE = 1024


def _nearest_rows(x: np.ndarray, m: int) -> np.ndarray:
    """The m nearest other rows of each, nearest first, ties by place. A product of matrices, a few rows at a time, tells who can be among them; their distances are then worked out by differences."""
    n, out = len(x), np.empty((len(x), m), np.int64)
    squares = (x * x).sum(axis=1)
    doubt = 1e-9 * (1 + squares.max())
    rows = max(1, (1 << 22) // n)
    for i in range(0, n, rows):
        part = x[i : i + rows]
        d = squares[i : i + rows, None] + squares[None] - 2 * part @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        at, to = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m] + doubt)
        exact = np.concatenate([((part[at[j : j + (1 << 16)]] - x[to[j : j + (1 << 16)]]) ** 2).sum(-1) for j in range(0, len(at), 1 << 16)])
        order = np.lexsort((to, exact, at))
        first = np.searchsorted(at, np.arange(len(d)))
        out[i : i + rows] = to[order][first[:, None] + np.arange(m)]
    return out


def _smooth_vectors(near: np.ndarray, k: int, tol: float = 1e-10, width: int = 8, most: int = 200) -> np.ndarray:
    """The k smallest eigenvectors of the normalised Laplacian of the symmetric graph, over the roots of the degrees: block Krylov spaces with restarts, on the links alone."""
    n, m = near.shape
    a, b = np.repeat(np.arange(n), m), near.ravel()
    code = np.unique(np.concatenate((a * n + b, b * n + a)))
    to = code % n
    first = np.searchsorted(code, np.arange(n) * n)
    root = 1 / np.sqrt(np.diff(np.append(first, len(code))))
    smoothed = lambda v: root[:, None] * np.stack([np.add.reduceat((root * c)[to], first) for c in v.T], axis=1)
    block = np.random.default_rng(n).normal(size=(n, k + width))
    block[:, 0] = 1 / root  # the known one, of eigenvalue 0
    block = np.linalg.qr(block)[0]
    for _ in range(most):
        basis, last = block, block
        for _step in range(10):
            last = smoothed(last)
            for _twice in range(2):
                last = last - basis @ (basis.T @ last)
            last = np.linalg.qr(last)[0]
            basis = np.concatenate((basis, last), axis=1)
        image = smoothed(basis)
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turn = turn[:, ::-1][:, : k + width]
        block, moved = basis @ turn, image @ turn
        if np.abs(moved[:, :k] - block[:, :k] * values[::-1][:k]).max() < tol:
            break
        block = np.linalg.qr(block)[0]
    return block[:, :k] * root[:, None]


def spectral_labels(cells: DataFrame, k: int) -> DataFrame:
    """slice, cell, label: k-means on the smallest eigenvectors of the normalised Laplacian of the symmetric graph of max(2, round(sqrt(n))) nearest neighbours, slice by slice. Slices of at most k cells get their place modulo k."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        x = np.stack(pdf["genes"].to_list())
        n = len(x)
        if n <= k:
            return pd.DataFrame({"slice": pdf["slice"], "cell": pdf["cell"], "label": np.arange(n) % k})
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        m = min(max(2, round(n**0.5)), n - 1)
        near = _nearest_rows(x, m)
        if n <= DENSE:
            linked = np.zeros((n, n))
            linked[np.repeat(np.arange(n), m), near.ravel()] = 1
            linked = np.maximum(linked, linked.T)
            root = 1 / np.sqrt(linked.sum(axis=1))
            vectors = np.linalg.eigh(np.eye(n) - root[:, None] * linked * root[None])[1][:, :k] * root[:, None]
        else:
            vectors = _smooth_vectors(near, k)
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
        return pd.DataFrame({"slice": pdf["slice"], "cell": pdf["cell"], "label": _kmeans(vectors, k)})

    return cells.select("slice", "cell", "genes").groupBy("slice").applyInPandas(one, "slice long, cell long, label long")


def matched_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: the largest accuracy of a one-to-one naming of predictions, from the contingency table."""
    n = df.groupBy(F.col(truth).cast("string").alias("p"), F.col(pred).cast("string").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    full = n.select("p").distinct().crossJoin(n.select("q").distinct()).join(n, ["p", "q"], "left")
    named = align(full.select("p", "q", (-F.coalesce("n", F.lit(0))).cast("double").alias("cost")))
    return named.agg((-F.sum("cost")).alias("hits")).crossJoin(df.agg(F.count(F.lit(1)).alias("n"))).select((F.col("hits") / F.col("n")).alias("accuracy"))
