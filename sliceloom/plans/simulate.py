"""Synthetic slices with known programs, and baseline decompositions to hold against them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sliceloom.plans.fit import on_cells
from sliceloom.sources.tables import written


def active_loadings(rng: np.random.Generator, p: int, genes: int, k: int) -> np.ndarray:
    """p Dirichlet loadings on k genes each; shares under 1 / (2 k) are cut and the rest sum to 1."""
    w = np.zeros((p, genes))
    for j in range(p):
        chosen = rng.choice(genes, k, replace=False)
        share = rng.dirichlet(np.ones(k))
        share[share < 1 / (2 * k)] = 0
        w[j, chosen] = share / share.sum()
    return w


def generate(seed: int = 1, slices: int = 12, genes: int = 40, p: int = 3, k: int = 8, cells: int = 60, age: Sequence[float] = (10.0, 5.0, 0.0), space: Sequence[float] = (6.0, 0.0, 8.0), error: float = 0.1, gamma_age: float = 0.5, gamma_space: float = 2.0) -> dict:
    """Ages from 3 to 30, kernels over time and place, trajectories, fields, scores, loadings and values by slice."""
    rng = np.random.default_rng(seed)
    ages = np.linspace(3, 30, slices) + rng.normal(0, 0.2, slices)
    z = (ages - ages.mean()) / ages.std(ddof=1)
    k_age = np.exp(-((z[:, None] - z[None]) ** 2) / gamma_age) + 1e-10 * np.eye(slices)
    w = active_loadings(rng, p, genes, k)
    alpha = np.array([np.sqrt(s) * np.linalg.cholesky(k_age) @ rng.normal(size=slices) for s in age[:p]])
    out = {"ages": ages, "w": w, "alpha": alpha, "slices": []}
    for t in range(slices):
        n = max(cells // 2, int(rng.normal(cells, cells / 10)))
        xy = rng.normal(size=(n, 2))
        k_space = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / gamma_space) + 1e-8 * np.eye(n)
        root = np.linalg.cholesky(k_space)
        b = np.stack([np.sqrt(s) * root @ rng.normal(size=n) for s in space[:p]], axis=1)
        h = alpha[:, t] + b
        out["slices"].append({"xy": xy, "h": h, "b": b, "y": h @ w + rng.normal(0, error**0.5, (n, genes))})
    return out


def as_cells(spark: SparkSession, data: dict, fit: str = "simulated") -> DataFrame:
    """fit, slice, age, cell, x, y, genes."""
    rows, cell = [], 0
    for t, s in enumerate(data["slices"]):
        for (x, y), values in zip(s["xy"].tolist(), s["y"].tolist(), strict=True):
            rows.append((fit, t, float(data["ages"][t]), cell, x, y, values))
            cell += 1
    return spark.createDataFrame(rows, "fit string, slice long, age double, cell long, x double, y double, genes array<double>")


def pca(gram: np.ndarray, mean: np.ndarray, n: float, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and singular values of centred values, from their Gram matrix and means."""
    values, vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))
    return vectors[:, ::-1][:, :p].T, np.sqrt(np.maximum(values[::-1][:p], 0))


def nmf(values: np.ndarray, p: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative scores and loadings by multiplicative updates from the absolute singular vectors; columns are shifted to be non-negative."""
    x = values - np.minimum(values.min(axis=0), 0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    h, w = np.abs(u[:, :p]) * np.sqrt(s[:p]) + 1e-6, np.abs(vt[:p]) * np.sqrt(s[:p])[:, None] + 1e-6
    for _ in range(rounds):
        w *= (h.T @ x) / np.maximum(h.T @ h @ w, 1e-12)
        h *= (x @ w.T) / np.maximum(h @ (w @ w.T), 1e-12)
    return h, w


def signal_share(signal: np.ndarray, genes: np.ndarray, cells: np.ndarray) -> float:
    """Variance of the signal over that of signal + gene + cell terms; 1 if there is no variance."""
    whole = float(np.var(signal + genes + cells[:, None])) if signal.size else 0.0
    return float(np.var(signal)) / whole if whole > 1e-12 else 1.0


def counts(data: dict, seed: int = 1, dispersion: float | None = 10.0, library: float | None = None, share: float | None = None, offset: tuple[float, float] = (0.25, 0.4)) -> dict:
    """Counts for the signal of generate(): data with 'counts' in each slice, 'tiers' of genes and the 'share' reached.

    Log rates are signal + gene baseline + cell offset. Genes of a program are markers, 30 % of all genes are
    housekeeping, the rest are mostly off. With `share`, baselines and offsets (85 and 15 % of the other variance) are
    scaled until the signal has that share of the variance of log rates. With `library`, offsets are shifted until cells
    have that many counts on average. Gamma-Poisson with `dispersion`, Poisson where it is None.
    """
    if share is not None and not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    rng = np.random.default_rng([seed, 7])
    w = data["w"]
    marker = (w > 0).any(axis=0)
    plain = rng.permutation(np.flatnonzero(~marker))
    house = plain[: round(0.3 * w.shape[1])]
    tiers = np.where(marker, "marker", "mostly_off").astype(object)
    tiers[house] = "housekeeping"
    span = {"marker": (-1.4, 0.2), "housekeeping": (1.2, 2.2), "mostly_off": (-3.6, -1.8)}
    base = np.array([rng.uniform(*span[t]) for t in tiers])
    signal = np.concatenate([s["h"] @ w for s in data["slices"]])
    middle, cells = base.mean(), rng.normal(0, offset[1], len(signal))
    genes, cells = base - middle, cells - cells.mean()
    if share is not None:
        other = np.var(signal) * (1 - share) / share
        genes, cells = (v * np.sqrt(part * other / np.var(v)) if np.var(v) > 1e-16 else v * 0 for v, part in ((genes, 0.85), (cells, 0.15)))
        lo, hi = 0.0, 1.0
        while signal_share(signal, hi * genes, hi * cells) > share and hi < 1e6:
            hi *= 2
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if signal_share(signal, mid * genes, mid * cells) > share else (lo, mid)
        genes, cells = hi * genes, hi * cells
    reached = signal_share(signal, genes, cells)
    shift = offset[0]
    if library is not None:
        rates = np.exp(np.clip(signal + middle + genes + np.clip(cells, -4, 4)[:, None], -20, 10))
        shift = np.log(library / rates.sum(axis=1).mean())
    rates = np.exp(np.clip(signal + middle + genes + np.clip(cells + shift, -4, 4)[:, None], -20, 10))
    drawn = rng.poisson(rates if dispersion is None else rng.gamma(dispersion, rates / dispersion))
    ends = np.cumsum([len(s["h"]) for s in data["slices"]])[:-1]
    return data | {"tiers": tiers, "share": reached, "slices": [s | {"counts": c} for s, c in zip(data["slices"], np.split(drawn, ends), strict=True)]}


def spatial_pca(lam: np.ndarray, u: np.ndarray, values: np.ndarray, p: int, times: np.ndarray | None = None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """tau, error variance, loadings (p x genes) and rotated scores (rows x p) of a spatial factor model with a common mean.

    In the eigenbasis of the spatial kernel 1 + tau K is diagonal. For a given tau the restricted likelihood is largest at
    the leading eigenvectors of the genes' Gram matrix that the kernel explains; tau is found by golden section on its
    logarithm in [-10, 10]. Scores are posterior means about the generalised least-squares mean. times: how many
    directions a row stands for.
    """
    times = np.ones(len(values)) if times is None else times
    n, genes = float(times.sum()), values.shape[1]
    p = min(p, genes)

    def residual(s: np.ndarray) -> np.ndarray:
        mean = (s * u) @ values / ((s * u) @ u)
        return (values.T * s) @ values - ((s * u) @ u) * np.outer(mean, mean)

    total = residual(np.ones(len(values)))

    def fit(x: float):
        s = 1 / (1 + np.exp(x) * lam)
        top, vectors = np.linalg.eigh(total - residual(s))
        left = max(np.trace(total) - top[-p:].sum(), 1e-30)
        return p * (np.log((s * u) @ u) - times @ np.log(s)) / 2 + genes * (n - 1) / 2 * np.log(left), left, vectors[:, ::-1][:, :p]

    lo, hi, g = -10.0, 10.0, (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = fit(a)[0], fit(b)[0]
    while hi - lo > 1e-5:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = fit(a)[0]
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = fit(b)[0]
    x = (lo + hi) / 2
    _, left, w = fit(x)
    s = 1 / (1 + np.exp(x) * lam)
    mean = (s * u) @ values / ((s * u) @ u)
    return float(np.exp(x)), left / (genes * (n - 1)), w.T, (np.exp(x) * lam * s)[:, None] * ((values - np.outer(u, mean)) @ w)


SPATIAL = "fit string, kind string, program int, key long, value double"


def spatial_pca_keys(spectral: DataFrame, p: int, scaled: bool = True, scores: bool = True) -> DataFrame:
    """One task for each fit key over its spectral rows. Rows by kind: tau, error, loading (key: gene), and with `scores` score (key: cell).

    scaled: genes have unit variance first. Signs follow the largest loading of each program. A task has no vectors:
    scores go back to cells slice by slice.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        u, values, times = pdf["u"].to_numpy(), np.stack(pdf["values"].to_list()), pdf["times"].to_numpy(float)
        if scaled:
            n = times.sum()
            var = ((values**2).sum(axis=0) - (u @ values) ** 2 / n) / max(n - 1, 1)
            values = values / np.where(var > 1e-24, np.sqrt(np.maximum(var, 0)), 1.0)
        tau, error, w, z = spatial_pca(pdf["lam"].to_numpy(), u, values, p, times)
        sign = np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)])
        w, z = w * sign[:, None], z * sign
        out = [("tau", None, None, tau), ("error", None, None, error)]
        out += [("loading", j, g, v) for j in range(len(w)) for g, v in enumerate(w[j])]
        table = pd.DataFrame(out, columns=["kind", "program", "key", "value"]).astype({"program": "Int32", "key": "Int64"})
        table = pd.concat((table, pd.DataFrame({"slice": pd.Series(dtype="Int64"), "i": pd.Series(dtype="Int32")})), axis=1).assign(z=None)
        if scores:
            table = pd.concat((table, pd.DataFrame({"kind": "row", "slice": pdf["slice"].to_numpy(), "i": pdf["i"].to_numpy(), "z": list(z)}).astype({"slice": "Int64", "i": "Int32"})))
        table.insert(0, "fit", pdf["fit"].iloc[0])
        return table

    found = spectral.drop("vector", "cells").groupBy("fit").applyInPandas(one, SPATIAL + ", slice long, i int, z array<double>")
    columns = ["fit", "kind", "program", "key", "value"]
    if not scores:
        return found.select(*columns)
    found = written(found, "fitted")
    return found.where("kind <> 'row'").select(*columns).unionByName(on_cells(found.where("kind = 'row'").select("fit", "slice", "i", "z"), spectral, {"z": "score"}))
