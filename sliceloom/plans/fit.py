"""The estimator: non-negative rank-p factorisation with Gaussian-process priors over time and space.

One eigendecomposition of each slice's kernel turns cells into spectral rows (eigenvalue, projection of the constant,
rotated values). On these rows every step is row-wise arithmetic, sums by slice and a solve over slices, so a fit is
one grouped task for each fit key, and independent fits run side by side. Without a spatial term only sums by slice and a
Gram matrix matter: one aggregation, whatever the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.sources.tables import written

FLOOR, CEILING, JITTER = 1e-6, 1e6, 1e-12
Z95 = 1.959963984540054
#: Cells of a slice up to which its kernel is decomposed as a dense matrix.
WHOLE = 1024


def project_simplex(v: np.ndarray, k: int | None = None) -> np.ndarray:
    """Euclidean projection on the simplex, of the k largest entries only if k is given."""
    out = np.zeros(len(v))
    chosen = np.argsort(-v, kind="stable")[: k or len(v)]
    u = v[chosen]
    excess = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    theta = excess[np.flatnonzero(u > excess)[-1]]
    out[chosen] = np.maximum(u - theta, 0)
    return out / out.sum()


def age_kernel(ages: np.ndarray, gamma: float) -> np.ndarray:
    """Gaussian kernel of z-scored ages; without spread all are alike."""
    sd = ages.std(ddof=1) if len(ages) > 1 else 0.0
    z = (ages - ages.mean()) / sd if sd > 1e-12 else np.zeros(len(ages))
    return np.exp(-((z[:, None] - z[None]) ** 2) / gamma)


@dataclass
class Rows:
    """Spectral rows: slice number, eigenvalue, projection of the constant, and how many directions a row stands for; rotated values beside them."""

    at: np.ndarray
    lam: np.ndarray
    u: np.ndarray
    k_age: np.ndarray
    spatial: bool = True
    times: np.ndarray | None = None
    cells: float = field(init=False)
    k_inverse: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        t = len(self.k_age)
        self.times = np.ones(len(self.at)) if self.times is None else self.times
        self.cells = float(self.times.sum())
        for jitter in (JITTER, 1e-8, 1e-4):
            try:
                np.linalg.cholesky(self.k_age + jitter * np.eye(t))
                self.k_inverse = np.linalg.inv(self.k_age + jitter * np.eye(t))
                break
            except np.linalg.LinAlgError:
                continue
        else:
            values, vectors = np.linalg.eigh((self.k_age + self.k_age.T) / 2)
            self.k_inverse = (vectors / np.maximum(values, 1e-10)) @ vectors.T
        self.sizes = self.sums(self.u * self.u)

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=v, minlength=len(self.k_age))


@dataclass
class Factor:
    h: np.ndarray
    w: np.ndarray
    age: float
    space: float
    error: float
    trace: float = 0.0
    steps: int = 0
    converged: bool = False


def posterior(rows: Rows, rw: np.ndarray, w2: float, age: float, space: float, error: float) -> tuple[np.ndarray, float]:
    """Posterior mean of the scores, and the trace of their covariance, given residual times loading."""
    if age < JITTER and (space < JITTER or not rows.spatial):
        return np.zeros(len(rw)), 0.0
    rho, a = rw / error, w2 / error
    d = 1 / (1 + a * space * rows.lam)
    x = d * (age * (rows.k_age @ rows.sums(rows.u * rho))[rows.at] * rows.u + space * rows.lam * rho)
    s = np.linalg.inv(rows.k_inverse / (a * max(age, JITTER)) + np.diag(rows.sums(d * rows.u**2)))
    h = x - (s @ rows.sums(rows.u * x))[rows.at] * d * rows.u
    trace = (rows.cells - (rows.times @ d - (np.diag(s) * rows.sums(d * d * rows.u**2)).sum())) / a
    return h, max(0.0, float(trace))


def update_variances(rows: Rows, rw: np.ndarray, w2: float, total: float, genes: int, age: float, space: float, error: float, fixed: bool) -> tuple[float, float, float]:
    """One minorise-maximise step; every variance is scaled by the root of its ratio."""
    c, y1 = 1 / (w2 * space * rows.lam + error), rw / np.sqrt(w2)
    r = rows.sums(c * rows.u**2)
    b = np.linalg.inv(rows.k_inverse / age + w2 * np.diag(r))
    z = c * y1 - c * w2 * (b @ rows.sums(rows.u * c * y1))[rows.at] * rows.u
    g = rows.sums(rows.u * z)
    across = max(0.0, total - float(y1 @ y1))
    age_up, age_down = w2 * g @ rows.k_age @ g, w2 * (np.diag(rows.k_age) @ r - w2 * (rows.k_age * np.outer(r, r) * b).sum())
    space_up, space_down = w2 * (rows.lam * z * z).sum(), w2 * (rows.times @ (rows.lam * c) - np.diag(b) @ (w2 * rows.sums(rows.lam * c * c * rows.u**2)))
    error_up = float(z @ z) + across / error**2
    error_down = rows.times @ c - np.diag(b) @ (w2 * rows.sums(c * c * rows.u**2)) + (genes - 1) * rows.cells / error

    def scaled(v: float, up: float, down: float) -> float:
        return float(np.clip(v * np.sqrt(max(up, 0) / max(down, 1e-300)), FLOOR, CEILING))

    return scaled(age, age_up, age_down), scaled(space, space_up, space_down) if rows.spatial else 0.0, error if fixed else scaled(error, error_up, error_down)


def start(rows: Rows, values: np.ndarray) -> Factor:
    """The leading right singular vector by the Gram matrix, its least-squares scores, and their variance between and within slices."""
    w = project_simplex(np.abs(np.linalg.eigh(values.T @ values)[1][:, -1]))
    h = values @ w / (w @ w + 1e-12)
    n = rows.cells
    error = float(((values - np.outer(h, w)) ** 2).sum() / (n * len(w)))
    sums = rows.sums(rows.u * h)
    means = sums / rows.sizes
    whole = float((h @ h - sums.sum() ** 2 / n) / max(1, n - 1))
    between = float(means.var(ddof=1)) if len(means) > 1 else 0.0
    within = whole - between if (rows.sizes > 1.5).any() else 1e-12
    between, within = max(between, 1e-12 * whole), max(within, 1e-12 * whole)
    scale = whole / (between + within) if whole > 0 else 1.0
    return Factor(h, w, max(FLOOR, scale * between), max(FLOOR, scale * within) if rows.spatial else 0.0, max(FLOOR, error))


def fit_rank1(rows: Rows, values: np.ndarray, k: int | None = None, begin: Factor | None = None, most: int = 200, tol: float = 1e-6, fixed: bool = False) -> Factor:
    f = begin or start(rows, values)
    w, age, space, error, total, change = f.w, f.age, f.space, f.error, float((values**2).sum()), np.inf
    for step in range(1, most + 1):
        h, trace = posterior(rows, values @ w, float(w @ w), age, space, error)
        fresh = project_simplex(values.T @ h / max(h @ h + trace, 1e-300), k)
        before = (age, space, error)
        age, space, error = update_variances(rows, values @ fresh, float(fresh @ fresh), total, values.shape[1], age, space, error, fixed)
        moved = [abs(a - b) / max(abs(b), 1e-12) for a, b in zip((age, space, error), before, strict=True)]
        change, w = max(float(np.linalg.norm(fresh - w) / max(np.linalg.norm(w), 1e-12)), *moved), fresh
        if change < tol:
            break
    h, trace = posterior(rows, values @ w, float(w @ w), age, space, error)
    return Factor(h, w, age, space, error, trace, step, change < tol)


def decompose(rows: Rows, values: np.ndarray, f: Factor, mode: str = "alpha_first") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trajectory by slice, spatial field by row, sd of the trajectory. alpha_first: exact trajectory, the field is what is left; b_first: exact field, the trajectory is the mean of what is left."""
    if mode not in ("alpha_first", "b_first"):
        raise ValueError(f"unknown mode: {mode}")
    w2 = float(f.w @ f.w)
    z, d = values @ f.w / w2, 1 / (f.space * rows.lam + f.error / w2)
    p = np.linalg.inv(rows.k_inverse / max(f.age, JITTER) + np.diag(rows.sums(d * rows.u**2)))
    v = d * z - (p @ rows.sums(rows.u * d * z))[rows.at] * d * rows.u
    alpha, b = f.age * (rows.k_age @ rows.sums(rows.u * v)), f.space * rows.lam * v
    if mode == "alpha_first":
        b = f.h - alpha[rows.at] * rows.u
    else:
        alpha = rows.sums(rows.u * (f.h - b)) / rows.sizes
    return alpha, b, np.sqrt(np.maximum(np.diag(p), 0))


def _resplit(rows: Rows, values: np.ndarray, fs: list[Factor], i: int, j: int, k: int | None, most: int, tol: float) -> None:
    """Two nearly equal factors start again from the two singular directions of their sum."""
    rest = values - sum(np.outer(f.h, f.w) for m, f in enumerate(fs) if m not in (i, j))
    pair = np.outer(fs[i].h, fs[i].w) + np.outer(fs[j].h, fs[j].w)
    vectors = np.linalg.eigh(pair.T @ pair)[1][:, -2:]
    for m, v in ((i, vectors[:, 1]), (j, vectors[:, 0])):
        w = project_simplex(np.abs(v), k)
        fs[m] = fit_rank1(rows, rest, k, Factor(rest @ w / (w @ w), w, fs[m].age, fs[m].space, fs[m].error), most, tol, True)
        rest = rest - np.outer(fs[m].h, fs[m].w)


def backfit(rows: Rows, values: np.ndarray, fs: list[Factor], k: int | None = None, sweeps: int = 500, inner: int = 200, inner_tol: float = 1e-3, tol: float = 1e-3, alike: float = 0.9, splits: int = 5) -> list[Factor]:
    """Sweeps over the factors, each fitted to what the others leave; the error variance is estimated once a sweep."""
    fs, error = list(fs), float(np.mean([f.error for f in fs]))
    residual = values - sum(np.outer(f.h, f.w) for f in fs)
    for sweep in range(sweeps):
        before = [(f.w, np.log1p([f.age, f.space])) for f in fs]
        for j, f in enumerate(fs):
            own = residual + np.outer(f.h, f.w)
            fs[j] = fit_rank1(rows, own, k, Factor(f.h, f.w, max(f.age, FLOOR), max(f.space, FLOOR) if rows.spatial else 0.0, error), inner, inner_tol, True)
            residual = own - np.outer(fs[j].h, fs[j].w)
        if sweep % 10 == 9:
            residual = values - sum(np.outer(f.h, f.w) for f in fs)
        error = max(FLOOR, float(((residual**2).sum() + sum(f.trace * (f.w @ f.w) for f in fs)) / (rows.cells * values.shape[1])))
        for f in fs:
            f.error = error
        if splits and len(fs) > 1:
            unit = np.array([f.w / np.linalg.norm(f.w) for f in fs])
            near = np.abs(unit @ unit.T) - np.eye(len(fs))
            if near.max() > alike:
                i, j = np.unravel_index(near.argmax(), near.shape)
                _resplit(rows, values, fs, int(i), int(j), k, inner, inner_tol)
                residual, splits = values - sum(np.outer(f.h, f.w) for f in fs), splits - 1
                continue
        dw = max(np.linalg.norm(f.w - w) / max(np.linalg.norm(w), 1e-12) for f, (w, _) in zip(fs, before, strict=True))
        dt = max(np.abs(np.log1p([f.age, f.space]) - t).max() for f, (_, t) in zip(fs, before, strict=True))
        if max(dw, dt) < tol:
            break
    return sorted(fs, key=lambda f: -(f.h @ f.h) * (f.w @ f.w))


def greedy(rows: Rows, values: np.ndarray, most: int, k: int | None = None, improve: float = 0.0, least_norm: float = 1e-8, inner: int = 200, tol: float = 1e-3) -> tuple[list[Factor], list[dict]]:
    """Factors fitted one after another to what is left, until one takes less than the share `improve` of what was left before it; with the trace of every trial.

    The first factor stays whatever it takes. The trace counts from 1 and gives the squares of the residuals' norms.
    """
    if most <= 0:
        raise ValueError("at least one factor must be allowed")
    left, fs, trace = values.copy(), [], []
    energy = float((values**2).sum())
    if energy <= 0:
        raise ValueError("the values hold no energy")
    for i in range(most):
        f = fit_rank1(rows, left, k, most=inner, tol=tol)
        after = left - np.outer(f.h, f.w)
        was, now, norm = float((left**2).sum()), float((after**2).sum()), float(np.sqrt((f.h @ f.h) * (f.w @ f.w)))
        gain = (was - now) / max(was, 1e-12)
        little = norm >= least_norm and bool(fs) and gain < improve
        keep = norm >= least_norm and not little
        # fixed values: the names of the record
        trace.append({"factor_index": i + 1, "rel_improve_total": gain, "component_norm": norm, "residual_norm_before": was, "residual_norm_after": now, "keep": keep, "stop_reason": "rel_improve_total" if little else None})
        if not keep:
            break
        fs.append(f)
        left = after
    if not fs:
        raise RuntimeError("no factor was kept")
    return fs, trace


def prune(values: np.ndarray, fs: list[Factor], least: float = 0.01) -> list[Factor]:
    """Factors with at least this share of the energy of the fit or of the values, whichever is more."""
    fitted = sum(np.outer(f.h, f.w) for f in fs)
    whole = max(float((fitted**2).sum()), float((values**2).sum()), 1e-12)
    return [f for f in fs if (f.h @ f.h) * (f.w @ f.w) / whole >= least]


def fit_factors(rows: Rows, values: np.ndarray, p: int, k: int | None = None, auto: bool = False, improve: float = 0.05, least: float = 0.01) -> tuple[list[Factor], list[dict]]:
    """p factors, or with auto at most p by greedy improvement, backfitting and pruning until none falls."""
    fs, trace = greedy(rows, values, p, k, improve if auto else -np.inf)
    fs = backfit(rows, values, fs, k)
    while auto and len(kept := prune(values, fs, least)) < len(fs) and kept:
        fs = backfit(rows, values, kept, k)
    return fs, trace


def kernel_root(xy: np.ndarray, gamma: float, tol: float = 1e-14) -> np.ndarray:
    """cells x rank, times its transpose the Gaussian kernel of the places: pivoted Cholesky, until the diagonal of what is left sums to tol a cell.

    What is left is positive semidefinite, so no eigenvalue is off by more than that sum. A smooth kernel's rank follows
    from its width and the extent of the places, not from the number of cells, so this grows with the cells.
    """
    n = len(xy)
    root, left, rank = np.empty((n, min(n, 64))), np.ones(n), 0
    while rank < n and left.sum() > tol * n:
        if rank == root.shape[1]:
            root = np.concatenate((root, np.empty((n, min(n - rank, max(64, rank // 4))))), axis=1)
        i = int(left.argmax())
        column = (np.exp(-((xy - xy[i]) ** 2).sum(-1) / gamma) - root[:, :rank] @ root[i, :rank]) / np.sqrt(left[i])
        root[:, rank] = column
        left = np.maximum(left - column * column, 0)
        left[i] = 0
        rank += 1
    return root[:, :rank]


def spectrum(xy: np.ndarray, values: np.ndarray, gamma: float, jitter: float, whole: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues of the kernel plus jitter, in ascending order, their vectors as columns, and the number of further directions with neither values nor constant.

    Beyond `whole` cells the kernel is its root. Off the root every direction has the eigenvalue jitter, so any basis
    will do there: one that starts with what is left of the values and the constant leaves nothing to the others.
    """
    n = len(xy)
    if n > whole:
        root = kernel_root(xy, gamma)
        if root.shape[1] + values.shape[1] + 1 < n:
            q, r = np.linalg.qr(root)
            del root
            turn, size, _ = np.linalg.svd(r)
            v = q @ turn[:, ::-1]
            del q
            rest = np.column_stack((values, np.ones(n)))
            for _ in range(2):
                rest -= v @ (v.T @ rest)
            rest = np.linalg.qr(rest)[0]
            return np.concatenate((np.zeros(rest.shape[1]), size[::-1] ** 2)) + jitter, np.column_stack((rest, v)), n - rest.shape[1] - v.shape[1]
    return *_whole_spectrum(xy, gamma, jitter), 0


def _whole_spectrum(xy: np.ndarray, gamma: float, jitter: float) -> tuple[np.ndarray, np.ndarray]:
    k = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / gamma)
    np.fill_diagonal(k, 1 + jitter)
    return np.linalg.eigh(k)


def rotated_spectrum(xy: np.ndarray, values: np.ndarray, gamma: float, jitter: float, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """spectrum without its vectors: eigenvalues, projections of the constant, rotated values, and the number of further directions.

    Beyond `whole` cells the triangle of root, values and constant tells all, so no basis and no vectors over the cells are made.
    """
    n = len(xy)
    if n > whole:
        root = kernel_root(xy, gamma)
        rank = root.shape[1]
        if rank + values.shape[1] + 1 < n:
            root = np.column_stack((root, values, np.ones(n)))
            r = np.linalg.qr(root, mode="r")
            del root
            size, turn = np.linalg.eigh(r[:rank, :rank] @ r[:rank, :rank].T)
            found = np.concatenate((r[rank:, rank:], turn.T @ r[:rank, rank:]))
            return np.concatenate((np.zeros(len(found) - rank), np.maximum(size, 0))) + jitter, found[:, -1], found[:, :-1], n - len(found)
        del root
    lam, v = _whole_spectrum(xy, gamma, jitter)
    return lam, v.sum(axis=0), v.T @ values, 0


def spectral_rows(cells: DataFrame, gamma: float | None, jitter: float = 1e-8, vectors: bool = True) -> DataFrame:
    """fit, slice, i (the number of the eigenvalue), age, lam, u, values, vector, cells, times: one grouped task for each fit key and slice.

    cells: fit, slice, age, cell, x, y, genes, and, where gamma is None, the fit's gamma. Coordinates are z-scored in the slice first; a constant one becomes 0.
    Directions without values are one row, times their number, with no vector. Slices over WHOLE cells name them in their
    first row only. Without `vectors`, which only scores of cells need, there is neither.
    """
    whole = WHOLE

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        xy, values = pdf[["x", "y"]].to_numpy(), np.stack(pdf["genes"].to_list())
        sd = xy.std(axis=0, ddof=1) if len(xy) > 1 else np.ones(2)
        xy = (xy - xy.mean(axis=0)) / np.where(sd > 0, sd, 1)
        wide = pdf["gamma"].iloc[0] if gamma is None else gamma
        if vectors:
            lam, v, idle = spectrum(xy, values, wide, jitter, whole)
            u, rotated = v.sum(axis=0), v.T @ values
        else:
            lam, u, rotated, idle = rotated_spectrum(xy, values, wide, jitter, whole)
        n = len(lam)
        names = pdf["cell"].tolist() if vectors else None
        out = {"i": np.arange(n), "lam": np.maximum(lam, 0), "u": u, "values": list(rotated), "vector": list(v.T) if vectors else [None] * n, "cells": [names] * n if len(xy) <= whole else [names] + [None] * (n - 1), "times": 1}
        table = pd.DataFrame(out)
        if idle:
            table = pd.concat((table, pd.DataFrame({"i": [n], "lam": jitter, "u": 0.0, "values": [np.zeros(values.shape[1])], "vector": [None], "cells": [None], "times": idle})))
        for c in ("fit", "slice", "age"):
            table[c] = pdf[c].iloc[0]
        return table

    return cells.groupBy("fit", "slice").applyInPandas(one, "fit string, slice long, i int, age double, lam double, u double, values array<double>, vector array<double>, cells array<long>, times long")


RESULT = "fit string, kind string, program int, key long, age double, value double, sd double"


def on_cells(rotated: DataFrame, spectral: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """fit, kind, program, key (cell), value: arrays over programs by spectral row (fit, slice, i and a column for each kind) back on cells, slice by slice."""
    both = rotated.join(spectral.where("vector is not null").select("fit", "slice", "i", "vector", "cells"), ["fit", "slice", "i"])

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, names = np.stack(pdf["vector"].to_list()), np.asarray(next(c for c in pdf["cells"] if c is not None))
        out = []
        for column, kind in kinds.items():
            found = vectors.T @ np.stack(pdf[column].to_list())
            out += [pd.DataFrame({"fit": pdf["fit"].iloc[0], "kind": kind, "program": j, "key": names, "value": found[:, j]}) for j in range(found.shape[1])]
        return pd.concat(out)

    return both.groupBy("fit", "slice").applyInPandas(back, "fit string, kind string, program int, key long, value double")


def scored(rotated: DataFrame, spectral: DataFrame) -> DataFrame:
    """RESULT rows of kind score and field by cell, from arrays hs and fields by spectral row."""
    none = F.lit(None).cast("double")
    return on_cells(rotated, spectral, {"hs": "score", "fields": "field"}).select("fit", "kind", "program", "key", none.alias("age"), "value", none.alias("sd"))


def fit_keys(spectral: DataFrame, p: int, k: int | None = None, auto: bool = False, gamma_age: float | None = 1.0, scores: bool = True) -> DataFrame:
    """One task for each fit key; where gamma_age is None, rows have their fit's gamma_age. Rows by kind: loading (key: gene), theta (0 age, 1 space, 2 error), trajectory (key: slice), and with `scores` score and field (key: cell).

    With auto at most p factors, and a row of kind trial for each one tried (key: 1 if it was kept, value: the share of the
    residual that it took). A task has no vectors: scores go back to cells slice by slice.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        slices = pdf.groupby("slice")["age"].first().sort_values(kind="stable")
        number = {s: i for i, s in enumerate(slices.index)}
        pdf = pdf.assign(at=pdf["slice"].map(number)).sort_values(["at", "lam"], kind="stable")
        ages = slices.to_numpy()
        rows = Rows(pdf["at"].to_numpy(), pdf["lam"].to_numpy(), pdf["u"].to_numpy(), age_kernel(ages, pdf["gamma_age"].iloc[0] if gamma_age is None else gamma_age), times=pdf["times"].to_numpy(float))
        values = np.stack(pdf["values"].to_list())
        fs, trace = fit_factors(rows, values, p, k, auto)
        out = [("trial", t["factor_index"] - 1, int(t["keep"]), None, t["rel_improve_total"], None) for t in trace] if auto else []
        fields = []
        for j, f in enumerate(fs):
            own = values - sum(np.outer(g.h, g.w) for m, g in enumerate(fs) if m != j)
            alpha, b, spread = decompose(rows, own, f, "b_first")
            fields.append(b)
            out += [("loading", j, g, None, w, None) for g, w in enumerate(f.w)] + [("theta", j, i, None, v, None) for i, v in enumerate((f.age, f.space, f.error))]
            out += [("trajectory", j, int(s), float(ages[i]), alpha[i], spread[i]) for s, i in number.items()]
        table = pd.DataFrame(out, columns=["kind", "program", "key", "age", "value", "sd"]).astype({"program": "Int32", "key": "Int64"})
        table = pd.concat((table, pd.DataFrame({"slice": pd.Series(dtype="Int64"), "i": pd.Series(dtype="Int32")})), axis=1).assign(hs=None, fields=None)
        if scores:
            rotated = {"kind": "row", "slice": pdf["slice"].to_numpy(), "i": pdf["i"].to_numpy(), "hs": list(np.stack([f.h for f in fs], axis=1)), "fields": list(np.stack(fields, axis=1))}
            table = pd.concat((table, pd.DataFrame(rotated).astype({"slice": "Int64", "i": "Int32"})))
        table.insert(0, "fit", pdf["fit"].iloc[0])
        return table

    found = spectral.drop("vector", "cells").groupBy("fit").applyInPandas(one, RESULT + ", slice long, i int, hs array<double>, fields array<double>")
    columns = ["fit", "kind", "program", "key", "age", "value", "sd"]
    if not scores:
        return found.select(*columns)
    found = written(found, "fitted")
    return found.where("kind <> 'row'").select(*columns).unionByName(scored(found.where("kind = 'row'").select("fit", "slice", "i", "hs", "fields"), spectral))


def sufficient(values: DataFrame, genes: Sequence[str], cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ages, cells, sums by slice and gene, Gram matrix) of long values: the driver gets slices x genes and genes x genes numbers.

    Values meet by cell once; every task adds its cells' outer products into one matrix, so what is shuffled after that
    is a matrix a task, not genes x genes rows a cell.
    """
    slices = cells.groupBy("slice").agg(F.min("age").alias("age"), F.count(F.lit(1)).alias("n")).orderBy("age", "slice").collect()
    number, width = {r["slice"]: i for i, r in enumerate(slices)}, len(genes)
    gene = {g: i for i, g in enumerate(genes)}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gram = np.zeros((len(slices), width)), np.zeros((width, width))
        for batch in batches:
            lists = batch.column("row")
            x = np.zeros((len(batch), width))
            flat = lists.flatten()
            at = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            x[at, [gene[g] for g in flat.field("gene").to_pylist()]] = flat.field("value").to_numpy(zero_copy_only=False)
            gram += x.T @ x
            np.add.at(sums, [number[s] for s in batch.column("slice").to_pylist()], x)
        whole = np.concatenate((sums, gram))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole)), pa.int32()), pa.array(list(whole), pa.list_(pa.float64()))], names=["i", "part"])

    rows = values.join(cells.select("cell", "slice"), "cell").groupBy("cell", "slice").agg(F.collect_list(F.struct("gene", "value")).alias("row"))
    parts = rows.mapInArrow(moments, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((len(slices) + width, width))
    for r in parts.collect():
        whole[r["i"], r["j"]] = r["v"]
    return np.array([r["age"] for r in slices]), np.array([r["n"] for r in slices], float), whole[: len(slices)], whole[len(slices) :]


def fit_without_space(ages: np.ndarray, n: np.ndarray, sums: np.ndarray, gram: np.ndarray, p: int, k: int | None = None, gamma_age: float = 1.0, most: int = 200, tol: float = 1e-6) -> list[dict]:
    """Greedy temporal factors from slice sums and a Gram matrix. Scores are constant in a slice, so a factor leaves both in closed form."""
    rows = Rows(np.arange(len(n)), np.zeros(len(n)), np.sqrt(n), age_kernel(ages, gamma_age), spatial=False)
    sums, gram, out = sums.copy(), gram.copy(), []
    for _ in range(p):
        w = project_simplex(np.abs(np.linalg.eigh(gram)[1][:, -1]))
        total, cells = float(np.trace(gram)), n.sum()
        mean = sums @ w / (w @ w + 1e-12) / n
        error = max(FLOOR, float((total - 2 * w @ gram @ w / (w @ w + 1e-12) + w @ gram @ w / (w @ w + 1e-12)) / (cells * len(w))))
        age = max(FLOOR, float(mean.var(ddof=1)))
        for _step in range(most):
            # a slice's rows rotate to one along the constant; the others have no prior variance and no mean
            h, _ = posterior(rows, sums @ w / np.sqrt(n), float(w @ w), age, 0.0, error)
            a, w2 = h / np.sqrt(n), float(w @ w)
            s = np.linalg.inv(rows.k_inverse / (w2 / error * age) + np.diag(n))
            trace = max(0.0, float(np.diag(s) @ n) * error / w2)
            fresh = project_simplex(sums.T @ a / max(float(h @ h) + trace, 1e-300), k)
            w2 = float(fresh @ fresh)
            rw = sums @ fresh / np.sqrt(n)
            off = float(fresh @ gram @ fresh - rw @ rw)  # along the loading, off the constant
            c, b = 1 / error, np.linalg.inv(rows.k_inverse / age + w2 * np.diag(n / error))
            y1 = rw / np.sqrt(w2)
            zed = c * y1 - c * w2 * (b @ (np.sqrt(n) * c * y1)) * np.sqrt(n)
            g, r = np.sqrt(n) * zed, n * c
            up = w2 * g @ rows.k_age @ g
            down = w2 * (np.diag(rows.k_age) @ r - w2 * (rows.k_age * np.outer(r, r) * b).sum())
            error_up = zed @ zed + off / w2 * c * c + max(0.0, total - fresh @ gram @ fresh / w2) / error**2
            error_down = cells * c - np.diag(b) @ (w2 * c * c * n) + (len(w) - 1) * cells / error
            new_age, new_error = float(np.clip(age * np.sqrt(up / down), FLOOR, CEILING)), float(np.clip(error * np.sqrt(error_up / error_down), FLOOR, CEILING))
            change = max(np.linalg.norm(fresh - w) / max(np.linalg.norm(w), 1e-12), abs(new_age - age) / age, abs(new_error - error) / error)
            w, age, error = fresh, new_age, new_error
            if change < tol:
                break
        h, _ = posterior(rows, sums @ w / np.sqrt(n), float(w @ w), age, 0.0, error)
        a = h / np.sqrt(n)
        out.append({"w": w, "alpha": a, "age": age, "error": error})
        yh = sums.T @ a
        gram = gram - np.outer(yh, w) - np.outer(w, yh) + float(h @ h) * np.outer(w, w)
        sums = sums - np.outer(n * a, w)
    return out
