"""Smooth trends, the condition of kernels, and time along paths through groups of cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the condition number from which a kernel counts as ill-conditioned.
ILL = 1e6


def smoothing_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A natural cubic smoothing spline through (x, y), x ascending, with the penalty that generalised cross-validation likes best, at new places; straight lines under 4 points.

    The smoother is (I + p K)^-1 with K the roughness matrix of the knots, so one eigendecomposition serves all penalties.
    """
    n = len(x)
    if n < 4:
        return np.interp(at, x, y)
    h = np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    rough = q @ np.linalg.solve(r, q.T)
    values, vectors = np.linalg.eigh((rough + rough.T) / 2)
    values, z = np.maximum(values, 0), vectors.T @ y
    values[:2] = 0  # straight lines have no roughness

    def score(log_p: float) -> float:
        left = 1 - 1 / (1 + np.exp(log_p) * values)
        return n * float(((left * z) ** 2).sum()) / max(float(left.sum()) ** 2, 1e-300)

    top = np.log(values[2:].mean())
    grid = np.linspace(-20, 20, 161) - top
    best = int(np.argmin([score(g) for g in grid]))
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if score(a) < score(b) else (a, hi)
    f = vectors @ (z / (1 + np.exp((lo + hi) / 2) * values))
    bend = np.concatenate(([0.0], np.linalg.solve(r, q.T @ f), [0.0]))
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    left, right, step = at - x[i], x[i + 1] - at, h[i]
    return (left * f[i + 1] + right * f[i]) / step - left * right / 6 * ((1 + left / step) * bend[i + 1] + (1 + right / step) * bend[i])


def smooth_trend(df: DataFrame, by: Sequence[str], x: str, y: str, points: int = 300) -> DataFrame:
    """by, x, y: a smooth curve at `points` even places for each group; values at one place are averaged first, nulls left out, a group of one place is that place. A group's places, slices or ages, are one task's input."""
    means = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.avg(F.col(y).cast("double")).alias("y"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        at = np.linspace(pdf["x"].iloc[0], pdf["x"].iloc[-1], points) if len(pdf) > 1 else pdf["x"].to_numpy()
        out = pd.DataFrame({"x": at, "y": smoothing_spline(pdf["x"].to_numpy(), pdf["y"].to_numpy(), at)})
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return means.groupBy(*by).applyInPandas(one, means.schema)


def kernel_condition(kernel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, size, condition, status of square kernels (by, s1, s2, k): largest eigenvalue over the smallest positive one, ill-conditioned beyond ILL. A kernel over slices is one task's input."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="s1", columns="s2", values="k").to_numpy(float)
        values = np.linalg.eigvalsh((wide + wide.T) / 2)
        positive = values[values > 0]
        condition = float(positive[-1] / positive[0]) if len(positive) else float("inf")
        out = pd.DataFrame({"size": [len(wide)], "condition": [condition], "status": ["ill-conditioned" if condition > ILL else "well-conditioned"]})
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    rows = kernel.withColumn("_all", F.lit(0)) if not by else kernel
    schema = ", ".join([f"`{c}` {dict(kernel.dtypes)[c]}" for c in by] + ["size long", "condition double", "status string"])
    return rows.groupBy(*(by or ["_all"])).applyInPandas(one, schema)


def spanning_paths(centres: np.ndarray, start: int) -> list[list[int]]:
    """Paths from `start` to every leaf of the minimum spanning tree of the centres, ordered; a single centre is a path by itself."""
    n = len(centres)
    d = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))
    inside, near, parent = {start}, d[start].copy(), np.full(n, start)
    children: dict[int, list[int]] = {i: [] for i in range(n)}
    while len(inside) < n:
        i = min((j for j in range(n) if j not in inside), key=lambda j: (near[j], j))
        inside.add(i)
        children[int(parent[i])].append(i)
        closer = d[i] < near
        near, parent = np.where(closer, d[i], near), np.where(closer, i, parent)
    paths, stack = [], [[start]]
    while stack:
        path = stack.pop()
        if not children[path[-1]]:
            paths.append(path)
        stack.extend([*path, c] for c in children[path[-1]])
    return sorted(paths)


def path_times(cells: DataFrame, label: str, features: str, start: str | None = None) -> DataFrame:
    """cell, lineage, label, time, distance, on_path, unified: each cell's place along the paths through its groups' centres.

    Centres of the labels are joined by their minimum spanning tree; a lineage is the path from the start, by default the
    label with the lowest mean along the feature of largest variance, to a leaf. time: length along the path up to the
    cell's nearest point on it; on_path: whether the lineage passes through the cell's label; unified: the mean time over
    those that do. A piecewise straight version of simultaneous principal curves. features: an array column; centres, a row a
    label, are the only things that reach the driver.
    """
    rows = cells.where(F.col(label).isNotNull()).select("cell", F.col(label).cast("string").alias("label"), F.col(features).alias("v"))
    width = rows.select(F.max(F.size("v"))).first()[0] or 0
    each = [F.avg(F.col("v")[i]) for i in range(width)]
    centres = rows.groupBy("label").agg(F.array(*each).alias("c")).orderBy("label").collect()
    schema = "cell " + dict(rows.dtypes)["cell"] + ", lineage int, label string, time double, distance double, on_path boolean, unified double"
    if not centres:
        return cells.sparkSession.createDataFrame([], schema)
    names, at = [r["label"] for r in centres], np.array([r["c"] for r in centres], float)
    if start is None:
        spread = rows.agg(F.array(*[F.var_pop(F.col("v")[i]) for i in range(width)])).first()[0]
        start = names[int(np.argmin(at[:, int(np.argmax(spread))]))]
    paths = spanning_paths(at, names.index(start))

    def along(v: np.ndarray, path: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(path) == 1:
            return np.zeros(len(v)), np.sqrt(((v - at[path[0]]) ** 2).sum(axis=1))
        time, best, before = np.zeros(len(v)), np.full(len(v), np.inf), 0.0
        for a, b in zip(path, path[1:]):
            line = at[b] - at[a]
            length = float(np.sqrt(line @ line))
            t = np.clip((v - at[a]) @ line / max(length**2, 1e-300), 0, 1)
            d = np.sqrt(((v - at[a] - t[:, None] * line) ** 2).sum(axis=1))
            closer = d < best
            time, best = np.where(closer, before + t * length, time), np.where(closer, d, best)
            before += length
        return time, best

    on = np.array([[i in p for p in paths] for i in range(len(names))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_list()).astype(float)
            own = on[pdf["label"].map({n: i for i, n in enumerate(names)}).to_numpy()]
            found = [along(v, p) for p in paths]
            times = np.stack([t for t, _ in found], axis=1)
            unified = (times * own).sum(axis=1) / own.sum(axis=1)
            for k, (t, d) in enumerate(found):
                yield pd.DataFrame({"cell": pdf["cell"], "lineage": k + 1, "label": pdf["label"], "time": t, "distance": d, "on_path": own[:, k], "unified": unified})

    return rows.mapInPandas(run, schema)
