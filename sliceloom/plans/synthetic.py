"""Synthetic values on the cells of a real table: their slices, ages and places stay, programs, trajectories and fields are drawn.

What is drawn for a slice depends on its key, and what is drawn for a cell on its own, never on partitions, so a lost
task draws the same again. Loadings and trajectories, programs by genes and by slices, are the only things made on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.operators import benchmark as B
from sliceloom.plans.fit import WHOLE, age_kernel, fit_keys, kernel_root, project_simplex, spectral_rows
from sliceloom.sources.tables import written


@dataclass(frozen=True)
class Design:
    """What is drawn: genes, k active ones a program, of which a share `overlap` is active in earlier programs too, variances of
    trajectories and fields by program, error variance, and the kernels over age (rbf or ar1) and place; not spatial: no fields."""

    genes: int = 100
    k: int = 10
    age: Sequence[float] = (10.0, 5.0, 0.0, 8.0)
    space: Sequence[float] = (6.0, 10.0, 8.0, 0.0)
    error: float = 0.1
    gamma_age: float = 0.5
    gamma_space: float = 2.0
    overlap: float = 0.25
    kind: str = "rbf"
    rho: float = 0.75
    spatial: bool = True


def make_seed(*parts) -> int:
    """A seed below 2^31 for any parts, the same on every machine."""
    return int.from_bytes(hashlib.md5(str(parts).encode(), usedforsecurity=False).digest()[:4], "little") % 2**31


def gaussian(covariance: np.ndarray, rng: np.random.Generator, jitter: float = 1e-10) -> np.ndarray:
    """One draw from a centred normal; zeros where there is no variance."""
    if not np.diag(covariance).sum():
        return np.zeros(len(covariance))
    return np.linalg.cholesky(covariance + jitter * np.eye(len(covariance))) @ rng.standard_normal(len(covariance))


def gaussian_of(root: np.ndarray, variance: float, noise: float, rng: np.random.Generator, block: int = 256) -> np.ndarray:
    """The draw of gaussian() for the covariance variance * root root^T + noise on the diagonal, which is not made: cells in order, a block at a time given those before, as Cholesky's steps are."""
    if not variance:
        return np.zeros(len(root))
    z, out = rng.standard_normal(len(root)), np.empty(len(root))
    mean, spread = np.zeros(root.shape[1]), variance * np.eye(root.shape[1])
    for i in range(0, len(z), block):
        rows, own = root[i : i + block], z[i : i + block]
        across = rows @ spread
        lower = np.linalg.cholesky(across @ rows.T + noise * np.eye(len(rows)))
        gain = np.linalg.solve(lower, across)
        out[i : i + block] = rows @ mean + lower @ own
        mean += gain.T @ own
        spread -= gain.T @ gain
    return out


def loadings(design: Design, replicate: int = 0) -> np.ndarray:
    """Programs by genes: Dirichlet shares of k genes each, those under 1 / (2 k) cut, summing to 1."""
    rng, p = np.random.default_rng(make_seed("loadings", design, replicate)), len(design.age)
    w, used = np.zeros((p, design.genes)), np.zeros(design.genes, bool)
    for j in range(p):
        old, fresh = np.flatnonzero(used), np.flatnonzero(~used)
        shared = max(1, min(round(design.k * design.overlap), design.k - 1, len(old))) if design.overlap > 0 and len(old) else 0
        chosen = np.concatenate((rng.choice(old, shared, replace=False), rng.choice(fresh, min(design.k - shared, len(fresh)), replace=False))).astype(int)
        share = np.zeros(0)
        while not share.sum():
            share = rng.dirichlet(np.ones(len(chosen)))
            share[share < 1 / (2 * design.k)] = 0
        w[j, chosen] = share / share.sum()
        used[chosen] = True
    return w


def trajectories(ages: np.ndarray, design: Design, replicate: int = 0) -> np.ndarray:
    """Programs by slices, for ages in ascending order."""
    if design.kind == "rbf":
        kernel = age_kernel(ages, design.gamma_age)
    elif design.kind == "ar1":
        kernel = design.rho ** np.abs(np.subtract.outer(np.arange(len(ages)), np.arange(len(ages))))
    else:
        raise ValueError(f"unknown kernel: {design.kind}")
    kernel = kernel + 1e-6 * np.eye(len(ages))
    return np.array([gaussian(v * kernel, np.random.default_rng(make_seed("trajectory", replicate, j))) for j, v in enumerate(design.age)])


def draw(cells: DataFrame, design: Design, replicate: int = 0) -> DataFrame:
    """fit, slice, age, cell, x, y, h, b, genes for cells (slice, age, cell, x, y): scores, fields and values; fit names the replicate.

    A grouped task holds one slice and its kernel, beyond WHOLE cells as the kernel's root. Places are z-scored in the slice.
    """
    whole = WHOLE
    slices = cells.groupBy("slice").agg(F.min("age").alias("age")).orderBy("age", "slice").collect()
    alpha = trajectories(np.array([r["age"] for r in slices], float), design, replicate)
    number, w, p = {r["slice"]: i for i, r in enumerate(slices)}, loadings(design, replicate), len(design.age)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        s, n = pdf["slice"].iloc[0], len(pdf)
        b = np.zeros((n, p))
        if design.spatial:
            xy = pdf[["x", "y"]].to_numpy(float)
            sd = xy.std(axis=0, ddof=1) if n > 1 else np.ones(2)
            xy = (xy - xy.mean(axis=0)) / np.where(sd > 0, sd, 1)
            rngs = [np.random.default_rng(make_seed("field", replicate, j, s)) for j in range(p)]
            if n <= whole:
                kernel = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / design.gamma_space) + 1e-6 * np.eye(n)
                fields = [gaussian(v * kernel, rng) for v, rng in zip(design.space, rngs, strict=True)]
            else:
                root = kernel_root(xy, design.gamma_space)
                fields = [gaussian_of(root, v, 1e-6 * v + 1e-10, rng) for v, rng in zip(design.space, rngs, strict=True)]
            b = np.stack(fields, axis=1)
        h = alpha[:, number[s]] + b
        noise = np.random.default_rng(make_seed("noise", replicate, s)).normal(0, np.sqrt(design.error), (n, design.genes))
        out = pdf[["slice", "age", "cell", "x", "y"]].assign(h=list(h), b=list(b), genes=list(h @ w + noise))
        out.insert(0, "fit", f"r{replicate}")
        return out

    kinds = dict(cells.dtypes)
    schema = f"fit string, slice {kinds['slice']}, age double, cell {kinds['cell']}, x double, y double, h array<double>, b array<double>, genes array<double>"
    return cells.select("slice", F.col("age").cast("double").alias("age"), "cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("slice").applyInPandas(one, schema)


def truth(cells: DataFrame, design: Design, replicate: int = 0) -> tuple[DataFrame, DataFrame]:
    """(loadings: fit, program, gene, weight; trajectories: fit, program, slice, age, alpha) that draw() used."""
    spark, name = cells.sparkSession, f"r{replicate}"
    slices = cells.groupBy("slice").agg(F.min("age").alias("age")).orderBy("age", "slice").collect()
    alpha = trajectories(np.array([r["age"] for r in slices], float), design, replicate)
    w = spark.createDataFrame([(name, str(j), g, float(v)) for j, row in enumerate(loadings(design, replicate)) for g, v in enumerate(row)], "fit string, program string, gene long, weight double")
    kind = dict(cells.dtypes)["slice"]
    return w, spark.createDataFrame([(name, str(j), r["slice"], float(r["age"]), float(alpha[j, i])) for j in range(len(alpha)) for i, r in enumerate(slices)], f"fit string, program string, slice {kind}, age double, alpha double")


def offsets(cells: np.ndarray, seed: int, sd: float) -> np.ndarray:
    """A normal offset for each cell number, from two hashed uniforms."""

    def uniform(k: int) -> np.ndarray:
        x = cells.astype(np.uint64) * np.uint64(2) + np.uint64((seed * 0x9E3779B97F4A7C15 + k) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53

    return sd * np.sqrt(-2 * np.log1p(-uniform(0))) * np.cos(2 * np.pi * uniform(1))


def gene_baselines(w: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(tier, log rate) of each gene: markers of a program, 30 % housekeeping, the rest mostly off."""
    rng = np.random.default_rng(seed)
    marker = (w > 0).any(axis=0)
    plain = rng.permutation(np.flatnonzero(~marker))
    tiers = np.where(marker, "marker", "mostly_off").astype(object)
    tiers[plain[: min(len(plain), round(0.3 * w.shape[1]))]] = "housekeeping"
    span = {"marker": (-1.4, 0.2), "housekeeping": (1.2, 2.2), "mostly_off": (-3.6, -1.8)}  # fixed values
    return tiers, np.array([rng.uniform(*span[t]) for t in tiers])


def _sums(df: DataFrame, f, size: int, columns: Sequence[str]) -> np.ndarray:
    """f of the columns' arrays, summed over all rows; one array a task is added up by the engine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += f(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["part"])

    rows = df.select(*columns).mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def signal_moments(drawn: DataFrame, p: int, seed: int, sd: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(cells, sums of h, of h h^T, of c h, of c, of c^2), c the cells' offsets: all that the share of the signal's variance needs."""

    def f(batch: pa.RecordBatch) -> np.ndarray:
        h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
        c = offsets(batch.column("cell").to_numpy(zero_copy_only=False), seed, sd)
        return np.concatenate(([len(h)], h.sum(axis=0), (h.T @ h).ravel(), h.T @ c, [c.sum(), c @ c]))

    v = _sums(drawn, f, 1 + p + p * p + p + 2, ["cell", "h"])
    return v[0], v[1 : 1 + p], v[1 + p : 1 + p + p * p].reshape(p, p), v[1 + p + p * p : 1 + 2 * p + p * p], v[-2], v[-1]


def draw_counts(drawn: DataFrame, w: np.ndarray, replicate: int = 0, dispersion: float | None = 10.0, library: float | None = None, share: float | None = None, offset: tuple[float, float] = (0.25, 0.4)) -> tuple[DataFrame, np.ndarray, float]:
    """(rows, tiers, share reached): drawn with `counts`, an array of longs, for the scores h of draw() and its loadings.

    Log rates are signal + gene baseline + cell offset. With `share`, baselines and offsets (85 and 15 % of the other
    variance) are scaled until the signal has that share of the variance of log rates; that follows from sums over cells. With
    `library`, offsets are shifted until cells have that many counts on average, one more pass. Gamma-Poisson with
    `dispersion`, Poisson where it is None. Every cell has a generator of its own.
    """
    if share is not None and not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    p, genes = w.shape
    seed = make_seed("counts", replicate)
    tiers, base = gene_baselines(w, seed)
    middle, g = base.mean(), base - base.mean()
    n, h1, h2, ch, c1, c2 = signal_moments(drawn, p, seed, offset[1])
    mean_c, var_c = c1 / n, max(0.0, c2 / n - (c1 / n) ** 2)
    mean_s = h1 / n @ w.sum(axis=1) / genes
    var_s = float((h2 / n * (w @ w.T)).sum() / genes - mean_s**2)
    with_g, with_c = float(h1 / n @ (w @ g) / genes), float((ch / n - mean_c * h1 / n) @ w.sum(axis=1) / genes)

    def reached(a: float, b: float) -> float:
        whole = var_s + a * a * g.var() + b * b * var_c + 2 * a * with_g + 2 * b * with_c
        return var_s / whole if whole > 1e-12 else 1.0

    a = b = 1.0
    if share is not None:
        other = max(0.0, var_s * (1 - share) / share)
        a0, b0 = (np.sqrt(part * other / v) if v > 1e-16 else 0.0 for part, v in ((0.85, g.var()), (0.15, var_c)))
        lo, hi = 0.0, 1.0
        while reached(hi * a0, hi * b0) > share and hi < 1e6:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if reached(mid * a0, mid * b0) > share else (lo, mid)
        a, b = hi * a0, hi * b0

    def rates(batch: pa.RecordBatch, shift: float) -> np.ndarray:
        h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
        c = b * (offsets(batch.column("cell").to_numpy(zero_copy_only=False), seed, offset[1]) - mean_c)
        return np.exp(np.clip(h @ w + middle + a * g + np.clip(c + shift, -4, 4)[:, None], -20, 10))

    shift = offset[0]
    if library is not None:
        shift = float(np.log(library * n / _sums(drawn, lambda batch: np.array([rates(batch, 0.0).sum()]), 1, ["cell", "h"])[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, rate in zip(batch.column("cell").to_pylist(), rates(batch, shift), strict=True):
                rng = np.random.default_rng([seed, cell % 2**63])
                out.append(rng.poisson(rate if dispersion is None else rng.gamma(dispersion, rate / dispersion)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "counts"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawn.schema.fields)
    return drawn.mapInArrow(run, schema + ", counts array<long>"), tiers, reached(a, b)


def components(drawn: DataFrame, p: int) -> DataFrame:
    """fit, program, gene, weight: absolute principal directions of each fit's values, projected on the simplex. Slices add up their own Gram matrices; a fit's sum, genes by genes, is one task's input."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.stack(pdf["genes"].to_list())
        return pd.DataFrame({"fit": pdf["fit"].iloc[0], "v": [np.concatenate(([len(y)], y.sum(axis=0), (y.T @ y).ravel()))]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(pdf["v"].to_list(), axis=0)
        g = int(round((np.sqrt(4 * len(v) - 3) - 1) / 2))
        n, s, gram = v[0], v[1 : 1 + g], v[1 + g :].reshape(g, g)
        top = np.linalg.eigh(gram - np.outer(s, s) / n)[1][:, ::-1][:, :p].T
        w = [project_simplex(np.abs(x)) for x in top]
        return pd.DataFrame([(pdf["fit"].iloc[0], str(j), i, float(x)) for j, row in enumerate(w) for i, x in enumerate(row)], columns=["fit", "program", "gene", "weight"])

    parts = drawn.select("fit", "slice", "genes").groupBy("fit", "slice").applyInPandas(part, "fit string, v array<double>")
    return parts.groupBy("fit").applyInPandas(whole, "fit string, program string, gene long, weight double")


def study(cells: DataFrame, design: Design, replicates: int = 10, k: int | None = None) -> DataFrame:
    """method, fit, p, q, cosine, pearson, spearman, hellinger, hit_rate: the true programs (p) of every replicate and what each method finds for them.

    Methods: estimator and principal components. All replicates are drawn and fitted side by side. hit_rate: the share
    of a program's active genes among as many of the largest found weights.
    """
    p, k = len(design.age), k or design.k
    drawn = [draw(cells, design, r) for r in range(replicates)]
    every, real = drawn[0], truth(cells, design, 0)[0]
    for r, more in enumerate(drawn[1:], 1):
        every, real = every.unionByName(more), real.unionByName(truth(cells, design, r)[0])
    every = written(every, "drawn")
    spectral = written(spectral_rows(every.select("fit", "slice", "age", "cell", "x", "y", "genes"), design.gamma_space, vectors=False), "spectral")
    fitted = fit_keys(spectral, p, k, gamma_age=design.gamma_age, scores=False).where("kind = 'loading'")
    fitted = fitted.select("fit", F.col("program").cast("string").alias("program"), F.col("key").alias("gene"), F.col("value").alias("weight"))
    found = written(fitted.withColumn("method", F.lit("estimator")).unionByName(components(every, p).withColumn("method", F.lit("components"))), "found")
    methods = F.explode(F.array(F.lit("estimator"), F.lit("components")))
    known = real.withColumn("method", methods)
    by = ["method", "fit"]
    best = B.matched_programs(B.pair_metrics(known, found, by), by)
    joined = best.select(*by, "p", "q").join(known.withColumnRenamed("program", "p").withColumnRenamed("weight", "_t"), [*by, "p"]).join(found.withColumnRenamed("program", "q").withColumnRenamed("weight", "_f"), [*by, "q", "gene"])
    keys = [*by, "p", "q"]
    rank = F.expr("row_number() over (partition by method, fit, p, q order by _f desc, gene)")
    active = F.expr("count_if(_t > 0) over (partition by method, fit, p, q)")
    scored = joined.withColumns({"_rank": rank, "_active": active})
    more = scored.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.sqrt("_t") - F.sqrt(F.greatest(F.lit(0.0), F.col("_f"))), F.lit(2.0))) / 2).alias("hellinger"), (F.count_if((F.col("_t") > 0) & (F.col("_rank") <= F.col("_active"))) / F.max("_active")).alias("hit_rate"))
    return best.join(more, keys).select(*keys, "cosine", "pearson", "spearman", "hellinger", "hit_rate")
