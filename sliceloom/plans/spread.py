"""The estimator over many tasks: one fit of any number of cells as passes over its spectral rows.

What a step of the fit needs of the rows are sums by slice and sums by gene. Each pass adds them up where the rows are, and
the driver solves over slices and genes: an iteration is three passes, and moves slices + genes numbers a task, never rows.
Scores stay with the rows; a fitted factor writes the rows once, and the table before them goes. Grouped tasks
(fit.fit_keys) take the same steps in memory, for the many fits that are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.plans.fit import CEILING, FLOOR, JITTER, RESULT, Factor, Rows, age_kernel, fit_keys, project_simplex, scored
from sliceloom.sources.tables import discard, scratch

#: Numbers of all tasks together that one pass may bring to the driver; beyond it the engine adds them up first.
COLLECTED = 1 << 22
#: Bytes of rotated values up to which a fit is a grouped task.
SMALL_BYTES = 256 << 20
Sums = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Spread:
    """The spectral rows of one fit: slice, i, lam, u, values and the scores hs of its factors, whose loadings are w."""

    def __init__(self, spectral: DataFrame, factors: int, gamma_age: float = 1.0):
        spark = spectral.sparkSession
        several = F.col("times") > 1
        idle = [F.sum(F.when(several, F.col("times")).otherwise(0)).alias("idle"), F.coalesce(F.max(F.when(several, F.col("lam"))), F.lit(0.0)).alias("idle_lam")]
        found = spectral.groupBy("slice").agg(F.first("age").alias("age"), F.sum("times").alias("n"), F.max(F.size("values")).alias("genes"), *idle).orderBy("age", "slice").collect()
        self.slices, self.ages, n = [r["slice"] for r in found], np.array([r["age"] for r in found]), np.array([r["n"] for r in found], float)
        self.cells, self.genes = int(n.sum()), int(found[0]["genes"])
        self.idle, self.idle_lam = (np.array([r[c] for r in found], float) for c in ("idle", "idle_lam"))  # directions without values, by slice
        self.solver = Rows(np.arange(len(n)), np.zeros(len(n)), np.sqrt(n), age_kernel(self.ages, gamma_age))
        order = np.argsort(self.slices)
        self._ids, self._at = np.array(self.slices)[order], order
        self.w = np.zeros((factors, self.genes))
        self.spark, self.path = spark, None
        self._store(spectral.where("times = 1").select("slice", "i", "lam", "u", "values", F.array_repeat(F.lit(0.0), factors).alias("hs")))

    def _store(self, rows: DataFrame) -> None:
        """The next generation of rows; the one before is removed once this one is whole."""
        path, before = scratch(self.spark, "spread"), self.path
        rows.write.parquet(path)
        self.path, self.frame = path, self.spark.read.schema(rows.schema).parquet(path)
        self.tasks = self.frame.select(F.spark_partition_id().alias("t")).distinct().count()
        if before:
            discard(self.spark, before)

    def _reader(self) -> Callable[[pa.RecordBatch], tuple]:
        ids, at_of = self._ids, self._at

        def read(batch: pa.RecordBatch) -> tuple:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            return at_of[np.searchsorted(ids, number("slice"))], number("lam"), number("u"), matrix("values"), matrix("hs")

        return read

    def total(self, f: Sums, size: int) -> np.ndarray:
        """f of (slice number, lam, u, values, hs), summed over all rows: one pass."""
        read = self._reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    out += f(*read(batch))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["part"])

        parts = self.frame.mapInArrow(run, "part array<double>")
        if self.tasks * size <= COLLECTED:
            return np.sum([r["part"] for r in parts.collect()], axis=0)
        out = np.zeros(size)
        for r in parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def mapped(self, f: Sums, column: str) -> DataFrame:
        """Rows with `column` replaced by f's values, an array a row."""
        read, schema = self._reader(), self.frame.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    fresh = f(*read(batch))
                    columns = [pa.array(list(fresh), pa.list_(pa.float64())) if c == column else batch.column(c) for c in batch.schema.names]
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return self.frame.mapInArrow(run, schema)

    def _left(self, used: list[int]) -> Callable:
        """values times a loading, without what the factors `used` explain."""
        w = self.w[used]
        return lambda v, hs, x: v @ x - hs[:, used] @ (w @ x)

    def energy(self, used: list[int]) -> float:
        w = self.w[used]
        return float(self.total(lambda at, lam, u, v, hs: np.array([((v - hs[:, used] @ w) ** 2).sum()]), 1)[0])

    def gene_sums(self, used: list[int], h: Callable) -> tuple[np.ndarray, float]:
        """What is left, transposed, times the scores h(at, lam, u, v, hs); and their squares' sum."""
        genes, w = self.genes, self.w[used]

        def f(at, lam, u, v, hs):
            x = h(at, lam, u, v, hs)
            return np.concatenate((v.T @ x - w.T @ (hs[:, used].T @ x), [x @ x]))

        out = self.total(f, genes + 1)
        return out[:-1], float(out[-1])

    def _by_slice(self, f: Sums, kinds: int) -> np.ndarray:
        """f gives (kinds, rows); sums by slice, (kinds, slices)."""
        t = len(self.slices)
        sums = lambda at, *rest: np.concatenate([np.bincount(at, weights=x, minlength=t) for x in f(at, *rest)])
        return self.total(sums, kinds * t).reshape(kinds, t)

    def scores(self, used: list[int], w: np.ndarray, age: float, space: float, error: float) -> tuple[Callable, float]:
        """The posterior mean of the scores as a function of rows, and the trace of their covariance: one pass and a solve over slices."""
        w2, left = float(w @ w), self._left(used)
        if age < JITTER and space < JITTER:
            return (lambda at, lam, u, v, hs: np.zeros(len(at))), 0.0
        a, k = w2 / error, self.solver

        def parts(at, lam, u, v, hs):
            rho, d = left(v, hs, w) / error, 1 / (1 + a * space * lam)
            return np.stack((u * rho, d * u * u, u * d * lam * rho, d, d * d * u * u))

        r, du, dl, d, dd = self._by_slice(parts, 5)
        d = d + self.idle / (1 + a * space * self.idle_lam)
        mean = age * (k.k_age @ r)
        s = np.linalg.inv(k.k_inverse / (a * max(age, JITTER)) + np.diag(du))
        back = s @ (mean * du + space * dl)
        trace = (self.cells - (d.sum() - (np.diag(s) * dd).sum())) / a

        def h(at, lam, u, v, hs):
            rho, d = left(v, hs, w) / error, 1 / (1 + a * space * lam)
            return d * (mean[at] * u + space * lam * rho) - back[at] * d * u

        return h, max(0.0, float(trace))

    def variances(self, used: list[int], w: np.ndarray, whole: float, age: float, space: float, error: float, fixed: bool) -> tuple[float, float, float]:
        """One minorise-maximise step of the variances: one pass and a solve over slices. With beta the slices' part of the
        solution, the sums of z^2, plain and by lam, follow from sums of y^2, y u and u^2."""
        w2, left, k = float(w @ w), self._left(used), self.solver

        def parts(at, lam, u, v, hs):
            y, c = left(v, hs, w) / np.sqrt(w2), 1 / (w2 * space * lam + error)
            cc = c * c
            return np.stack((c * u * u, c * u * y, y * y, c, cc * y * y, cc * y * u, cc * u * u, lam * c, lam * cc * y * y, lam * cc * y * u, lam * cc * u * u))

        r, q, yy, c, zyy, zyu, zuu, lc, lyy, lyu, luu = self._by_slice(parts, 11)
        bare = self.idle / (w2 * space * self.idle_lam + error)
        c, lc = c + bare, lc + self.idle_lam * bare
        b = np.linalg.inv(k.k_inverse / age + w2 * np.diag(r))
        beta = w2 * (b @ q)
        g = q - beta * r
        z2 = lambda yy, yu, uu: float((yy - 2 * beta * yu + beta * beta * uu).sum())
        across = max(0.0, whole - float(yy.sum()))
        age_up, age_down = w2 * g @ k.k_age @ g, w2 * (np.diag(k.k_age) @ r - w2 * (k.k_age * np.outer(r, r) * b).sum())
        space_up, space_down = w2 * z2(lyy, lyu, luu), w2 * (lc.sum() - np.diag(b) @ (w2 * luu))
        error_up, error_down = z2(zyy, zyu, zuu) + across / error**2, c.sum() - np.diag(b) @ (w2 * zuu) + (self.genes - 1) * self.cells / error
        scaled = lambda x, up, down: float(np.clip(x * np.sqrt(max(up, 0) / max(down, 1e-300)), FLOOR, CEILING))
        return scaled(age, age_up, age_down), scaled(space, space_up, space_down), error if fixed else scaled(error, error_up, error_down)

    def leading(self, used: list[int], most: int = 64, tol: float = 1e-10) -> np.ndarray:
        """The leading right singular vector of what is left, by Lanczos steps of one pass each: no matrix of genes is made."""
        left = self._left(used)
        basis, x = [], np.full(self.genes, 1 / np.sqrt(self.genes)) + np.linspace(0, 1e-3, self.genes)
        x, diagonal, beside = x / np.linalg.norm(x), [], []
        while True:
            basis.append(x)
            y, _ = self.gene_sums(used, lambda at, lam, u, v, hs, x=x: left(v, hs, x))
            diagonal.append(float(y @ x))
            q = np.array(basis)
            for _ in range(2):
                y = y - q.T @ (q @ y)
            rest = float(np.linalg.norm(y))
            _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
            top = vectors[:, -1]
            if len(basis) >= min(most, self.genes) or rest * abs(top[-1]) <= tol * max(diagonal):
                return q.T @ top
            beside.append(rest)
            x = y / rest

    def start(self, used: list[int]) -> Factor:
        w = project_simplex(np.abs(self.leading(used)))
        left, n, ww = self._left(used), self.cells, float(w @ w)
        rw = lambda v, hs: left(v, hs, w)
        uh, h2, one = self._by_slice(lambda at, lam, u, v, hs: np.stack((u * rw(v, hs), rw(v, hs) ** 2, np.ones(len(at)))), 3)
        part = 1 / (ww + 1e-12)
        sums, squares = uh * part, float(h2.sum()) * part * part
        error = (self.energy(used) - 2 * float(h2.sum()) * part + squares * ww) / (n * self.genes)
        means = sums / self.solver.sizes
        spread = float((squares - sums.sum() ** 2 / n) / max(1, n - 1))
        between = float(means.var(ddof=1)) if len(means) > 1 else 0.0
        within = spread - between if (self.solver.sizes > 1.5).any() else 1e-12
        between, within = max(between, 1e-12 * spread), max(within, 1e-12 * spread)
        scale = spread / (between + within) if spread > 0 else 1.0
        return Factor(np.zeros(0), w, max(FLOOR, scale * between), max(FLOOR, scale * within), max(FLOOR, error))

    def fit_rank1(self, used: list[int], k: int | None, begin: Factor | None = None, most: int = 200, tol: float = 1e-6, fixed: bool = False) -> tuple[Factor, Callable]:
        """(factor without scores, its scores as a function of rows), fitted to what the factors `used` leave."""
        f = begin or self.start(used)
        w, age, space, error, whole, change, step = f.w, f.age, f.space, f.error, self.energy(used), np.inf, 0
        for step in range(1, most + 1):  # noqa: B007
            h, trace = self.scores(used, w, age, space, error)
            up, h2 = self.gene_sums(used, h)
            fresh = project_simplex(up / max(h2 + trace, 1e-300), k)
            before = (age, space, error)
            age, space, error = self.variances(used, fresh, whole, age, space, error, fixed)
            moved = [abs(a - b) / max(abs(b), 1e-12) for a, b in zip((age, space, error), before, strict=True)]
            change, w = max(float(np.linalg.norm(fresh - w) / max(np.linalg.norm(w), 1e-12)), *moved), fresh
            if change < tol:
                break
        h, trace = self.scores(used, w, age, space, error)
        return Factor(np.zeros(0), w, age, space, error, trace, step, change < tol), h

    def put(self, j: int, f: Factor, h: Callable | None) -> None:
        """Write the rows with factor j's scores (zeros for None)."""

        def fresh(at, lam, u, v, hs):
            out = hs.copy()
            out[:, j] = 0.0 if h is None else h(at, lam, u, v, hs)
            return out

        self._store(self.mapped(fresh, "hs"))
        self.w[j] = 0.0 if h is None else f.w

    def cross(self) -> np.ndarray:
        """Inner products of all scores."""
        p = len(self.w)
        return self.total(lambda at, lam, u, v, hs: (hs.T @ hs).ravel(), p * p).reshape(p, p)

    def greedy(self, most: int, k: int | None, improve: float, least_norm: float = 1e-8, inner: int = 200, tol: float = 1e-3) -> tuple[list[Factor], list[dict]]:
        """As fit.greedy: factors one after another to what is left."""
        if most <= 0:
            raise ValueError("at least one factor must be allowed")
        fs, trace, was = [], [], self.energy([])
        if was <= 0:
            raise ValueError("the values hold no energy")
        for i in range(most):
            used = list(range(i))
            f, h = self.fit_rank1(used, k, None, inner, tol)
            up, h2 = self.gene_sums(used, h)
            now, norm = was - 2 * float(up @ f.w) + h2 * float(f.w @ f.w), float(np.sqrt(h2 * (f.w @ f.w)))
            gain = (was - now) / max(was, 1e-12)
            little = norm >= least_norm and bool(fs) and gain < improve
            keep = norm >= least_norm and not little
            trace.append({"factor_index": i + 1, "rel_improve_total": gain, "component_norm": norm, "residual_norm_before": was, "residual_norm_after": now, "keep": keep, "stop_reason": "rel_improve_total" if little else None})
            if not keep:
                break
            self.put(i, f, h)
            fs.append(f)
            was = now
        if not fs:
            raise RuntimeError("no factor was kept")
        return fs, trace

    def _resplit(self, fs: list[Factor], i: int, j: int, k: int | None, most: int, tol: float) -> None:
        """Two nearly equal factors start again from the two singular directions of their sum."""
        h, pair = self.cross()[np.ix_([i, j], [i, j])], self.w[[i, j]]
        vectors = np.linalg.eigh(pair.T @ h @ pair)[1][:, -2:]
        used = [m for m in range(len(fs)) if m not in (i, j)]
        for m, v in ((i, vectors[:, 1]), (j, vectors[:, 0])):
            w = project_simplex(np.abs(v), k)
            fs[m], scores = self.fit_rank1(used, k, Factor(np.zeros(0), w, fs[m].age, fs[m].space, fs[m].error), most, tol, True)
            self.put(m, fs[m], scores)
            used = [*used, m]

    def backfit(self, fs: list[Factor], k: int | None, sweeps: int = 500, inner: int = 200, inner_tol: float = 1e-3, tol: float = 1e-3, alike: float = 0.9, splits: int = 5) -> list[Factor]:
        """As fit.backfit: sweeps over the factors, each fitted to what the others leave."""
        fs, error, every = list(fs), float(np.mean([f.error for f in fs])), list(range(len(fs)))
        for _ in range(sweeps):
            before = [(f.w, np.log1p([f.age, f.space])) for f in fs]
            for j in every:
                begin = Factor(np.zeros(0), fs[j].w, max(fs[j].age, FLOOR), max(fs[j].space, FLOOR), error)
                fs[j], h = self.fit_rank1([m for m in every if m != j], k, begin, inner, inner_tol, True)
                self.put(j, fs[j], h)
            error = max(FLOOR, float((self.energy(every) + sum(f.trace * (f.w @ f.w) for f in fs)) / (self.cells * self.genes)))
            for f in fs:
                f.error = error
            if splits and len(fs) > 1:
                unit = np.array([f.w / np.linalg.norm(f.w) for f in fs])
                near = np.abs(unit @ unit.T) - np.eye(len(fs))
                if near.max() > alike:
                    i, j = np.unravel_index(near.argmax(), near.shape)
                    self._resplit(fs, int(i), int(j), k, inner, inner_tol)
                    splits -= 1
                    continue
            dw = max(np.linalg.norm(f.w - w) / max(np.linalg.norm(w), 1e-12) for f, (w, _) in zip(fs, before, strict=True))
            dt = max(np.abs(np.log1p([f.age, f.space]) - t).max() for f, (_, t) in zip(fs, before, strict=True))
            if max(dw, dt) < tol:
                break
        size = np.diag(self.cross())[: len(fs)] * np.array([f.w @ f.w for f in fs])
        return self._kept(fs, np.argsort(-size, kind="stable").tolist())

    def _kept(self, fs: list[Factor], order: list[int]) -> list[Factor]:
        """Only the factors numbered in `order`, in that order."""
        if order != list(range(len(self.w))):
            p = len(self.w)
            self._store(self.mapped(lambda at, lam, u, v, hs: np.concatenate((hs[:, order], np.zeros((len(hs), p - len(order)))), axis=1), "hs"))
            self.w = np.concatenate((self.w[order], np.zeros((p - len(order), self.genes))))
        return [fs[i] for i in order]

    def fit_factors(self, p: int, k: int | None, auto: bool, improve: float = 0.05, least: float = 0.01, most: int = 200, sweeps: int = 500) -> tuple[list[Factor], list[dict]]:
        """As fit.fit_factors: greedy, backfitting, and with auto pruning until none falls. most, sweeps: bounds of the iterations."""
        fs, trace = self.greedy(p, k, improve if auto else -np.inf, inner=most)
        fs = self.backfit(fs, k, sweeps, most)
        while auto:
            h, every = self.cross(), range(len(fs))
            whole = max(float(((self.w @ self.w.T) * h).sum()), self.energy([]), 1e-12)
            kept = [j for j in every if h[j, j] * (fs[j].w @ fs[j].w) / whole >= least]
            if not kept or len(kept) == len(fs):
                break
            fs = self.backfit(self._kept(fs, kept), k, sweeps, most)
        return fs, trace

    def fields(self, fs: list[Factor]) -> tuple[list[tuple], DataFrame]:
        """(rows of the trajectories, frame with the fields of all factors in place of values): the exact field, and the trajectory as the mean of what is left."""
        out, solved, k = [], [], self.solver
        for j, f in enumerate(fs):
            used = [m for m in range(len(fs)) if m != j]
            w2, left = float(f.w @ f.w), self._left(used)
            near = lambda lam, f=f, w2=w2: 1 / (f.space * lam + f.error / w2)
            z = lambda v, hs, f=f, w2=w2, left=left: left(v, hs, f.w) / w2
            du, dz = self._by_slice(lambda at, lam, u, v, hs, near=near, z=z: np.stack((near(lam) * u * u, u * near(lam) * z(v, hs))), 2)
            p = np.linalg.inv(k.k_inverse / max(f.age, JITTER) + np.diag(du))
            back = p @ dz
            field = lambda at, lam, u, v, hs, f=f, near=near, z=z, back=back: f.space * lam * (near(lam) * z(v, hs) - back[at] * near(lam) * u)
            alpha = self._by_slice(lambda at, lam, u, v, hs, j=j, field=field: (u * (hs[:, j] - field(at, lam, u, v, hs)))[None], 1)[0] / k.sizes
            solved.append(field)
            spread = np.sqrt(np.maximum(np.diag(p), 0))
            out += [("trajectory", j, int(s), float(self.ages[i]), float(alpha[i]), float(spread[i])) for i, s in enumerate(self.slices)]
        return out, self.mapped(lambda at, lam, u, v, hs: np.stack([b(at, lam, u, v, hs) for b in solved], axis=1), "values")


def fit_spread(spectral: DataFrame, name: str, p: int, k: int | None = None, auto: bool = False, gamma_age: float = 1.0, most: int = 200, sweeps: int = 500) -> DataFrame:
    """Rows of fit.fit_keys for one fit, `name`, whose spectral rows are spread over tasks; most and sweeps bound the iterations.

    The driver holds loadings and sums by slice. Scores and fields go back from spectral rows to cells slice by slice, as
    the rows were made.
    """
    state = Spread(spectral, p, gamma_age)
    fs, trace = state.fit_factors(p, k, auto, most=most, sweeps=sweeps)
    out = [("trial", t["factor_index"] - 1, int(t["keep"]), None, t["rel_improve_total"], None) for t in trace] if auto else []
    for j, f in enumerate(fs):
        out += [("loading", j, g, None, float(w), None) for g, w in enumerate(f.w)] + [("theta", j, i, None, float(v), None) for i, v in enumerate((f.age, f.space, f.error))]
    trajectories, fields = state.fields(fs)
    first = lambda c: F.slice(c, 1, len(fs))
    rotated = fields.select(F.lit(name).alias("fit"), "slice", "i", first("hs").alias("hs"), first("values").alias("fields"))
    small = spectral.sparkSession.createDataFrame([(name, *r) for r in out + trajectories], RESULT)
    return small.unionByName(scored(rotated, spectral.withColumn("fit", F.lit(name))))


def fit_all(spectral: DataFrame, p: int, k: int | None = None, auto: bool = False, gamma_age: float = 1.0) -> DataFrame:
    """fit_keys for the fits whose rotated values are at most SMALL_BYTES, side by side, and fit_spread for each larger one."""
    sizes = spectral.groupBy("fit").agg(F.sum(F.size("values").cast("long") * 8).alias("bytes"))
    out = fit_keys(spectral.join(sizes.where(F.col("bytes") <= SMALL_BYTES).select("fit"), "fit"), p, k, auto, gamma_age)
    for r in sizes.where(F.col("bytes") > SMALL_BYTES).collect():  # one row a fit too large for a task
        out = out.unionByName(fit_spread(spectral.where(F.col("fit") == r["fit"]), r["fit"], p, k, auto, gamma_age))
    return out
