"""Programs as weighted gene sets: simplex projection, similarity, recovery metrics, alignment, enrichment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project_simplex(loadings: DataFrame, k: int | None = None) -> DataFrame:
    """program, gene, weight: Euclidean projection of each program on the simplex; with k only of its k largest, the others 0."""
    order = Window.partitionBy("program").orderBy(F.desc("weight"), "gene")
    rows = loadings.withColumn("r", F.row_number().over(order))
    if k is not None:
        rows = rows.withColumn("v", F.when(F.col("r") <= k, F.col("weight")))
    else:
        rows = rows.withColumn("v", F.col("weight"))
    rows = rows.withColumn("cs", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    theta = rows.where("v is not null and v * r > cs - 1").groupBy("program").agg(F.max_by((F.col("cs") - 1) / F.col("r"), "r").alias("theta"))
    cut = rows.join(F.broadcast(theta), "program").withColumn("u", F.coalesce(F.greatest(F.col("v") - F.col("theta"), F.lit(0.0)), F.lit(0.0)))
    return cut.select("program", "gene", (F.col("u") / F.sum("u").over(Window.partitionBy("program"))).alias("weight"))


def sparsify_absolute(loadings: DataFrame, share: float | None = 0.1, top: int | None = None, project: bool = True) -> DataFrame:
    """program, gene, weight: absolute weights, only the `top` largest of each program, or the share of all genes, rounded up and at least one; the others 0. project: then onto the simplex, as all of them with neither share nor top."""
    rows = loadings.withColumn("weight", F.abs("weight"))
    if top is not None or share is not None:
        genes = F.count(F.lit(1)).over(Window.partitionBy("program"))
        k = F.lit(top) if top is not None else F.greatest(F.lit(1), F.ceil(F.lit(share) * genes))
        order = Window.partitionBy("program").orderBy(F.desc("weight"), "gene")
        rows = rows.withColumn("weight", F.when(F.row_number().over(order) <= k, F.col("weight")).otherwise(0.0))
    rows = rows.select("program", "gene", "weight")
    return project_simplex(rows) if project else rows


def top_genes(loadings: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("program").orderBy(F.desc("weight"), "gene")
    return loadings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _both(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Every program of a with every program of b, gene by gene; programs are few."""
    left = a.select(F.col("program").alias("p"), "gene", F.col("weight").alias("wa"))
    right = b.select(F.col("program").alias("q"), "gene", F.col("weight").alias("wb"))
    if how == "inner":
        return left.join(right, "gene")
    grid = left.select("p").distinct().crossJoin(F.broadcast(right.select("q").distinct())).crossJoin(left.select("gene").union(right.select("gene")).distinct())
    return grid.join(left, ["p", "gene"], "left").join(right, ["q", "gene"], "left").withColumns({"wa": F.coalesce("wa", F.lit(0.0)), "wb": F.coalesce("wb", F.lit(0.0))})


def cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """p, q, cosine over shared genes, in [0, 1]."""
    s = _both(a, b).groupBy("p", "q").agg(F.sum(F.col("wa") * F.col("wb")).alias("ab"), F.sum(F.col("wa") * F.col("wa")).alias("aa"), F.sum(F.col("wb") * F.col("wb")).alias("bb"))
    value = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    return s.select("p", "q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("cosine"))


def jaccard(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """p, q, jaccard of the n top genes."""
    both = _both(top_genes(a, n), top_genes(b, n)).groupBy("p", "q").agg(F.count(F.lit(1)).alias("k"))
    sizes = [top_genes(x, n).groupBy("program").agg(F.count(F.lit(1)).alias(c)).withColumnRenamed("program", m) for x, m, c in ((a, "p", "na"), (b, "q", "nb"))]
    grid = sizes[0].crossJoin(F.broadcast(sizes[1])).join(both, ["p", "q"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return grid.select("p", "q", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def average_rank(value: str, *by: str) -> Column:
    """Average rank of a column inside groups: ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """p, q, mse, tv (1 - half L1), hellinger (1 - distance), pearson, spearman over all genes, absent ones 0."""
    rows = _both(a, b, "full")
    rows = rows.withColumns({"ra": average_rank("wa", "p", "q"), "rb": average_rank("wb", "p", "q")})
    half = F.sqrt(F.sum(F.pow(F.sqrt("wa") - F.sqrt("wb"), 2)) / 2)
    return rows.groupBy("p", "q").agg(
        F.avg(F.pow(F.col("wa") - F.col("wb"), 2)).alias("mse"),
        (1 - F.sum(F.abs(F.col("wa") - F.col("wb"))) / 2).alias("tv"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - half)).alias("hellinger"),
        F.corr("wa", "wb").alias("pearson"),
        F.corr("ra", "rb").alias("spearman"),
    )


def mass_set(loadings: DataFrame, tau: float) -> DataFrame:
    """The smallest top genes of each program that hold tau of its mass."""
    order = Window.partitionBy("program").orderBy(F.desc("weight"), "gene").rowsBetween(Window.unboundedPreceding, -1)
    return loadings.withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0.0))).where(F.col("before") < tau).drop("before")


def matching(truth: DataFrame, found: DataFrame, tau: float = 0.8) -> DataFrame:
    """p, q, f1, jaccard of the tau-mass sets, and hit: the share of true genes among as many top ones found."""
    a, b = mass_set(truth, tau), mass_set(found, tau)
    both = _both(a, b).groupBy("p", "q").agg(F.count(F.lit(1)).alias("k"))
    na, nb = (x.groupBy("program").agg(F.count(F.lit(1)).alias(c)).withColumnRenamed("program", m) for x, m, c in ((a, "p", "na"), (b, "q", "nb")))
    real = truth.where("weight > 1e-10")
    sizes = real.groupBy("program").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("program", "p")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("program").orderBy(F.desc("weight"), "gene")))
    hits = real.select(F.col("program").alias("p"), "gene").join(ranked.select(F.col("program").alias("q"), "gene", "rank"), "gene").join(sizes, "p").where("rank <= n").groupBy("p", "q").agg(F.count(F.lit(1)).alias("h"))
    grid = na.crossJoin(F.broadcast(nb)).join(both, ["p", "q"], "left").join(hits, ["p", "q"], "left").join(sizes, "p")
    k, h = F.coalesce("k", F.lit(0)), F.coalesce("h", F.lit(0))
    return grid.select("p", "q", (2 * k / (F.col("na") + F.col("nb"))).alias("f1"), (k / (F.col("na") + F.col("nb") - k)).alias("jaccard"), (h / F.col("n")).alias("hit"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Columns of the least-cost assignment of rows, rows <= columns, by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used)
            slack = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


def align(costs: DataFrame) -> DataFrame:
    """costs (p, q, cost), one row a pair of programs -> p, q, cost of the best one-to-one matching."""
    rows = costs.select("p", "q", "cost").collect()  # programs of two fits: tens
    ps, qs = sorted({r["p"] for r in rows}), sorted({r["q"] for r in rows})
    table = np.full((len(ps), len(qs)), 1e18)
    for r in rows:
        table[ps.index(r["p"]), qs.index(r["q"])] = r["cost"]
    flip = len(ps) > len(qs)
    chosen = assignment(table.T if flip else table)
    pairs = [(ps[j], qs[i]) if flip else (ps[i], qs[j]) for i, j in enumerate(chosen.tolist())]
    return costs.sparkSession.createDataFrame([(p, q, float(table[ps.index(p), qs.index(q)])) for p, q in pairs], "p string, q string, cost double")


def overlap(loadings: DataFrame, sets: DataFrame, n: int, background: DataFrame) -> DataFrame:
    """program, term, k, drawn, good, total, odds: hits of the n top genes in each set, inside a background of genes."""
    known = background.select("gene").distinct()
    total = known.agg(F.count(F.lit(1)).alias("total"))
    members = sets.join(known, "gene", "left_semi").select("term", "gene").distinct()
    good = members.groupBy("term").agg(F.count(F.lit(1)).alias("good"))
    drawn = top_genes(loadings.where("weight > 0"), n).join(known, "gene", "left_semi")
    size = drawn.groupBy("program").agg(F.count(F.lit(1)).alias("drawn"))
    hits = drawn.join(members, "gene").groupBy("program", "term").agg(F.count(F.lit(1)).alias("k"))
    rows = hits.join(F.broadcast(size), "program").join(good, "term").crossJoin(F.broadcast(total))
    a, b, c = F.col("k"), F.col("drawn") - F.col("k"), F.col("good") - F.col("k")
    d = F.col("total") - F.col("drawn") - c
    return rows.withColumn("odds", F.when((b > 0) & (c > 0), a * d / (b * c)))
