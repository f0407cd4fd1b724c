"""How well programs, variances and low-rank signals are recovered, and what a fitted factor explains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def topk_hit_rate(truth: DataFrame, found: DataFrame, eps: float = 1e-10) -> DataFrame:
    """program, n, hits, rate: of a program's n true genes (weight > eps), the share among its n largest found in absolute value; ties by gene."""
    true = truth.where(F.col("weight") > eps).select("program", "gene")
    size = true.groupBy("program").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("program").orderBy(F.abs("weight").desc(), "gene")
    top = found.withColumn("r", F.row_number().over(order)).join(F.broadcast(size), "program").where("r <= n").select("program", "gene")
    hits = true.join(top, ["program", "gene"]).groupBy("program").agg(F.count(F.lit(1)).alias("hits"))
    out = size.join(hits, "program", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("rate", F.col("hits") / F.col("n"))


def variance_errors(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: age_rmse, age_log_rmse, space_rmse, space_log_rmse over programs of both (program, age, space); the logarithm of 0 is -inf for age and null for space."""
    both = truth.join(found.select("program", F.col("age").alias("a"), F.col("space").alias("s")), "program")
    r = both.agg(F.sqrt(F.avg((F.col("age") - F.col("a")) ** 2)).alias("age_rmse"), F.sqrt(F.avg((F.col("space") - F.col("s")) ** 2)).alias("space_rmse"))
    age_log = F.when(F.col("age_rmse") > 0, F.log("age_rmse")).when(F.col("age_rmse") == 0, F.lit(float("-inf")))
    return r.select("age_rmse", age_log.alias("age_log_rmse"), "space_rmse", F.when(F.col("space_rmse") > 0, F.log("space_rmse")).alias("space_log_rmse"))


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 - norm of the principal angles between two row spaces / sqrt(their number); programs x genes."""
    k = min(*a.shape, *b.shape)
    cosines = np.linalg.svd(np.linalg.qr(a.T)[0].T @ np.linalg.qr(b.T)[0], compute_uv=False)
    return float(1 - np.linalg.norm(np.arccos(np.clip(cosines, 0, 1))[:k]) / np.sqrt(k))


def interval(trajectory: DataFrame, z: float = Z95) -> DataFrame:
    """alpha with lower and upper: alpha -/+ z * sqrt(max(variance, 0))."""
    half = F.sqrt(F.greatest(F.col("variance"), F.lit(0.0))) * z
    return trajectory.withColumns({"lower": F.col("alpha") - half, "upper": F.col("alpha") + half})


def variance_share(age: Column, space: Column) -> Column:
    """Share of a program's variance that its trajectory has; 0 where both are 0."""
    whole = age + space
    return age / F.when(whole == 0, F.lit(1.0)).otherwise(whole)


def prune(scores: DataFrame, loadings: DataFrame, energy: float, least: float = 0.01) -> DataFrame:
    """program, fraction, keep from scores (program, cell, h) and loadings (program, gene, weight).

    fraction is ||h||^2 ||w||^2 over the larger of the fitted signal's energy and `energy`. The signal's energy comes
    from the programs' two Gram matrices, so no cells x genes product is formed.
    """

    def gram(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
        other = df.select(F.col("program").alias("q"), key, F.col(value).alias("o"))
        return df.select(F.col("program").alias("p"), key, value).join(other, key).groupBy("p", "q").agg(F.sum(F.col(value) * F.col("o")).alias(out))

    both = gram(scores, "cell", "h", "hh").join(gram(loadings, "gene", "weight", "ww"), ["p", "q"]).withColumn("e", F.col("hh") * F.col("ww"))
    whole = both.agg(F.greatest(F.sum("e"), F.lit(float(energy)), F.lit(1e-12)).alias("whole"))
    own = both.where("p = q").crossJoin(F.broadcast(whole))
    return own.select(F.col("p").alias("program"), (F.col("e") / F.col("whole")).alias("fraction")).withColumn("keep", F.col("fraction") >= least)


def low_rank_signal(rows: DataFrame, gram: np.ndarray, mean: np.ndarray, n: float, rank: int) -> DataFrame:
    """cell, signal: values of cells (cell, genes) on the `rank` leading directions about their mean; rank 0 leaves the mean.

    The directions come from the genes' centred Gram matrix, one aggregation; the projection is a map over cells.
    """
    vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))[1][:, ::-1][:, : max(rank, 0)]

    def project(batches):
        for pdf in batches:
            x = np.stack(pdf["genes"].to_list()) - mean if len(pdf) else np.zeros((0, len(mean)))
            yield pdf[["cell"]].assign(signal=list(x @ vectors @ vectors.T + mean))

    return rows.select("cell", "genes").mapInPandas(project, "cell long, signal array<double>")
