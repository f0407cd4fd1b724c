"""Agreement across settings and replicates, and summaries over programs, effectors and cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sweep_grid(spark: SparkSession, temporal: Sequence[float], spatial: Sequence[float], base: tuple[float, float]) -> DataFrame:
    """setting_id, panel, temporal_rho, spatial_rho, is_baseline: each panel varies one value from the baseline, which both share once."""
    rows = {(t, base[1]): "temporal" for t in temporal} | {(base[0], s): "spatial" for s in spatial if s != base[1]}
    rows.setdefault(base, "temporal")
    name = lambda v: f"{v:.2f}".replace(".", "p")
    return spark.createDataFrame([(f"t{name(t)}_s{name(s)}", panel, float(t), float(s), (t, s) == base) for (t, s), panel in sorted(rows.items())], "setting_id string, panel string, temporal_rho double, spatial_rho double, is_baseline boolean")


def recurrence(enriched: DataFrame, settings: int, cut: float = 0.05) -> DataFrame:
    """program, term, recovered, share, least_p, median_score over the settings in which the term passes."""
    hits = enriched.where((F.col("adjusted_p") > 0) & (F.col("adjusted_p") < cut) & (F.col("score") > 0))
    s = hits.groupBy("program", "term").agg(F.countDistinct("setting").alias("recovered"), F.min("adjusted_p").alias("least_p"), F.median("score").alias("median_score"))
    return s.withColumn("share", F.col("recovered") / F.lit(settings))


def decomposed(scores: DataFrame) -> DataFrame:
    """program, slice, cell, alpha, b: the mean of a slice's scores, and what is left."""
    alpha = F.avg("h").over(Window.partitionBy("program", "slice"))
    return scores.withColumn("alpha", alpha).withColumn("b", F.col("h") - F.col("alpha"))


def weights_by_correlation(values: DataFrame, scores: DataFrame, cells: DataFrame) -> DataFrame:
    """program, gene, weight: correlation over slices of mean values and mean scores; null where either is constant."""
    x = values.join(cells.select("cell", "slice"), "cell").groupBy("slice", "gene").agg(F.avg("value").alias("x"))
    y = scores.join(cells.select("cell", "slice"), "cell").groupBy("slice", "program").agg(F.avg("h").alias("y"))
    s = x.join(y, "slice").groupBy("program", "gene").agg(F.corr("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return s.select("program", "gene", F.when((F.col("sx") >= 1e-12) & (F.col("sy") >= 1e-12), F.col("c")).alias("weight"))


def best_program(correlations: DataFrame, signed: bool = False) -> DataFrame:
    """marker, program, r with the largest correlation, in absolute value for signed methods; ties to the first program."""
    value = F.abs("r") if signed else F.col("r")
    order = Window.partitionBy("marker").orderBy(value.desc_nulls_last(), "program")
    return correlations.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def effector_summary(effects: DataFrame, cut: float = 0.05) -> DataFrame:
    """program, significant, positive, negative, top, bottom among effects with q < cut."""
    s = effects.where(F.col("q") < cut)
    return s.groupBy("program").agg(F.count(F.lit(1)).alias("significant"), F.count_if(F.col("effect") > 0).alias("positive"), F.count_if(F.col("effect") < 0).alias("negative"), F.max_by("other_type", "effect").alias("top"), F.min_by("other_type", "effect").alias("bottom"))


def colour_limits(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """by, lo, hi: symmetric at the 99th percentile of absolute values where any is negative, else the 1st and 99th."""
    s = df.groupBy(*by).agg(F.min(column).alias("m"), F.percentile(F.abs(column), F.lit(0.99)).alias("a"), F.percentile(column, F.lit(0.01)).alias("p1"), F.percentile(column, F.lit(0.99)).alias("p99"))
    return s.select(*by, F.when(F.col("m") < 0, -F.col("a")).otherwise(F.col("p1")).alias("lo"), F.when(F.col("m") < 0, F.col("a")).otherwise(F.col("p99")).alias("hi"))


def ordinary_least_squares(df: DataFrame, value: str, columns: Sequence[str], ridge: float = 1e-8) -> DataFrame:
    """term, estimate, se, t of value on an intercept and columns, and r2; from one aggregate of (k + 1)^2 sums."""
    names = ["intercept", *columns]
    x = {"intercept": F.lit(1.0)} | {c: F.col(c) for c in columns}
    sums = [F.sum(x[a] * x[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)] + [F.sum(x[a] * F.col(value)).alias(f"y_{i}") for i, a in enumerate(names)]
    r = df.agg(*sums, F.sum(F.col(value) * F.col(value)).alias("yy"), F.sum(value).alias("y"), F.count(F.lit(1)).alias("n")).first()
    k = len(names)
    inverse = np.linalg.inv(np.array([[r[f"{i}_{j}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k))
    xy = np.array([r[f"y_{i}"] for i in range(k)])
    beta = inverse @ xy
    left = max(0.0, r["yy"] - 2 * beta @ xy + beta @ np.linalg.inv(inverse) @ beta)
    se = np.sqrt(np.diag(inverse) * left / max(1, r["n"] - k))
    r2 = 1 - left / (r["yy"] - r["y"] ** 2 / r["n"])
    return df.sparkSession.createDataFrame([(n, float(b), float(s), float(b / s) if s else None, float(r2)) for n, b, s in zip(names, beta, se, strict=True)], "term string, estimate double, se double, t double, r2 double")
