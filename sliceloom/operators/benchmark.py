"""Label benchmarks over many groups at once (slices and methods), and agreement of programs across settings, from contingency and product tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceloom.operators.programs import assignment, average_rank


def _pairs(c):
    return c * (c - 1) / 2.0


def contingency(df: DataFrame, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    """by, t, p, n over rows with both labels."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))


def merged_labels(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, p, label: the commonest truth of each prediction of a contingency table, ties to the smallest."""
    order = Window.partitionBy(*by, "p").orderBy(F.desc("n"), "t")
    return table.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*by, "p", F.col("t").alias("label"))


def evaluate_groups(df: DataFrame, truth: str, pred: str, by: Sequence[str], least: int = 1) -> DataFrame:
    """by, cells, raw_ari, raw_nmi, merged_acc, merged_balanced, merged_macro_f1 of every group with at least `least` labelled rows.

    nmi by the arithmetic mean; both are 1 where neither side splits the group. merged: predictions renamed to their
    commonest truth. Only contingency tables, aggregated before the shuffle, meet by group.
    """
    table = contingency(df, truth, pred, by)
    n = F.col("n").cast("double")
    a = table.groupBy(*by, "t").agg(F.sum(n).alias("a")).groupBy(*by).agg(F.sum(_pairs(F.col("a"))).alias("_i"), F.sum(F.col("a") * F.ln("a")).alias("_ea"), F.count(F.lit(1)).alias("_ka"))
    b = table.groupBy(*by, "p").agg(F.sum(n).alias("b")).groupBy(*by).agg(F.sum(_pairs(F.col("b"))).alias("_j"), F.sum(F.col("b") * F.ln("b")).alias("_eb"), F.count(F.lit(1)).alias("_kb"))
    whole = table.groupBy(*by).agg(F.sum("n").alias("cells"), F.sum(_pairs(n)).alias("_ij"), F.sum(n * F.ln(n)).alias("_em"))
    named = table.join(merged_labels(table, by), [*by, "p"])
    hits = named.groupBy(*by, "t").agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("t") == F.col("label"), F.col("n")).otherwise(0)).alias("_tp"))
    said = named.groupBy(*by, F.col("label").alias("t")).agg(F.sum("n").alias("_m"))
    merged = hits.join(said, [*by, "t"], "left").groupBy(*by).agg((F.sum("_tp") / F.sum("_n")).alias("merged_acc"), F.avg(F.col("_tp") / F.col("_n")).alias("merged_balanced"), F.avg(2 * F.col("_tp") / (F.col("_n") + F.coalesce("_m", F.lit(0)))).alias("merged_macro_f1"))
    rows = whole.where(F.col("cells") >= least).join(a, list(by)).join(b, list(by)).join(merged, list(by))
    t = F.col("cells").cast("double")
    expected = F.try_divide(F.col("_i") * F.col("_j"), _pairs(t))
    middle = (F.col("_i") + F.col("_j")) / 2
    ari = F.when((F.col("_ka") == 1) & (F.col("_kb") == 1), 1.0).when((F.col("_ka") == t) & (F.col("_kb") == t), 1.0).otherwise(F.try_divide(F.col("_ij") - expected, middle - expected))
    ha, hb = F.ln(t) - F.col("_ea") / t, F.ln(t) - F.col("_eb") / t
    mutual = F.ln(t) + (F.col("_em") - F.col("_ea") - F.col("_eb")) / t
    nmi = F.when((F.col("_ka") == 1) & (F.col("_kb") == 1), 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(mutual, (ha + hb) / 2)))
    return rows.select(*by, "cells", ari.alias("raw_ari"), nmi.alias("raw_nmi"), "merged_acc", "merged_balanced", "merged_macro_f1")


def matched_accuracy_groups(df: DataFrame, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    """by, raw_acc: the largest accuracy of a one-to-one naming of predictions in each group. A group's contingency table, labels by labels, is one task's input."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="p", values="n", fill_value=0).to_numpy(float)
        wide = wide if wide.shape[0] <= wide.shape[1] else wide.T
        hits = wide[np.arange(len(wide)), assignment(-wide)].sum()
        return pdf[list(by)].head(1).assign(raw_acc=hits / wide.sum())

    table = contingency(df, truth, pred, by)
    return table.groupBy(*by).applyInPandas(one, table.select(*by).withColumn("raw_acc", F.lit(0.0)).schema)


def confusion(df: DataFrame, truth: str, pred: str, targets: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, t, p, n, fraction of the truth's row, for all pairs of target labels, zeros included; other labels are left out."""
    table = contingency(df, truth, pred, by).where(F.col("t").isin(list(targets)) & F.col("p").isin(list(targets)))
    names = F.array(*map(F.lit, targets))
    frame = df.select(*by).distinct().withColumn("t", F.explode(names)).withColumn("p", F.explode(names))
    full = frame.join(table, [*by, "t", "p"], "left").fillna(0, ["n"])
    whole = F.sum("n").over(Window.partitionBy(*by, "t"))
    return full.withColumn("fraction", F.when(whole > 0, F.col("n") / whole).otherwise(0.0))


def proportions(df: DataFrame, label: str, targets: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, label, n, fraction among the target labels of the group, zeros included, for groups that have labels."""
    rows = df.where(F.col(label).isNotNull()).select(*by, F.col(label).cast("string").alias("label"))
    frame = rows.select(*by).distinct().withColumn("label", F.explode(F.array(*map(F.lit, targets))))
    full = frame.join(rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")), [*by, "label"], "left").fillna(0, ["n"])
    whole = F.sum("n").over(Window.partitionBy(*by))
    return full.withColumn("fraction", F.when(whole > 0, F.col("n") / whole).otherwise(0.0))


def long_metrics(metrics: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, metric, value: one row a metric."""
    return metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("_m")).select(*by, "_m.*")


def reference_deltas(metrics: DataFrame, reference: str, at: str = "slice") -> DataFrame:
    """method, metric, pairs, mean, median, better: the reference method's value minus each other method's, over the slices that both have. metrics: method, `at`, metric, value."""
    own = metrics.where(F.col("method") == reference).select(at, "metric", F.col("value").alias("_r"))
    both = metrics.where(F.col("method") != reference).join(own, [at, "metric"]).withColumn("_d", F.col("_r") - F.col("value")).where(F.col("_d").isNotNull() & ~F.isnan("_d"))
    return both.groupBy("method", "metric").agg(F.count(F.lit(1)).alias("pairs"), F.avg("_d").alias("mean"), F.median("_d").alias("median"), F.count_if(F.col("_d") > 0).alias("better"))


# agreement of programs across settings

#: Correlations that are varied one at a time, and the baseline that both panels share.
TEMPORAL, SPATIAL, BASELINE = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85), (0.20, 0.30, 0.40, 0.50, 0.60), (0.70, 0.50)


def settings(spark: SparkSession, temporal: Sequence[float] = TEMPORAL, spatial: Sequence[float] = SPATIAL, base: tuple[float, float] = BASELINE) -> DataFrame:
    """setting_id, panel, temporal_rho, spatial_rho, setting_label, is_baseline: the temporal panel, then the spatial one, the shared baseline once."""
    rows = dict.fromkeys([(t, base[1]) for t in temporal], "temporal")
    for s in spatial:
        rows.setdefault((base[0], s), "spatial")
    if base not in rows:
        raise ValueError("no setting is the baseline")
    name = lambda v: f"{v:.2f}".replace(".", "p")
    out = [(f"temporal_rho_{name(t)}_spatial_rho_{name(s)}", panel, t, s, f"t={t:.2f}, s={s:.2f}", (t, s) == base) for (t, s), panel in rows.items()]
    return spark.createDataFrame(out, "setting_id string, panel string, temporal_rho double, spatial_rho double, setting_label string, is_baseline boolean")


def pair_metrics(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, p, q, cosine, pearson, spearman of every program of a with every one of b in the same group, over the genes that both have; a, b: by, program, gene, weight. Correlations of constant weights are null."""
    left, right = (df.select(*by, F.col("program").alias(p), "gene", F.col("weight").alias(w)) for df, p, w in ((a, "p", "x"), (b, "q", "y")))
    rows = left.join(right, [*by, "gene"])
    keys = [*by, "p", "q"]
    rows = rows.withColumns({"_rx": average_rank("x", *keys), "_ry": average_rank("y", *keys)})
    s = rows.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("_xy"), F.sum(F.col("x") * F.col("x")).alias("_xx"), F.sum(F.col("y") * F.col("y")).alias("_yy"), F.corr("x", "y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return s.select(*keys, (F.col("_xy") / F.greatest(F.lit(1e-12), F.sqrt(F.col("_xx") * F.col("_yy")))).alias("cosine"), known("pearson"), known("spearman"))


def matched_programs(pairs: DataFrame, by: Sequence[str], score: str = "cosine") -> DataFrame:
    """The rows of pair_metrics that the one-to-one matching of largest summed score keeps, in each group; a group's programs by programs are one task's input."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="p", columns="q", values=score, fill_value=-1e9)
        cost = -wide.to_numpy(float)
        flip = cost.shape[0] > cost.shape[1]
        chosen = assignment(cost.T if flip else cost)
        found = {(wide.index[j], wide.columns[i]) if flip else (wide.index[i], wide.columns[j]) for i, j in enumerate(chosen.tolist())}
        return pdf[[(p, q) in found for p, q in zip(pdf["p"], pdf["q"], strict=True)]]

    return pairs.groupBy(*by).applyInPandas(one, pairs.schema)


def baseline_aligned(loadings: DataFrame, grid: DataFrame, left: str, right: str) -> DataFrame:
    """How the baseline's left-right pairs of programs fare in every setting. loadings: setting_id, side, program, gene, weight; grid: settings().

    The baseline's left programs are matched to its right ones; in every setting each side's programs are matched to the
    baseline's of that side; a row for each setting and baseline pair tells which programs stand for it now and
    their cosine, Pearson and Spearman correlation. Settings without loadings of both sides have no rows.
    """
    of = lambda side: loadings.where(F.col("side") == side).drop("side")
    base = F.broadcast(grid.where("is_baseline").select(F.col("setting_id").alias("_base")))  # one row
    at_base = lambda df: df.join(base, F.col("setting_id") == F.col("_base"), "left_semi").drop("setting_id")
    one = F.lit(0).alias("_one")
    l0, r0 = at_base(of(left)), at_base(of(right))
    pairs = matched_programs(pair_metrics(l0.select(one, "*"), r0.select(one, "*"), ["_one"]), ["_one"]).select(F.col("p").alias("baseline_left_program"), F.col("q").alias("baseline_right_program"))
    every = grid.select("setting_id")
    now = {}
    for side, mine, first in (("left", of(left), l0), ("right", of(right), r0)):
        near = matched_programs(pair_metrics(every.crossJoin(first), mine, ["setting_id"]), ["setting_id"])
        now[side] = near.select("setting_id", F.col("p").alias(f"baseline_{side}_program"), F.col("q").alias(f"{side}_program"))
    rows = pairs.join(now["left"], "baseline_left_program").join(now["right"], ["setting_id", "baseline_right_program"])
    scores = pair_metrics(of(left), of(right), ["setting_id"]).withColumnsRenamed({"p": "left_program", "q": "right_program"})
    return rows.join(scores, ["setting_id", "left_program", "right_program"]).join(grid, "setting_id")


def panel_summary(aligned: DataFrame, score: str = "cosine") -> DataFrame:
    """panel, baseline_left_program, baseline_right_program, least, median, n of a score over the settings of each panel; the baseline counts in both."""
    panels = F.when(F.col("is_baseline"), F.array(F.lit("temporal"), F.lit("spatial"))).otherwise(F.array("panel"))
    return aligned.withColumn("panel", F.explode(panels)).groupBy("panel", "baseline_left_program", "baseline_right_program").agg(F.min(score).alias("least"), F.median(score).alias("median"), F.count(score).alias("n"))


def completion(grid: DataFrame, loadings: DataFrame, sides: Sequence[str]) -> DataFrame:
    """setting_id, side, complete, programs: a row for each setting and side, whether or not there are loadings."""
    found = loadings.groupBy("setting_id", "side").agg(F.countDistinct("program").alias("programs"))
    frame = grid.select("setting_id", F.explode(F.array(*map(F.lit, sides))).alias("side"))
    return frame.join(found, ["setting_id", "side"], "left").withColumn("complete", F.col("programs").isNotNull()).fillna(0, ["programs"])


def loading_check(loadings: DataFrame, by: Sequence[str], top: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """by, program, total, sums_to_one, rank, gene: every program's sum and its `top` genes, the largest weights first, ties by gene."""
    keys = [*by, "program"]
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "gene")
    rows = loadings.withColumns({"total": F.sum("weight").over(Window.partitionBy(*keys)), "rank": F.row_number().over(order)})
    return rows.where(F.col("rank") <= top).select(*keys, "total", (F.abs(F.col("total") - 1) <= tolerance).alias("sums_to_one"), "rank", "gene")

