"""Domains of cells over time: choice of slices, labels aligned over slices or to a truth, evidence and roles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.operators.programs import assignment

UNASSIGNED = "#unassigned"


def closest_slices(slices: DataFrame, targets: Sequence[float]) -> DataFrame:
    """slice, age, target: for each target in order, the unused slice whose age is closest; ties to the smaller age, then slice.

    The n-th target can only fall on one of the n slices nearest to it, so no more than that many rows a target reach
    the fold, whatever the number of slices.
    """
    spark, n = slices.sparkSession, len(targets)
    if not n:
        return slices.select("slice", "age").where("false").withColumn("target", F.lit(0.0))
    goals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets)], "i int, target double")
    order = Window.partitionBy("i").orderBy(F.abs(F.col("age") - F.col("target")), "age", "slice")
    near = slices.select("slice", "age").where("age is not null").crossJoin(F.broadcast(goals)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, rows in pdf.sort_values(["i", "r"]).groupby("i"):
            free = rows[~rows["slice"].isin(used)].head(1)
            used.update(free["slice"])
            out.append(free)
        return pd.concat(out)[["slice", "age", "target"]]

    schema = slices.select("slice", "age").withColumn("target", F.lit(0.0)).schema
    return near.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(fold, schema)


def occurrences(slices: DataFrame, picks: Iterable[tuple[int, int]]) -> DataFrame:
    """target, slice: the n-th slice (by age, slice) whose rounded age is the target, the last if there are fewer; else the closest slice."""
    goals = slices.sparkSession.createDataFrame([(int(t), int(n)) for t, n in picks], "target int, n int")
    pairs = slices.crossJoin(F.broadcast(goals)).withColumn("hit", F.bround("age").cast("int") == F.col("target"))
    by = Window.partitionBy("target", "n")
    rows = pairs.withColumns({"hits": F.count_if("hit").over(by), "k": F.row_number().over(by.orderBy(F.desc("hit"), F.when(~F.col("hit"), F.abs(F.col("age") - F.col("target"))), "age", "slice"))})
    wanted = F.when(F.col("hits") == 0, 1).otherwise(F.least("n", "hits"))
    return rows.where(F.col("k") == wanted).select("target", "n", "slice")


def slice_scores(slices: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """slices with a score: each named column scaled to [0, 1] over all slices (0 if constant), weighted and summed."""
    ends = slices.agg(*[f(c).alias(f"{m}_{c}") for c in weights for m, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    score = reduce(lambda a, b: a + b, [scaled(c) * F.lit(w) for c, w in weights.items()])
    return slices.crossJoin(F.broadcast(ends)).withColumn("score", score).select(*slices.columns, "score")


def start_domain(cells: DataFrame, components: Sequence[str], domain: str = "domain") -> DataFrame:
    """One row, component and domain: the component of the largest variance, and the domain with its lowest mean; ties to the first."""
    spread = cells.agg(*[F.var_pop(c).alias(c) for c in components]).select(F.explode(F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(c).alias("component"), F.col(c).alias("v")) for i, c in enumerate(components)])).alias("s"))
    best = spread.agg(F.max_by("s.component", F.struct("s.v", "s.i")).alias("component"))
    means = cells.groupBy(domain).agg(*[F.avg(c).alias(c) for c in components])
    value = reduce(lambda a, c: F.when(F.col("component") == c, F.col(c)).otherwise(a), components, F.lit(None).cast("double"))
    return means.crossJoin(F.broadcast(best)).groupBy("component").agg(F.min_by(domain, F.struct(value.alias("m"), F.col(domain))).alias(domain))


def evidence(domains: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """domains with one column a kind: the sum of its components' z-scores (ddof 1; 0 where constant) over domains."""
    columns = sorted({c for cs in kinds.values() for c in cs})
    moments = domains.agg(*[f(c).alias(f"{m}_{c}") for c in columns for m, f in (("m", F.avg), ("s", F.stddev_samp))])

    def z(c: str) -> Column:
        return F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0))

    sums = {k: reduce(lambda a, b: a + b, map(z, cs)) for k, cs in kinds.items()}
    return domains.crossJoin(F.broadcast(moments)).withColumns(sums).select(*domains.columns, *kinds)


def roles(domains: DataFrame, order: Mapping[str, str], domain: str = "domain", rest: str = "unassigned") -> DataFrame:
    """domains with a role: each kind in order takes the domain without a role that has its largest evidence (ties to the first); others get `rest`."""
    out = domains.withColumn("role", F.lit(None).cast("string"))
    for kind, role in order.items():
        first = out.where(F.col("role").isNull()).agg(F.max(F.col(kind)).alias("v"))
        chosen = out.join(F.broadcast(first), F.col("role").isNull() & (F.col(kind) == F.col("v")), "left_semi").agg(F.min(domain).alias("chosen"))
        out = out.crossJoin(F.broadcast(chosen)).withColumn("role", F.when(F.col("role").isNull() & (F.col(domain) == F.col("chosen")), F.lit(role)).otherwise(F.col("role"))).drop("chosen")
    return out.withColumn("role", F.coalesce("role", F.lit(rest)))


def align_over_time(cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """slice, label, aligned (from 1) for cells with slice, age, label and features.

    Slices go by age. The first, and each whose number of labels differs from that of the slice before, is numbered by
    its labels' means of the first feature; the others are matched to the slice before by least squared distance of
    centroids. Centroids are one aggregation; only they, a few rows a slice, reach the fold.
    """
    centroids = cells.groupBy("slice", "label").agg(F.min("age").alias("age"), F.array(*[F.avg(c) for c in features]).alias("c"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        pdf = pdf.assign(first=pdf.groupby("slice")["age"].transform("min"))
        for _, rows in pdf.sort_values(["first", "slice", "label"]).groupby(["first", "slice"]):
            c = np.stack(rows["c"].to_list())
            if before is None or len(before) != len(c):
                at = np.empty(len(c), int)
                at[np.argsort(c[:, 0], kind="stable")] = np.arange(len(c))
            else:
                at = np.asarray(assignment(((c[:, None] - before[None]) ** 2).sum(-1)))
            before = np.empty_like(c)
            before[at] = c
            out.append(rows[["slice", "label"]].assign(aligned=at + 1))
        return pd.concat(out)

    schema = cells.select("slice", "label").withColumn("aligned", F.lit(0).cast("long")).schema
    return centroids.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(fold, schema)


def align_to_truth(df: DataFrame, truth: str, pred: str, targets: Sequence[str], by: str, fallback: str | None = None) -> DataFrame:
    """by, pred, aligned: the largest one-to-one overlap of predicted labels with targets inside each group; labels left over take the target
    they overlap most, or #unassigned if none. A label whose rows have no target in `truth` is counted by `fallback`."""
    names = [truth] + ([fallback] if fallback else [])
    table = df.where(F.col(pred).isNotNull()).groupBy(by, pred).agg(*[F.count_if(F.col(n) == F.lit(t)).alias(f"n{i}_{j}") for i, n in enumerate(names) for j, t in enumerate(targets)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pred)
        counts = [pdf[[f"n{i}_{j}" for j in range(len(targets))]].to_numpy(float) for i in range(len(names))]
        t = counts[0]
        if fallback:
            t = np.where(t.sum(axis=1, keepdims=True) > 0, t, counts[1])
        wide = t if t.shape[0] <= t.shape[1] else t.T
        pairs = list(enumerate(assignment(-wide)))
        got = {i: j for i, j in (pairs if wide is t else [(b, a) for a, b in pairs]) if t[i, j] > 0}
        found = [targets[got.get(i, int(np.argmax(t[i])))] if t[i].sum() > 0 else UNASSIGNED for i in range(len(t))]
        return pdf[[by, pred]].assign(aligned=found)

    return table.groupBy(by).applyInPandas(one, df.select(by, pred).withColumn("aligned", F.lit("")).schema)


def method_ranks(scores: DataFrame, value: str = "value", method: str = "method", metric: str = "metric") -> DataFrame:
    """method, mean_rank: the average over metrics of a method's rank, best first, ties sharing the mean of their places."""
    rank = F.rank().over(Window.partitionBy(metric).orderBy(F.desc(value))) + (F.count(F.lit(1)).over(Window.partitionBy(metric, value)) - 1) / 2
    return scores.withColumn("r", rank).groupBy(method).agg(F.avg("r").alias("mean_rank"))
