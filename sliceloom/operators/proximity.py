"""Proximity of programs to cell types: effect and enrichment tables over all programs and types at once, and their summaries.

targets have (cell, slice, x, y), scores (cell, program, b), others (cell, slice, celltype, x, y). Distances and shell
counts do not depend on the program, so cells meet their surroundings once; scores join afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.functions.tails import normal_sf, normal_two_sided, rank_sum_sf
from sliceloom.operators.programs import average_rank
from sliceloom.operators.spatial import nearest_within, shell_counts
from sliceloom.operators.statistics import bh, block_effects

#: Least cells on either side of a block, of an enrichment over all slices and of one in a slice; quantiles of high and low.
BLOCK, GROUP, SLICE_GROUP, HIGH, LOW = 8, 30, 8, 0.75, 0.25
_PLACES = ["cell", "slice", "x", "y"]


def rank_sum_test(df: DataFrame, value: str, first: Column, by: Sequence[str], alternative: str = "two-sided") -> DataFrame:
    """by, n1, n2, u, p: rows where `first` against the others. alternative: two-sided, or greater (first has larger values).

    Exact where the smaller side has at most 8 rows and no values tie, else normal with correction for ties and
    continuity; where all values are equal p is 1, where a side is empty it is null.
    """
    if alternative not in ("two-sided", "greater"):
        raise ValueError(f"unknown alternative: {alternative}")
    rows = df.withColumns({"_f": first.cast("int"), "_v": F.col(value)}).withColumns({"_rank": average_rank("_v", *by), "_t": F.count(F.lit(1)).over(Window.partitionBy(*by, "_v"))})
    s = rows.groupBy(*by).agg(F.sum("_f").alias("n1"), F.sum(1 - F.col("_f")).alias("n2"), F.sum(F.col("_rank") * F.col("_f")).alias("_r"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("_ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n, mean = n1 + n2, n1 * n2 / 2
    s = s.withColumn("u", F.col("_r") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    away = F.abs(F.col("u") - mean) if alternative == "two-sided" else F.col("u") - mean
    least = F.greatest(F.col("u"), n1 * n2 - F.col("u")) if alternative == "two-sided" else F.col("u")
    sides = 2.0 if alternative == "two-sided" else 1.0
    small = (F.least(n1, n2) <= 8) & (F.col("_ties") == 0)
    s = s.withColumns({"_exact": rank_sum_sf(F.when(small, least), n1, n2), "_near": normal_sf(F.when(sd > 0, (away - 0.5) / sd))})
    p = F.when((n1 == 0) | (n2 == 0), None).when(small, F.least(F.lit(1.0), sides * F.col("_exact"))).when(F.col("_near").isNull(), 1.0).otherwise(F.least(F.lit(1.0), sides * F.col("_near")))
    return s.withColumn("p", p).select(*by, "n1", "n2", "u", "p")


def _types(others: DataFrame) -> DataFrame:
    return others.select(F.col("celltype").alias("effector")).distinct()


def _measured(targets: DataFrame, scores: DataFrame, others: DataFrame, far: float) -> DataFrame:
    """cell, slice, program, b, effector, d: a row for each type that the cell's slice has, d null beyond far."""
    near = nearest_within(targets.select(*_PLACES), others, far).withColumnRenamed("other_type", "effector")
    return near.join(scores, "cell")


def effect_table(targets: DataFrame, scores: DataFrame, others: DataFrame, near: float = 30.0, far: float = 150.0, least: int = BLOCK) -> DataFrame:
    """program, effector, effect, se, z, p, n_near, n_far, n_blocks, q_bh for every program and type of others.

    Median near minus median far in each slice, pooled by inverse variance; q_bh over the whole table. Pairs without a
    block have counts 0 and nulls, and play no part in q_bh. others may be any cells with places, the targets' own table or another.
    """
    d = _measured(targets, scores, others, far)
    blocks = block_effects(d, "b", F.col("d") <= near, F.col("d").isNull(), ["program", "effector", "slice"], least)
    s = blocks.groupBy("program", "effector").agg((F.sum(F.col("weight") * F.col("effect")) / F.sum("weight")).alias("effect"), (1 / F.sqrt(F.sum("weight"))).alias("se"), F.sum("nn").alias("n_near"), F.sum("nf").alias("n_far"), F.count(F.lit(1)).alias("n_blocks"))
    every = scores.select("program").distinct().crossJoin(_types(others))
    rows = every.join(s, ["program", "effector"], "left").fillna(0, ["n_near", "n_far", "n_blocks"]).withColumn("z", F.col("effect") / F.col("se"))
    return bh(rows.withColumn("p", normal_two_sided("z")), "p", "q_bh").select("program", "effector", "effect", "se", "z", "p", "n_near", "n_far", "n_blocks", "q_bh")


def significant_effectors(effects: DataFrame, cut: float = 0.05, most: int = 12) -> DataFrame:
    """program, rank, effector, effect, q_bh: of each program the effectors with q_bh < cut, the largest effects first, at most `most`."""
    order = Window.partitionBy("program").orderBy(F.abs("effect").desc(), "effector")
    found = effects.where(F.col("q_bh") < cut).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= most).select("program", "rank", "effector", "effect", "q_bh")


def shell_table(targets: DataFrame, scores: DataFrame, others: DataFrame, inner: float = 20.0, outer: float = 50.0, by_slice: bool = False, least: int | None = None) -> DataFrame:
    """Shell enrichment of every program and type: program, (slice,) effector, hi_threshold, lo_threshold, n_hi, n_lo, hi_mean, lo_mean, log2fc, p, q_bh, (q_bh_by_slice,) valid.

    Cells of a high score against those of a low one by how many of the type lie within inner < d <= outer, with
    quantiles over all cells, or in each slice of at least 2 * least of them. Groups under `least` cells are rows too: not
    valid, without ratio and p, so q_bh (inside a program) leaves them out; q_bh_by_slice corrects inside a slice.
    """
    least = least or (SLICE_GROUP if by_slice else GROUP)
    keys = ["program", "slice"] if by_slice else ["program"]
    rated = scores.join(targets.select("cell", "slice"), "cell")
    cuts = rated.groupBy(*keys).agg(F.percentile("b", F.lit(HIGH)).alias("hi_threshold"), F.percentile("b", F.lit(LOW)).alias("lo_threshold"), F.count(F.lit(1)).alias("_n"))
    if by_slice:
        enough = F.col("_n") >= 2 * least
        cuts = cuts.withColumns({c: F.when(enough, F.col(c)) for c in ("hi_threshold", "lo_threshold")})
    sides = F.filter(F.array(F.when(F.col("b") >= F.col("hi_threshold"), "hi"), F.when(F.col("b") <= F.col("lo_threshold"), "lo")), lambda s: s.isNotNull())
    marked = rated.join(cuts.drop("_n"), keys).withColumn("side", F.explode(sides)).select(*keys, "cell", "side")
    found = shell_counts(targets.select(*_PLACES), others, inner, outer).select("cell", F.col("other_type").alias("effector"), "n")
    types = _types(others)
    counted = marked.crossJoin(types).join(found, ["cell", "effector"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    groups = [*keys, "effector"]
    hi = F.col("side") == "hi"
    s = counted.groupBy(*groups).agg(F.count_if(hi).alias("n_hi"), F.count_if(~hi).alias("n_lo"), F.avg(F.when(hi, F.col("n"))).alias("hi_mean"), F.avg(F.when(~hi, F.col("n"))).alias("lo_mean"))
    tests = rank_sum_test(counted, "n", hi, groups).select(*groups, "p")
    rows = cuts.drop("_n").crossJoin(types).join(s, groups, "left").fillna(0, ["n_hi", "n_lo"]).join(tests, groups, "left")
    valid = (F.col("n_hi") >= least) & (F.col("n_lo") >= least)
    rows = rows.withColumns({"valid": valid, "log2fc": F.when(valid, F.log2((F.col("hi_mean") + 0.05) / (F.col("lo_mean") + 0.05))), "p": F.when(valid, F.col("p"))})
    rows = bh(rows, "p", "q_bh", ["program"])
    out = ["hi_threshold", "lo_threshold", "n_hi", "n_lo", "hi_mean", "lo_mean", "log2fc", "p", "q_bh"]
    if by_slice:
        rows = bh(rows, "p", "q_bh_by_slice", keys)
        out.append("q_bh_by_slice")
    return rows.select(*keys, "effector", *out, "valid")


def slice_table(targets: DataFrame, scores: DataFrame, others: DataFrame, near: float = 30.0, far: float = 150.0, least: int = BLOCK, mode: str = "corrected") -> DataFrame:
    """program, slice, effector, effect, se, z, p, n_near, n_far, q_bh, q_bh_by_slice, valid: the matched effect inside every slice, for every type.

    Slices under 2 * least targets, or without the type, count none on either side. mode 'weight' gives the inverse variance
    itself as se, as older analyses did. q_bh corrects inside a program, q_bh_by_slice inside a program's slice.
    """
    if mode not in ("corrected", "weight"):
        raise ValueError(f"unknown mode: {mode}")
    groups = ["program", "slice", "effector"]
    d = _measured(targets, scores, others, far)
    sizes = scores.join(targets.select("cell", "slice"), "cell").groupBy("program", "slice").agg(F.count(F.lit(1)).alias("_n"))
    n = d.groupBy(*groups).agg(F.count_if(F.col("d") <= near).alias("n_near"), F.count_if(F.col("d").isNull()).alias("n_far"))
    effects = block_effects(d, "b", F.col("d") <= near, F.col("d").isNull(), groups, least).select(*groups, "effect", "weight")
    rows = sizes.crossJoin(_types(others)).join(n, groups, "left").join(effects, groups, "left")
    enough = F.col("_n") >= 2 * least
    rows = rows.withColumns({c: F.when(enough, F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")) for c in ("n_near", "n_far")})
    rows = rows.withColumn("se", F.col("weight") if mode == "weight" else 1 / F.sqrt("weight")).withColumn("z", F.col("effect") / F.col("se"))
    rows = rows.withColumns({"p": normal_two_sided("z"), "valid": F.col("effect").isNotNull()})
    rows = bh(bh(rows, "p", "q_bh", ["program"]), "p", "q_bh_by_slice", ["program", "slice"])
    return rows.select(*groups, "effect", "se", "z", "p", "n_near", "n_far", "q_bh", "q_bh_by_slice", "valid")


def _first(column: str, order: Column) -> Column:
    return F.min_by(F.col(column), F.struct(order, F.col(column)))


def downstream_summary(enriched: DataFrame, by_slice: DataFrame, matched: DataFrame, effects: DataFrame, cut: float = 0.05) -> DataFrame:
    """A row for each program from its shell_table over all slices and inside slices, its slice_table and its effect_table: what was tested, how much of it is significant, and the strongest types."""
    sure = lambda c: F.coalesce(F.col(c) < cut, F.lit(False))
    fold = F.when(F.col("valid"), F.col("log2fc"))
    whole = enriched.groupBy("program").agg(
        F.countDistinct("effector").alias("n_effectors_tested"),
        F.count_if(F.col("valid") & sure("q_bh")).alias("n_all_slice_enrichment_sig"),
        F.when(F.count_if("valid") > 0, _first("effector", F.coalesce(-fold, F.lit(float("inf"))))).otherwise("").alias("top_all_slice_enriched_effector"),
        F.when(F.count_if("valid") > 0, _first("effector", F.coalesce(fold, F.lit(float("inf"))))).otherwise("").alias("top_all_slice_depleted_effector"),
    )
    inside = by_slice.groupBy("program").agg(F.countDistinct("slice").alias("n_slices_tested"), F.count_if(sure("q_bh_by_slice")).alias("n_per_slice_enrichment_sig"))
    near = matched.groupBy("program").agg(F.count_if(sure("q_bh_by_slice")).alias("n_per_slice_matched_sig"))
    names = F.array_join(F.array_sort(F.collect_list(F.when(sure("q_bh"), F.col("effector")))), "|")
    pooled = effects.groupBy("program").agg(F.count_if(sure("q_bh")).alias("n_global_matched_sig"), names.alias("global_matched_sig_effectors"))
    return whole.join(inside, "program", "left").join(near, "program", "left").join(pooled, "program", "left")


def program_summary(effects: DataFrame, permuted: DataFrame, targets: DataFrame, cut: float = 0.05, most: int = 12) -> DataFrame:
    """A row for each program of an effect_table: its targets, its significant effectors, the three strongest of either sign, and which effectors the permutations confirm.

    permuted: program, effector, observed, p. Lists are joined by |, the strongest first.
    """
    chosen = significant_effectors(effects, cut, most)
    listed = lambda df, name: df.groupBy("program").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "effector"))), lambda r: r["effector"]), "|").alias(name))
    out = effects.select("program").distinct().join(listed(chosen, "sig_effectors"), "program", "left")
    for name, order in (("pro", F.col("effect").desc()), ("anti", F.col("effect").asc())):
        ranked = effects.where("effect is not null").withColumn("rank", F.row_number().over(Window.partitionBy("program").orderBy(order, "effector"))).where("rank <= 3")
        first = ranked.where("rank = 1").select("program", F.col("effector").alias(f"top_{name}_effector"), F.col("effect").alias(f"top_{name}_effect"))
        out = out.join(listed(ranked, f"{name}_effectors"), "program", "left").join(first, "program", "left")
    passed = permuted.where((F.col("p") < cut) & F.col("observed").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("program").orderBy(F.abs("observed").desc(), "effector")))
    confirmed = listed(passed, "perm_pass_effectors").join(passed.groupBy("program").agg(F.count(F.lit(1)).alias("n_perm_pass")), "program")
    out = out.join(confirmed, "program", "left").fillna(0, ["n_perm_pass"]).fillna("", ["sig_effectors", "pro_effectors", "anti_effectors", "perm_pass_effectors", "top_pro_effector", "top_anti_effector"])
    return out.crossJoin(targets.agg(F.count(F.lit(1)).alias("n_target_cells")))


def near_far_samples(targets: DataFrame, scores: DataFrame, others: DataFrame, near: float = 50.0, far: float = 150.0, cells: int = 10, least: int = 5) -> DataFrame:
    """program, effector, slice, cell, side (near or far), b: the cells behind a pooled comparison, from slices with `cells` targets and `least` of them on either side."""
    d = _measured(targets, scores, others, far).withColumn("side", F.when(F.col("d") <= near, "near").when(F.col("d").isNull(), "far"))
    n = d.groupBy("program", "effector", "slice").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("side") == "near").alias("_a"), F.count_if(F.col("side") == "far").alias("_b"))
    kept = n.where((F.col("_n") >= cells) & (F.col("_a") >= least) & (F.col("_b") >= least)).select("program", "effector", "slice")
    return d.where("side is not null").join(kept, ["program", "effector", "slice"]).select("program", "effector", "slice", "cell", "side", "b")


def violin_effects(targets: DataFrame, scores: DataFrame, others: DataFrame, near: float = 30.0, far: float = 150.0, least: int = 5) -> DataFrame:
    """program, slice, effector, n_near, n_far, difference, p: medians near and far inside a slice with `least` cells of the type and on either side, and their rank-sum test."""
    enough = others.groupBy("slice", F.col("celltype").alias("effector")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    d = _measured(targets, scores, others, far).join(enough, ["slice", "effector"]).withColumn("_near", F.col("d") <= near)
    d = d.where(F.col("d").isNull() | F.col("_near")).withColumn("_near", F.col("d").isNotNull())
    groups = ["program", "slice", "effector"]
    medians = d.groupBy(*groups).agg((F.median(F.when(F.col("_near"), F.col("b"))) - F.median(F.when(~F.col("_near"), F.col("b")))).alias("difference"))
    tests = rank_sum_test(d, "b", F.col("_near"), groups).where((F.col("n1") >= least) & (F.col("n2") >= least))
    return tests.join(medians, groups).select(*groups, F.col("n1").alias("n_near"), F.col("n2").alias("n_far"), "difference", "p")


def downstream(targets: DataFrame, scores: DataFrame, others: DataFrame, near: float = 30.0, far: float = 150.0, inner: float = 20.0, outer: float = 50.0) -> dict[str, DataFrame]:
    """All tables of one target type: effects, significant, all_slices, per_slice, matched, summary."""
    effects = effect_table(targets, scores, others, near, far)
    whole, inside = (shell_table(targets, scores, others, inner, outer, s) for s in (False, True))
    matched = slice_table(targets, scores, others, near, far)
    return {"effects": effects, "significant": significant_effectors(effects), "all_slices": whole, "per_slice": inside, "matched": matched, "summary": downstream_summary(whole, inside, matched, effects)}
