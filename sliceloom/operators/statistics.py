"""Tests, corrections and proximity statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.functions.tails import hypergeometric_sf, normal_sf, signed_rank_sf
from sliceloom.operators.programs import average_rank
from sliceloom.operators.spatial import masks_within, nearest_within, shell_counts
from sliceloom.sources.tables import written


def bh(df: DataFrame, p: str, out: str = "q", by: Sequence[str] = (), missing: str = "skip") -> DataFrame:
    """Benjamini-Hochberg inside groups. missing: 'skip' leaves null p out, 'one' counts it as 1."""
    value = F.coalesce(F.col(p), F.lit(1.0)) if missing == "one" else F.col(p)
    rows = df.withColumn("_p", value)
    known = F.col("_p").isNotNull()
    m = F.count("_p").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy("_p"))
    scaled = rows.withColumn("_s", F.when(known, F.col("_p") * m / rank)).withColumn("_r", rank).withColumn("_k", known)
    low = F.min("_s").over(Window.partitionBy(*by, "_k").orderBy(F.desc("_r")))
    return scaled.withColumn(out, F.least(F.lit(1.0), low)).withColumn(out, F.when(F.col("_k"), F.col(out))).drop("_p", "_s", "_r", "_k")


def holm(df: DataFrame, p: str, out: str = "holm", by: Sequence[str] = ()) -> DataFrame:
    known = df.where(F.col(p).isNotNull())
    m = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p))
    stepped = known.withColumn("_s", (m - rank + 1) * F.col(p)).withColumn("_r", rank)
    high = F.max("_s").over(Window.partitionBy(*by).orderBy("_r"))
    done = stepped.withColumn(out, F.least(F.lit(1.0), high)).drop("_s", "_r")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def mann_whitney(df: DataFrame, value: str, first: Column, by: Sequence[str]) -> DataFrame:
    """by, n1, n2, u, z: rows where `first` against the others; z with tie and continuity correction."""
    rows = df.withColumns({"_f": first.cast("int"), "_v": F.col(value)}).withColumns({"_rank": average_rank("_v", *by), "_t": F.count(F.lit(1)).over(Window.partitionBy(*by, "_v"))})
    s = rows.groupBy(*by).agg(F.sum("_f").alias("n1"), F.sum(1 - F.col("_f")).alias("n2"), F.sum(F.col("_rank") * F.col("_f")).alias("r"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.when(sd > 0, (u - mean - F.signum(u - mean) * 0.5) / sd)
    return s.withColumn("u", u).withColumn("z", z).drop("r", "ties")


def wilcoxon(df: DataFrame, difference: str, by: Sequence[str]) -> DataFrame:
    """by, n, w: the rank sum of positive differences, zeros dropped."""
    rows = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference)).withColumn("_r", average_rank("_a", *by))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("_r")).otherwise(0.0)).alias("w"))


def wilcoxon_greater(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """by, pairs, w, p: signed-rank test that a is greater than b, over pairs without nulls or NaN.

    Under two pairs p is null; where all differences are close to 0 it is 1. Up to 50 differences without zeros and ties
    p is exact, else from the normal distribution with the variance of ties; zeros are dropped.
    """
    d = F.col(a).cast("double") - F.col(b).cast("double")
    rows = df.withColumn("_d", d).where(F.col("_d").isNotNull() & ~F.isnan("_d"))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.max(F.abs("_d")).alias("_most"))
    nonzero = rows.where(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    ranked = nonzero.withColumns({"_r": average_rank("_a", *by), "_t": F.count(F.lit(1)).over(Window.partitionBy(*by, "_a"))})
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("_ties"))
    both = whole.join(sums, list(by), "left")
    n = F.col("_n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    exact = (n <= 50) & (F.col("_ties") == 0) & (n == F.col("pairs"))
    p = F.when(F.col("pairs") < 2, None).when(F.col("_most") <= 1e-8, 1.0).when(exact, signed_rank_sf("w", "_n")).otherwise(normal_sf(z))
    return both.select(*by, "pairs", F.coalesce("w", F.lit(0.0)).alias("w"), p.alias("p"))


def paired_summary(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.avg(d).alias("mean"), F.median(d).alias("median"), F.count_if(d > 0).alias("above"), F.count_if(d < 0).alias("below"), F.count_if(d == 0).alias("equal"))


def fisher_greater(df: DataFrame, high: Column, group: str) -> DataFrame:
    """log_odds with p: one-sided exact test that `high` is more frequent inside the group."""
    return log_odds(df, high, group).withColumn("p", hypergeometric_sf("a", F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")))


def log_odds(df: DataFrame, high: Column, group: str) -> DataFrame:
    """group, a, b, c, d, log2 odds of high inside the group against outside: infinite as 5, clipped to [-4, 5]."""
    n = df.withColumn("_h", high.cast("int")).groupBy(group).agg(F.sum("_h").alias("a"), F.sum(1 - F.col("_h")).alias("b"))
    whole = df.agg(F.sum(high.cast("int")).alias("h"), F.sum(1 - high.cast("int")).alias("l"))
    rows = n.crossJoin(F.broadcast(whole)).select(group, "a", "b", (F.col("h") - F.col("a")).alias("c"), (F.col("l") - F.col("b")).alias("d"))
    zero = (F.col("b") == 0) | (F.col("c") == 0)
    value = F.when(zero, 5.0).when((F.col("a") == 0) | (F.col("d") == 0), -4.0).otherwise(F.greatest(F.lit(-4.0), F.least(F.lit(5.0), F.log2(F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))))))
    return rows.withColumn("log2_odds", value)


def block_effects(cells: DataFrame, value: str, near: Column, far: Column, by: Sequence[str], least: int = 8) -> DataFrame:
    """by, nn, nf, effect, weight: median near minus median far, weighted by inverse variance, where both sides have `least` cells."""
    n, f = F.when(near, F.col(value)), F.when(far, F.col(value))
    s = cells.groupBy(*by).agg(F.count(n).alias("nn"), F.count(f).alias("nf"), F.median(n).alias("mn"), F.median(f).alias("mf"), F.var_samp(n).alias("vn"), F.var_samp(f).alias("vf")).where((F.col("nn") >= least) & (F.col("nf") >= least))
    return s.select(*by, "nn", "nf", (F.col("mn") - F.col("mf")).alias("effect"), (1 / (F.col("vn") / F.col("nn") + F.col("vf") / F.col("nf") + 1e-9)).alias("weight"))


def pooled(effects: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inverse-variance pooling: by, blocks, effect, se, z."""
    s = effects.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), (F.sum(F.col("weight") * F.col("effect")) / F.sum("weight")).alias("effect"), (1 / F.sqrt(F.sum("weight"))).alias("se"))
    return s.withColumn("z", F.col("effect") / F.col("se"))


def matched_effects(targets: DataFrame, others: DataFrame, value: str, near: float = 30.0, far: float = 150.0, least: int = 8, block: str = "slice", by: Sequence[str] = ()) -> DataFrame:
    """other_type (and by), blocks, effect, se, z of being near a type against far, pooled over blocks. All types share one distance join."""
    d = nearest_within(targets, others, far)
    blocks = block_effects(d, value, F.col("d") <= near, F.col("d").isNull(), [*by, "other_type", block], least)
    return pooled(blocks, [*by, "other_type"])


def slice_effects(targets: DataFrame, others: DataFrame, value: str, near: float, far: float, least: int = 8, mode: str = "corrected") -> DataFrame:
    """slice, other_type, effect, se, z. mode 'weight' gives the weight itself as se, as older analyses did."""
    d = nearest_within(targets, others, far)
    blocks = block_effects(d, value, F.col("d") <= near, F.col("d").isNull(), ["slice", "other_type"], least)
    se = F.col("weight") if mode == "weight" else 1 / F.sqrt("weight")
    return blocks.withColumn("se", se).withColumn("z", F.col("effect") / F.col("se")).drop("weight")


def distance_decay(targets: DataFrame, others: DataFrame, value: str, edges: Sequence[float] = (0, 25, 50, 100, 200), reference: float = 300.0, least: int = 8) -> DataFrame:
    """other_type, band (lo, hi], effect, se, z against cells beyond the reference distance."""
    d = nearest_within(targets, others, reference)
    bands = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(edges, edges[1:], strict=False)])
    rows = d.select("slice", "other_type", value, "d", F.explode(bands).alias("band")).select("slice", "other_type", value, "d", "band.*")
    blocks = block_effects(rows, value, (F.col("d") > F.col("lo")) & (F.col("d") <= F.col("hi")), F.col("d").isNull(), ["other_type", "lo", "hi", "slice"], least)
    return pooled(blocks, ["other_type", "lo", "hi"])


def shell_enrichment(targets: DataFrame, others: DataFrame, value: str, inner: float, outer: float, by: Sequence[str] = (), least: int = 30) -> DataFrame:
    """other_type, hi, lo, log2 ratio, u, z: shell counts around the upper quarter of cells against the lower."""
    w = targets.groupBy(*by) if by else targets.groupBy()
    q = w.agg(F.percentile(value, F.lit(0.75)).alias("q3"), F.percentile(value, F.lit(0.25)).alias("q1"))
    marked = targets.join(F.broadcast(q), list(by)) if by else targets.crossJoin(F.broadcast(q))
    marked = marked.where((F.col(value) >= F.col("q3")) | (F.col(value) <= F.col("q1"))).withColumn("high", F.col(value) >= F.col("q3"))
    n = shell_counts(marked, others, inner, outer).join(marked.select("cell", "high"), "cell")
    keys = [*by, "other_type"] if not by or "slice" in by else ["other_type"]
    s = n.groupBy(*keys).agg(F.count_if("high").alias("nh"), F.count_if(~F.col("high")).alias("nl"), F.avg(F.when(F.col("high"), F.col("n"))).alias("hi"), F.avg(F.when(~F.col("high"), F.col("n"))).alias("lo"))
    test = mann_whitney(n, "n", F.col("high"), keys).drop("n1", "n2")
    return s.join(test, keys).where((F.col("nh") >= least) & (F.col("nl") >= least)).withColumn("log2_ratio", F.log2((F.col("hi") + 0.05) / (F.col("lo") + 0.05)))


#: Draws in a word of bits.
WORD = 64


def _drawn(others: DataFrame, kind: str, draws: int, seed: int) -> DataFrame:
    """others' slice, cell, x, y, and _d0, _d1, ...: bits of the draws that a cell is in, for the slices that have the type.

    A draw is the n smallest hashes of a slice, n its cells of the type. The n-th one is sought between n - 10 sqrt(n) - 50
    and n + 10 sqrt(n) + 50 expected hashes, and only those are shuffled and ranked; it lies elsewhere with a chance below
    1e-12. Then every cell tells its draws from the last hash and cell of each.
    """
    sizes = others.groupBy("slice").agg(F.count_if(F.col("celltype") == kind).alias("n"), F.count(F.lit(1)).alias("of")).where("n > 0")
    spare = 10 * F.sqrt("n") + 50
    bounds = sizes.select("slice", "n", ((F.col("n") - spare) / F.col("of")).alias("low"), ((F.col("n") + spare) / F.col("of")).alias("high"))
    hashed = lambda draw, cell: F.xxhash64(F.lit(seed), draw, cell)
    pool = others.select("slice", "cell").join(bounds, "slice").crossJoin(F.broadcast(others.sparkSession.range(draws).withColumnRenamed("id", "draw")))
    pool = pool.withColumn("hash", hashed(F.col("draw"), F.col("cell"))).withColumn("at", F.col("hash") / 2.0**64 + 0.5)
    sure = pool.where("at < low").groupBy("draw", "slice").agg(F.count(F.lit(1)).alias("sure"))
    ranked = pool.where("at >= low and at <= high").withColumn("r", F.row_number().over(Window.partitionBy("draw", "slice").orderBy("hash", "cell")))
    last = ranked.join(sure, ["draw", "slice"], "left").where(F.col("r") == F.col("n") - F.coalesce("sure", F.lit(0)))
    word = lambda k: F.collect_list(F.when(F.floor(F.col("draw") / WORD) == k, F.struct("draw", "hash", "cell"))).alias(f"_l{k}")
    words = range(-(-draws // WORD))
    limits = written(last.groupBy("slice").agg(*[word(k) for k in words]), "draws")

    def bit(t: Column) -> Column:
        h = hashed(t["draw"], F.col("cell"))
        in_ = (h < t["hash"]) | ((h == t["hash"]) & (F.col("cell") <= t["cell"]))
        return F.when(in_, F.call_function("shiftleft", F.lit(1).cast("long"), (t["draw"] % WORD).cast("int"))).otherwise(F.lit(0).cast("long"))

    return others.select("slice", "cell", "x", "y").join(limits, "slice").select("slice", "cell", "x", "y", *[F.aggregate(f"_l{k}", F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(bit(t))).alias(f"_d{k}") for k in words])


def permutation_null(targets: DataFrame, others: DataFrame, kind: str, value: str, near: float, far: float, draws: int = 100, seed: int = 0, least: int = 8, add_one: bool = False) -> DataFrame:
    """observed, p, sd: the pooled effect of a type against that of as many cells of each slice drawn by a hash.

    All draws meet the targets at once, as bits of the cells around them; a row for each target and draw is made only
    inside tasks, and only draws of a slice with `least` targets near and far come to the medians.
    """
    of_kind = others.where(F.col("celltype") == kind)
    observed = matched_effects(targets, of_kind, value, near, far, least)
    words = range(-(-draws // WORD))
    drawn = _drawn(others, kind, draws, seed)
    there = of_kind.where("slice is not null").select("slice").distinct()
    met = written(masks_within(targets.join(there, "slice", "left_semi").select("slice", "cell", "x", "y", value), drawn, [f"_d{k}" for k in words], near, far).select("slice", value, *[f"{c}_{k}" for c in ("near", "far") for k in words]), "draws-met")

    def told(df: DataFrame) -> DataFrame:
        """A row for each target and draw."""
        rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        bit = lambda c: F.call_function("shiftright", F.element_at(F.array(*[F.col(f"{c}_{k}") for k in words]), F.floor(F.col("draw") / WORD).cast("int") + 1), F.col("draw") % WORD).bitwiseAND(F.lit(1).cast("long")) == 1
        return rows.select("slice", "draw", value, bit("near").alias("_near"), (~bit("far")).alias("_far"))

    there = F.col(value).isNotNull()
    enough = told(met).groupBy("slice", "draw").agg(F.count_if(F.col("_near") & there).alias("nn"), F.count_if(F.col("_far") & there).alias("nf")).where((F.col("nn") >= least) & (F.col("nf") >= least))
    enough = written(enough.groupBy("slice").agg(F.collect_set("draw").alias("_enough")), "draws-enough")
    rows = told(met.join(enough.select("slice"), "slice", "left_semi")).where("_near or _far").join(enough, "slice").where(F.array_contains("_enough", F.col("draw")))
    null = pooled(block_effects(rows, value, F.col("_near"), F.col("_far"), ["draw", "slice"], least), ["draw"])
    extra = 1 if add_one else 0
    both = null.select(F.col("effect").alias("e")).crossJoin(F.broadcast(observed.select(F.col("effect").alias("observed"))))
    return both.groupBy("observed").agg(((F.count_if(F.abs("e") >= F.abs("observed")) + extra) / (F.count(F.lit(1)) + extra)).alias("p"), F.stddev_pop("e").alias("sd"))


def variance_partition(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, r2_age, r2_region, r2_both, unique_age, unique_region, shared, residual of value ~ age + region; null under 5 rows or 2 regions."""
    inner = [*by, "region"]
    w = Window.partitionBy(*inner)
    rows = df.withColumns({"_y": F.col(value) - F.avg(value).over(w), "_x": F.col("age") - F.avg("age").over(w), "_g": F.avg(value).over(w) - F.avg(value).over(Window.partitionBy(*by))})
    s = rows.groupBy(*by).agg(F.regr_r2(value, "age").alias("r2_age"), F.sum(F.pow("_g", F.lit(2))).alias("ssb"), (F.var_pop(value) * F.count(F.lit(1))).alias("sst"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.count(F.lit(1)).alias("n"), F.countDistinct("region").alias("k"))
    s = s.withColumn("r2_region", F.col("ssb") / F.col("sst")).withColumn("r2_both", (F.col("ssb") + F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))) / F.col("sst"))
    ok = (F.col("n") >= 5) & (F.col("k") >= 2)
    clamp = lambda c: F.when(ok, F.greatest(F.lit(0.0), c))
    ua, ur = F.col("r2_both") - F.col("r2_region"), F.col("r2_both") - F.col("r2_age")
    return s.select(*by, clamp(F.col("r2_age")).alias("r2_age"), clamp(F.col("r2_region")).alias("r2_region"), clamp(F.col("r2_both")).alias("r2_both"), clamp(ua).alias("unique_age"), clamp(ur).alias("unique_region"), clamp(F.col("r2_age") + F.col("r2_region") - F.col("r2_both")).alias("shared"), clamp(1 - F.col("r2_both")).alias("residual"))
