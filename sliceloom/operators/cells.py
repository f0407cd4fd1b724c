"""Quality control, normalisation and summaries of cells and counts. Long tables leave zeros out; every mean here counts them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qc_metrics(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"))


def quantile_filter(metrics: DataFrame, least_total: float, least_genes: float, top: float = 0.999, band: str | None = None, low: float = 0.001) -> DataFrame:
    """Cells between fixed minima and upper quantiles; `band`, if given, between its quantiles, or null or NaN."""
    limits = [F.percentile("total", F.lit(top)).alias("_t"), F.percentile("n_genes", F.lit(top)).alias("_g")]
    if band:
        value = F.when(~F.isnan(band), F.col(band))
        limits += [F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(top)).alias("_hi")]
    kept = metrics.crossJoin(F.broadcast(metrics.agg(*limits))).where((F.col("total") >= least_total) & (F.col("total") <= F.col("_t")) & (F.col("n_genes") >= least_genes) & (F.col("n_genes") <= F.col("_g")))
    if band:
        kept = kept.where(F.col(band).isNull() | F.isnan(band) | F.col(band).between(F.col("_lo"), F.col("_hi")))
    return kept.select(*metrics.columns)


#: Ranks that a quantile's sketch may be off by, as a part of the rows; so many of them around a rank are sorted.
SHARP = 10000


def quantiles(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]], sharp: int = SHARP) -> dict[str, float | None]:
    """The exact quantile of each column at its share, between two ranks by their distance, nulls left out; None without values.

    A sketch tells two values around each rank. What is below them is counted, and only the distinct values between them
    are put in order, so no task holds a column. A rank that lies elsewhere, which the counts tell, gets percentile().
    """
    value = {name: c.cast("double") for name, (c, _) in wanted.items()}
    share = {name: q for name, (_, q) in wanted.items()}
    ends = lambda q: F.array(F.lit(max(0.0, q - 3 / sharp)), F.lit(min(1.0, q + 3 / sharp)))
    first = rows.agg(*[f.alias(n + name) for name, v in value.items() for n, f in (("n_", F.count(v)), ("e_", F.percentile_approx(v, ends(share[name]), F.lit(sharp))))]).first()
    held = {name: first["e_" + name] for name in value if first["n_" + name]}
    if not held:
        return dict.fromkeys(value)
    below = rows.agg(*[F.count_if(value[name] < F.lit(low)).alias(name) for name, (low, _) in held.items()]).first()
    near = F.array(*[F.when(value[name].between(F.lit(low), F.lit(high)), F.struct(F.lit(name).alias("name"), value[name].alias("v"))) for name, (low, high) in held.items()])
    inside = rows.select(F.explode(F.array_compact(near)).alias("r")).groupBy("r.name", "r.v").agg(F.count(F.lit(1)).alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("name").orderBy("v")))
    place = {name: (first["n_" + name] - 1) * share[name] for name in held}
    ranks = [F.create_map(*[F.lit(v) for name in held for v in (name, int(f(place[name])) - below[name])])[F.col("name")] for f in (math.floor, math.ceil)]
    met = inside.where(ranks[0] >= 0).groupBy("name").agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))).alias(c) for c, r in zip(("low", "high"), ranks, strict=True)])
    found = {r["name"]: (r["low"], r["high"]) for r in met.collect()}
    out: dict[str, float | None] = dict.fromkeys(value)
    for name in held:
        low, high = found.get(name, (None, None))
        if low is None or high is None:
            out[name] = rows.agg(F.percentile(value[name], F.lit(share[name]))).first()[0]
        else:
            over = place[name] - math.floor(place[name])
            out[name] = low if low == high or not over else (math.ceil(place[name]) - place[name]) * low + over * high
    return out


def exclude_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that match every column of a row of keys go."""
    return df.join(keys, keys.columns, "left_anti")


def exclude_ages(df: DataFrame, ages: Sequence[float]) -> DataFrame:
    """Rows of these ages go; values that are no number stay."""
    return df.where(~F.coalesce(F.expr("try_cast(age as double)").isin([float(a) for a in ages]), F.lit(False)))


def marker_fraction(counts: DataFrame, markers: Sequence[str]) -> DataFrame:
    """cell, fraction of its counts in the markers; 0 for an empty cell."""
    sums = counts.groupBy("cell").agg(F.sum(F.when(F.col("gene").isin(list(markers)), F.col("value")).otherwise(0.0)).alias("m"), F.sum("value").alias("t"))
    return sums.select("cell", F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0).alias("fraction"))


def bbox_area(df: DataFrame) -> DataFrame:
    return df.withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))


def age_bin(age: Column) -> Column:
    return F.when(age < 12, "young").when(age < 24, "middle").when(age.isNotNull(), "old")


def stars(p: Column, label: str = "ns") -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(label)


def median_age_split(slices: DataFrame) -> DataFrame:
    middle = slices.select("age").distinct().agg(F.median("age").alias("_m"))
    return slices.crossJoin(F.broadcast(middle)).withColumn("half", F.when(F.col("age") < F.col("_m"), "Young").otherwise("Old")).drop("_m")


def library_normalize(counts: DataFrame, target: float = 1e4, eps: float = 1e-12) -> DataFrame:
    """Values scaled so that each cell sums to target."""
    whole = F.sum("value").over(Window.partitionBy("cell"))
    return counts.withColumn("value", F.col("value") * target / F.greatest(whole, F.lit(eps)))


def log1p_normalize(counts: DataFrame, target: float = 250.0) -> DataFrame:
    return library_normalize(counts, target).withColumn("value", F.log1p("value"))


def slice_means(values: DataFrame, cells: DataFrame) -> DataFrame:
    """slice, gene, mean over all cells of the slice."""
    sizes = cells.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    sums = values.join(cells.select("cell", "slice"), "cell").groupBy("slice", "gene").agg(F.sum("value").alias("s"))
    return sums.join(F.broadcast(sizes), "slice").select("slice", "gene", (F.col("s") / F.col("n")).alias("mean"))


def gene_moments(values: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, mean, sd (n - 1; under 1e-12 counts as 1) over all cells."""
    n = cells.agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    rows = sums.crossJoin(F.broadcast(n)).select("gene", (F.col("s") / F.col("n")).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    sd = F.sqrt(F.greatest(F.col("v"), F.lit(0.0)))
    return rows.select("gene", "mean", F.when(sd < 1e-12, 1.0).otherwise(sd).alias("sd"))


def demean(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Dense values minus the mean of their gene over all cells."""
    grid = cells.select("cell").crossJoin(F.broadcast(gene_moments(values, cells)))
    return grid.join(values, ["cell", "gene"], "left").select("cell", "gene", (F.coalesce("value", F.lit(0.0)) - F.col("mean")).alias("value"))


def balanced_centres(counts: DataFrame, cells: DataFrame, most: float = 10.0) -> DataFrame:
    """gene, centre: the unweighted mean over slices of means of log1p(scaled counts), scaled to the median library by at most `most`."""
    library = qc_metrics(counts).where("total > 0")
    target = library.agg(F.median("total").alias("target"))
    scaled = counts.join(library, "cell").crossJoin(F.broadcast(target)).select("cell", "gene", F.log1p(F.col("value") * F.least(F.lit(most), F.col("target") / F.col("total"))).alias("value"))
    slices = cells.select("slice").distinct().agg(F.count(F.lit(1)).alias("n"))
    sums = slice_means(scaled, cells).groupBy("gene").agg(F.sum("mean").alias("s"))
    return sums.crossJoin(F.broadcast(slices)).select("gene", (F.col("s") / F.col("n")).alias("centre"))


def standardize(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add z-scores (n - 1), name -> column, inside groups."""
    w = Window.partitionBy(*by)
    return df.withColumns({name: (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w) for name, c in columns.items()})


def minmax(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add columns scaled to [0, 1] inside groups; a column without range raises on use."""
    w, out = Window.partitionBy(*by), {}
    for name, c in columns.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        out[name] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.raise_error(F.lit(f"{c} has no range")).cast("double"))
    return df.withColumns(out)


def centre_by_median(df: DataFrame) -> DataFrame:
    """Slices centred on their median place and scaled by the 95th percentile radius, else the largest, else 1."""
    middle = df.groupBy("slice").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    moved = df.join(F.broadcast(middle), "slice").withColumns({"xc": F.col("x") - F.col("mx"), "yc": F.col("y") - F.col("my")})
    radius = moved.groupBy("slice").agg(F.percentile(F.hypot("xc", "yc"), F.lit(0.95)).alias("r"), F.max(F.hypot("xc", "yc")).alias("m"))
    scale = F.when(F.col("r") > 0, F.col("r")).when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    return moved.join(F.broadcast(radius), "slice").withColumns({"xn": F.col("xc") / scale, "yn": F.col("yc") / scale}).drop("mx", "my", "xc", "yc", "r", "m")


def dot_plot(values: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, age, mean, expressed share, z of the mean across ages (population, + 1e-12)."""
    ages = cells.groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    sums = values.join(cells.select("cell", "age"), "cell").groupBy("gene", "age").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    rows = sums.join(F.broadcast(ages), "age").select("gene", "age", (F.col("s") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("expressed"))
    w = Window.partitionBy("gene")
    return rows.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / (F.stddev_pop("mean").over(w) + 1e-12))


def abundance(cells: DataFrame) -> DataFrame:
    """slice, celltype, n, with zeros for types that a slice lacks."""
    frame = cells.select("slice").distinct().crossJoin(F.broadcast(cells.select("celltype").distinct()))
    return frame.join(cells.groupBy("slice", "celltype").agg(F.count(F.lit(1)).alias("n")), ["slice", "celltype"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n and its share of the row."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def program_scores(values: DataFrame, loadings: DataFrame, moments: DataFrame, cells: DataFrame) -> DataFrame:
    """program, age, score: mean over cells of the sum of weight * (value - gene mean)."""
    ages = cells.groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    parts = values.join(cells.select("cell", "age"), "cell").groupBy("age", "gene").agg(F.sum("value").alias("s"))
    weighted = ages.crossJoin(F.broadcast(loadings.join(moments, "gene"))).join(parts, ["age", "gene"], "left")
    return weighted.groupBy("program", "age").agg(F.sum(F.col("weight") * (F.coalesce("s", F.lit(0.0)) / F.col("n") - F.col("mean"))).alias("score"))


def silverman(values: DataFrame) -> DataFrame:
    """One row: the median over genes of 0.9 min(sd, IQR / 1.34) n^-0.2, positive ones only, over the values given."""
    per = values.groupBy("gene").agg(F.stddev_samp("value").alias("sd"), (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"), F.count("value").alias("n"))
    bandwidth = 0.9 * F.least(F.col("sd"), F.col("iqr") / 1.34) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return per.select(bandwidth.alias("h")).where("h > 0 and not isnan(h)").agg(F.median("h").alias("bandwidth"))


def set_score(counts: DataFrame, cells: DataFrame, genes: Sequence[str]) -> DataFrame:
    """cell, score: the mean over a set's genes that are present of z-scores over all cells (ddof 0; a constant gene's spread is 1).

    Names match without regard to case. Absent counts are 0: their z-scores are summed once, not for each cell.
    """
    rows = counts.where(F.upper("gene").isin([g.upper() for g in genes]))
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    sums = rows.join(cells.select("cell"), "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(n))
    mu = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0)))
    stats = sums.select("gene", mu.alias("mu"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd"))
    zero = stats.agg(F.sum(-F.col("mu") / F.col("sd")).alias("z"), F.count(F.lit(1)).alias("g"))
    scaled = rows.join(F.broadcast(stats), "gene").groupBy("cell").agg(F.sum(F.col("value") / F.col("sd")).alias("v"))
    return cells.select("cell").join(scaled, "cell", "left").crossJoin(F.broadcast(zero)).select("cell", ((F.coalesce("v", F.lit(0.0)) + F.col("z")) / F.col("g")).alias("score"))


def demeaned_slice_means(values: DataFrame, cells: DataFrame) -> DataFrame:
    """slice, gene, mean of values minus their gene's mean over all cells. Zeros are counted, not made: the work follows the stored values, and the result has a row for each slice and gene."""
    n = cells.agg(F.count(F.lit(1)).alias("_n"))
    whole = values.join(cells.select("cell"), "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("_s")).crossJoin(n).select("gene", (F.col("_s") / F.col("_n")).alias("_m"))
    frame = cells.select("slice").distinct().crossJoin(whole)
    return frame.join(slice_means(values, cells), ["slice", "gene"], "left").select("slice", "gene", (F.coalesce("mean", F.lit(0.0)) - F.col("_m")).alias("mean"))


def gene_zscores(values: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, gene, z of the stored values; gene, zero, the z of every value that is not stored): columns scaled by mean and sd over all cells, n - 1, an sd under 1e-12 as 1."""
    moments = gene_moments(values, cells)
    stored = values.join(moments, "gene").select("cell", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    return stored, moments.select("gene", (-F.col("mean") / F.col("sd")).alias("zero"))


def balanced_values(counts: DataFrame, cells: DataFrame, most: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(cell, gene, value of the stored counts; gene, centre): log1p of counts scaled to the median library by at most `most`, minus the centre; a count that is not stored has minus the centre."""
    library = qc_metrics(counts).where("total > 0")
    target = library.agg(F.median("total").alias("_target"))  # one row
    scale = F.least(F.lit(most), F.col("_target") / F.col("total"))
    centres = balanced_centres(counts, cells, most)
    scaled = counts.join(library, "cell").crossJoin(target).withColumn("value", F.log1p(F.col("value") * scale))
    return scaled.join(centres, "gene").select("cell", "gene", (F.col("value") - F.col("centre")).alias("value")), centres


def centred_counts(counts: DataFrame, cells: DataFrame, target: float = 250.0) -> DataFrame:
    """slice, gene, mean of counts scaled to `target` a cell, logged and minus their gene's mean: what centred inputs look like, slice by slice."""
    return demeaned_slice_means(log1p_normalize(counts, target), cells)


def centering(values: DataFrame, cells: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """One row: the largest and the mean absolute gene mean over all cells, and whether the largest is within tolerance."""
    n = cells.agg(F.count(F.lit(1)).alias("_n"))
    means = values.groupBy("gene").agg(F.sum("value").alias("_s")).crossJoin(n).select(F.abs(F.col("_s") / F.col("_n")).alias("_m"))
    return means.agg(F.max("_m").alias("largest"), F.avg("_m").alias("mean")).withColumn("centred", F.col("largest") <= tolerance)


def standard_ages(slices: DataFrame) -> DataFrame:
    """slices with z, the z-score (n - 1) of age over them; 0 where there are fewer than two or all are alike."""
    moments = slices.agg(F.count("age").alias("_n"), F.avg("age").alias("_m"), F.stddev_samp("age").alias("_s"))
    z = F.when((F.col("_n") < 2) | F.isnan("_s") | (F.col("_s") < 1e-12), 0.0).otherwise((F.col("age") - F.col("_m")) / F.col("_s"))
    return slices.crossJoin(moments).select(*slices.columns, z.alias("z"))


def scaled_covariates(cells: DataFrame, within: bool = False) -> DataFrame:
    """cell, age01, x01, y01: ages scaled to [0, 1] over all cells, places over all or (within) over their slice; a column without range raises."""
    rows = minmax(cells, {"age01": "age"})
    return minmax(rows, {"x01": "x", "y01": "y"}, ["slice"] if within else []).select("cell", "age01", "x01", "y01")


def bucket_means(df: DataFrame, value: str, buckets: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, mean, buckets: the mean over buckets of their means, each weighing alike; rows without a value are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(*by, *buckets).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("buckets"))
