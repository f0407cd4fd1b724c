"""A sweep over kernel widths: one fit for each setting and side, all in one grouped job, and how programs agree across settings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.operators import benchmark as B
from sliceloom.operators.cells import standardize
from sliceloom.operators.spatial import TASKS, spatial_bandwidth, temporal_bandwidth
from sliceloom.plans.fit import fit_keys, spectral_rows
from sliceloom.sources.tables import written


def widths(cells: DataFrame, sides: list[str], share: float = 0.05) -> DataFrame:
    """side, gap, reach: squared median distances of ages and of k-th neighbours in z-scored slices. A kernel's width is that over |ln rho|, so one estimate a side serves all settings; a few rows."""
    scaled = standardize(cells, {"_zx": "x", "_zy": "y"}, ["slice"]).select("side", "slice", "cell", F.coalesce("_zx", F.lit(0.0)).alias("x"), F.coalesce("_zy", F.lit(0.0)).alias("y"))
    out = []
    for side in sides:
        mine = F.col("side") == side
        slices = cells.where(mine).groupBy("slice").agg(F.min("age").alias("age"))
        gap = temporal_bandwidth(slices, math.exp(-1)).first()["gamma"]
        reach = spatial_bandwidth(scaled.where(mine), share, math.exp(-1)).first()["gamma"]
        out.append((side, float(gap), float(reach)))
    return cells.sparkSession.createDataFrame(out, "side string, gap double, reach double")


def sweep_fits(cells: DataFrame, grid: DataFrame, sides: list[str], p: int = 3, k: int | None = 15, share: float = 0.05) -> DataFrame:
    """setting_id, side, program, gene, weight of every setting of grid (see benchmark.settings) and side.

    cells: side, slice, age, cell, x, y, genes. A slice's kernel is decomposed once for each spatial width, whatever the
    number of temporal ones; each fit is a grouped task. Settings and sides, a few rows, are broadcast.
    """
    wide = grid.crossJoin(widths(cells, sides, share)).withColumns({"gamma_age": F.col("gap") / F.abs(F.ln("temporal_rho")), "gamma": F.col("reach") / F.abs(F.ln("spatial_rho"))})
    wide = written(wide.select("setting_id", "side", "spatial_rho", "gamma", "gamma_age"), "settings")
    spatial = wide.select("side", "spatial_rho", "gamma").distinct()
    key = F.concat_ws("|", "side", F.col("spatial_rho").cast("string"))
    rows = cells.join(F.broadcast(spatial), "side").withColumn("fit", key)
    slices = rows.select("fit", "slice").distinct().count()  # few bytes each and much work: left to the sizes of partitions, many end in one task
    rows = rows.repartition(max(1, min(4 * slices, TASKS)), "fit", "slice")
    spectral = written(spectral_rows(rows.select("fit", "slice", "age", "cell", "x", "y", "genes", "gamma"), None, vectors=False), "spectral")
    fits = F.broadcast(wide.select(key.alias("fit"), F.concat_ws("|", "setting_id", "side").alias("_name"), "gamma_age"))
    named = spectral.join(fits, "fit").drop("fit").withColumnRenamed("_name", "fit")
    found = fit_keys(named.select("fit", *[c for c in named.columns if c != "fit"]), p, k, gamma_age=None, scores=False).where("kind = 'loading'")
    parts = F.split("fit", "\\|")
    return found.select(parts[0].alias("setting_id"), parts[1].alias("side"), F.col("program").cast("string").alias("program"), F.col("key").alias("gene"), F.col("value").alias("weight"))


def sweep(cells: DataFrame, sides: tuple[str, str], p: int = 3, k: int | None = 15) -> dict[str, DataFrame]:
    """settings, loadings, aligned, panels and completion of the whole grid over two sides."""
    grid = B.settings(cells.sparkSession)
    loadings = written(sweep_fits(cells, grid, list(sides), p, k), "loadings")
    aligned = B.baseline_aligned(loadings, grid, *sides)
    return {"settings": grid, "loadings": loadings, "aligned": aligned, "panels": B.panel_summary(aligned), "completion": B.completion(grid, loadings, sides)}
