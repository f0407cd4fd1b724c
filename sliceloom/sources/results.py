"""Fits kept for later: results with their parameters, loaders for the layouts that methods leave behind, cohorts from many files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceloom.operators.robustness import weights_by_correlation
from sliceloom.sources.tables import discard, read_csv, to_long


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _place(root: str, method: str, seed: int) -> str:
    return f"{root.rstrip('/')}/method={method}/seed={seed}"


def save_result(root: str, method: str, seed: int, params: Mapping, loadings: DataFrame, scores: DataFrame | None = None, extra: Mapping | None = None) -> None:
    """Keep loadings (program, gene, weight) and scores of one fit under root, with its parameters and whatever else is to be known.

    The record is written last: a result without one was not finished and counts as missing, whatever files it left.
    """
    path, spark = _place(root, method, seed), loadings.sparkSession
    discard(spark, path)
    loadings.write.parquet(f"{path}/loadings")
    if scores is not None:
        scores.write.parquet(f"{path}/scores")
    record = {"method": method, "seed": seed, "params": dict(params), "extra": dict(extra or {}), "scores": scores is not None}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/record")


def is_complete(spark: SparkSession, root: str, method: str, seed: int) -> bool:
    return exists(spark, f"{_place(root, method, seed)}/record/_SUCCESS")


def load_result(spark: SparkSession, root: str, method: str, seed: int, params: Mapping | None = None, any_params: bool = False) -> tuple[DataFrame, DataFrame | None, dict]:
    """(loadings, scores or None, record) of a finished result; other parameters than `params` are an error unless any_params."""
    if not is_complete(spark, root, method, seed):
        raise FileNotFoundError(f"no finished result of {method} with seed {seed}")
    path = _place(root, method, seed)
    record = json.loads(spark.read.text(f"{path}/record").first()["value"])
    wanted = None if params is None else json.loads(json.dumps(dict(params)))
    if wanted is not None and not any_params and wanted != record["params"]:
        differing = sorted(k for k in {*wanted, *record["params"]} if wanted.get(k) != record["params"].get(k))
        raise ValueError(f"the result of {method} with seed {seed} was made with other parameters: {', '.join(differing)}")
    return spark.read.parquet(f"{path}/loadings"), spark.read.parquet(f"{path}/scores") if record["scores"] else None, record


def resume(spark: SparkSession, root: str, jobs: Iterable[tuple[str, int]], make: Callable[[str, int], None]) -> list[tuple[str, int]]:
    """Run make(method, seed) for the jobs that have no finished result, and tell which they were."""
    left = [j for j in jobs if not is_complete(spark, root, *j)]
    for method, seed in left:
        make(method, seed)
    return left


def load_all(spark: SparkSession, root: str) -> DataFrame:
    """method, seed, program, gene, weight of every result under root, finished or not: one scan over its folders."""
    return spark.read.option("basePath", root).parquet(f"{root.rstrip('/')}/method=*/seed=*/loadings").select("method", F.col("seed").cast("int").alias("seed"), "program", "gene", "weight")


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _wide(spark: SparkSession, path: str, first: str) -> DataFrame:
    names = _header(spark, path)
    return read_csv(spark, path, ", ".join([f"`{first}` string", *[f"`{n}` double" for n in names[1:]]]))


def load_loadings(spark: SparkSession, path: str, layout: str, prefix: str = "") -> DataFrame:
    """program, gene, weight from the layout that a method leaves; program names get a prefix.

    long: Parquet of program, gene, weight. wide: CSV, a row a program and a column a gene. transposed: CSV, a row a gene and
    a column a program. replicates: Parquet with one more column, replicate, averaged. scores: Parquet of program, cell, h
    of values (cell, gene, value) and of cells (cell, slice) in folders scores, values and cells: weights are correlations over slices.
    """
    if layout == "long":
        rows = spark.read.parquet(path).select("program", "gene", "weight")
    elif layout == "wide":
        rows = to_long(_wide(spark, path, "program"))
    elif layout == "transposed":
        rows = _wide(spark, path, "gene")
        rows = rows.unpivot("gene", [c for c in rows.columns if c != "gene"], "program", "weight").where("weight is not null").select("program", "gene", "weight")
    elif layout == "replicates":
        rows = spark.read.parquet(path).groupBy("program", "gene").agg(F.avg("weight").alias("weight"))
    elif layout == "scores":
        values, scores, cells = (spark.read.parquet(f"{path}/{name}") for name in ("values", "scores", "cells"))
        rows = weights_by_correlation(values, scores, cells).where("weight is not null")
    else:
        raise ValueError(f"unknown layout: {layout}")
    return rows.withColumn("program", F.concat(F.lit(prefix), F.col("program").cast("string")))


def read_cohort_files(spark: SparkSession, glob: str, pattern: str = r"([^/]+?)(\.parquet)?/[^/]*$") -> DataFrame:
    """All Parquet files or folders that match a path pattern, with `cohort`, what the regular expression's first group finds in a file's path. One scan; columns that some files lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(glob).withColumn("cohort", F.regexp_extract(F.input_file_name(), pattern, 1))


def in_order(results: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """results scattered back over rows (key, order): a row for each of rows, in ascending order of `order`, null where there is no result. A range sort, so no task holds the table."""
    return rows.select(key, order).join(results, key, "left").orderBy(order)
