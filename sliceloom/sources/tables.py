"""Readers and writers around the engine: cohorts, wide and long loadings, gene sets, logs, cached results."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_cohorts(frames: Mapping[str, DataFrame], required: Sequence[str] = ("celltype",)) -> DataFrame:
    """Union of tables over their common columns with a literal cohort; rows without a required value (null, '', 'nan', 'None') go."""
    common = [c for c in next(iter(frames.values())).columns if all(c in f.columns for f in frames.values())]
    out = None
    for name, frame in frames.items():
        rows = frame.select(*common).withColumn("cohort", F.lit(name))
        for c in required:
            rows = rows.where(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "nan", "None"))
        out = rows if out is None else out.unionByName(rows)
    return out


def safe_name(c: Column) -> Column:
    """All but letters, digits, '-' and '_' become '_'."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def write_by_type(df: DataFrame, path: str, column: str = "celltype") -> None:
    df.withColumn("part", safe_name(F.col(column))).write.partitionBy("part").parquet(path)


def active_genes(loadings: DataFrame) -> DataFrame:
    """Positive weights, ranked in each program by weight, then gene."""
    order = Window.partitionBy("program").orderBy(F.desc("weight"), "gene")
    return loadings.where("weight > 0").withColumn("rank", F.row_number().over(order))


def to_wide(loadings: DataFrame, genes: Sequence[str]) -> DataFrame:
    return loadings.groupBy("program").pivot("gene", list(genes)).agg(F.first("weight"))


def to_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot("program", [c for c in wide.columns if c != "program"], "gene", "weight").where("weight is not null")


def read_gmt(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """collection, term, gene from gene-set files: name, description and genes separated by tabs."""
    out = None
    for name, path in paths.items():
        fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) > 2")
        rows = fields.select(F.lit(name).alias("collection"), F.col("f")[0].alias("term"), F.explode(F.expr("slice(f, 3, size(f) - 2)")).alias("gene")).where("gene <> ''")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no gene-set files given")
    return out


def append_log(spark: SparkSession, path: str, records: Sequence[Mapping]) -> None:
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in records], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def params_key(params: Mapping) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, params: Mapping, make, refresh: bool = False) -> DataFrame:
    """The table stored under root for these parameters, made once; other parameters have another path."""
    path = f"{root}/{params_key(params)}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().withColumn("params", F.lit(json.dumps(params, sort_keys=True))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mean_loadings(replicates: DataFrame) -> DataFrame:
    """program, gene, weight averaged over replicates."""
    return replicates.groupBy("program", "gene").agg(F.avg("weight").alias("weight"))


def standard_weights(loadings: DataFrame, signed: bool = False, unit: bool = True) -> DataFrame:
    """Absolute values if signed, else negatives as 0; programs scaled to sum 1, empty ones left at 0."""
    w = F.abs("weight") if signed else F.greatest(F.lit(0.0), F.col("weight"))
    rows = loadings.withColumn("weight", w)
    if not unit:
        return rows
    whole = F.sum("weight").over(Window.partitionBy("program"))
    return rows.withColumn("weight", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; in /tmp/checkpoints where that is unset on one machine, as in tests."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir names no folder that {master} shares")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a fresh scratch path, read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_csv(df: DataFrame, path: str) -> None:
    """Gzip-compressed CSV with a header."""
    df.write.option("header", True).option("compression", "gzip").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
