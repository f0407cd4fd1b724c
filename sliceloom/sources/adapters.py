"""The driver's tables as cells, counts, points and programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, value: absent means 0."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, slice, age, celltype, status of every cell that has counts."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell")).distinct()
    slice_ = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), slice_.alias("slice"), ((slice_ - 7980) * F.lit(3.0)).alias("age"), F.col("o_orderpriority").alias("celltype"), F.col("o_orderstatus").alias("status"))
    return orders.join(cells, "cell", "left_semi")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, slice, age, celltype, region, x, y, b: b is the value centred in its slice."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    rows = e.select(
        F.col("event_id").alias("cell"),
        F.date_format("ts", "yyyy-MM-dd").alias("slice"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).cast("double").alias("age"),
        F.col("event_type").alias("celltype"),
        (F.col("user_id") % 3).cast("long").alias("region"),
        ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))) / F.lit(240.0)).alias("x"),
        F.col("value").alias("y"),
    )
    means = rows.groupBy("slice").agg(F.avg("y").alias("m"))
    return rows.join(means, "slice").withColumn("b", F.col("y") - F.col("m")).drop("m")


def spatial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, slice, age, celltype, x, y, genes (array<double>)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("cell"),
        F.col("label").cast("long").alias("slice"),
        F.col("label").cast("double").alias("age"),
        (F.col("vec_id") % 4).cast("long").alias("celltype"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        F.transform(F.slice("embedding", 3, 62), lambda v: v.cast("double")).alias("genes"),
    )


def long_genes(cells: DataFrame) -> DataFrame:
    return cells.select("cell", "slice", F.posexplode("genes").alias("gene", "value")).withColumn("gene", F.col("gene").cast("long"))


def programs(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """program, gene, weight: mean counts by order status or return flag, weights of a program summing to 1."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if by == "o_orderstatus":
        rows = rows.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = rows.groupBy(F.col(by).alias("program"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("w"))
    whole = sums.groupBy("program").agg(F.sum("w").alias("s"))
    return sums.join(F.broadcast(whole), "program").select("program", "gene", (F.col("w") / F.col("s")).alias("weight"))
