"""Shared intermediate tables: lineage is cut by Parquet files in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder (tests on one machine).
FALLBACK_DIR = "/tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no folder that {master} shares")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/sliceloom/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to a new shared path and read it again; the new plan survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def prefix_for(df: DataFrame) -> str:
    """Underscores that no column of df begins with, for columns of our own beside df's."""
    out = "_"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over the whole table."""
    return int(df.selectExpr(f"sum(cast(octet_length(`{column}`) as bigint)) as n").first()["n"] or 0)
