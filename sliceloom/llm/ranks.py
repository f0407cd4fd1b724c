"""Ranks and running sums inside groups of any size, without one task ever holding a whole group.

Rows of a group are spread over buckets by an order key; bucket totals (one row a bucket, pre-aggregated before
the shuffle) give each bucket its offset, and only rows of one bucket meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.llm.store import save

ROWS_PER_BUCKET = 1024


def hashed_order(*columns: Column) -> Column:
    """A uniform, repeatable order key in [0, 2^31)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 33).cast("long")


def running(df: DataFrame, group: list[str], order: Column, ties: list[Column], weight: Column, rows: int, out: str) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the group that come before this row.

    order must be uniform in [0, 2^31) (see hashed_order); rows of equal order and ties count in any order among
    themselves, so give ties that tell rows apart. rows: rows of df, for the number of buckets.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    keyed = df.withColumn("_order", order).withColumn("_bucket", F.floor(F.col("_order") * F.lit(buckets) / F.lit(2**31)).cast("long")).withColumn("_weight", weight)
    totals = keyed.groupBy(*group, "_bucket").agg(F.sum("_weight").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return ranked.join(offsets, same).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_order", "_bucket", "_weight", "_inside", "_offset", "_b", *[f"_g{i}" for i in range(len(group))])


def name_ranks(rows: DataFrame, column: str, null_last: bool = False) -> DataFrame:
    """name, rank: the distinct values of a column by code point from 0, null first or last. Names are dealt by their order, so no task sorts them all."""
    names = rows.select(F.col(column).alias("name")).distinct()
    order = F.col("name").asc_nulls_last() if null_last else F.col("name").asc_nulls_first()
    dealt = save(names.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "names")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_place", place).join(offsets, F.col("_part") == F.col("_p")).select("name", (F.col("_place") + F.col("_offset")).cast("long").alias("rank"))
