"""Exact quantiles without a task that holds a column, and a control whose counts are read once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceloom.operators.cells import quantiles
from sliceloom.plans.control import Rules, control


@pytest.mark.parametrize("sharp", [20, 10000])
def test_quantiles_are_those_of_percentile(spark, sharp):
    """Few distinct values, many, nulls, infinities, one value and none; with a coarse sketch too."""
    rng = np.random.default_rng(8)
    rows = [(float(rng.normal()), int(rng.integers(0, 3)), None if i % 3 else float(i), math.inf if i % 50 == 0 else float(i % 7), 4.0 if i == 5 else None, None) for i in range(3001)]
    frame = spark.createDataFrame(rows, "a double, b long, c double, d double, e double, f double").repartition(5)
    for q in (0.0, 0.001, 0.37, 0.5, 0.9, 0.999, 1.0):
        got = quantiles(frame, {c: (F.col(c), q) for c in frame.columns}, sharp)
        assert got == frame.agg(*[F.percentile(c, F.lit(q)).alias(c) for c in frame.columns]).first().asDict()
    assert quantiles(frame.limit(0), {"a": (F.col("a"), 0.5)}) == {"a": None}


def test_control_reads_its_counts_once(spark):
    """Each of the steps behind the limits read and shuffled all counts again, as the plan was only lazy."""
    cells = spark.range(40).selectExpr("id as cell", "id % 2 as slice", "if(id % 4 = 0, 'n', 'g') as celltype", "double(id) as x", "0.0D as y", "0.0D as min_x", "2.0D as max_x", "0.0D as min_y", "1.0D as max_y")
    counts = spark.range(80).selectExpr("id % 40 as cell", "concat('g', id % 3) as gene", "5.0D as value")
    got = control(cells, counts, Rules(["n", "g"], 1, 1, neurons=["n"], markers=["g0"], most_fraction=1.0, least_distance=3.0))
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["cell"] for r in got.collect()} == {i for i in range(40) if i % 4 != 2}
