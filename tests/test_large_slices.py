"""Steps that take a slice apart give what the whole matrix gives."""

import numpy as np
from pyspark.sql import functions as F

from sliceloom.operators import labels as L
from sliceloom.operators import spatial as S


def test_labels_without_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (3, 6))
    rows = [(i, 0, (centres[i % 3] + rng.normal(0, 1.2, 6)).tolist()) for i in range(240)]
    cells = spark.createDataFrame(rows, "cell long, slice long, genes array<double>")
    dense = {r["cell"]: r["label"] for r in L.spectral_labels(cells, 3).collect()}
    monkeypatch.setattr(L, "DENSE", 10)
    assert dense == {r["cell"]: r["label"] for r in L.spectral_labels(cells, 3).collect()}
    x = rng.normal(size=(500, 4)).round(1)  # with ties
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert (L._nearest_rows(x, 22) == np.argsort(d, axis=1, kind="stable")[:, :22]).all()


def test_time_gradient_has_no_window(spark, capsys):
    cells = spark.range(1000).select(F.lit("all").alias("slice"), (F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 25).cast("double").alias("y"), F.col("id").cast("double").alias("b"))
    S.time_gradient(cells, "b").explain()
    assert "Window" not in capsys.readouterr().out  # a window over a slice brings all of it into one task
