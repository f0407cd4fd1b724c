"""Quality control of whole cohorts: the filters in their order, as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.operators.cells import bbox_area, marker_fraction, qc_metrics, quantiles
from sliceloom.operators.spatial import nearest_within
from sliceloom.sources.tables import written


@dataclass(frozen=True)
class Rules:
    """Limits of a control: least counts and genes, upper quantile of both, band of the box area, and, where given, the upper
    quantile of the anisotropy, the neurons' types, their markers and most share in other cells, and least distance of other cells."""

    celltypes: Sequence[str]
    least_total: float = 40
    least_genes: int = 15
    top: float = 0.999
    low: float = 0.001
    drop_genes: Sequence[str] = ()
    anisotropy: float | None = None
    neurons: Sequence[str] = ()
    markers: Sequence[str] = field(default=())
    most_fraction: float = 0.15
    least_distance: float = 15.0


def slice_key(donor: str, region: str):
    return F.concat_ws("_", F.col(donor).cast("string"), F.col(region).cast("string"))


def _measured(cells: DataFrame, counts: DataFrame) -> DataFrame:
    return cells.join(qc_metrics(counts), "cell", "left").withColumns({"total": F.coalesce(F.col("total").cast("double"), F.lit(0.0)), "n_genes": F.coalesce("n_genes", F.lit(0).cast("long"))})


def control(cells: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame:
    """The cells that pass, with area, total, n_genes (and fraction, the markers' share).

    cells: cell, slice, celltype, x, y, min_x, max_x, min_y, max_y (and anisotropy); counts: cell, gene, value. Types
    and genes are restricted first; all quantiles are taken over what is left then, before any other filter, and
    without missing values, which pass. Then other cells rich in the neurons' markers go, and last those nearer to a neuron
    of their slice than least_distance; neurons stay. Counts are read and shuffled by cell once: what is measured is
    written before the limits, and what passes them before distances, as several steps read each.
    """
    kept = bbox_area(cells.where(F.col("celltype").isin(list(rules.celltypes))))
    counts = counts.where(~F.col("gene").isin(list(rules.drop_genes))) if rules.drop_genes else counts
    rows = _measured(kept, counts)
    if shares := bool(rules.neurons and rules.markers):
        rows = rows.join(marker_fraction(counts, rules.markers), "cell", "left").fillna(0.0, ["fraction"])
    rows = written(rows, "measured")
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    wanted = {c: (F.col(c), rules.top) for c in ("total", "n_genes")} | {n: (real("area"), q) for n, q in (("lo", rules.low), ("hi", rules.top))}
    if rules.anisotropy is not None:
        wanted["a"] = (real("anisotropy"), rules.anisotropy)
    limit = {name: F.lit(v).cast("double") for name, v in quantiles(rows, wanted).items()}
    ok = (F.col("total") >= rules.least_total) & (F.col("total") <= limit["total"]) & (F.col("n_genes") >= rules.least_genes) & (F.col("n_genes") <= limit["n_genes"])
    ok = ok & (real("area").isNull() | (F.abs("area") == float("inf")) | F.col("area").between(limit["lo"], limit["hi"]))
    if rules.anisotropy is not None:
        ok = ok & (real("anisotropy").isNull() | (F.col("anisotropy") <= limit["a"]))
    passed = rows.where(ok)
    if not rules.neurons:
        return passed
    neuron = F.col("celltype").isin(list(rules.neurons))
    passed = written(passed.where(neuron | (F.col("fraction") <= rules.most_fraction)) if shares else passed, "passed")
    near = nearest_within(passed.where(~neuron).select("slice", "cell", "x", "y"), passed.where(neuron), rules.least_distance).where(F.col("d") < rules.least_distance)
    return passed.join(near.select("cell").distinct(), "cell", "left_anti")
