"""Queries for quality control of whole cohorts, label benchmarks by slice and method, and programs across settings; they register beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.operators import benchmark as B
from sliceloom.operators import cells as C
from sliceloom.operators import programs as P
from sliceloom.operators import spatial as S
from sliceloom.operators import trends as T
from sliceloom.plans.control import Rules, control, slice_key
from sliceloom.plans.queries import CELLS, COUNTS, POINTS, PROGRAMS, SPATIAL, query, rounded, slices_of
from sliceloom.plans.sweep import sweep
from sliceloom.sources import adapters as A
from sliceloom.sources import results as K
from sliceloom.sources import tables as IO

# quality control

_PLACED = "placed AS (SELECT o_orderkey AS cell, concat_ws('_', o_custkey % 3, o_orderkey % 2) AS slice, o_orderpriority AS celltype, CAST(o_totalprice % 5000 AS DOUBLE) AS x, CAST(o_custkey % 97 AS DOUBLE) * 10 AS y, 0.0::DOUBLE AS min_x, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / 1000 END AS max_x, 0.0::DOUBLE AS min_y, 1.0::DOUBLE + o_custkey % 7 AS max_y, CASE WHEN o_orderkey % 13 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice % 1000 AS DOUBLE) END AS anisotropy FROM orders)"


def _placed_cells(spark, d) -> DataFrame:
    o = A.table(spark, d, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice").cast("double")
    one = F.lit(0.0)
    return o.select(
        key.alias("cell"), (cust % 3).alias("donor"), (key % 2).alias("region"), F.col("o_orderpriority").alias("celltype"), (F.col("o_totalprice") % 5000).cast("double").alias("x"), ((cust % 97).cast("double") * 10).alias("y"),
        one.alias("min_x"), F.when(key % 11 != 0, price / 1000).alias("max_x"), one.alias("min_y"), (1.0 + cust % 7).cast("double").alias("max_y"),
        F.when(key % 13 == 0, F.lit(float("nan"))).when(key % 17 != 0, (F.col("o_totalprice") % 1000).cast("double")).alias("anisotropy"),
    ).withColumn("slice", slice_key("donor", "region"))


def _control_sql(types: str, drop: str, total: int, genes: int) -> str:
    """SQL of the part that both controls share, as CTE passed."""
    return f"""{COUNTS}, {_PLACED}, kc AS (SELECT * FROM counts WHERE {drop}), kept AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area FROM placed WHERE celltype IN ({types})),
    m AS (SELECT cell, CAST(sum(value) AS DOUBLE) AS total, count(*) FILTER (value > 0) AS n_genes FROM kc GROUP BY 1), r AS (SELECT k.*, coalesce(total, 0) AS total, coalesce(n_genes, 0) AS n_genes FROM kept k LEFT JOIN m USING (cell)),
    q AS (SELECT quantile_cont(total, 0.999) AS qt, quantile_cont(n_genes, 0.999) AS qg, quantile_cont(area, 0.001) AS lo, quantile_cont(area, 0.999) AS hi, quantile_cont(anisotropy, 0.9) FILTER (NOT isnan(anisotropy)) AS qa FROM r),
    passed AS (SELECT r.*, qa FROM r, q WHERE total >= {total} AND total <= qt AND n_genes >= {genes} AND n_genes <= qg AND (area IS NULL OR area BETWEEN lo AND hi))"""


@query(f"WITH {_control_sql("'1-URGENT', '2-HIGH', '5-LOW'", "gene <> 'Brand#11'", 40, 2)} SELECT cell, slice, round(area, 6) AS area, total, n_genes FROM passed")
def qc_control(spark, d):
    """Types and genes restricted, then counts, genes and areas inside their limits."""
    rules = Rules(["1-URGENT", "2-HIGH", "5-LOW"], 40, 2, drop_genes=["Brand#11"])
    return rounded(control(_placed_cells(spark, d), A.counts(spark, d), rules).select("cell", "slice", "area", "total", "n_genes"))


@query(f"""WITH {_control_sql("'1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'", "true", 20, 1)}, p2 AS (SELECT *, celltype = '1-URGENT' AS neuron FROM passed WHERE anisotropy IS NULL OR isnan(anisotropy) OR anisotropy <= qa),
    f AS (SELECT cell, sum(value) FILTER (gene IN ('Brand#22', 'Brand#31')) / sum(value) AS fraction FROM counts GROUP BY 1), p3 AS (SELECT p2.*, coalesce(fraction, 0) AS fraction FROM p2 LEFT JOIN f USING (cell) WHERE neuron OR coalesce(fraction, 0) <= 0.15)
    SELECT cell, slice, round(area, 6) AS area, round(anisotropy, 6) AS anisotropy, total, n_genes, round(fraction, 6) AS fraction FROM p3 a WHERE neuron OR NOT EXISTS (SELECT 1 FROM p3 b WHERE b.neuron AND b.slice = a.slice AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 15)""")
def qc_control_neurons(spark, d):
    """All filters: also anisotropy, the neurons' markers in other cells, and nearness to neurons."""
    rules = Rules(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], 20, 1, anisotropy=0.9, neurons=["1-URGENT"], markers=["Brand#22", "Brand#31"])
    return rounded(control(_placed_cells(spark, d), A.counts(spark, d), rules).select("cell", "slice", "area", "anisotropy", "total", "n_genes", "fraction"))


# labels by slice and method

_LABELS = f"WITH {POINTS}, l AS (SELECT slice, age, cell, celltype AS truth, 'near' AS method, CASE WHEN cell % 4 = 0 THEN 'x' ELSE celltype END AS pred FROM points UNION ALL SELECT slice, age, cell, celltype, 'far', CAST(cell % 3 AS VARCHAR) FROM points UNION ALL SELECT slice, age, cell, celltype, 'region', CAST(region AS VARCHAR) FROM points), c AS (SELECT method, slice, truth AS t, pred AS p, count(*) AS n FROM l GROUP BY 1, 2, 3, 4), lab AS (SELECT method, slice, p, t AS label FROM c QUALIFY row_number() OVER (PARTITION BY method, slice, p ORDER BY n DESC, t) = 1)"
_SCORES = """,
    a AS (SELECT method, slice, sum(x * (x - 1) / 2) AS i, sum(x * ln(x)) AS ea FROM (SELECT method, slice, t, CAST(sum(n) AS DOUBLE) AS x FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2), b AS (SELECT method, slice, sum(x * (x - 1) / 2) AS j, sum(x * ln(x)) AS eb FROM (SELECT method, slice, p, CAST(sum(n) AS DOUBLE) AS x FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
    w AS (SELECT method, slice, CAST(sum(n) AS BIGINT) AS cells, sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS em FROM c GROUP BY 1, 2),
    h AS (SELECT method, slice, c.t, sum(n) AS n, coalesce(sum(n) FILTER (label = c.t), 0) AS tp FROM c JOIN lab USING (method, slice, p) GROUP BY 1, 2, 3), s AS (SELECT method, slice, label AS t, sum(n) AS m FROM c JOIN lab USING (method, slice, p) GROUP BY 1, 2, 3),
    g AS (SELECT method, slice, sum(tp) / sum(n) AS merged_acc, avg(tp / n) AS merged_balanced, avg(2 * tp / (n + coalesce(m, 0))) AS merged_macro_f1 FROM h LEFT JOIN s USING (method, slice, t) GROUP BY 1, 2),
    scores AS (SELECT method, slice, cells, (ij - i * j / (cells * (cells - 1) / 2)) / ((i + j) / 2 - i * j / (cells * (cells - 1) / 2)) AS raw_ari, greatest(0, (ln(cells) + (em - ea - eb) / cells) / ((2 * ln(cells) - (ea + eb) / cells) / 2)) AS raw_nmi, merged_acc, merged_balanced, merged_macro_f1 FROM w JOIN a USING (method, slice) JOIN b USING (method, slice) JOIN g USING (method, slice))"""


def _labels(spark, d) -> DataFrame:
    p = A.points(spark, d)
    row = lambda method, pred: F.struct(F.lit(method).alias("method"), pred.cast("string").alias("pred"))
    said = F.array(row("near", F.when(F.col("cell") % 4 == 0, F.lit("x")).otherwise(F.col("celltype"))), row("far", F.col("cell") % 3), row("region", F.col("region")))
    return p.select("slice", "age", "cell", F.col("celltype").alias("truth"), F.explode(said).alias("s")).select("slice", "age", "cell", "truth", "s.*")


_METRICS = ["raw_ari", "raw_nmi", "merged_acc"]


@query(_LABELS + _SCORES + " SELECT method, slice, cells, round(raw_ari, 6) AS raw_ari, round(raw_nmi, 6) AS raw_nmi, round(merged_acc, 6) AS merged_acc, round(merged_balanced, 6) AS merged_balanced, round(merged_macro_f1, 6) AS merged_macro_f1 FROM scores")
def slice_label_scores(spark, d):
    return rounded(B.evaluate_groups(_labels(spark, d), "truth", "pred", ["method", "slice"], 4))


@query()
def slice_raw_accuracy(spark, d):
    """The best one-to-one naming in every slice and method."""
    return rounded(B.matched_accuracy_groups(_labels(spark, d), "truth", "pred", ["method", "slice"]))


@query(_LABELS + " SELECT method, label, slice, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(1, sum(coalesce(n, 0)) OVER (PARTITION BY method, slice)), 6) AS fraction FROM (SELECT DISTINCT method, slice FROM l) JOIN (VALUES ('click'), ('view'), ('error')) v(label) ON true LEFT JOIN (SELECT method, slice, label, CAST(sum(n) AS BIGINT) AS n FROM c JOIN lab USING (method, slice, p) GROUP BY 1, 2, 3) USING (method, slice, label)")
def layer_proportions(spark, d):
    """Shares of the merged labels among three target labels of each slice."""
    rows = _labels(spark, d)
    named = rows.join(B.merged_labels(B.contingency(rows, "truth", "pred", ["method", "slice"]), ["method", "slice"]).withColumnRenamed("p", "pred"), ["method", "slice", "pred"])
    return rounded(B.proportions(named, "label", ["click", "view", "error"], ["method", "slice"]))


@query(_LABELS + ", k AS (SELECT method, c.t, label AS p, CAST(sum(n) AS BIGINT) AS n FROM c JOIN lab USING (method, slice, p) GROUP BY 1, 2, 3), v AS (SELECT * FROM (VALUES ('click'), ('view'), ('purchase')) v(t)) SELECT method, t, p, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(1, sum(coalesce(n, 0)) OVER (PARTITION BY method, t)), 6) AS fraction FROM (SELECT DISTINCT method FROM l) CROSS JOIN v CROSS JOIN (SELECT t AS p FROM v) LEFT JOIN k USING (method, t, p)")
def layer_confusion(spark, d):
    rows = _labels(spark, d)
    named = rows.join(B.merged_labels(B.contingency(rows, "truth", "pred", ["method", "slice"]), ["method", "slice"]).withColumnRenamed("p", "pred"), ["method", "slice", "pred"])
    return rounded(B.confusion(named, "truth", "label", ["click", "view", "purchase"], ["method"]))


@query(_LABELS + _SCORES + ", o AS (SELECT method, slice, unnest(['raw_ari', 'raw_nmi', 'merged_acc']) AS metric, unnest([raw_ari, raw_nmi, merged_acc]) AS value FROM scores), e AS (SELECT o.method, o.metric, r.value - o.value AS x FROM o JOIN o r ON r.slice = o.slice AND r.metric = o.metric AND r.method = 'near' WHERE o.method <> 'near') SELECT method, metric, count(*) AS pairs, round(avg(x), 6) AS mean, round(median(x), 6) AS median, count(*) FILTER (x > 0) AS better FROM e GROUP BY 1, 2")
def label_deltas(spark, d):
    scores = B.evaluate_groups(_labels(spark, d), "truth", "pred", ["method", "slice"])
    return rounded(B.reference_deltas(B.long_metrics(scores, _METRICS, ["method", "slice"]), "near"))


@query(_LABELS + _SCORES + ", o AS (SELECT method, age, unnest(['raw_ari', 'raw_nmi', 'merged_acc']) AS metric, unnest([raw_ari, raw_nmi, merged_acc]) AS value FROM scores JOIN (SELECT DISTINCT slice, age FROM points) USING (slice)) SELECT method, age, metric, round(avg(value), 6) AS value FROM o GROUP BY 1, 2, 3")
def label_scores_by_age(spark, d):
    rows = _labels(spark, d)
    scores = B.evaluate_groups(rows, "truth", "pred", ["method", "slice", "age"])
    return rounded(B.long_metrics(scores, _METRICS, ["method", "age"]).groupBy("method", "age", "metric").agg(F.avg("value").alias("value")))


# programs across settings

_LOADINGS = "w0 AS (SELECT o_orderpriority AS setting_id, l_returnflag AS side, o_orderstatus AS program, p_brand AS gene, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3, 4), w AS (SELECT *, w / sum(w) OVER (PARTITION BY setting_id, side, program) AS weight FROM w0)"
_PAIRS = """pa AS (SELECT a.setting_id, a.program AS p, b.program AS q, a.weight AS x, b.weight AS y, rank() OVER (PARTITION BY a.setting_id, a.program, b.program ORDER BY a.weight) + (count(*) OVER (PARTITION BY a.setting_id, a.program, b.program, a.weight) - 1) / 2 AS rx, rank() OVER (PARTITION BY a.setting_id, a.program, b.program ORDER BY b.weight) + (count(*) OVER (PARTITION BY a.setting_id, a.program, b.program, b.weight) - 1) / 2 AS ry FROM w a JOIN w b ON a.setting_id = b.setting_id AND a.gene = b.gene AND a.side = 'A' AND b.side = 'R'),
    ps AS (SELECT setting_id, p, q, sum(x * y) / greatest(1e-12, sqrt(sum(x * x) * sum(y * y))) AS cosine, CASE WHEN isfinite(corr(x, y)) THEN corr(x, y) END AS pearson, CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END AS spearman FROM pa GROUP BY 1, 2, 3)"""


def _loadings(spark, d) -> DataFrame:
    """Programs are order statuses, settings priorities, sides return flags."""
    rows = A.table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(A.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = rows.groupBy(F.col("o_orderpriority").alias("setting_id"), F.col("l_returnflag").alias("side"), F.col("o_orderstatus").alias("program"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("w"))
    whole = sums.groupBy("setting_id", "side", "program").agg(F.sum("w").alias("s"))
    return sums.join(whole, ["setting_id", "side", "program"]).select("setting_id", "side", "program", "gene", (F.col("w") / F.col("s")).cast("double").alias("weight"))


def _grid(spark, d) -> DataFrame:
    """A setting for each priority; the first is the baseline, and panels take turns."""
    return A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("setting_id")).distinct().withColumn("panel", F.when(F.substring("setting_id", 1, 1).cast("int") % 2 == 1, "temporal").otherwise("spatial")).withColumn("is_baseline", F.col("setting_id") == "1-URGENT")


@query(f"WITH {_LOADINGS}, {_PAIRS} SELECT setting_id, p, q, round(cosine, 6) AS cosine, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM ps")
def setting_similarity(spark, d):
    w = _loadings(spark, d)
    of = lambda s: w.where(F.col("side") == s).drop("side")
    return rounded(B.pair_metrics(of("A"), of("R"), ["setting_id"]))


@query()
def settings_aligned(spark, d):
    return rounded(B.baseline_aligned(_loadings(spark, d), _grid(spark, d), "A", "R"))


@query()
def panel_summaries(spark, d):
    return rounded(B.panel_summary(B.baseline_aligned(_loadings(spark, d), _grid(spark, d), "A", "R")))


@query(f"WITH {_LOADINGS}, g AS (SELECT DISTINCT o_orderpriority AS setting_id FROM orders) SELECT setting_id, side, n IS NOT NULL AS complete, coalesce(n, 0) AS programs FROM g CROSS JOIN (VALUES ('A'), ('R'), ('missing')) v(side) LEFT JOIN (SELECT setting_id, side, count(DISTINCT program) AS n FROM w GROUP BY 1, 2) USING (setting_id, side)")
def settings_completion(spark, d):
    return B.completion(_grid(spark, d), _loadings(spark, d), ["A", "R", "missing"])


@query(f"WITH {_LOADINGS} SELECT setting_id, side, program, round(sum(weight) OVER (PARTITION BY setting_id, side, program), 6) AS total, true AS sums_to_one, row_number() OVER (PARTITION BY setting_id, side, program ORDER BY weight DESC, gene) AS rank, gene FROM w QUALIFY rank <= 10")
def loading_checks(spark, d):
    return rounded(B.loading_check(_loadings(spark, d), ["setting_id", "side"]))


@query()
def kernel_sweep(spark, d):
    """All 12 settings on both halves of the cells: a fit each, and how the baseline's pairs of programs fare."""
    cells = A.spatial_cells(spark, d).withColumn("side", F.when(F.col("cell") % 2 == 0, "left").otherwise("right"))
    return rounded(sweep(cells, ("left", "right"))["aligned"], 4)


@query(f"WITH {SPATIAL}, n AS (SELECT slice, count(*) AS n FROM sp GROUP BY slice), r AS (SELECT a.slice, a.cell, n, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS r FROM sp a JOIN sp b ON a.slice = b.slice AND a.cell <> b.cell JOIN n ON n.slice = a.slice) SELECT slice, cell, n, CAST(r AS BIGINT) AS k, round(d, 6) AS d FROM r WHERE r = least(greatest(1, ceil(0.1 * n)), n - 1)")
def kth_distances(spark, d):
    return rounded(S.kth_distances(A.spatial_cells(spark, d), 0.1))


# normalisation, kernels and trends


@query(f"WITH {COUNTS}, {CELLS}, n AS (SELECT count(*) AS n FROM cells), s AS (SELECT gene, sum(value) / any_value(n) AS m, sqrt((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1)) AS sd FROM counts, n GROUP BY 1) SELECT cell, gene, round((value - m) / sd, 6) AS z FROM counts JOIN s USING (gene) UNION ALL SELECT NULL, gene, round(-m / sd, 6) FROM s")
def gene_zscores(spark, d):
    """Stored values, and, without a cell, what all others have."""
    stored, zero = C.gene_zscores(A.counts(spark, d), A.count_cells(spark, d))
    return rounded(stored.unionByName(zero.select(F.lit(None).cast("long").alias("cell"), "gene", F.col("zero").alias("z"))))


@query(f"""WITH {COUNTS}, {CELLS}, lib AS (SELECT cell, sum(value) AS total FROM counts GROUP BY cell HAVING sum(value) > 0), t AS (SELECT median(total) AS target FROM lib),
    v AS (SELECT counts.cell, gene, ln(1 + value * least(10, target / total)) AS v FROM counts JOIN lib USING (cell), t), nt AS (SELECT slice, count(*) AS n FROM cells GROUP BY slice),
    m AS (SELECT slice, gene, sum(v) / any_value(n) AS m FROM v JOIN cells USING (cell) JOIN nt USING (slice) GROUP BY slice, gene), c AS (SELECT gene, sum(m) / (SELECT count(*) FROM nt) AS centre FROM m GROUP BY gene)
    SELECT cell, gene, round(v - centre, 6) AS value FROM v JOIN c USING (gene)""")
def balanced_values(spark, d):
    return rounded(C.balanced_values(A.counts(spark, d), A.count_cells(spark, d))[0])


@query(f"""WITH {COUNTS}, {CELLS}, v AS (SELECT cell, gene, ln(1 + value * 250 / sum(value) OVER (PARTITION BY cell)) AS v FROM counts), n AS (SELECT count(*) AS n FROM cells), m AS (SELECT gene, sum(v) / any_value(n) AS m FROM v, n GROUP BY 1), k AS (SELECT slice, count(*) AS n FROM cells GROUP BY 1),
    s AS (SELECT slice, gene, sum(v) AS s FROM v JOIN cells USING (cell) GROUP BY 1, 2) SELECT k.slice, m.gene, round(coalesce(s, 0) / k.n - m, 6) AS mean FROM k CROSS JOIN m LEFT JOIN s ON s.slice = k.slice AND s.gene = m.gene""")
def centred_slice_means(spark, d):
    return rounded(C.centred_counts(A.counts(spark, d), A.count_cells(spark, d)))


@query(f"WITH {COUNTS}, {CELLS}, m AS (SELECT gene, abs(sum(value) / (SELECT count(*) FROM cells)) AS m FROM counts GROUP BY 1) SELECT round(max(m), 6) AS largest, round(avg(m), 6) AS mean, max(m) <= 0.01 AS centred FROM m")
def centering_check(spark, d):
    return rounded(C.centering(A.counts(spark, d), A.count_cells(spark, d)))


@query(f"WITH {SPATIAL} SELECT cell, round((age - min(age) OVER ()) / (max(age) OVER () - min(age) OVER ()), 6) AS age01, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS x01, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 6) AS y01, within FROM sp, (VALUES (true), (false)) v(within) WINDOW w AS (PARTITION BY within, CASE WHEN within THEN slice END)")
def scaled_covariates(spark, d):
    cells = A.spatial_cells(spark, d)
    both = [C.scaled_covariates(cells, w).withColumn("within", F.lit(w)) for w in (True, False)]
    return rounded(both[0].unionByName(both[1]))


@query(f"WITH {CELLS}, s AS (SELECT slice, (age - avg(age) OVER ()) / stddev_samp(age) OVER () AS z FROM (SELECT DISTINCT slice, age FROM cells)) SELECT a.slice AS s1, b.slice AS s2, round(exp(-pow(a.z - b.z, 2) / 0.8) + CASE WHEN a.slice = b.slice THEN 0.001 ELSE 0 END, 6) AS k FROM s a, s b")
def scaled_age_kernel(spark, d):
    return rounded(S.temporal_kernel(slices_of(A.count_cells(spark, d)), "rbf", 0.8, jitter=0.001, scaled=True))


@query(f"WITH {SPATIAL}, z AS (SELECT slice, cell, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS y FROM sp WINDOW w AS (PARTITION BY slice)), d AS (SELECT a.slice, a.cell AS src, b.cell AS dst, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM z a JOIN z b ON a.slice = b.slice AND a.cell <= b.cell) SELECT slice, src, dst, round(1 - d2 / (d2 + 2) + CASE WHEN src = dst THEN 0.01 ELSE 0 END, 6) AS k FROM d")
def scaled_quadratic_kernel(spark, d):
    return S.spatial_kernel(A.spatial_cells(spark, d), 2.0, "quadratic", 0.01, scaled=True, digits=6)


@query()
def kernel_conditions(spark, d):
    """Wide and narrow kernels over the ages."""
    slices = slices_of(A.count_cells(spark, d))
    both = [S.temporal_kernel(slices, "rbf", g, scaled=True).withColumn("gamma", F.lit(g)) for g in (0.01, 4.0)]
    return T.kernel_condition(both[0].unionByName(both[1]), ["gamma"]).select("gamma", "size", "status")


@query()
def smooth_trends(spark, d):
    return rounded(T.smooth_trend(A.points(spark, d), ["celltype"], "age", "y", 30), 4)


@query()
def domain_times(spark, d):
    """Time along paths through the types of cells, in the space of places and genes."""
    cells = A.spatial_cells(spark, d).withColumn("v", F.concat(F.array("x", "y"), "genes"))
    return rounded(T.path_times(cells, "celltype", "v"), 4)


# results and their layouts


@query(f"WITH {PROGRAMS} SELECT 'first' AS method, 3 AS seed, program, gene, round(weight, 6) AS weight FROM pa UNION ALL SELECT 'second', 5, program, gene, round(weight, 6) FROM pb")
def result_store(spark, d):
    """Two results kept with their parameters, and all read in one scan."""
    root = IO.scratch(spark, "results")
    for method, seed, by in (("first", 3, "o_orderstatus"), ("second", 5, "l_returnflag")):
        K.resume(spark, root, [(method, seed)], lambda m, s, by=by: K.save_result(root, m, s, {"by": by}, A.programs(spark, d, by)))
    K.load_result(spark, root, "first", 3, {"by": "o_orderstatus"})
    return rounded(K.load_all(spark, root))


@query(f"WITH {PROGRAMS} SELECT v.layout, layout || '-' || program AS program, gene, round(weight, 6) AS weight FROM pa, (VALUES ('long'), ('wide'), ('transposed'), ('replicates')) v(layout)")
def result_layouts(spark, d):
    """One set of loadings through every layout that a method may leave."""
    w, root = IO.written(A.programs(spark, d, "o_orderstatus"), "programs"), IO.scratch(spark, "layouts")  # read by every layout
    names = lambda df, c: [r[0] for r in df.select(c).distinct().orderBy(c).collect()]
    w.write.parquet(f"{root}/long")
    IO.write_csv(IO.to_wide(w, names(w, "gene")), f"{root}/wide")
    IO.write_csv(w.groupBy("gene").pivot("program", names(w, "program")).agg(F.first("weight")), f"{root}/transposed")
    w.withColumn("replicate", F.explode(F.array(F.lit(-0.5), F.lit(0.5)))).withColumn("weight", F.col("weight") * (1 + F.col("replicate"))).write.parquet(f"{root}/replicates")
    out = None
    for layout in ("long", "wide", "transposed", "replicates"):
        rows = K.load_loadings(spark, f"{root}/{layout}", layout, f"{layout}-").withColumn("layout", F.lit(layout))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


@query(f"WITH {POINTS} SELECT 'type_' || celltype AS cohort, count(*) AS n, round(sum(y), 4) AS total FROM points GROUP BY 1")
def cohort_files(spark, d):
    """A file for each type of cell, read by one path pattern."""
    root, points = IO.scratch(spark, "cohorts"), A.points(spark, d)
    for name in [r[0] for r in points.select("celltype").distinct().collect()]:
        points.where(F.col("celltype") == name).write.parquet(f"{root}/type_{name}.parquet")
    return K.read_cohort_files(spark, f"{root}/type_*.parquet").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query(f"""WITH {PROGRAMS}, v AS (SELECT program, gene, abs(weight * 20 - 0.9) AS v0 FROM pa), k AS (SELECT program, gene, CASE WHEN row_number() OVER (PARTITION BY program ORDER BY v0 DESC, gene) <= greatest(1, ceil(0.2 * count(*) OVER (PARTITION BY program))) THEN v0 ELSE 0 END AS v FROM v),
    r AS (SELECT *, row_number() OVER w AS r, sum(v) OVER w AS cs FROM k WINDOW w AS (PARTITION BY program ORDER BY v DESC, gene)), t AS (SELECT program, max_by((cs - 1) / r, r) AS theta FROM r WHERE v * r > cs - 1 GROUP BY program), u AS (SELECT program, gene, greatest(v - theta, 0) AS u FROM r JOIN t USING (program))
    SELECT program, gene, round(u / sum(u) OVER (PARTITION BY program), 6) AS weight FROM u""")
def absolute_simplex(spark, d):
    return rounded(P.sparsify_absolute(A.programs(spark, d, "o_orderstatus").withColumn("weight", F.col("weight") * 20 - 0.9), 0.2))


@query("SELECT status, round(avg(m), 6) AS mean, count(*) AS buckets FROM (SELECT o_orderstatus AS status, o_orderpriority AS p, o_custkey % 5 AS c, avg(o_totalprice) AS m FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1, 2, 3) GROUP BY 1")
def bucket_means(spark, d):
    """Buckets weigh alike, however many rows they hold; rows without a value are left out."""
    o = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 5).alias("c"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice").cast("double")).alias("v"))
    return rounded(C.bucket_means(o, "v", ["p", "c"], ["status"]))


@query("SELECT o_orderpriority AS priority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_largest(spark, d):
    wide = A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return wide.toDF("priority", "f", "o", "p")
