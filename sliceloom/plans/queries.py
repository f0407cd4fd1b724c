"""One query for each operator over the driver's tables, with the SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceloom.functions.tails import hypergeometric_sf, normal_two_sided, t_two_sided
from sliceloom.functions.text import clean_term, program_label
from sliceloom.operators import cells as C
from sliceloom.operators import labels as L
from sliceloom.operators import programs as P
from sliceloom.operators import robustness as R
from sliceloom.operators import spatial as S
from sliceloom.operators import statistics as T
from sliceloom.plans import fit as M
from sliceloom.plans import spread as MS
from sliceloom.plans import simulate as Z
from sliceloom.plans import synthetic as Y
from sliceloom.sources import adapters as A
from sliceloom.sources import tables as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COUNTS = "counts AS (SELECT l_orderkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
CELLS = "cells AS (SELECT o_orderkey AS cell, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS slice, CAST((year(o_orderdate) * 4 + quarter(o_orderdate) - 1 - 7980) * 3 AS DOUBLE) AS age, o_orderpriority AS celltype, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
POINTS = "raw AS (SELECT event_id AS cell, strftime(ts, '%Y-%m-%d') AS slice, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS age, event_type AS celltype, CAST(user_id % 3 AS BIGINT) AS region, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) / 240 AS x, value AS y FROM events), points AS (SELECT *, y - avg(y) OVER (PARTITION BY slice) AS b FROM raw)"
SPATIAL = "sp AS (SELECT vec_id AS cell, CAST(label AS BIGINT) AS slice, CAST(label AS DOUBLE) AS age, CAST(vec_id % 4 AS BIGINT) AS celltype, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
PROGRAMS = "pa0 AS (SELECT o_orderstatus AS program, p_brand AS gene, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), pa AS (SELECT program, gene, w / sum(w) OVER (PARTITION BY program) AS weight FROM pa0), pb0 AS (SELECT l_returnflag AS program, p_brand AS gene, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), pb AS (SELECT program, gene, w / sum(w) OVER (PARTITION BY program) AS weight FROM pb0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _two_sided(z: str) -> str:
    """SQL for the two-sided normal tail of z: the series of the error function whose terms are all positive; beyond 9 the tail is under 1e-18."""
    x = f"(least(abs({z}), 9) / sqrt(2))"
    terms = f"[exp(2 * i * ln(2) + (2 * i + 1) * ln({x}) + lgamma(i + 1) - lgamma(2 * i + 2)) for i in range(0, 200)]"
    return f"CASE WHEN {z} = 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum({terms})) END"


def _t_two_sided(t: str, df: str) -> str:
    """SQL for the two-sided tail of Student's t with a whole number of degrees of freedom: the finite sums in the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum([exp(lgamma(2 * j + 1) - j * ln(4) - 2 * lgamma(j + 1)) * pow(cos({angle}), 2 * j) for j in range(0, {df} // 2)])"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum([exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos({angle}), 2 * j + 1) for j in range(0, ({df} - 1) // 2)]), 0))"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def slices_of(points: DataFrame) -> DataFrame:
    return points.select("slice", "age").distinct()


# quality control


@query(f"WITH {COUNTS} SELECT cell, sum(value) AS total, count(*) FILTER (value > 0) AS n_genes FROM counts GROUP BY cell")
def qc_metrics(spark, d):
    return C.qc_metrics(A.counts(spark, d))


@query(f"""WITH {COUNTS}, m AS (SELECT cell, sum(value) AS total, count(*) FILTER (value > 0) AS n_genes FROM counts GROUP BY cell),
    q AS (SELECT quantile_cont(total, 0.999) AS t, quantile_cont(n_genes, 0.999) AS g FROM m)
    SELECT cell, total, n_genes FROM m, q WHERE total BETWEEN 40 AND t AND n_genes BETWEEN 2 AND g""")
def qc_quantile_filter(spark, d):
    return C.quantile_filter(C.qc_metrics(A.counts(spark, d)), 40, 2)


@query(f"WITH {COUNTS} SELECT cell, round(sum(value) FILTER (gene IN ('Brand#11', 'Brand#12', 'Brand#13')) / sum(value), 6) AS fraction FROM counts GROUP BY cell HAVING coalesce(sum(value) FILTER (gene IN ('Brand#11', 'Brand#12', 'Brand#13')), 0) / sum(value) > 0.15")
def marker_contamination(spark, d):
    return rounded(C.marker_fraction(A.counts(spark, d), ["Brand#11", "Brand#12", "Brand#13"]).where("fraction > 0.15"))


@query(f"WITH {CELLS} SELECT cell, slice, age, celltype FROM cells WHERE NOT (celltype = '1-URGENT' AND status = 'F') AND age NOT IN (0, 3)")
def exclusions(spark, d):
    keys = spark.createDataFrame([("1-URGENT", "F")], "celltype string, status string")
    return C.exclude_ages(C.exclude_rows(A.count_cells(spark, d), keys), [0, 3]).select("cell", "slice", "age", "celltype")


@query(f"""WITH {CELLS} SELECT cell, CASE WHEN age < 12 THEN 'young' WHEN age < 24 THEN 'middle' ELSE 'old' END AS bin,
    CASE WHEN age < (SELECT median(age) FROM (SELECT DISTINCT age FROM cells)) THEN 'Young' ELSE 'Old' END AS half, status || '_' || celltype AS key, regexp_replace(celltype, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM cells""")
def age_bins(spark, d):
    return C.median_age_split(A.count_cells(spark, d)).select("cell", C.age_bin(F.col("age")).alias("bin"), "half", F.concat_ws("_", "status", "celltype").alias("key"), IO.safe_name(F.col("celltype")).alias("safe"))


@query("SELECT o_orderpriority AS celltype, o_orderkey AS cell, 'a' AS cohort FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority, o_orderkey, 'b' FROM orders WHERE o_orderkey % 2 = 1")
def cohort_union(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("celltype"), F.col("o_orderkey").alias("cell"), "o_totalprice")
    return IO.read_cohorts({"a": rows.where("cell % 2 = 0"), "b": rows.where("cell % 2 = 1").drop("o_totalprice")}).select("celltype", "cell", "cohort")


# normalisation


@query(f"""WITH {COUNTS}, {CELLS}, n AS (SELECT cell, gene, ln(1 + value * 250 / sum(value) OVER (PARTITION BY cell)) AS v FROM counts)
    SELECT slice, gene, round(sum(v) / (SELECT count(*) FROM cells c2 WHERE c2.slice = cells.slice), 6) AS mean FROM n JOIN cells USING (cell) GROUP BY slice, gene""")
def normalized_slice_means(spark, d):
    return rounded(C.slice_means(C.log1p_normalize(A.counts(spark, d)), A.count_cells(spark, d)))


@query(f"""WITH {COUNTS}, {CELLS}, n AS (SELECT count(*) AS n FROM cells), s AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM counts GROUP BY gene)
    SELECT gene, round(s / n, 6) AS mean, round(sqrt((q - s * s / n) / (n - 1)), 6) AS sd FROM s, n""")
def gene_moments(spark, d):
    return rounded(C.gene_moments(A.counts(spark, d), A.count_cells(spark, d)))


@query(f"""WITH {COUNTS}, {CELLS}, n AS (SELECT count(*) AS n FROM cells), m AS (SELECT gene, sum(ln(1 + value)) / any_value(n) AS m FROM counts, n GROUP BY gene)
    SELECT m.gene, c.slice, round(avg(coalesce(ln(1 + value), 0) - m.m), 6) AS mean FROM cells c CROSS JOIN m LEFT JOIN counts ON counts.cell = c.cell AND counts.gene = m.gene GROUP BY 1, 2""")
def log_demeaned(spark, d):
    values = A.counts(spark, d).withColumn("value", F.log1p("value"))
    cells = A.count_cells(spark, d)
    return rounded(C.demeaned_slice_means(values, cells).select("gene", "slice", "mean"))


@query(f"""WITH {COUNTS}, {CELLS}, lib AS (SELECT cell, sum(value) AS total FROM counts GROUP BY cell HAVING sum(value) > 0), t AS (SELECT median(total) AS target FROM lib),
    v AS (SELECT counts.cell, gene, ln(1 + value * least(10, target / total)) AS v FROM counts JOIN lib USING (cell), t), nt AS (SELECT slice, count(*) AS n FROM cells GROUP BY slice),
    m AS (SELECT slice, gene, sum(v) / any_value(n) AS m FROM v JOIN cells USING (cell) JOIN nt USING (slice) GROUP BY slice, gene)
    SELECT gene, round(sum(m) / (SELECT count(*) FROM nt), 6) AS centre FROM m GROUP BY gene""")
def balanced_normalize(spark, d):
    return rounded(C.balanced_centres(A.counts(spark, d), A.count_cells(spark, d)))


@query(f"""WITH {SPATIAL} SELECT cell, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) AS xz, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 6) AS yz,
    round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS x01, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 6) AS y01 FROM sp WINDOW w AS (PARTITION BY slice)""")
def scaled_coordinates(spark, d):
    cells = C.standardize(A.spatial_cells(spark, d), {"xz": "x", "yz": "y"}, ["slice"])
    return rounded(C.minmax(cells, {"x01": "x", "y01": "y"}, ["slice"]).select("cell", "xz", "yz", "x01", "y01"))


@query(f"""WITH {SPATIAL}, m AS (SELECT *, x - median(x) OVER (PARTITION BY slice) AS xc, y - median(y) OVER (PARTITION BY slice) AS yc FROM sp),
    r AS (SELECT slice, quantile_cont(sqrt(xc * xc + yc * yc), 0.95) AS r FROM m GROUP BY slice) SELECT cell, round(xc / r, 6) AS xn, round(yc / r, 6) AS yn FROM m JOIN r USING (slice)""")
def median_centred(spark, d):
    return rounded(C.centre_by_median(A.spatial_cells(spark, d)).select("cell", "xn", "yn"))


@query(f"""WITH {COUNTS}, {CELLS}, n AS (SELECT age, count(*) AS n FROM cells GROUP BY age), r AS (SELECT gene, age, sum(value) / any_value(n) AS mean, count(*) FILTER (value > 0) / any_value(n) AS expressed FROM counts JOIN cells USING (cell) JOIN n USING (age) GROUP BY gene, age)
    SELECT gene, age, round(mean, 6) AS mean, round(expressed, 6) AS expressed, round((mean - avg(mean) OVER w) / (stddev_pop(mean) OVER w + 1e-12), 6) AS z FROM r WINDOW w AS (PARTITION BY gene)""")
def dot_plot(spark, d):
    return rounded(C.dot_plot(A.counts(spark, d), A.count_cells(spark, d)))


@query(f"WITH {CELLS} SELECT s.slice, t.celltype, count(c.cell) AS n FROM (SELECT DISTINCT slice FROM cells) s CROSS JOIN (SELECT DISTINCT celltype FROM cells) t LEFT JOIN cells c ON c.slice = s.slice AND c.celltype = t.celltype GROUP BY 1, 2")
def abundance(spark, d):
    return C.abundance(A.count_cells(spark, d))


@query(f"WITH {CELLS} SELECT slice, celltype, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY slice), 6) AS share FROM cells GROUP BY 1, 2")
def crosstab(spark, d):
    return rounded(C.crosstab(A.count_cells(spark, d), "slice", "celltype"))


@query(f"""WITH {COUNTS}, {CELLS}, {PROGRAMS}, n AS (SELECT age, count(*) AS n FROM cells GROUP BY age), m AS (SELECT gene, sum(value) / (SELECT count(*) FROM cells) AS m FROM counts GROUP BY gene), s AS (SELECT age, gene, sum(value) AS s FROM counts JOIN cells USING (cell) GROUP BY 1, 2)
    SELECT program, n.age, round(sum(weight * (coalesce(s, 0) / n - m)), 6) AS score FROM n CROSS JOIN pa JOIN m USING (gene) LEFT JOIN s ON s.age = n.age AND s.gene = pa.gene GROUP BY 1, 2""")
def program_scores(spark, d):
    counts, cells = A.counts(spark, d), A.count_cells(spark, d)
    return rounded(C.program_scores(counts, A.programs(spark, d, "o_orderstatus"), C.gene_moments(counts, cells), cells))


@query("WITH g AS (SELECT vec_id AS cell, unnest(embedding[3:]) AS value, generate_subscripts(embedding[3:], 1) AS gene FROM embeddings), p AS (SELECT gene, stddev_samp(CAST(value AS DOUBLE)) AS sd, quantile_cont(CAST(value AS DOUBLE), 0.75) - quantile_cont(CAST(value AS DOUBLE), 0.25) AS iqr, count(*) AS n FROM g GROUP BY gene) SELECT round(median(0.9 * least(sd, iqr / 1.34) * pow(n, -0.2)), 6) AS bandwidth FROM p")
def silverman_bandwidth(spark, d):
    return rounded(C.silverman(A.long_genes(A.spatial_cells(spark, d))))


# kernels and distance joins


@query(f"WITH {CELLS}, s AS (SELECT DISTINCT slice, age FROM cells) SELECT a.slice AS s1, b.slice AS s2, round(exp(-pow(a.age - b.age, 2) / 50), 6) AS k FROM s a, s b")
def rbf_kernel(spark, d):
    return rounded(S.temporal_kernel(slices_of(A.count_cells(spark, d)), "rbf", 50.0))


@query(f"WITH {CELLS}, s AS (SELECT slice, dense_rank() OVER (ORDER BY age) AS r FROM (SELECT DISTINCT slice, age FROM cells)) SELECT a.slice AS s1, b.slice AS s2, round(pow(0.75, abs(a.r - b.r)), 6) AS k FROM s a, s b")
def ar1_kernel(spark, d):
    return rounded(S.temporal_kernel(slices_of(A.count_cells(spark, d)), "ar1"))


@query(f"WITH {CELLS}, s AS (SELECT slice, (age - avg(age) OVER ()) / stddev_samp(age) OVER () AS z FROM (SELECT DISTINCT slice, age FROM cells)) SELECT round(pow(median(abs(a.z - b.z)), 2) / 2, 6) AS gamma FROM s a JOIN s b ON a.slice < b.slice WHERE a.z <> b.z")
def temporal_bandwidth(spark, d):
    return rounded(S.temporal_bandwidth(slices_of(A.count_cells(spark, d))))


@query(f"""WITH {SPATIAL}, n AS (SELECT slice, count(*) AS n FROM sp GROUP BY slice), r AS (SELECT a.slice, n, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.cell) AS r FROM sp a JOIN sp b ON a.slice = b.slice AND a.cell <> b.cell JOIN n ON n.slice = a.slice)
    SELECT round(pow(median(m), 2) / abs(ln(0.9)), 6) AS gamma FROM (SELECT slice, median(d) AS m FROM r WHERE r = least(greatest(1, ceil(0.05 * n)), n - 1) GROUP BY slice)""")
def spatial_bandwidth(spark, d):
    return rounded(S.spatial_bandwidth(A.spatial_cells(spark, d)))


@query(f"WITH {SPATIAL} SELECT a.slice, a.cell AS src, b.cell AS dst, round(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2), 6) AS k FROM sp a JOIN sp b ON a.slice = b.slice AND a.cell <= b.cell")
def spatial_kernel(spark, d):
    return S.spatial_kernel(A.spatial_cells(spark, d), 2.0, digits=6)


@query(f"WITH {SPATIAL} SELECT a.slice, a.cell AS src, b.cell AS dst, round(1 / (1 + (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2), 6) AS k FROM sp a JOIN sp b ON a.slice = b.slice AND a.cell <= b.cell")
def cauchy_kernel(spark, d):
    return S.spatial_kernel(A.spatial_cells(spark, d), 2.0, "cauchy", digits=6)


@query(f"""WITH {SPATIAL}, c AS (SELECT slice, avg(x) AS cx, avg(y) AS cy FROM sp GROUP BY slice), f AS (SELECT slice, x AS fx, y AS fy FROM (SELECT sp.*, row_number() OVER (PARTITION BY slice ORDER BY sqrt(pow(x - cx, 2) + pow(y - cy, 2)), cell) AS r FROM sp JOIN c USING (slice)) WHERE r = 1)
    SELECT slice, cell, round(exp(-(pow(x - fx, 2) + pow(y - fy, 2)) / 2), 6) AS k FROM sp JOIN f USING (slice)""")
def reference_kernel(spark, d):
    return rounded(S.reference_kernel(A.spatial_cells(spark, d), 2.0))


@query(f"""WITH {SPATIAL}, r AS (SELECT a.slice, a.cell AS src, b.cell AS dst, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.cell) AS r FROM sp a JOIN sp b ON a.slice = b.slice AND a.cell <> b.cell), e AS (SELECT slice, src, dst FROM r WHERE r <= 5)
    SELECT slice, src, dst FROM e UNION SELECT slice, dst, src FROM e""")
def knn_graph(spark, d):
    return S.knn_graph(A.spatial_cells(spark, d), 5)


@query(f"WITH {POINTS} SELECT * EXCLUDE (b, y, x) FROM points p WHERE celltype = 'click' OR NOT EXISTS (SELECT 1 FROM points q WHERE q.slice = p.slice AND q.celltype = 'click' AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) < 3)")
def near_type_removed(spark, d):
    return S.near_removed(A.points(spark, d), "click", 3.0).select("cell", "slice", "age", "celltype", "region")


@query(f"""WITH {POINTS}, t AS (SELECT DISTINCT slice, celltype AS other_type FROM points) SELECT p.cell, t.other_type, p.slice, count(q.cell) AS n FROM points p JOIN t ON t.slice = p.slice
    LEFT JOIN points q ON q.slice = p.slice AND q.celltype = t.other_type AND q.cell <> p.cell AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) > 5 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 15 WHERE p.celltype = 'view' GROUP BY 1, 2, 3""")
def shell_counts(spark, d):
    points = A.points(spark, d)
    return S.shell_counts(points.where("celltype = 'view'"), points, 5.0, 15.0).select("cell", "other_type", "slice", "n")


@query(f"""WITH {POINTS}, t AS (SELECT DISTINCT slice, celltype AS other_type FROM points) SELECT p.cell, t.other_type, round(min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6) AS d FROM points p JOIN t ON t.slice = p.slice
    LEFT JOIN points q ON q.slice = p.slice AND q.celltype = t.other_type AND q.cell <> p.cell AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 10 WHERE p.celltype = 'view' GROUP BY 1, 2""")
def nearest_distance(spark, d):
    points = A.points(spark, d)
    return rounded(S.nearest_within(points.where("celltype = 'view'"), points, 10.0).select("cell", "other_type", "d"))


@query(f"""WITH {POINTS}, n AS (SELECT p.cell, p.celltype, q.celltype AS other_type, count(*) AS n FROM points p JOIN points q ON q.slice = p.slice AND q.cell <> p.cell AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 10 GROUP BY 1, 2, 3),
    t AS (SELECT cell, celltype, slice, sum(n) AS t FROM n JOIN points USING (cell, celltype) GROUP BY 1, 2, 3), k AS (SELECT DISTINCT slice, celltype AS other_type FROM points)
    SELECT t.celltype, k.other_type, round(avg(coalesce(n.n, 0) / t.t), 6) AS share FROM t JOIN k ON k.slice = t.slice LEFT JOIN n ON n.cell = t.cell AND n.other_type = k.other_type GROUP BY 1, 2""")
def neighbourhood_composition(spark, d):
    return rounded(S.composition(A.points(spark, d), 10.0))


@query(f"""WITH {POINTS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
    c AS (SELECT CAST(least(9, floor((x - x0) / (x1 - x0) * 10)) AS BIGINT) AS gx, CAST(least(9, floor((y - y0) / (y1 - y0) * 10)) AS BIGINT) AS gy, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(b) AS time FROM points CROSS JOIN e GROUP BY 1, 2 HAVING count(*) >= 10),
    s AS (SELECT g.gx, g.gy, sum((h.time - g.time) * (h.x - g.x) / (pow(h.x - g.x, 2) + pow(h.y - g.y, 2))) AS sx, sum((h.time - g.time) * (h.y - g.y) / (pow(h.x - g.x, 2) + pow(h.y - g.y, 2))) AS sy
        FROM c g JOIN c h ON abs(g.gx - h.gx) <= 1 AND abs(g.gy - h.gy) <= 1 AND NOT (g.gx = h.gx AND g.gy = h.gy) GROUP BY 1, 2)
    SELECT 'all' AS slice, gx, gy, n, round(x, 6) AS x, round(y, 6) AS y, round(time, 6) AS time, CASE WHEN sqrt(sx * sx + sy * sy) > 0 THEN round(sx / sqrt(sx * sx + sy * sy), 6) ELSE 0 END AS dx,
    CASE WHEN sqrt(sx * sx + sy * sy) > 0 THEN round(sy / sqrt(sx * sx + sy * sy), 6) ELSE 0 END AS dy FROM c LEFT JOIN s USING (gx, gy)""")
def time_gradient(spark, d):
    return rounded(S.time_gradient(A.points(spark, d).withColumn("slice", F.lit("all")), "b"))


# programs


@query(f"""WITH {PROGRAMS}, v AS (SELECT program, gene, weight * 20 - 0.6 AS v FROM pa), r AS (SELECT *, row_number() OVER w AS r, sum(v) OVER w AS cs FROM v WINDOW w AS (PARTITION BY program ORDER BY v DESC, gene)),
    t AS (SELECT program, max_by((cs - 1) / r, r) AS theta FROM r WHERE v * r > cs - 1 GROUP BY program), u AS (SELECT program, gene, greatest(v - theta, 0) AS u FROM r JOIN t USING (program))
    SELECT program, gene, round(u / sum(u) OVER (PARTITION BY program), 6) AS weight FROM u""")
def simplex_projection(spark, d):
    return rounded(P.project_simplex(A.programs(spark, d, "o_orderstatus").withColumn("weight", F.col("weight") * 20 - 0.6)))


@query(f"""WITH {PROGRAMS}, v AS (SELECT program, gene, weight * 20 - 0.6 AS v FROM pa), r AS (SELECT *, row_number() OVER w AS r, sum(v) OVER w AS cs FROM v WINDOW w AS (PARTITION BY program ORDER BY v DESC, gene)),
    t AS (SELECT program, max_by((cs - 1) / r, r) AS theta FROM r WHERE r <= 5 AND v * r > cs - 1 GROUP BY program), u AS (SELECT program, gene, CASE WHEN r <= 5 THEN greatest(v - theta, 0) ELSE 0 END AS u FROM r JOIN t USING (program))
    SELECT program, gene, round(u / sum(u) OVER (PARTITION BY program), 6) AS weight FROM u""")
def simplex_topk(spark, d):
    return rounded(P.project_simplex(A.programs(spark, d, "o_orderstatus").withColumn("weight", F.col("weight") * 20 - 0.6), 5))


@query(f"WITH {PROGRAMS} SELECT * FROM (SELECT program, gene, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS INT) AS rank FROM pa) WHERE rank <= 5")
def top_genes(spark, d):
    return rounded(P.top_genes(IO.active_genes(A.programs(spark, d, "o_orderstatus")).drop("rank"), 5))


@query(f"WITH {PROGRAMS} SELECT a.program AS p, b.program AS q, round(sum(a.weight * b.weight) / sqrt(sum(a.weight * a.weight) * sum(b.weight * b.weight)), 6) AS cosine FROM pa a JOIN pb b USING (gene) GROUP BY 1, 2")
def program_cosine(spark, d):
    return rounded(P.cosine(A.programs(spark, d, "o_orderstatus"), A.programs(spark, d, "l_returnflag")))


@query(f"""WITH {PROGRAMS}, ra AS (SELECT program, gene, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS r FROM pa), rb AS (SELECT program, gene, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS r FROM pb)
    SELECT p.program AS p, q.program AS q, round(count(*) FILTER (b.gene IS NOT NULL) / (20 - count(*) FILTER (b.gene IS NOT NULL)), 6) AS jaccard FROM (SELECT DISTINCT program FROM pa) p CROSS JOIN (SELECT DISTINCT program FROM pb) q JOIN ra a ON a.program = p.program AND a.r <= 10 LEFT JOIN rb b ON b.program = q.program AND b.r <= 10 AND b.gene = a.gene GROUP BY 1, 2""")
def program_jaccard(spark, d):
    return rounded(P.jaccard(A.programs(spark, d, "o_orderstatus"), A.programs(spark, d, "l_returnflag"), 10))


@query(f"""WITH {PROGRAMS}, j AS (SELECT a.program AS p, b.program AS q, a.weight AS wa, b.weight AS wb FROM pa a JOIN pb b USING (gene)), r AS (SELECT *, rank() OVER (PARTITION BY p, q ORDER BY wa) + (count(*) OVER (PARTITION BY p, q, wa) - 1) / 2 AS ra, rank() OVER (PARTITION BY p, q ORDER BY wb) + (count(*) OVER (PARTITION BY p, q, wb) - 1) / 2 AS rb FROM j)
    SELECT p, q, round(avg(pow(wa - wb, 2)), 6) AS mse, round(1 - sum(abs(wa - wb)) / 2, 6) AS tv, round(1 - sqrt(sum(pow(sqrt(wa) - sqrt(wb), 2)) / 2), 6) AS hellinger, round(corr(wa, wb), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY p, q""")
def program_distances(spark, d):
    return rounded(P.distances(A.programs(spark, d, "o_orderstatus"), A.programs(spark, d, "l_returnflag")))


@query(f"""WITH {PROGRAMS}, ma AS (SELECT program, gene FROM (SELECT *, coalesce(sum(weight) OVER (PARTITION BY program ORDER BY weight DESC, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pa) WHERE b < 0.5), mb AS (SELECT program, gene FROM (SELECT *, coalesce(sum(weight) OVER (PARTITION BY program ORDER BY weight DESC, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pb) WHERE b < 0.5),
    na AS (SELECT program AS p, count(*) AS na FROM ma GROUP BY 1), nb AS (SELECT program AS q, count(*) AS nb FROM mb GROUP BY 1), k AS (SELECT ma.program AS p, mb.program AS q, count(*) AS k FROM ma JOIN mb USING (gene) GROUP BY 1, 2),
    n AS (SELECT program AS p, count(*) AS n FROM pa WHERE weight > 1e-10 GROUP BY 1), rb AS (SELECT program AS q, gene, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS r FROM pb), h AS (SELECT pa.program AS p, rb.q, count(*) AS h FROM pa JOIN rb USING (gene) JOIN n ON n.p = pa.program WHERE weight > 1e-10 AND r <= n GROUP BY 1, 2)
    SELECT p, q, round(2 * coalesce(k, 0) / (na + nb), 6) AS f1, round(coalesce(k, 0) / (na + nb - coalesce(k, 0)), 6) AS jaccard, round(coalesce(h, 0) / n, 6) AS hit FROM na CROSS JOIN nb LEFT JOIN k USING (p, q) LEFT JOIN h USING (p, q) JOIN n USING (p)""")
def program_matching(spark, d):
    return rounded(P.matching(A.programs(spark, d, "o_orderstatus"), A.programs(spark, d, "l_returnflag"), 0.5))


@query(f"""WITH {PROGRAMS}, c AS (SELECT a.program AS p, b.program AS q, avg(pow(a.weight - b.weight, 2)) AS cost FROM pa a JOIN pb b USING (gene) GROUP BY 1, 2),
    perms AS (SELECT c1.q AS q1, c2.q AS q2, c3.q AS q3, c1.cost AS k1, c2.cost AS k2, c3.cost AS k3, c1.p AS p1, c2.p AS p2, c3.p AS p3 FROM c c1 JOIN c c2 ON c2.p > c1.p AND c2.q <> c1.q JOIN c c3 ON c3.p > c2.p AND c3.q NOT IN (c1.q, c2.q)), best AS (SELECT * FROM perms ORDER BY k1 + k2 + k3 LIMIT 1)
    SELECT p1 AS p, q1 AS q, round(k1, 9) AS cost FROM best UNION ALL SELECT p2, q2, round(k2, 9) FROM best UNION ALL SELECT p3, q3, round(k3, 9) FROM best""")
def program_alignment(spark, d):
    costs = P.distances(A.programs(spark, d, "o_orderstatus"), A.programs(spark, d, "l_returnflag"))
    return rounded(P.align(costs.select("p", "q", F.col("mse").alias("cost"))), 9)


_SETS = "sets AS (SELECT DISTINCT p_type AS term, p_brand AS gene FROM part WHERE p_size <= 3)"


@query(f"""WITH {PROGRAMS}, {_SETS}, r AS (SELECT program, gene FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS r FROM pa WHERE weight > 0) WHERE r <= 8),
    g AS (SELECT term, count(*) AS good FROM sets GROUP BY 1) SELECT program, term, count(*) AS k, CAST(8 AS BIGINT) AS drawn, any_value(good) AS good, (SELECT count(DISTINCT p_brand) FROM part) AS total FROM r JOIN sets USING (gene) JOIN g USING (term) GROUP BY 1, 2""")
def set_overlap(spark, d):
    return _overlap(spark, d).select("program", "term", "k", "drawn", "good", "total")


def _overlap(spark, d):
    part = A.table(spark, d, "part")
    sets = part.where("p_size <= 3").select(F.col("p_type").alias("term"), F.col("p_brand").alias("gene")).distinct()
    return P.overlap(A.programs(spark, d, "o_orderstatus"), sets, 8, part.select(F.col("p_brand").alias("gene")))


@query()
def set_enrichment(spark, d):
    rows = _overlap(spark, d).withColumn("p", hypergeometric_sf("k", "drawn", "good", "total"))
    return rounded(T.bh(rows, "p", "q", ["program"]).withColumn("score", -F.ln("p") * F.col("odds")).withColumn("label", clean_term(F.col("term"))).withColumn("name", program_label(F.col("program"))))


# statistics

_TEST = "t AS (SELECT slice, celltype, b FROM points)"


@query(f"""WITH {POINTS}, r AS (SELECT slice, celltype = 'click' AS f, rank() OVER (PARTITION BY slice ORDER BY y) + (count(*) OVER (PARTITION BY slice, y) - 1) / 2 AS r, count(*) OVER (PARTITION BY slice, y) AS t FROM points),
    s AS (SELECT slice, CAST(count(*) FILTER (f) AS BIGINT) AS n1, CAST(count(*) FILTER (NOT f) AS BIGINT) AS n2, sum(r) FILTER (f) AS r, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY slice), u AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
    SELECT slice, n1, n2, round(u, 6) AS u, round((u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark, d):
    return rounded(T.mann_whitney(A.points(spark, d), "y", F.col("celltype") == "click", ["slice"]))


@query(f"""WITH {POINTS}, r AS (SELECT slice, celltype = 'click' AS f, rank() OVER (PARTITION BY slice ORDER BY y) + (count(*) OVER (PARTITION BY slice, y) - 1) / 2 AS r, count(*) OVER (PARTITION BY slice, y) AS t FROM points),
    s AS (SELECT slice, CAST(count(*) FILTER (f) AS BIGINT) AS n1, CAST(count(*) FILTER (NOT f) AS BIGINT) AS n2, sum(r) FILTER (f) AS r, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY slice), u AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s),
    z AS (SELECT slice, n1, n2, u.u, (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u), p AS (SELECT *, {_two_sided("z")} AS p FROM z),
    k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM p)
    SELECT slice, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 6) AS q, round(least(1, max(p * (m - k + 1)) OVER (ORDER BY k)), 6) AS holm FROM k""")
def mann_whitney_p(spark, d):
    rows = T.mann_whitney(A.points(spark, d), "y", F.col("celltype") == "click", ["slice"]).withColumn("p", normal_two_sided("z"))
    return rounded(T.holm(T.bh(rows, "p"), "p"))


@query(f"""WITH {POINTS}, d AS (SELECT celltype, b AS d FROM points WHERE b <> 0), r AS (SELECT *, rank() OVER (PARTITION BY celltype ORDER BY abs(d)) + (count(*) OVER (PARTITION BY celltype, abs(d)) - 1) / 2 AS r FROM d) SELECT celltype, count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 1) AS w FROM r GROUP BY 1""")
def wilcoxon(spark, d):
    return rounded(T.wilcoxon(A.points(spark, d), "b", ["celltype"]), 1)


@query(f"WITH {POINTS} SELECT slice, round(avg(y - x), 6) AS mean, round(median(y - x), 6) AS median, count(*) FILTER (y > x) AS above, count(*) FILTER (y < x) AS below, count(*) FILTER (y = x) AS equal FROM points GROUP BY slice")
def paired_summary(spark, d):
    return rounded(T.paired_summary(A.points(spark, d), "y", "x", ["slice"]))


@query(f"""WITH {POINTS}, h AS (SELECT celltype, y >= (SELECT quantile_cont(y, 0.95) FROM points) AS h FROM points), n AS (SELECT celltype, count(*) FILTER (h) AS a, count(*) FILTER (NOT h) AS b FROM h GROUP BY 1), w AS (SELECT count(*) FILTER (h) AS h, count(*) FILTER (NOT h) AS l FROM h)
    SELECT celltype, a, b, h - a AS c, l - b AS d, round(greatest(-4, least(5, log2(a * (l - b) / (b * (h - a))))), 6) AS log2_odds FROM n, w""")
def fisher_odds(spark, d):
    points = A.points(spark, d)
    high = points.crossJoin(F.broadcast(points.agg(F.percentile("y", F.lit(0.95)).alias("cut")))).withColumn("high", F.col("y") >= F.col("cut"))
    return rounded(T.log_odds(high, F.col("high"), "celltype"))


@query(f"""WITH {POINTS}, h AS (SELECT celltype, y >= (SELECT quantile_cont(y, 0.95) FROM points) AS h FROM points), n AS (SELECT celltype, count(*) FILTER (h) AS a, count(*) FILTER (NOT h) AS b FROM h GROUP BY 1), w AS (SELECT count(*) FILTER (h) AS h, count(*) AS t FROM h),
    i AS (SELECT celltype, a, b, h, t, unnest(generate_series(a, least(a + b, h))) AS i FROM n, w)
    SELECT celltype, a, b, round(least(1, sum(exp(lgamma(h + 1) - lgamma(i + 1) - lgamma(h - i + 1) + lgamma(t - h + 1) - lgamma(a + b - i + 1) - lgamma(t - h - a - b + i + 1) - lgamma(t + 1) + lgamma(a + b + 1) + lgamma(t - a - b + 1)))), 6) AS p FROM i GROUP BY celltype, a, b""")
def fisher_greater(spark, d):
    points = A.points(spark, d)
    high = points.crossJoin(F.broadcast(points.agg(F.percentile("y", F.lit(0.95)).alias("cut")))).withColumn("high", F.col("y") >= F.col("cut"))
    return rounded(T.fisher_greater(high, F.col("high"), "celltype").select("celltype", "a", "b", "p"))


@query()
def wilcoxon_greater(spark, d):
    return rounded(T.wilcoxon_greater(A.points(spark, d), "y", "x", ["celltype"]))


_BH = "SELECT cell, p, least(1, min(p * m / r) OVER (PARTITION BY slice ORDER BY r DESC)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY p) AS r, count(*) OVER (PARTITION BY slice) AS m FROM t)"


@query(f"WITH {POINTS}, t AS (SELECT cell, slice, (cell * 7919 % 10007 + 1) / 10008 AS p FROM points) SELECT cell, round(p, 6) AS p, round(q, 6) AS q FROM ({_BH})")
def bh_fdr(spark, d):
    rows = A.points(spark, d).withColumn("p", (F.col("cell") * 7919 % 10007 + 1) / 10008)
    return rounded(T.bh(rows, "p", "q", ["slice"]).select("cell", "p", "q"))


@query(f"WITH {POINTS}, t AS (SELECT cell, slice, (cell * 7919 % 10007 + 1) / 10008 / 200 AS p FROM points) SELECT cell, round(least(1, max((m - r + 1) * p) OVER (PARTITION BY slice ORDER BY r)), 6) AS holm FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY p) AS r, count(*) OVER (PARTITION BY slice) AS m FROM t)")
def holm(spark, d):
    rows = A.points(spark, d).withColumn("p", (F.col("cell") * 7919 % 10007 + 1) / 10008 / 200)
    return rounded(T.holm(rows, "p", "holm", ["slice"]).select("cell", "holm"))


def _nearest(radius: float) -> str:
    return f"k AS (SELECT DISTINCT slice, celltype AS other_type FROM points), n AS (SELECT p.slice, p.cell, p.b, p.age, k.other_type, min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS d FROM points p JOIN k ON k.slice = p.slice LEFT JOIN points q ON q.slice = p.slice AND q.celltype = k.other_type AND q.cell <> p.cell AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= {radius} WHERE p.celltype = 'view' GROUP BY 1, 2, 3, 4, 5)"


_EFFECT = "median(b) FILTER (near) - median(b) FILTER (far) AS e, 1 / (var_samp(b) FILTER (near) / count(*) FILTER (near) + var_samp(b) FILTER (far) / count(*) FILTER (far) + 1e-9) AS w"
_ENOUGH = "HAVING count(*) FILTER (near) >= 8 AND count(*) FILTER (far) >= 8"


@query(f"""WITH {POINTS}, {_nearest(20)}, m AS (SELECT *, coalesce(d <= 6, false) AS near, d IS NULL AS far FROM n), e AS (SELECT other_type, slice, {_EFFECT} FROM m GROUP BY 1, 2 {_ENOUGH})
    SELECT other_type, count(*) AS blocks, round(sum(w * e) / sum(w), 6) AS effect, round(1 / sqrt(sum(w)), 6) AS se, round(sum(w * e) / sum(w) * sqrt(sum(w)), 6) AS z FROM e GROUP BY 1""")
def matched_effects(spark, d):
    points = A.points(spark, d)
    return rounded(T.matched_effects(points.where("celltype = 'view'"), points, "b", 6.0, 20.0))


@query(f"""WITH {POINTS}, {_nearest(20)}, m AS (SELECT *, CASE WHEN age < 12 THEN 'young' WHEN age < 24 THEN 'middle' ELSE 'old' END AS stratum, coalesce(d <= 6, false) AS near, d IS NULL AS far FROM n), e AS (SELECT stratum, other_type, slice, {_EFFECT} FROM m GROUP BY 1, 2, 3 {_ENOUGH})
    SELECT stratum, other_type, count(*) AS blocks, round(sum(w * e) / sum(w), 6) AS effect, round(1 / sqrt(sum(w)), 6) AS se, round(sum(w * e) / sum(w) * sqrt(sum(w)), 6) AS z FROM e GROUP BY 1, 2""")
def age_strata_effects(spark, d):
    points = A.points(spark, d)
    return rounded(T.matched_effects(points.where("celltype = 'view'").withColumn("stratum", C.age_bin(F.col("age"))), points, "b", 6.0, 20.0, by=["stratum"]))


@query(f"""WITH {POINTS}, {_nearest(25)}, bands AS (SELECT * FROM (VALUES (0.0::DOUBLE, 4.0::DOUBLE), (4.0, 8.0), (8.0, 16.0)) v(lo, hi)), m AS (SELECT n.*, lo, hi, coalesce(d > lo AND d <= hi, false) AS near, d IS NULL AS far FROM n, bands), e AS (SELECT other_type, lo, hi, slice, {_EFFECT} FROM m GROUP BY 1, 2, 3, 4 {_ENOUGH})
    SELECT other_type, lo, hi, count(*) AS blocks, round(sum(w * e) / sum(w), 6) AS effect, round(1 / sqrt(sum(w)), 6) AS se, round(sum(w * e) / sum(w) * sqrt(sum(w)), 6) AS z FROM e GROUP BY 1, 2, 3""")
def distance_decay(spark, d):
    points = A.points(spark, d)
    return rounded(T.distance_decay(points.where("celltype = 'view'"), points, "b", (0, 4, 8, 16), 25.0))


@query(f"""WITH {POINTS}, {_nearest(20)}, m AS (SELECT *, coalesce(d <= 6, false) AS near, d IS NULL AS far FROM n)
    SELECT slice, other_type, count(*) FILTER (near) AS nn, count(*) FILTER (far) AS nf, round(median(b) FILTER (near) - median(b) FILTER (far), 6) AS effect, round(sqrt(var_samp(b) FILTER (near) / count(*) FILTER (near) + var_samp(b) FILTER (far) / count(*) FILTER (far) + 1e-9), 6) AS se FROM m GROUP BY 1, 2 {_ENOUGH}""")
def slice_effects(spark, d):
    points = A.points(spark, d)
    return rounded(T.slice_effects(points.where("celltype = 'view'"), points, "b", 6.0, 20.0).drop("z"))


@query()
def proximity_permutation(spark, d):
    points = A.points(spark, d)
    return rounded(T.permutation_null(points.where("celltype = 'view'"), points, "click", "b", 6.0, 20.0))


@query(f"""WITH {POINTS}, v AS (SELECT *, quantile_cont(b, 0.75) OVER () AS q3, quantile_cont(b, 0.25) OVER () AS q1 FROM points WHERE celltype = 'view'), t AS (SELECT slice, cell, x, y, b >= q3 AS high FROM v WHERE b >= q3 OR b <= q1),
    k AS (SELECT DISTINCT slice, celltype AS other_type FROM points), n AS (SELECT t.cell, t.high, k.other_type, count(p.cell) AS n FROM t JOIN k USING (slice) LEFT JOIN points p ON p.slice = t.slice AND p.celltype = k.other_type AND p.cell <> t.cell
        AND sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) > 5 AND sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) <= 15 GROUP BY 1, 2, 3),
    r AS (SELECT *, rank() OVER (PARTITION BY other_type ORDER BY n) + (count(*) OVER (PARTITION BY other_type, n) - 1) / 2 AS r, count(*) OVER (PARTITION BY other_type, n) AS ties FROM n),
    s AS (SELECT other_type, count(*) FILTER (high) AS nh, count(*) FILTER (NOT high) AS nl, avg(n) FILTER (high) AS hi, avg(n) FILTER (NOT high) AS lo, sum(r) FILTER (high) AS r, CAST(sum(ties * ties - 1) AS DOUBLE) AS ties FROM r GROUP BY 1 HAVING nh >= 30 AND nl >= 30),
    u AS (SELECT *, r - nh * (nh + 1) / 2 AS u, sqrt(nh * nl / 12 * ((nh + nl + 1) - ties / ((nh + nl) * (nh + nl - 1)))) AS sd FROM s), z AS (SELECT *, CASE WHEN sd > 0 THEN (u - nh * nl / 2 - sign(u - nh * nl / 2) * 0.5) / sd END AS z FROM u),
    p AS (SELECT *, {_two_sided("z")} AS p FROM z), k2 AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY coalesce(p, 1)) AS k FROM p), f AS (SELECT *, least(1, min(coalesce(p, 1) * m / k) OVER (ORDER BY k DESC)) AS q FROM k2)
    SELECT other_type, nh, nl, round(hi, 6) AS hi, round(lo, 6) AS lo, round(u, 6) AS u, round(z, 6) AS z, round(log2((hi + 0.05) / (lo + 0.05)), 6) AS log2_ratio, round(p, 6) AS p, round(q, 6) AS q, CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END AS stars FROM f""")
def shell_enrichment(spark, d):
    points = A.points(spark, d)
    rows = T.shell_enrichment(points.where("celltype = 'view'"), points, "b", 5.0, 15.0).withColumn("p", normal_two_sided("z"))
    return rounded(T.bh(rows, "p", "q", missing="one").withColumn("stars", C.stars(F.col("q"))))


@query(f"""WITH {POINTS}, s AS (SELECT DISTINCT slice, age FROM points), n AS (SELECT s.slice, s.age, t.celltype, count(p.cell) AS n FROM s CROSS JOIN (SELECT DISTINCT celltype FROM points) t LEFT JOIN points p ON p.slice = s.slice AND p.celltype = t.celltype GROUP BY 1, 2, 3),
    r AS (SELECT celltype, rank() OVER (PARTITION BY celltype ORDER BY n) + (count(*) OVER (PARTITION BY celltype, n) - 1) / 2 AS rn, rank() OVER (PARTITION BY celltype ORDER BY age) + (count(*) OVER (PARTITION BY celltype, age) - 1) / 2 AS ra FROM n),
    c AS (SELECT celltype, corr(rn, ra) AS rho, count(*) AS slices FROM r GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT *, rho * sqrt((slices - 2) / (1 - rho * rho)) AS t FROM c)
    SELECT celltype, round(rho, 6) AS rho, slices, round(t, 6) AS t, round({_t_two_sided("t", "(slices - 2)")}, 6) AS p FROM t""")
def abundance_trend(spark, d):
    n = C.abundance(A.points(spark, d)).join(slices_of(A.points(spark, d)), "slice")
    ranked = n.withColumns({"rn": P.average_rank("n", "celltype"), "ra": P.average_rank("age", "celltype")})
    rho = ranked.groupBy("celltype").agg(F.corr("rn", "ra").alias("rho"), F.count(F.lit(1)).alias("slices")).where("slices >= 3")
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("slices") - 2, 1 - F.col("rho") * F.col("rho")))
    return rounded(rho.withColumn("t", t).withColumn("p", t_two_sided("t", (F.col("slices") - 2).cast("double"))))


@query(f"""WITH {POINTS}, c AS (SELECT celltype, y, age, region, y - avg(y) OVER (PARTITION BY celltype, region) AS yw, age - avg(age) OVER (PARTITION BY celltype, region) AS xw, avg(y) OVER (PARTITION BY celltype, region) - avg(y) OVER (PARTITION BY celltype) AS g FROM points),
    s AS (SELECT celltype, regr_r2(y, age) AS ra, sum(g * g) / (var_pop(y) * count(*)) AS rr, (sum(g * g) + pow(sum(xw * yw), 2) / sum(xw * xw)) / (var_pop(y) * count(*)) AS rb FROM c GROUP BY 1)
    SELECT celltype, round(ra, 6) AS r2_age, round(rr, 6) AS r2_region, round(rb, 6) AS r2_both, round(greatest(0, rb - rr), 6) AS unique_age, round(greatest(0, rb - ra), 6) AS unique_region, round(greatest(0, ra + rr - rb), 6) AS shared, round(greatest(0, 1 - rb), 6) AS residual FROM s""")
def variance_partition(spark, d):
    return rounded(T.variance_partition(A.points(spark, d), "y", ["celltype"]))


# labels


@query("""WITH d AS (SELECT quality AS t, lang AS l FROM documents JOIN labels USING (doc_id)), n AS (SELECT t, l, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1, 2), a AS (SELECT t, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT l, sum(n) AS b FROM n GROUP BY 1), w AS (SELECT sum(n) AS total, sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS em FROM n),
    ra AS (SELECT sum(a * (a - 1) / 2) AS i, sum(a * ln(a)) AS ea FROM a), rb AS (SELECT sum(b * (b - 1) / 2) AS j, sum(b * ln(b)) AS eb, count(*) AS labels FROM b), maj AS (SELECT l, t AS m FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, t) AS r FROM n) WHERE r = 1),
    p AS (SELECT t, m FROM d JOIN maj USING (l)), h AS (SELECT t, count(*) AS n, count(*) FILTER (t = m) AS tp FROM p GROUP BY 1), s AS (SELECT m AS t, count(*) AS m FROM p GROUP BY 1), f AS (SELECT sum(tp) / sum(n) AS accuracy, avg(tp / n) AS balanced, avg(2 * tp / (n + coalesce(m, 0))) AS macro_f1 FROM h LEFT JOIN s USING (t))
    SELECT round((ij - i * j / (total * (total - 1) / 2)) / ((i + j) / 2 - i * j / (total * (total - 1) / 2)), 6) AS ari, round((ln(total) + em / total - ea / total - eb / total) / ((2 * ln(total) - ea / total - eb / total) / 2), 6) AS nmi, round(accuracy, 6) AS accuracy, round(balanced, 6) AS balanced, round(macro_f1, 6) AS macro_f1, labels FROM w, ra, rb, f""")
def label_evaluation(spark, d):
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id").select("quality", "lang")
    return rounded(L.evaluate(rows, "quality", "lang"))


@query("SELECT source, label FROM (SELECT source, lang AS label, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def majority_merge(spark, d):
    return L.majority(A.table(spark, d, "documents"), "source", "lang")


@query(f"""WITH {SPATIAL}, g AS (SELECT vec_id AS cell, label, list_transform(embedding[3:6], lambda v: CAST(v AS DOUBLE)) AS m FROM embeddings), u AS (SELECT cell, unnest(m) AS v, generate_subscripts(m, 1) - 1 AS k FROM g), z AS (SELECT cell, k, (v - avg(v) OVER (PARTITION BY k)) / (stddev_pop(v) OVER (PARTITION BY k) + 1e-8) AS z FROM u)
    SELECT cell, CAST(max_by(k, z) AS BIGINT) AS region FROM z GROUP BY cell""")
def marker_region(spark, d):
    rows = A.long_genes(A.spatial_cells(spark, d)).where("gene < 4")
    w = Window.partitionBy("gene")
    z = rows.withColumn("z", (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-8))
    return z.groupBy("cell").agg(F.max_by("gene", "z").alias("region"))


@query(f"WITH {CELLS} SELECT slice, count(*) FILTER (celltype = '1-URGENT') AS urgent, count(*) FILTER (celltype = '2-HIGH') AS high, count(*) FILTER (celltype = '3-MEDIUM') AS medium FROM cells GROUP BY slice")
def pivot_types(spark, d):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
    wide = A.count_cells(spark, d).groupBy("slice").pivot("celltype", list(names)).count()
    return wide.select("slice", *[F.coalesce(F.col(f"`{a}`"), F.lit(0).cast("long")).alias(b) for a, b in names.items()])


@query(f"WITH {PROGRAMS} SELECT gene, round(avg(weight), 6) AS weight, program FROM (SELECT * FROM pa UNION ALL SELECT program, gene, weight FROM pb) GROUP BY program, gene")
def mean_loadings(spark, d):
    both = [A.programs(spark, d, c) for c in ("o_orderstatus", "l_returnflag")]
    return rounded(IO.mean_loadings(reduce(DataFrame.unionByName, both)).select("gene", "weight", "program"))


# fits


@query()
def temporal_fit(spark, d):
    counts, cells = C.log1p_normalize(A.counts(spark, d)), A.count_cells(spark, d)
    genes = [r["gene"] for r in counts.select("gene").distinct().orderBy("gene").collect()]
    factors = M.fit_without_space(*M.sufficient(counts, genes, cells), p=2)
    rows = [(j, g, float(w)) for j, f in enumerate(factors) for g, w in zip(genes, f["w"], strict=True)]
    return rounded(spark.createDataFrame(rows, "program int, gene string, weight double"), 4)


def _fit_cells(spark, d):
    return A.spatial_cells(spark, d).withColumn("fit", F.lit("embeddings"))


@query()
def spectral_fit(spark, d):
    return rounded(MS.fit_all(IO.written(M.spectral_rows(_fit_cells(spark, d), 2.0), "spectral"), 2, 15), 4)


@query()
def spread_fit(spark, d):
    """One fit as passes over rows in all tasks, with few iterations: two programs of 15 genes."""
    return rounded(MS.fit_spread(IO.written(M.spectral_rows(_fit_cells(spark, d), 2.0), "spectral"), "embeddings", 2, 15, most=8, sweeps=1), 4)


@query()
def automatic_rank(spark, d):
    """The estimator with its number of programs chosen by the data: at most 6 of 15 genes."""
    return rounded(MS.fit_all(IO.written(M.spectral_rows(_fit_cells(spark, d), 2.0), "spectral"), 6, 15, auto=True), 4)


@query()
def simulated_recovery(spark, d):
    """One replicate drawn on the table's cells, fitted and matched to the truth."""
    cells, design = A.spatial_cells(spark, d), Y.Design()
    drawn = IO.written(Y.draw(cells, design), "drawn")
    found = M.fit_keys(M.spectral_rows(drawn.select("fit", "slice", "age", "cell", "x", "y", "genes"), design.gamma_space, vectors=False), len(design.age), design.k, gamma_age=design.gamma_age, scores=False).where("kind = 'loading'")
    found = IO.written(found.select(F.col("program").cast("string").alias("program"), F.col("key").alias("gene"), F.col("value").alias("weight")), "found")
    truth = Y.truth(cells, design)[0].drop("fit")
    near = P.distances(truth, found)
    best = P.align(near.select("p", "q", (1 - F.col("hellinger")).alias("cost")))
    return rounded(best.join(near, ["p", "q"]).join(P.matching(truth, found), ["p", "q"]), 4)


@query()
def simulated_study(spark, d):
    """Methods by replicates on the table's cells."""
    return rounded(Y.study(A.spatial_cells(spark, d), Y.Design(), 2), 4)


@query()
def principal_components(spark, d):
    counts, cells = C.log1p_normalize(A.counts(spark, d)), A.count_cells(spark, d)
    genes = [r["gene"] for r in counts.select("gene").distinct().orderBy("gene").collect()]
    _, n, sums, gram = M.sufficient(counts, genes, cells)
    _, singular = Z.pca(gram, sums.sum(axis=0) / n.sum(), float(n.sum()), 5)
    return rounded(spark.createDataFrame([(i, float(s)) for i, s in enumerate(singular)], "component int, singular double"), 4)


# agreement and summaries


@query("SELECT * FROM (VALUES ('t0p60_s0p50', 'temporal', 0.6::DOUBLE, 0.5::DOUBLE, false), ('t0p70_s0p40', 'spatial', 0.7, 0.4, false), ('t0p70_s0p50', 'temporal', 0.7, 0.5, true)) v(setting_id, panel, temporal_rho, spatial_rho, is_baseline)")
def sweep_grid(spark, d):
    return R.sweep_grid(spark, [0.6, 0.7], [0.4, 0.5], (0.7, 0.5))


@query("""WITH e AS (SELECT o_orderstatus AS program, o_orderpriority AS term, o_custkey % 12 AS setting, (o_orderkey * 37 % 1000) / 1000 AS adjusted_p, o_totalprice AS score FROM orders)
    SELECT program, term, count(DISTINCT setting) AS recovered, round(min(adjusted_p), 6) AS least_p, round(median(score), 6) AS median_score, round(count(DISTINCT setting) / 12, 6) AS share FROM e WHERE adjusted_p > 0 AND adjusted_p < 0.05 AND score > 0 GROUP BY 1, 2""")
def term_recurrence(spark, d):
    o = A.table(spark, d, "orders")
    rows = o.select(F.col("o_orderstatus").alias("program"), F.col("o_orderpriority").alias("term"), (F.col("o_custkey") % 12).alias("setting"), (F.col("o_orderkey") * 37 % 1000 / 1000).alias("adjusted_p"), F.col("o_totalprice").alias("score"))
    return rounded(R.recurrence(rows, 12))


@query(f"WITH {POINTS} SELECT celltype AS program, slice, cell, round(avg(y) OVER (PARTITION BY celltype, slice), 6) AS alpha, round(y - avg(y) OVER (PARTITION BY celltype, slice), 6) AS b FROM points")
def score_decomposition(spark, d):
    scores = A.points(spark, d).select(F.col("celltype").alias("program"), "slice", "cell", F.col("y").alias("h"))
    return rounded(R.decomposed(scores).select("program", "slice", "cell", "alpha", "b"))


@query(f"""WITH {SPATIAL}, g AS (SELECT vec_id AS cell, label AS slice, unnest(embedding[3:7]) AS v, generate_subscripts(embedding[3:7], 1) - 1 AS gene FROM embeddings), x AS (SELECT slice, gene, avg(CAST(v AS DOUBLE)) AS x FROM g GROUP BY 1, 2), y AS (SELECT slice, avg(x) AS yx, avg(y) AS yy FROM sp GROUP BY 1),
    r AS (SELECT gene, corr(x, yx) AS r0, corr(x, yy) AS r1 FROM x JOIN y ON y.slice = x.slice GROUP BY gene) SELECT CAST(gene AS BIGINT) AS marker, CASE WHEN abs(r1) > abs(r0) THEN 'y' ELSE 'x' END AS program, round(CASE WHEN abs(r1) > abs(r0) THEN r1 ELSE r0 END, 6) AS r FROM r""")
def best_programs(spark, d):
    cells = A.spatial_cells(spark, d)
    scores = cells.select("cell", F.lit("x").alias("program"), F.col("x").alias("h")).unionByName(cells.select("cell", F.lit("y").alias("program"), F.col("y").alias("h")))
    found = R.weights_by_correlation(A.long_genes(cells).where("gene < 5").drop("slice"), scores, cells)
    return rounded(R.best_program(found.select(F.col("gene").alias("marker"), "program", F.col("weight").alias("r")), signed=True))


@query(f"WITH {POINTS} SELECT slice, round(-quantile_cont(abs(b), 0.99), 6) AS lo, round(quantile_cont(abs(b), 0.99), 6) AS hi FROM points GROUP BY slice")
def colour_limits(spark, d):
    return rounded(R.colour_limits(A.points(spark, d), "b", ["slice"]))


@query(f"WITH {POINTS} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM points")
def simple_regression(spark, d):
    fit = R.ordinary_least_squares(A.points(spark, d), "y", ["x"])
    pick = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    return fit.agg(F.round(pick("x", "estimate"), 6).alias("slope"), F.round(pick("intercept", "estimate"), 5).alias("intercept"), F.round(F.max("r2"), 6).alias("r2"))


@query()
def density_regression(spark, d):
    points = A.points(spark, d)
    near = S.log_density(points.where("celltype = 'view'"), points, 10.0)
    kinds = sorted(r["other_type"] for r in near.select("other_type").distinct().collect())
    wide = near.groupBy("cell").pivot("other_type", kinds).agg(F.first("density")).na.fill(0.0)
    rows = points.join(wide, "cell").withColumns({f"region_{k}": (F.col("region") == k).cast("double") for k in (1, 2)})
    return rounded(R.ordinary_least_squares(rows, "y", ["age", "region_1", "region_2", *kinds]), 4)


@query(f"""WITH {POINTS}, {_nearest(20)}, m AS (SELECT *, coalesce(d <= 6, false) AS near, d IS NULL AS far FROM n), e AS (SELECT other_type, slice, {_EFFECT} FROM m GROUP BY 1, 2 {_ENOUGH}), f AS (SELECT other_type, sum(w * e) / sum(w) AS effect, sum(w * e) / sqrt(sum(w)) AS z FROM e GROUP BY 1),
    p AS (SELECT other_type, effect, {_two_sided("z")} AS p FROM f), k2 AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM p), q AS (SELECT *, least(1, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM k2)
    SELECT 'b' AS program, count(*) AS significant, count(*) FILTER (effect > 0) AS positive, count(*) FILTER (effect < 0) AS negative, max_by(other_type, effect) AS top, min_by(other_type, effect) AS bottom FROM q WHERE q < 0.5 HAVING count(*) > 0""")
def effector_summary(spark, d):
    points = A.points(spark, d)
    effects = T.matched_effects(points.where("celltype = 'view'"), points, "b", 6.0, 20.0).withColumn("p", normal_two_sided("z"))
    return R.effector_summary(T.bh(effects, "p").withColumn("program", F.lit("b")), 0.5)


@query()
def spectral_labels(spark, d):
    cells = A.spatial_cells(spark, d)
    found = IO.written(L.spectral_labels(cells, 3), "spectral-labels").join(cells.select("cell", "celltype"), "cell")  # read by several aggregations
    return rounded(L.matched_accuracy(found, "celltype", "label").crossJoin(L.evaluate(found, "celltype", "label").drop("accuracy")))
