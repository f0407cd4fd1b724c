"""Queries for sources and sinks, recovery, domains over time and summaries; they register beside those of `queries`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.operators import cells as C
from sliceloom.operators import domains as D
from sliceloom.operators import labels as L
from sliceloom.operators import programs as P
from sliceloom.operators import recovery as R
from sliceloom.plans import fit as M
from sliceloom.plans import simulate as Z
from sliceloom.plans import synthetic as Y
from sliceloom.plans.queries import CELLS, COUNTS, POINTS, PROGRAMS, SPATIAL, query, rounded, slices_of
from sliceloom.sources import adapters as A
from sliceloom.sources import tables as IO

# sources and sinks


@query(f"WITH {PROGRAMS} SELECT program, gene, round(weight, 6) AS weight, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS rank FROM pa WHERE weight > 0")
def active_gene_table(spark, d):
    return rounded(IO.active_genes(A.programs(spark, d, "o_orderstatus")))


@query(f"WITH {PROGRAMS} SELECT program, gene, round(weight, 6) AS weight FROM pa")
def loadings_round_trip(spark, d):
    """Long to wide, to gzip CSV, and back."""
    loadings = A.programs(spark, d, "o_orderstatus")
    genes = [r["gene"] for r in A.table(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct().orderBy("gene").collect()]
    IO.write_csv(IO.to_wide(loadings, genes), path := IO.scratch(spark, "loadings"))
    return rounded(IO.to_long(IO.read_csv(spark, path, "program string, " + ", ".join(f"`{g}` double" for g in genes))))


@query(f"WITH {POINTS} SELECT celltype AS part, count(*) AS n, round(sum(y), 4) AS total FROM points GROUP BY 1")
def files_by_type(spark, d):
    """One folder for each cell type, read back with the type as partition column."""
    IO.write_by_type(A.points(spark, d), path := IO.scratch(spark, "types"))
    return spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("SELECT o_orderpriority AS label, regexp_replace(o_orderpriority, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe, count(*) AS n FROM orders GROUP BY 1, 2")
def safe_names(spark, d):
    c = F.col("o_orderpriority")
    return A.table(spark, d, "orders").groupBy(c.alias("label"), IO.safe_name(c).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


# quality control


@query(f"""WITH {POINTS}, a AS (SELECT cell, (x + 1 + region - x) * (abs(y) - 0) AS area FROM points), q AS (SELECT quantile_cont(area, 0.01) AS lo, quantile_cont(area, 0.99) AS hi FROM a)
    SELECT cell, round(area, 6) AS area FROM a, q WHERE area BETWEEN lo AND hi""")
def bbox_band(spark, d):
    boxes = A.points(spark, d).withColumns({"min_x": F.col("x"), "max_x": F.col("x") + 1 + F.col("region"), "min_y": F.lit(0.0), "max_y": F.abs("y")})
    rows = C.bbox_area(boxes).select("cell", "area", F.lit(1.0).alias("total"), F.lit(1).alias("n_genes"))
    return rounded(C.quantile_filter(rows, 0, 0, 0.99, "area", 0.01).select("cell", "area"))


@query(f"WITH {POINTS} SELECT celltype, celltype IN ('view', 'click', 'purchase') AS allowed, count(*) AS n FROM points GROUP BY 1, 2")
def allowed_types(spark, d):
    """Cells by type inside the allow-list, and the report of what it discards."""
    kinds = spark.createDataFrame([("view",), ("click",), ("purchase",)], "celltype string")
    points = A.points(spark, d)
    count = lambda df, v: df.groupBy("celltype").agg(F.count(F.lit(1)).alias("n")).select("celltype", F.lit(v).alias("allowed"), "n")
    return count(points.join(kinds, "celltype", "left_semi"), True).unionByName(count(points.join(kinds, "celltype", "left_anti"), False))


@query(f"WITH {POINTS} SELECT cell, CASE WHEN region = 1 THEN 'L' ELSE 'R' END AS side, CASE celltype WHEN 'view' THEN 2 WHEN 'click' THEN 14 ELSE 42 END AS days FROM points WHERE celltype IN ('view', 'click', 'purchase')")
def side_and_time(spark, d):
    """Side from the last character of an identifier, days from its label; labels without days go."""
    ident = F.concat(F.col("celltype"), F.lit("_"), F.when(F.col("region") == 1, "L").otherwise("R"))
    rows = A.points(spark, d).withColumn("ident", ident)
    days = F.element_at(F.create_map(*[F.lit(v) for kv in (("view", 2), ("click", 14), ("purchase", 42), ("error", 0)) for v in kv]), F.col("celltype"))
    return rows.select("cell", F.right("ident", F.lit(1)).alias("side"), days.alias("days")).where("days > 0")


@query("WITH p AS (SELECT event_id AS cell, (event_id * 37 % 1000) / 1000 AS p FROM events) SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, count(*) AS n FROM p GROUP BY 1")
def significance_stars(spark, d):
    p = F.col("event_id") * 37 % 1000 / 1000
    return A.table(spark, d, "events").groupBy(C.stars(p).alias("stars")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS}, s AS (SELECT DISTINCT slice, age FROM points), m AS (SELECT median(age) AS m FROM (SELECT DISTINCT age FROM s)) SELECT slice, age, CASE WHEN age < m THEN 'Young' ELSE 'Old' END AS half FROM s, m")
def median_age_halves(spark, d):
    return C.median_age_split(slices_of(A.points(spark, d)))


# recovery


@query(f"""WITH {PROGRAMS}, t AS (SELECT chr(CAST(64 + row_number() OVER (ORDER BY program) AS INT)) AS program, p0 FROM (SELECT DISTINCT program, program AS p0 FROM pa)), f AS (SELECT chr(CAST(64 + row_number() OVER (ORDER BY program) AS INT)) AS program, q0 FROM (SELECT DISTINCT program, program AS q0 FROM pb)),
    tr AS (SELECT t.program, gene FROM pa JOIN t ON p0 = pa.program WHERE weight > 0.04), n AS (SELECT program, count(*) AS n FROM tr GROUP BY 1), fo AS (SELECT f.program, gene, row_number() OVER (PARTITION BY f.program ORDER BY abs(weight) DESC, gene) AS r FROM pb JOIN f ON q0 = pb.program)
    SELECT n.program, n, count(tr.gene) AS hits, round(count(tr.gene) / n, 6) AS rate FROM n JOIN fo ON fo.program = n.program AND r <= n LEFT JOIN tr ON tr.program = fo.program AND tr.gene = fo.gene GROUP BY 1, 2""")
def topk_hit_rate(spark, d):
    named = lambda df: df.withColumn("program", F.chr(F.lit(64) + F.dense_rank().over(Window.orderBy("program"))))
    return rounded(R.topk_hit_rate(named(A.programs(spark, d, "o_orderstatus")), named(A.programs(spark, d, "l_returnflag")), 0.04))


THETA = "m AS (SELECT celltype, region, slice, avg(y) AS m, var_pop(y) AS v FROM points GROUP BY 1, 2, 3), theta AS (SELECT celltype AS program, region, var_pop(m) AS age, avg(v) AS space FROM m GROUP BY 1, 2)"


def _theta(spark, d) -> DataFrame:
    means = A.points(spark, d).groupBy("celltype", "region", "slice").agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    return means.groupBy(F.col("celltype").alias("program"), "region").agg(F.var_pop("m").alias("age"), F.avg("v").alias("space"))


@query(f"WITH {POINTS}, {THETA} SELECT round(sqrt(avg((a.age - b.age) ** 2)), 6) AS age_rmse, round(ln(sqrt(avg((a.age - b.age) ** 2))), 6) AS age_log_rmse, round(sqrt(avg((a.space - b.space) ** 2)), 6) AS space_rmse, round(ln(sqrt(avg((a.space - b.space) ** 2))), 6) AS space_log_rmse FROM theta a JOIN theta b ON a.program = b.program WHERE a.region = 0 AND b.region = 1")
def variance_errors(spark, d):
    theta = _theta(spark, d)
    return rounded(R.variance_errors(theta.where("region = 0").drop("region"), theta.where("region = 1").drop("region")))


@query(f"WITH {POINTS}, {THETA} SELECT program, region, round(age / (age + space), 6) AS share FROM theta")
def variance_shares(spark, d):
    return rounded(_theta(spark, d).select("program", "region", R.variance_share(F.col("age"), F.col("space")).alias("share")))


@query(f"WITH {POINTS} SELECT slice, round(avg(y), 6) AS alpha, round(avg(y) - 1.959963984540054 * sqrt(var_samp(y) / count(*)), 6) AS lower, round(avg(y) + 1.959963984540054 * sqrt(var_samp(y) / count(*)), 6) AS upper FROM points GROUP BY 1")
def trajectory_interval(spark, d):
    alpha = A.points(spark, d).groupBy("slice").agg(F.avg("y").alias("alpha"), (F.var_samp("y") / F.count(F.lit(1))).alias("variance"))
    return rounded(R.interval(alpha).select("slice", "alpha", "lower", "upper"))


@query(f"""WITH {COUNTS}, {CELLS}, {PROGRAMS}, h AS (SELECT program, cell, sum(value * weight) AS h FROM counts JOIN pa USING (gene) GROUP BY 1, 2), hh AS (SELECT a.program AS p, b.program AS q, sum(a.h * b.h) AS hh FROM h a JOIN h b USING (cell) GROUP BY 1, 2),
    ww AS (SELECT a.program AS p, b.program AS q, sum(a.weight * b.weight) AS ww FROM pa a JOIN pa b USING (gene) GROUP BY 1, 2), e AS (SELECT p, q, hh * ww AS e FROM hh JOIN ww USING (p, q)), t AS (SELECT sum(e) AS t FROM e) SELECT p AS program, round(e / t, 6) AS fraction, e / t >= 0.1 AS keep FROM e, t WHERE p = q""")
def factor_energy(spark, d):
    loadings = A.programs(spark, d, "o_orderstatus")
    scores = A.counts(spark, d).join(F.broadcast(loadings), "gene").groupBy("program", "cell").agg(F.sum(F.col("value") * F.col("weight")).alias("h"))
    return rounded(R.prune(scores, loadings, 0.0, 0.1))


@query()
def low_rank_signal(spark, d):
    """Share of the centred genes' variance that three directions keep, from the reconstructed cells."""
    cells = A.spatial_cells(spark, d)
    n, mean, gram = _moments(cells)
    signal = R.low_rank_signal(cells, gram, mean, n, 3)
    square = F.aggregate(F.zip_with("signal", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    whole = float(np.trace(gram) - n * (mean @ mean))
    return rounded(signal.agg((F.sum(square) / whole).alias("kept"), F.count(F.lit(1)).alias("cells")))


def _moments(cells: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, gene means and gene Gram matrix: partial sums of each batch, then one row a partition."""

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["genes"].to_list())
                yield pdf.iloc[:1][[]].assign(n=float(len(x)), s=[x.sum(axis=0)], g=[(x.T @ x).ravel()])

    sums = cells.select("genes").mapInPandas(partial, "n double, s array<double>, g array<double>")
    add = lambda c: sums.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    n, s, g = float(sums.agg(F.sum("n")).first()[0]), add("s"), add("g")
    return n, s / n, g.reshape(len(s), len(s))


@query()
def subspace_agreement(spark, d):
    """Agreement of the two tables of programs as subspaces of gene space; programs are few."""
    wide = [A.programs(spark, d, by).toPandas().pivot(index="program", columns="gene", values="weight").fillna(0.0) for by in ("o_orderstatus", "l_returnflag")]
    genes = sorted(set(wide[0]) | set(wide[1]))
    a, b = (w.reindex(columns=genes, fill_value=0.0).to_numpy() for w in wide)
    return rounded(spark.createDataFrame([(R.subspace_similarity(a, b), len(genes))], "similarity double, genes int"))


@query(f"WITH {PROGRAMS}, b AS (SELECT gene, arg_max(program, weight) AS program, max(weight) AS weight FROM (SELECT * FROM pa ORDER BY program) GROUP BY 1) SELECT gene, program, row_number() OVER (ORDER BY program, weight DESC, gene) AS place FROM b")
def gene_order(spark, d):
    """Genes by the program they weigh most in, then by weight."""
    best = A.programs(spark, d, "o_orderstatus").groupBy("gene").agg(F.max_by("program", "weight").alias("program"), F.max("weight").alias("weight"))
    return best.select("gene", "program", F.row_number().over(Window.orderBy("program", F.desc("weight"), "gene")).alias("place"))


# simulation and baselines


@query()
def simulated_counts(spark, d):
    """Counts drawn on the table's cells, summed by tier of genes."""
    design = Y.Design(age=(1.0, 0.5, 0.0, 0.8), space=(0.6, 1.0, 0.8, 0.0))
    rows, tiers, _ = Y.draw_counts(IO.written(Y.draw(A.spatial_cells(spark, d), design), "drawn"), Y.loadings(design), library=500.0, share=0.3)
    named = spark.createDataFrame([(g, str(t)) for g, t in enumerate(tiers)], "gene int, tier string")
    long = rows.select(F.posexplode("counts").alias("gene", "value")).where("value > 0")
    return long.join(F.broadcast(named), "gene").groupBy("tier").agg(F.countDistinct("gene").alias("genes"), F.sum("value").alias("total"))


@query()
def spatial_components(spark, d):
    """Spatial factor model over all slices, with a common loading and a block-diagonal kernel."""
    cells = A.spatial_cells(spark, d).withColumn("fit", F.lit("embeddings"))
    found = Z.spatial_pca_keys(M.spectral_rows(cells, 2.0, vectors=False), 2, scores=False)
    return rounded(found.where("kind in ('tau', 'error', 'loading')"), 4)


# domains over time


@query()
def closest_slices(spark, d):
    return D.closest_slices(slices_of(A.points(spark, d)), [3.0, 3.0, 4.0, 20.0])


@query(f"WITH {POINTS}, s AS (SELECT DISTINCT slice, age FROM points), c AS (SELECT slice, floor(age / 2) * 2 AS age FROM s) SELECT 4 AS target, 2 AS n, (SELECT slice FROM c WHERE age = 4 ORDER BY slice LIMIT 1 OFFSET 1) AS slice UNION ALL SELECT 6, 9, (SELECT max(slice) FROM c WHERE age = 6) UNION ALL SELECT 1001, 2, (SELECT slice FROM c ORDER BY abs(age - 1001), age, slice LIMIT 1)")
def age_occurrences(spark, d):
    paired = slices_of(A.points(spark, d)).withColumn("age", F.floor(F.col("age") / 2) * 2.0)
    return D.occurrences(paired, [(4, 2), (6, 9), (1001, 2)])


@query(f"""WITH {POINTS}, s AS (SELECT slice, CAST(count(*) AS DOUBLE) AS n_cells, median(age) AS age, var_pop(y) AS spread FROM points GROUP BY 1), w AS (SELECT min(n_cells) a, max(n_cells) b, min(spread) c, max(spread) e, min(age) f, max(age) g FROM s)
    SELECT slice, round(CASE WHEN b > a THEN 0.55 * (n_cells - a) / (b - a) ELSE 0 END + CASE WHEN e > c THEN 0.3 * (spread - c) / (e - c) ELSE 0 END + CASE WHEN g > f THEN 0.15 * (age - f) / (g - f) ELSE 0 END, 6) AS score FROM s, w""")
def slice_choice(spark, d):
    s = A.points(spark, d).groupBy("slice").agg(F.count(F.lit(1)).cast("double").alias("n_cells"), F.median("age").alias("age"), F.var_pop("y").alias("spread"))
    return rounded(D.slice_scores(s, {"n_cells": 0.55, "spread": 0.3, "age": 0.15}).select("slice", "score"))


@query(f"""WITH {SPATIAL}, v AS (SELECT var_pop(x) AS vx, var_pop(y) AS vy FROM sp), m AS (SELECT celltype, avg(x) AS mx, avg(y) AS my FROM sp GROUP BY 1) SELECT CASE WHEN vx >= vy THEN 'x' ELSE 'y' END AS component, celltype AS domain FROM m, v ORDER BY CASE WHEN vx >= vy THEN mx ELSE my END, celltype LIMIT 1""")
def start_domain(spark, d):
    cells = A.spatial_cells(spark, d).withColumnRenamed("celltype", "domain")
    return D.start_domain(cells, ["x", "y"])


def _domains(spark, d) -> DataFrame:
    return A.points(spark, d).groupBy(F.col("celltype").alias("domain")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg((F.col("region") == 1).cast("double")).alias("fr"))


@query(f"""WITH {POINTS}, m AS (SELECT celltype AS domain, avg(x) AS mx, avg(y) AS my, avg(CASE WHEN region = 1 THEN 1.0 ELSE 0 END) AS fr FROM points GROUP BY 1), z AS (SELECT domain, (mx - avg(mx) OVER ()) / stddev_samp(mx) OVER () AS zx, (my - avg(my) OVER ()) / stddev_samp(my) OVER () AS zy, (fr - avg(fr) OVER ()) / stddev_samp(fr) OVER () AS zf FROM m),
    r1 AS (SELECT domain FROM z ORDER BY zx DESC, domain LIMIT 1), r2 AS (SELECT domain FROM z WHERE domain NOT IN (FROM r1) ORDER BY zy + zf DESC, domain LIMIT 1)
    SELECT domain, round(zx, 6) AS recovery, round(zy + zf, 6) AS injury, CASE WHEN domain IN (FROM r1) THEN 'recovering' WHEN domain IN (FROM r2) THEN 'injured' ELSE 'unassigned' END AS role FROM z""")
def domain_roles(spark, d):
    found = D.evidence(_domains(spark, d), {"recovery": ["mx"], "injury": ["my", "fr"]})
    return rounded(D.roles(found, {"recovery": "recovering", "injury": "injured"}).select("domain", "recovery", "injury", "role"))


@query()
def labels_over_time(spark, d):
    """Spectral labels of each slice, matched from slice to slice."""
    cells = A.spatial_cells(spark, d)
    found = cells.select("cell", "slice", "age", "x", "y").join(L.spectral_labels(cells, 3).select("cell", "label"), "cell")
    return D.align_over_time(found, ["x", "y"])


@query()
def labels_to_truth(spark, d):
    points = A.points(spark, d).withColumn("truth", F.col("region").cast("string")).withColumn("pred", F.col("celltype"))
    return D.align_to_truth(points, "truth", "pred", ["0", "1", "2"], "slice")


METRICS = "s AS (SELECT celltype AS method, region AS metric, round(avg(y), 0) AS value FROM points GROUP BY 1, 2)"


@query(f"WITH {POINTS}, {METRICS}, r AS (SELECT method, rank() OVER (PARTITION BY metric ORDER BY value DESC) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS r FROM s) SELECT method, round(avg(r), 6) AS mean_rank FROM r GROUP BY 1")
def method_ranks(spark, d):
    scores = A.points(spark, d).groupBy(F.col("celltype").alias("method"), F.col("region").alias("metric")).agg(F.round(F.avg("y"), 0).alias("value"))
    return rounded(D.method_ranks(scores))


# summaries


@query(f"WITH {POINTS}, f AS (SELECT slice, region, avg(CASE WHEN celltype IN ('error', 'signup') THEN 1.0 ELSE 0 END) AS f FROM points GROUP BY 1, 2) SELECT region, round(avg(f), 6) AS mean, round(min(f), 6) AS least, round(max(f), 6) AS most FROM f GROUP BY 1")
def fraction_summary(spark, d):
    """Share of some types in each sample, then its mean and range over samples."""
    f = A.points(spark, d).groupBy("slice", "region").agg(F.avg(F.col("celltype").isin("error", "signup").cast("double")).alias("f"))
    return rounded(f.groupBy("region").agg(F.avg("f").alias("mean"), F.min("f").alias("least"), F.max("f").alias("most")))


@query(f"WITH {POINTS} SELECT slice, CASE WHEN stddev_pop(x) < 1e-12 OR stddev_pop(y) < 1e-12 THEN NULL ELSE round(corr(x, y), 6) END AS r FROM points GROUP BY 1")
def slice_correlation(spark, d):
    safe = F.when((F.stddev_pop("x") >= 1e-12) & (F.stddev_pop("y") >= 1e-12), F.corr("x", "y"))
    return rounded(A.points(spark, d).groupBy("slice").agg(safe.alias("r")))


@query(f"""WITH {PROGRAMS}, t AS (SELECT program, gene FROM (SELECT program, gene, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS r FROM pa) WHERE r <= 8 AND program IN ('F', 'O'))
    SELECT gene, CASE WHEN count(DISTINCT program) = 2 THEN 'common' ELSE min(program) END AS part FROM t GROUP BY 1""")
def set_partition(spark, d):
    """Top genes of two programs as common ones and those of one only."""
    top = P.top_genes(A.programs(spark, d, "o_orderstatus").where("program in ('F', 'O')"), 8)
    return top.groupBy("gene").agg(F.when(F.countDistinct("program") == 2, "common").otherwise(F.min("program")).alias("part"))


@query("""WITH e AS (SELECT o_orderstatus AS program, o_orderpriority || '-' || (o_custkey % 12) AS term, (o_orderkey * 37 % 1000) / 1000 AS p, o_totalprice AS score, o_orderkey AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY p, score DESC, k) AS place FROM e WHERE p > 0 AND p < 0.05 AND score > 0)
    SELECT program, term, p, round(score, 6) AS score, place FROM r WHERE place <= 5""")
def enrichment_panel(spark, d):
    """The five best terms of each program among those that pass."""
    o = A.table(spark, d, "orders")
    e = o.select(F.col("o_orderstatus").alias("program"), F.concat("o_orderpriority", F.lit("-"), (F.col("o_custkey") % 12).cast("string")).alias("term"), (F.col("o_orderkey") * 37 % 1000 / 1000).alias("p"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("k"))
    order = Window.partitionBy("program").orderBy("p", F.desc("score"), "k")
    ranked = e.where("p > 0 and p < 0.05 and score > 0").withColumn("place", F.row_number().over(order))
    return rounded(ranked.where("place <= 5").drop("k"))


@query(f"""WITH {COUNTS}, {CELLS}, n AS (SELECT count(*) AS n FROM cells), m AS (SELECT gene, sum(value) / n AS mu, sqrt(greatest(sum(value * value) / n - (sum(value) / n) ** 2, 0)) AS sd FROM counts, n WHERE upper(gene) IN ('BRAND#11', 'BRAND#12') GROUP BY gene, n), zero AS (SELECT sum(-mu / CASE WHEN sd > 0 THEN sd ELSE 1 END) AS z, count(*) AS g FROM m),
    s AS (SELECT cell, sum(value / CASE WHEN sd > 0 THEN sd ELSE 1 END) AS s FROM counts JOIN m USING (gene) GROUP BY 1) SELECT cell, round((coalesce(s, 0) + z) / g, 6) AS score FROM cells LEFT JOIN s USING (cell), zero""")
def gene_set_score(spark, d):
    """Mean z-score (ddof 0) of the genes of a set that are present, matched without regard to case; absent counts are 0."""
    return rounded(C.set_score(A.counts(spark, d), A.count_cells(spark, d), ["brand#11", "BRAND#12", "missing"]))
