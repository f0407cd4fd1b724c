"""Queries for the proximity tables over several programs; they register beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceloom.operators import proximity as X
from sliceloom.operators import statistics as T
from sliceloom.plans.queries import POINTS, _nearest, _two_sided, query, rounded
from sliceloom.sources import adapters as A

NEAR, FAR, INNER, OUTER = 6.0, 20.0, 5.0, 15.0

_SCORES = f"WITH {POINTS}, {_nearest(FAR)}, t AS (SELECT * FROM points WHERE celltype = 'view'), types AS (SELECT DISTINCT celltype AS effector FROM points), scores AS (SELECT cell, 'P1' AS program, b FROM t UNION ALL SELECT cell, 'P2', b * (1 + region) FROM t), m AS (SELECT s.program, s.b, n.cell, n.slice, n.other_type AS effector, coalesce(d <= {NEAR}, false) AS near, d IS NULL AS far FROM n JOIN scores s ON s.cell = n.cell)"


def _corrected(source: str, out: str, q: str, by: str = "") -> str:
    """SQL: `source` with Benjamini-Hochberg of its p, nulls left out, inside groups."""
    return f"""{out} AS (SELECT * EXCLUDE (_s, _k, m), CASE WHEN p IS NOT NULL THEN least(1, min(_s) OVER (PARTITION BY {by + ", " if by else ""}p IS NULL ORDER BY _k DESC)) END AS {q} FROM (SELECT *, p * m / _k AS _s FROM (SELECT *, count(p) OVER ({"PARTITION BY " + by if by else ""}) AS m, row_number() OVER (PARTITION BY {by + ", " if by else ""}p IS NULL ORDER BY p) AS _k FROM {source})))"""


_BLOCKS = "median(b) FILTER (near) - median(b) FILTER (far) AS e, 1 / (var_samp(b) FILTER (near) / count(*) FILTER (near) + var_samp(b) FILTER (far) / count(*) FILTER (far) + 1e-9) AS w, count(*) FILTER (near) AS nn, count(*) FILTER (far) AS nf"
_EFFECTS = f"""eb AS (SELECT program, effector, slice, {_BLOCKS} FROM m GROUP BY 1, 2, 3 HAVING nn >= 8 AND nf >= 8), es AS (SELECT program, effector, sum(w * e) / sum(w) AS effect, 1 / sqrt(sum(w)) AS se, sum(nn) AS n_near, sum(nf) AS n_far, count(*) AS n_blocks FROM eb GROUP BY 1, 2),
    eg AS (SELECT g.program, y.effector, effect, se, effect / se AS z, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_far, 0) AS BIGINT) AS n_far, coalesce(n_blocks, 0) AS n_blocks FROM (SELECT DISTINCT program FROM scores) g CROSS JOIN types y LEFT JOIN es ON es.program = g.program AND es.effector = y.effector),
    ep AS (SELECT *, CASE WHEN z IS NOT NULL THEN {_two_sided("z")} END AS p FROM eg), {_corrected("ep", "effects", "q_bh")}"""


def _shells(name: str, by_slice: bool) -> str:
    """SQL of a shell table as the last of several tables, `name`."""
    k = "program, slice" if by_slice else "program"
    least, enough = (8, "count(*) >= 16") if by_slice else (30, "true")
    last = _corrected(f"{name}_1", f"{name}_2", "q_bh", "program") + ", " + (_corrected(f"{name}_2", name, "q_bh_by_slice", k) if by_slice else f"{name} AS (SELECT * FROM {name}_2)")
    on = " AND ".join(f"x.{c} = y.{c}" for c in k.split(", "))
    groups = f"{k}, effector"
    return f"""{name}_q AS (SELECT {k}, CASE WHEN {enough} THEN quantile_cont(s.b, 0.75) END AS hi_threshold, CASE WHEN {enough} THEN quantile_cont(s.b, 0.25) END AS lo_threshold FROM scores s JOIN t USING (cell) GROUP BY {k}),
    {name}_m AS (SELECT y.*, x.cell, x.slice AS at, side FROM (SELECT s.*, t.slice FROM scores s JOIN t USING (cell)) x JOIN {name}_q y ON {on}, (VALUES ('hi'), ('lo')) v(side) WHERE CASE side WHEN 'hi' THEN x.b >= hi_threshold ELSE x.b <= lo_threshold END),
    {name}_n AS (SELECT a.{k.replace(", ", ", a.")}, a.side, c.effector, c.n FROM {name}_m a JOIN counted c ON c.cell = a.cell),
    {name}_r AS (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY n) + (count(*) OVER (PARTITION BY {groups}, n) - 1) / 2 AS r, count(*) OVER (PARTITION BY {groups}, n) AS ties FROM {name}_n),
    {name}_s AS (SELECT {groups}, count(*) FILTER (side = 'hi') AS n_hi, count(*) FILTER (side = 'lo') AS n_lo, avg(n) FILTER (side = 'hi') AS hi_mean, avg(n) FILTER (side = 'lo') AS lo_mean, sum(r) FILTER (side = 'hi') AS r, CAST(sum(ties * ties - 1) AS DOUBLE) AS ties FROM {name}_r GROUP BY {groups}),
    {name}_u AS (SELECT *, abs(r - n_hi * (n_hi + 1) / 2 - n_hi * n_lo / 2) AS away, sqrt(n_hi * n_lo / 12 * ((n_hi + n_lo + 1) - ties / ((n_hi + n_lo) * (n_hi + n_lo - 1)))) AS sd FROM {name}_s),
    {name}_z AS (SELECT *, (away - 0.5) / nullif(sd, 0) AS z FROM {name}_u),
    {name}_1 AS (SELECT x.*, y.effector, coalesce(n_hi, 0) AS n_hi, coalesce(n_lo, 0) AS n_lo, hi_mean, lo_mean, coalesce(n_hi >= {least} AND n_lo >= {least}, false) AS valid, CASE WHEN valid THEN log2((hi_mean + 0.05) / (lo_mean + 0.05)) END AS log2fc, CASE WHEN valid THEN CASE WHEN z IS NULL OR z < 0 THEN 1 ELSE {_two_sided("z")} END END AS p
        FROM {name}_q x CROSS JOIN types y LEFT JOIN {name}_z z ON {on.replace("y.", "z.")} AND z.effector = y.effector), {last}"""


_COUNTED = f"counted AS (SELECT t.cell, k.effector, count(p.cell) AS n FROM t CROSS JOIN types k LEFT JOIN points p ON p.slice = t.slice AND p.celltype = k.effector AND p.cell <> t.cell AND sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) > {INNER} AND sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) <= {OUTER} GROUP BY 1, 2)"
_MATCHED = f"""sb AS (SELECT program, slice, effector, count(*) FILTER (near) AS n_near, count(*) FILTER (far) AS n_far, CASE WHEN n_near >= 8 AND n_far >= 8 THEN median(b) FILTER (near) - median(b) FILTER (far) END AS effect, sqrt(var_samp(b) FILTER (near) / n_near + var_samp(b) FILTER (far) / n_far + 1e-9) AS s FROM m GROUP BY 1, 2, 3),
    sz AS (SELECT program, slice, count(*) AS n FROM scores JOIN t USING (cell) GROUP BY 1, 2),
    sg AS (SELECT sz.program, sz.slice, y.effector, effect, CASE WHEN effect IS NOT NULL THEN s END AS se, effect / s AS z, CASE WHEN n >= 16 THEN coalesce(n_near, 0) ELSE 0 END AS n_near, CASE WHEN n >= 16 THEN coalesce(n_far, 0) ELSE 0 END AS n_far, effect IS NOT NULL AS valid FROM sz CROSS JOIN types y LEFT JOIN sb ON sb.program = sz.program AND sb.slice = sz.slice AND sb.effector = y.effector),
    sp AS (SELECT *, CASE WHEN z IS NOT NULL THEN {_two_sided("z")} END AS p FROM sg), {_corrected("sp", "sq", "q_bh", "program")}, {_corrected("sq", "matched", "q_bh_by_slice", "program, slice")}"""


def _tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, scores of two programs, and all cells."""
    points = A.points(spark, d)
    targets = points.where("celltype = 'view'")
    two = F.array(F.struct(F.lit("P1").alias("program"), F.col("b").alias("b")), F.struct(F.lit("P2").alias("program"), (F.col("b") * (1 + F.col("region"))).alias("b")))
    return targets, targets.select("cell", F.explode(two).alias("s")).select("cell", "s.*"), points


@query(f"{_SCORES}, {_EFFECTS} SELECT program, effector, round(effect, 6) AS effect, round(se, 6) AS se, round(z, 6) AS z, round(p, 6) AS p, n_near, n_far, n_blocks, round(q_bh, 6) AS q_bh FROM effects")
def effect_table(spark, d):
    return rounded(X.effect_table(*_tables(spark, d), NEAR, FAR))


@query(f"{_SCORES}, {_EFFECTS} SELECT program, rank, effector, round(effect, 6) AS effect, round(q_bh, 6) AS q_bh FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY abs(effect) DESC, effector) AS rank FROM effects WHERE q_bh < 0.9) WHERE rank <= 3")
def significant_effectors(spark, d):
    """With a mild cut: the events know no real effects."""
    return rounded(X.significant_effectors(X.effect_table(*_tables(spark, d), NEAR, FAR), 0.9, 3))


_SHELL_COLUMNS = "round(hi_threshold, 6) AS hi_threshold, round(lo_threshold, 6) AS lo_threshold, n_hi, n_lo, round(hi_mean, 6) AS hi_mean, round(lo_mean, 6) AS lo_mean, round(log2fc, 6) AS log2fc, round(p, 6) AS p, round(q_bh, 6) AS q_bh"


@query(f"{_SCORES}, {_COUNTED}, {_shells('whole', False)} SELECT program, effector, {_SHELL_COLUMNS}, valid FROM whole")
def all_slice_enrichment(spark, d):
    return rounded(X.shell_table(*_tables(spark, d), INNER, OUTER))


@query(f"{_SCORES}, {_COUNTED}, {_shells('inside', True)} SELECT program, slice, effector, {_SHELL_COLUMNS}, round(q_bh_by_slice, 6) AS q_bh_by_slice, valid FROM inside")
def per_slice_enrichment(spark, d):
    return rounded(X.shell_table(*_tables(spark, d), INNER, OUTER, by_slice=True))


@query(f"{_SCORES}, {_MATCHED} SELECT program, slice, effector, round(effect, 6) AS effect, round(se, 6) AS se, round(z, 6) AS z, round(p, 6) AS p, n_near, n_far, round(q_bh, 6) AS q_bh, round(q_bh_by_slice, 6) AS q_bh_by_slice, valid FROM matched")
def per_slice_matched(spark, d):
    return rounded(X.slice_table(*_tables(spark, d), NEAR, FAR))


@query(f"""{_SCORES}, {_COUNTED}, {_EFFECTS}, {_MATCHED}, {_shells("whole", False)}, {_shells("inside", True)},
    w AS (SELECT program, count(DISTINCT effector) AS n_effectors_tested, count(*) FILTER (valid AND q_bh < 0.05) AS n_all_slice_enrichment_sig, coalesce(arg_min(effector, (-log2fc, effector)) FILTER (valid), '') AS top_all_slice_enriched_effector, coalesce(arg_min(effector, (log2fc, effector)) FILTER (valid), '') AS top_all_slice_depleted_effector FROM whole GROUP BY 1),
    i AS (SELECT program, count(DISTINCT slice) AS n_slices_tested, count(*) FILTER (q_bh_by_slice < 0.05) AS n_per_slice_enrichment_sig FROM inside GROUP BY 1),
    a AS (SELECT program, count(*) FILTER (q_bh_by_slice < 0.05) AS n_per_slice_matched_sig FROM matched GROUP BY 1),
    e AS (SELECT program, count(*) FILTER (q_bh < 0.05) AS n_global_matched_sig, coalesce(string_agg(effector, '|' ORDER BY effector) FILTER (q_bh < 0.05), '') AS global_matched_sig_effectors FROM effects GROUP BY 1)
    SELECT * FROM w JOIN i USING (program) JOIN a USING (program) JOIN e USING (program)""")
def downstream_summary(spark, d):
    return X.downstream(*_tables(spark, d), NEAR, FAR, INNER, OUTER)["summary"]


@query(f"{_SCORES}, k2 AS (SELECT program, effector, slice FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND count(*) FILTER (near) >= 5 AND count(*) FILTER (far) >= 5) SELECT program, effector, slice, cell, CASE WHEN near THEN 'near' ELSE 'far' END AS side, round(b, 6) AS b FROM m JOIN k2 USING (program, effector, slice) WHERE near OR far")
def near_far_samples(spark, d):
    return rounded(X.near_far_samples(*_tables(spark, d), NEAR, FAR))


@query()
def violin_effects(spark, d):
    """Targets are all cells, and the radii wide: the small tables have few cells in a slice."""
    points = A.points(spark, d)
    return rounded(X.violin_effects(points, points.select("cell", F.lit("P1").alias("program"), "b"), points, 40.0, 60.0))


@query()
def program_summary(spark, d):
    """With permutations of one type of effector for either program."""
    targets, scores, others = _tables(spark, d)
    null = None
    for name in ("P1", "P2"):
        own = targets.drop("b").join(scores.where(F.col("program") == name), "cell")
        found = T.permutation_null(own, others, "click", "b", NEAR, FAR).select(F.lit(name).alias("program"), F.lit("click").alias("effector"), "observed", "p")
        null = found if null is None else null.unionByName(found)
    return rounded(X.program_summary(X.effect_table(targets, scores, others, NEAR, FAR), null, targets))
