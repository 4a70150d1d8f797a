"""Every operator as a query on the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.special import erfc_sql
from helixframe.operators import de, embedding, graphs, hvg, labels, metrics, moments, preprocess, similarity, splits, vocab
from helixframe.plans import tables as t
from helixframe.plans.registry import ORACLES, QUERIES, query, rounded  # noqa: F401
from helixframe.plans.tables import sql

CONTROL = "5-LOW"


# Totals and normalization

_TOTALS = ", tot AS (SELECT obs.cell, coalesce(sum(value), 0.0) AS total FROM obs LEFT JOIN c1 USING (cell) GROUP BY 1)"


@query(sql("c1 obs", _TOTALS + " SELECT cell, round(total, 6) + 0.0 AS total FROM tot"))
def cell_totals(spark, d):
    return rounded(moments.cell_totals(t.order_counts(spark, d), t.order_obs(spark, d)))


_WITH_TOTAL = ", w AS (SELECT *, sum(value) OVER (PARTITION BY cell) AS total FROM c1)"


@query(sql("c1", _WITH_TOTAL + " SELECT cell, gene, round(CASE WHEN total = 0 THEN 0 ELSE value / (total / 10000.0) END, 6) + 0.0 AS value FROM w"))
def normalize_total(spark, d):
    return rounded(preprocess.normalize_total(t.order_counts(spark, d), t.order_obs(spark, d), 1e4))


@query(sql("c1", _WITH_TOTAL + ", m AS (SELECT median(total) AS med FROM (SELECT DISTINCT cell, total FROM w) WHERE total > 0) SELECT cell, gene, round(value / (total / med), 6) + 0.0 AS value FROM w, m WHERE total > 0"))
def normalize_median(spark, d):
    return rounded(preprocess.normalize_total(t.order_counts(spark, d), t.order_obs(spark, d)))


_HIGH = ", tot AS (SELECT cell, sum(value) AS total FROM c2 GROUP BY 1), high AS (SELECT DISTINCT gene FROM c2 JOIN tot USING (cell) WHERE value > total * 0.4)"


@query(sql("c2", _HIGH + " SELECT gene FROM high"))
def highly_expressed_genes(spark, d):
    x = t.user_counts(spark, d)
    return moments.dominating_genes(x, moments.cell_totals(x, t.user_obs(spark, d)), 0.4)


@query(sql("c2", _HIGH + ", r AS (SELECT cell, coalesce(sum(value) FILTER (WHERE gene NOT IN (SELECT gene FROM high)), 0.0) AS total FROM c2 GROUP BY 1) SELECT cell, gene, round(CASE WHEN total = 0 THEN 0 ELSE value / (total / 100.0) END, 6) + 0.0 AS value FROM c2 JOIN r USING (cell)"))
def normalize_exclude_high(spark, d):
    return rounded(preprocess.normalize_total(t.user_counts(spark, d), t.user_obs(spark, d), 100.0, True, 0.4))


@query(sql("c1", "SELECT cell, gene, round(ln(1 + value), 6) + 0.0 AS value FROM c1"))
def log1p(spark, d):
    return rounded(preprocess.log1p(t.order_counts(spark, d)))


# Moments

_MOMENTS = ", n AS (SELECT count(*)::DOUBLE AS n FROM obs), mv AS (SELECT gene, sum(value) / n AS mean, greatest(0, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1)) AS variance FROM c1, n GROUP BY gene, n)"


@query(sql("c1 obs", _MOMENTS + " SELECT gene, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance FROM mv"))
def gene_mean_var(spark, d):
    return rounded(moments.mean_var(t.order_counts(spark, d), t.order_obs(spark, d)))


@query(sql("c1", "SELECT gene, round(avg(value), 6) + 0.0 AS mean, round(var_samp(value), 6) + 0.0 AS variance FROM c1 GROUP BY gene"))
def gene_mean_var_nonzero(spark, d):
    return rounded(moments.mean_var(t.order_counts(spark, d), t.order_obs(spark, d), False))


_GROUPS = """, sz AS (SELECT pert AS grp, count(*)::DOUBLE AS n FROM obs GROUP BY 1), sp AS (SELECT gene, grp, n FROM (SELECT DISTINCT gene FROM c1), sz),
gs AS (SELECT gene, pert AS grp, count(*) AS k, sum(value) AS s1, sum(value * value) AS s2 FROM c1 JOIN obs USING (cell) GROUP BY 1, 2),
g AS (SELECT sp.gene, sp.grp, n, coalesce(k, 0) AS k, coalesce(s1, 0.0) AS s1, coalesce(s2, 0.0) AS s2 FROM sp LEFT JOIN gs ON sp.gene = gs.gene AND sp.grp = gs.grp)"""


@query(sql("c1 obs", _GROUPS + " SELECT gene, grp, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS nonzero, round(s1 / n, 6) + 0.0 AS mean, round(greatest(0, (s2 - s1 * s1 / n) / (n - 1)), 6) + 0.0 AS variance FROM g"))
def group_mean_var(spark, d):
    return rounded(moments.group_mean_var(t.order_counts(spark, d), t.order_obs(spark, d), "pert"))


@query(sql("c1 obs", _MOMENTS + " SELECT gene, round(sum(least(value, mean + 2 * sqrt(variance))), 4) + 0.0 AS total, round(sum(power(least(value, mean + 2 * sqrt(variance)), 2)), 4) + 0.0 AS squares FROM c1 JOIN mv USING (gene) GROUP BY gene"))
def clipped_moments(spark, d):
    x = t.order_counts(spark, d)
    clips = moments.mean_var(x, t.order_obs(spark, d)).select("gene", (F.col("mean") + 2 * F.sqrt("variance")).alias("clip"))
    return rounded(moments.clipped_moments(x, clips), 4)


_WITH_MOMENTS = ", n AS (SELECT count(*)::DOUBLE AS n FROM obs), s AS (SELECT *, sum(value) OVER (PARTITION BY gene) AS s1, sum(value * value) OVER (PARTITION BY gene) AS s2 FROM c1), mv AS (SELECT cell, gene, value, s1 / n AS mean, greatest(0, (s2 - s1 * s1 / n) / (n - 1)) AS variance FROM s, n)"


@query(sql("c1 obs", _WITH_MOMENTS + " SELECT cell, gene, round((value - mean) / sqrt(variance), 6) + 0.0 AS value FROM mv"))
def scale(spark, d):
    return rounded(preprocess.scale(t.order_counts(spark, d), t.order_obs(spark, d)))


@query(sql("c1 obs", _WITH_MOMENTS + " SELECT cell, gene, round(least(2.0, value / sqrt(variance)), 6) + 0.0 AS value FROM mv"))
def scale_clipped(spark, d):
    return rounded(preprocess.scale(t.order_counts(spark, d), t.order_obs(spark, d), False, 2.0))


@query(sql("c1 obs", ", n AS (SELECT count(*)::DOUBLE AS n FROM obs WHERE batch = 'F'), b AS (SELECT c1.*, batch = 'F' AS chosen FROM c1 JOIN obs USING (cell)), s AS (SELECT *, sum(value) FILTER (WHERE chosen) OVER (PARTITION BY gene) AS s1, sum(value * value) FILTER (WHERE chosen) OVER (PARTITION BY gene) AS s2 FROM b) SELECT cell, gene, round(CASE WHEN chosen THEN (value - s1 / n) / sqrt((s2 - s1 * s1 / n) / (n - 1)) ELSE value END, 6) + 0.0 AS value FROM s, n"))
def scale_masked(spark, d):
    return rounded(preprocess.scale(t.order_counts(spark, d), t.order_obs(spark, d), mask="batch = 'F'"))


@query(sql("e1", ", m AS (SELECT gene, avg(value) AS mean, stddev_samp(value) AS std FROM e1 GROUP BY gene) SELECT cell, gene, round((value - mean) / std, 6) + 0.0 AS value FROM e1 JOIN m USING (gene)"))
def scale_dense(spark, d):
    x = t.vectors(spark, d)
    return rounded(preprocess.scale(x.select("cell", "gene", "value"), x.select("cell").distinct(), dense=True))


@query(sql("c1 obs", _GROUPS + f" SELECT a.gene, round(a.s1 / a.n - b.s1 / b.n, 6) + 0.0 AS delta FROM g a JOIN g b ON a.gene = b.gene WHERE a.grp = '1-URGENT' AND b.grp = '{CONTROL}'"))
def pseudobulk_delta(spark, d):
    o = t.order_obs(spark, d)
    return rounded(moments.pseudobulk_delta(t.order_counts(spark, d), o.filter("pert = '1-URGENT'"), o.filter(F.col("pert") == CONTROL)))


# Differential expression

_LFC = "log2((a.s1 / a.n + 1e-9) / (b.s1 / b.n + 1e-9))"
_PAIR = f"FROM g a JOIN g b ON a.gene = b.gene WHERE a.grp <> '{CONTROL}' AND b.grp = '{CONTROL}'"


@query(sql("c1 obs", _GROUPS + f" SELECT a.gene, a.grp AS target, round(a.s1 / a.n - b.s1 / b.n, 6) + 0.0 AS mean_diff, round({_LFC}, 6) + 0.0 AS log2_fold_change {_PAIR}"))
def log_fold_change(spark, d):
    return rounded(de.log_fold_change(t.order_counts(spark, d), t.order_obs(spark, d), "pert", CONTROL))


def _t_sql(kind: str) -> str:
    var = lambda x: f"(greatest(0, {x}.s2 / {x}.n - ({x}.s1 / {x}.n) * ({x}.s1 / {x}.n)) * {x}.n / ({x}.n - 1))"
    v1, v0 = var("a"), var("b")
    if kind == "student":
        se, df = f"sqrt(((b.n - 1) * {v0} + (a.n - 1) * {v1}) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))", "a.n + b.n - 2"
    else:
        q0, q1 = f"({v0} / b.n)", f"({v1} / a.n)"
        se, df = f"sqrt({q0} + {q1})", f"({q0} + {q1}) * ({q0} + {q1}) / ({q0} * {q0} / (b.n - 1) + {q1} * {q1} / (a.n - 1))"
    z = "(abs(s) / sqrt(1.0 + s * s / df) / sqrt(2.0))"
    return sql("c1 obs", _GROUPS + f", tt AS (SELECT a.gene, a.grp AS target, (a.s1 / a.n - b.s1 / b.n) / {se} AS s, {df} AS df, a.s1 / a.n - b.s1 / b.n AS md, {_LFC} AS l {_PAIR}) SELECT gene, target, round(s, 6) + 0.0 AS statistic, round(df, 4) + 0.0 AS df, round(least(1.0, {erfc_sql(z)}), 6) + 0.0 AS p_value, round(md, 6) + 0.0 AS mean_diff, round(l, 6) + 0.0 AS log2_fold_change FROM tt")


def _t_query(spark, d, kind):
    out = de.t_test(t.order_counts(spark, d), t.order_obs(spark, d), "pert", CONTROL, kind)
    return rounded(out.withColumn("df", F.round("df", 4)))


@query(_t_sql("student"))
def ttest_student(spark, d):
    return _t_query(spark, d, "student")


@query(_t_sql("welch"))
def ttest_welch(spark, d):
    return _t_query(spark, d, "welch")


#: The exact tail: the continued fraction of the incomplete beta function, folded over a list of its terms.
_EXACT = """, x AS (SELECT *, CASE WHEN df / (df + s * s) < (df / 2 + 1) / (df / 2 + 2.5) THEN df / 2 ELSE 0.5 END AS p, CASE WHEN df / (df + s * s) < (df / 2 + 1) / (df / 2 + 2.5) THEN 0.5 ELSE df / 2 END AS q FROM tt),
z AS (SELECT *, CASE WHEN q = 0.5 THEN df ELSE s * s END / (df + s * s) AS z, exp(lgamma((df + 1) / 2) - lgamma(df / 2) - lgamma(0.5) + df / 2 * ln(df / (df + s * s)) + 0.5 * ln(s * s / (df + s * s))) AS front FROM x),
h AS (SELECT *, list_reduce(list_prepend({'c': CAST(1.0 AS DOUBLE), 'd': 1 / (1 - (p + q) * z / (p + 1)), 'h': 1 / (1 - (p + q) * z / (p + 1)), 's': CAST(0.0 AS DOUBLE)},
          list_transform(range(2, 600), lambda j: {'c': CAST(1.0 AS DOUBLE), 'd': CAST(1.0 AS DOUBLE), 'h': CAST(1.0 AS DOUBLE), 's': CASE WHEN j % 2 = 0 THEN (j // 2) * (q - j // 2) * z / ((p + j - 1) * (p + j)) ELSE -(p + j // 2) * (p + q + j // 2) * z / ((p + j - 1) * (p + j)) END})),
          lambda a, t: {'c': 1 + t.s / a.c, 'd': 1 / (1 + t.s * a.d), 'h': a.h * (1 + t.s / a.c) / (1 + t.s * a.d), 's': t.s}).h AS h FROM z)
SELECT gene, target, round(s, 6) + 0.0 AS statistic, round(df, 6) + 0.0 AS df, round(CASE WHEN s = 0 THEN 1.0 WHEN q = 0.5 THEN front * h / p ELSE 1 - front * h / p END, 6) + 0.0 AS p_value, round(md, 6) + 0.0 AS mean_diff, round(l, 6) + 0.0 AS log2_fold_change FROM h"""


@query(_t_sql("welch").split(" SELECT gene, target, round(s, 6)")[0] + _EXACT)
def ttest_welch_exact(spark, d):
    return rounded(de.t_test(t.order_counts(spark, d), t.order_obs(spark, d), "pert", CONTROL, "welch", "exact"))


_U = f"""{_GROUPS}, h AS (SELECT gene, pert AS grp, value AS v, count(*)::DOUBLE AS c FROM c1 JOIN obs USING (cell) WHERE value <> 0 GROUP BY 1, 2, 3
UNION ALL SELECT gene, grp, 0.0, n - k FROM g WHERE n - k > 0),
r AS (SELECT gene, v, sum(c) AS c FROM h WHERE grp = '{CONTROL}' GROUP BY 1, 2),
rc AS (SELECT gene, v, c, sum(c) OVER (PARTITION BY gene ORDER BY v) AS upto FROM r),
rt AS (SELECT gene, sum(c * c * c - c) AS ties FROM r GROUP BY 1),
p AS (SELECT h.gene, h.grp, h.c, coalesce(e.c, 0.0) AS eq, coalesce((SELECT max(b.upto) FROM rc b WHERE b.gene = h.gene AND b.v < h.v), 0.0) AS below FROM h LEFT JOIN r e ON e.gene = h.gene AND e.v = h.v WHERE h.grp <> '{CONTROL}'),
us AS (SELECT p.gene, p.grp AS target, sum(c * (below + 0.5 * eq)) AS u, any_value(ties) + sum((c + eq) * (c + eq) * (c + eq) - (c + eq) - (eq * eq * eq - eq)) AS tie_sum FROM p JOIN rt USING (gene) GROUP BY 1, 2),
w AS (SELECT us.*, a.n AS n1, b.n AS n0, sqrt(b.n * a.n / 12 * ((a.n + b.n + 1) - tie_sum / ((a.n + b.n) * (a.n + b.n - 1)))) AS sd FROM us JOIN sz a ON a.grp = target, sz b WHERE b.grp = '{CONTROL}'),
x AS (SELECT gene, target, u, tie_sum, (abs(u - n0 * n1 / 2) - 0.5) / sd AS z FROM w),
rs AS (SELECT gene, target, u, tie_sum, z, least(1.0, {erfc_sql("(z / sqrt(2.0))")}) AS p_value FROM x)"""


@query(sql("c1 obs", _U + " SELECT gene, target, u, tie_sum, round(z, 6) + 0.0 AS z, round(p_value, 6) + 0.0 AS p_value FROM rs"))
def rank_sum(spark, d):
    return rounded(de.rank_sum(t.order_counts(spark, d), t.order_obs(spark, d), "pert", CONTROL))


_DE = _U + f""", l AS (SELECT a.gene, a.grp AS target, {_LFC} AS lfc {_PAIR}),
k AS (SELECT rs.*, lfc, row_number() OVER (ORDER BY p_value, gene, target) AS i, count(*) OVER () AS m FROM rs JOIN l USING (gene, target)),
q AS (SELECT *, least(1.0, min(p_value * m / i) OVER (ORDER BY i DESC)) AS fdr FROM k),
tab AS (SELECT target, gene AS feature, u AS statistic, p_value, power(2.0, greatest(-20, least(20, lfc))) AS fold_change, greatest(-20, least(20, lfc)) AS log2_fold_change, fdr FROM q)"""
_TAB = "target, feature, statistic, round(p_value, 6) + 0.0 AS p_value, round(fold_change, 6) + 0.0 AS fold_change, round(log2_fold_change, 6) + 0.0 AS log2_fold_change, round(fdr, 6) + 0.0 AS fdr"


def _de(spark, d):
    return de.differential_expression(t.order_counts(spark, d), t.order_obs(spark, d), "pert", CONTROL)


@query(sql("c1 obs", _DE + f" SELECT {_TAB} FROM tab"))
def de_rank_sum(spark, d):
    return rounded(_de(spark, d))


@query(sql("c1 obs", _DE + f" SELECT {_TAB}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_value, statistic DESC, feature) AS rank FROM tab) WHERE rank <= 5"))
def de_ranked(spark, d):
    return rounded(de.ranked(_de(spark, d), 5))


@query(sql("c1 obs", _GROUPS + " SELECT gene, grp AS target, round(k / n, 6) + 0.0 AS pts, round((sum(k) OVER (PARTITION BY gene) - k) / (sum(n) OVER (PARTITION BY gene) - n), 6) + 0.0 AS pts_rest FROM g"))
def de_expressing_fractions(spark, d):
    return rounded(de.expressing_fractions(t.order_counts(spark, d), t.order_obs(spark, d), "pert"))


def _p_table(spark, d):
    return t.table(spark, d, "part").select("p_partkey", (F.pmod("p_partkey", F.lit(997)) / 1000.0).alias("p_value"))


_P = "p AS (SELECT p_partkey, (p_partkey % 997) / 1000.0::DOUBLE AS p_value FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p_value, p_partkey) AS i, count(*) OVER () AS m FROM p)"


@query(f"WITH {_P} SELECT p_partkey, p_value, round(least(1.0, min(p_value * m / i) OVER (ORDER BY i DESC)), 6) + 0.0 AS fdr FROM k")
def fdr_bh(spark, d):
    return rounded(de.adjusted(_p_table(spark, d)))


@query(f"WITH {_P}, h AS (SELECT sum(1.0::DOUBLE / i) AS h FROM k) SELECT p_partkey, p_value, round(least(1.0, min(p_value * m * h / i) OVER (ORDER BY i DESC)), 6) + 0.0 AS fdr FROM k, h")
def fdr_by(spark, d):
    return rounded(de.adjusted(_p_table(spark, d), method="by"), 6)


@query(f"WITH {_P} SELECT p_partkey, p_value, round(least(1.0, p_value * m), 6) + 0.0 AS fdr FROM k")
def fdr_bonferroni(spark, d):
    return rounded(de.adjusted(_p_table(spark, d), method="bonferroni"))


# Highly variable genes

_DISP = _MOMENTS + ", dd AS (SELECT gene, greatest(mean, 1e-12) AS mean, CASE WHEN variance > 0 THEN variance / greatest(mean, 1e-12) END AS disp FROM mv)"


@query(sql("c1 obs", _DISP + """, e AS (SELECT unnest(quantile_cont(mean, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])) AS edge FROM dd),
b AS (SELECT dd.*, (SELECT count(DISTINCT edge) FROM e WHERE edge < mean) AS mean_bin FROM dd), m AS (SELECT mean_bin, median(disp) AS mid, mad(disp) / 0.6744897501960817 AS dev FROM b GROUP BY 1)
SELECT gene, round(mean, 6) + 0.0 AS means, round(disp, 6) + 0.0 AS dispersions, CAST(mean_bin AS INTEGER) AS mean_bin, round((disp - mid) / nullif(dev, 0), 4) + 0.0 AS dispersions_norm FROM b JOIN m USING (mean_bin)"""))
def hvg_cell_ranger(spark, d):
    out = hvg.dispersions(t.order_counts(spark, d), t.order_obs(spark, d), "cell_ranger").drop("batch")
    return rounded(out.withColumn("dispersions_norm", F.round("dispersions_norm", 4)))


_SEURAT = """, n AS (SELECT {b}count(*)::DOUBLE AS n FROM obs {gb}), s AS (SELECT {b}gene, sum(exp(x) - 1) AS s1, sum(power(exp(x) - 1, 2)) AS s2 FROM (SELECT cell, gene, ln(1 + value) AS x FROM c1) JOIN obs USING (cell) GROUP BY {b}gene),
mv AS (SELECT {b}gene, s1 / n AS mean, (s2 - s1 * s1 / n) / (n - 1) / (s1 / n) AS disp FROM s {jn}),
l AS (SELECT {b}gene, ln(1 + mean) AS means, ln(disp) AS dispersions FROM mv), r AS (SELECT *, min(means) OVER ({p}) AS lo, max(means) OVER ({p}) AS hi FROM l),
bi AS (SELECT *, CAST(greatest(0, least(19, ceil((means - lo) / ((hi - lo) / 20)) - 1)) AS INTEGER) AS mean_bin FROM r),
nm AS (SELECT {b}gene, means, dispersions, mean_bin, CASE WHEN count(*) OVER ({pb}mean_bin) = 1 THEN 1.0 ELSE (dispersions - avg(dispersions) OVER ({pb}mean_bin)) / stddev_samp(dispersions) OVER ({pb}mean_bin) END AS norm FROM bi)"""
_ONE = _SEURAT.format(b="", gb="", jn=", n", p="", pb="PARTITION BY ")
_MANY = _SEURAT.format(b="batch, ", gb="GROUP BY batch", jn="JOIN n USING (batch)", p="PARTITION BY batch", pb="PARTITION BY batch, ")


def _logged(spark, d):
    return preprocess.log1p(t.order_counts(spark, d))


@query(sql("c1 obs", _ONE + " SELECT gene, round(means, 6) + 0.0 AS means, round(dispersions, 6) + 0.0 AS dispersions, round(norm, 4) + 0.0 AS dispersions_norm, 1 AS n_batches, CAST(printf('%.8e', norm) AS DOUBLE) >= (SELECT min(v) FROM (SELECT CAST(printf('%.8e', norm) AS DOUBLE) AS v FROM nm ORDER BY v DESC, gene LIMIT 8)) AS highly_variable FROM nm"))
def hvg_seurat(spark, d):
    out = hvg.highly_variable(_logged(spark, d), t.order_obs(spark, d), n_top=8)
    return rounded(out.withColumn("dispersions_norm", F.round("dispersions_norm", 4)))


@query(sql("c1 obs", _MANY + ", f AS (SELECT *, means > 0.0125 AND means < 3 AND norm > 0.5 AS flag FROM nm) SELECT gene, round(avg(means), 6) + 0.0 AS means, round(avg(dispersions), 6) + 0.0 AS dispersions, round(avg(norm), 4) + 0.0 AS dispersions_norm, CAST(sum(flag::INT) AS INTEGER) AS n_batches, avg(means) > 0.0125 AND avg(means) < 3 AND avg(norm) > 0.5 AS highly_variable FROM f GROUP BY gene"))
def hvg_batched(spark, d):
    out = hvg.highly_variable(_logged(spark, d), t.order_obs(spark, d), batch="batch")
    return rounded(out.withColumn("dispersions_norm", F.round("dispersions_norm", 4)))


@query(sql("c1 obs", _MANY + ", f AS (SELECT *, CAST(printf('%.8e', norm) AS DOUBLE) AS x, row_number() OVER (PARTITION BY batch ORDER BY CAST(printf('%.8e', norm) AS DOUBLE) DESC NULLS LAST, gene) AS r FROM nm), cut AS (SELECT batch, min(x) FILTER (WHERE r <= 8) AS nth FROM f GROUP BY batch), g AS (SELECT gene, avg(norm) AS v, CAST(sum(coalesce(x >= nth, false)::INT) AS INTEGER) AS n_batches FROM f JOIN cut USING (batch) GROUP BY gene) SELECT gene, n_batches, row_number() OVER (ORDER BY n_batches DESC, CAST(printf('%.8e', v) AS DOUBLE) DESC NULLS LAST, gene) <= 8 AS highly_variable FROM g"))
def hvg_batched_top(spark, d):
    return hvg.highly_variable(_logged(spark, d), t.order_obs(spark, d), n_top=8, batch="batch").select("gene", "n_batches", "highly_variable")


@query(sql("c1 obs", _MOMENTS + " SELECT gene, round(mean, 6) + 0.0 AS means, round(variance, 6) + 0.0 AS variances, round(variance / mean, 6) + 0.0 AS ratio, CAST(row_number() OVER (ORDER BY variance / mean DESC, gene) AS INTEGER) AS rank FROM mv ORDER BY rank LIMIT 10"))
def hvg_simple(spark, d):
    return rounded(hvg.simple_variable(t.order_counts(spark, d), t.order_obs(spark, d), 10))


#: The local quadratic fit by Cramer's rule on the weighted normal equations of each gene's nearest third.
_LOCAL = """, mv AS (SELECT batch, gene, n, coalesce(s1, 0) / n AS mean, greatest(0, (coalesce(s2, 0) - coalesce(s1, 0) * coalesce(s1, 0) / n) / (n - 1)) AS var
  FROM (SELECT batch, count(*)::DOUBLE AS n FROM obs GROUP BY 1) CROSS JOIN (SELECT DISTINCT gene FROM c1) LEFT JOIN (SELECT batch, gene, sum(value) AS s1, sum(value * value) AS s2 FROM c1 JOIN obs USING (cell) GROUP BY 1, 2) USING (batch, gene)),
pts AS (SELECT batch, gene, log10(mean) AS x, log10(var) AS y, count(*) OVER (PARTITION BY batch) AS m FROM mv WHERE var > 0),
nb AS (SELECT a.batch, a.gene, b.x - a.x AS d, b.y, row_number() OVER (PARTITION BY a.batch, a.gene ORDER BY abs(b.x - a.x), b.x) AS r, least(a.m, greatest(3, ceil(0.3 * a.m))) AS k FROM pts a JOIN pts b USING (batch)),
wt AS (SELECT batch, gene, d / f AS d, y, power(1 - power(abs(d) / (f * 1.0000001), 3), 3) AS w FROM (SELECT *, max(abs(d)) OVER (PARTITION BY batch, gene) AS f FROM nb WHERE r <= k)),
s AS (SELECT batch, gene, sum(w) AS a, sum(w * d) AS b, sum(w * d * d) AS c, sum(w * d * d * d) AS e, sum(w * d * d * d * d) AS f, sum(w * y) AS p, sum(w * d * y) AS q, sum(w * d * d * y) AS r FROM wt GROUP BY 1, 2),
fit AS (SELECT batch, gene, (p * (c * f - e * e) - b * (q * f - e * r) + c * (q * e - c * r)) / (a * (c * f - e * e) - b * (b * f - c * e) + c * (b * e - c * c)) AS y FROM s),
reg AS (SELECT mv.*, coalesce(sqrt(power(10, y)), 1.0) AS reg FROM mv LEFT JOIN fit USING (batch, gene)),
cs AS (SELECT batch, gene, sum(least(value, reg * sqrt(n) + mean)) AS s1, sum(power(least(value, reg * sqrt(n) + mean), 2)) AS s2 FROM c1 JOIN obs USING (cell) JOIN reg USING (batch, gene) GROUP BY 1, 2),
nm AS (SELECT batch, gene, (n * mean * mean + coalesce(s2, 0) - 2 * mean * coalesce(s1, 0)) / ((n - 1) * reg * reg) AS norm FROM reg LEFT JOIN cs USING (batch, gene)),
rk AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY norm DESC, gene) - 1 AS r FROM nm),
g AS (SELECT gene, avg(norm) AS v, median(CASE WHEN r < 10 THEN r END) AS m, CAST(count(*) FILTER (WHERE r < 10) AS INTEGER) AS b FROM rk GROUP BY 1)
SELECT gene, round(v, 6) + 0.0 AS variances_norm, m AS median_rank, b AS n_batches, row_number() OVER (ORDER BY m NULLS LAST, b DESC, gene) <= 10 AS highly_variable FROM g"""


@query(sql("c1 obs", _LOCAL))
def hvg_regularized(spark, d):
    return rounded(hvg.regularized_variance(t.order_counts(spark, d), t.order_obs(spark, d), 10, batch="batch"))


# Metrics

_BULK = ", k AS (SELECT gene, avg(value) FILTER (WHERE label = 1) AS p, avg(value) FILTER (WHERE label = 2) AS t, avg(value) FILTER (WHERE label = 0) AS c FROM e1 GROUP BY gene)"


def _vector_sql(p: str, q: str, end: str) -> str:
    return f"round(1 - sum(({q} - {p}) * ({q} - {p})) / (var_pop({q}) * count(*)), 6) + 0.0 AS r2{end}, round(corr({p}, {q}), 6) + 0.0 AS pearson{end}, round(avg(power({q} - {p}, 2)), 6) + 0.0 AS mse{end}, round(sqrt(avg(power({q} - {p}, 2))), 6) + 0.0 AS rmse{end}, round(avg(abs({q} - {p})), 6) + 0.0 AS mae{end}, round(sum({p} * {q}) / sqrt(sum({p} * {p}) * sum({q} * {q})), 6) + 0.0 AS cosine{end}, round(sqrt(sum(power({q} - {p}, 2))), 6) + 0.0 AS l2{end}"


def _triplet(spark, d):
    return tuple(t.labelled(spark, d, k) for k in (1, 2, 0))


@query(sql("e1", _BULK + f" SELECT {_vector_sql('p', 't', '')}, {_vector_sql('(p - c)', '(t - c)', '_delta')} FROM k"))
def expression_metrics(spark, d):
    return rounded(metrics.evaluate_perturbation(*_triplet(spark, d)))


@query(sql("e1", _BULK + ", f AS (SELECT p - c > 0 AS a, t - c > 0 AS b FROM k) SELECT round(avg((a = b)::INT::DOUBLE), 6) + 0.0 AS direction_accuracy, count(*) AS n_genes, count(*) FILTER (WHERE a = b) AS n_correct, count(*) FILTER (WHERE a AND b) AS n_both_up, count(*) FILTER (WHERE NOT a AND NOT b) AS n_both_down, count(*) FILTER (WHERE a <> b) AS n_opposite FROM f"))
def direction_metrics(spark, d):
    return rounded(metrics.direction_metrics(*_triplet(spark, d)))


@query(sql("e1", ", k AS (SELECT a.gene, avg(exp(-power(a.value - b.value, 2))) FILTER (WHERE a.label = 1 AND b.label = 1) + avg(exp(-power(a.value - b.value, 2))) FILTER (WHERE a.label = 2 AND b.label = 2) - 2 * avg(exp(-power(a.value - b.value, 2))) FILTER (WHERE a.label = 1 AND b.label = 2) AS m FROM e1 a JOIN e1 b ON a.gene = b.gene AND a.label IN (1, 2) AND b.label IN (1, 2) GROUP BY 1) SELECT gene, round(m, 6) + 0.0 AS mmd FROM k"))
def mmd_per_gene(spark, d):
    return rounded(metrics.mmd(*_triplet(spark, d)[:2], per_gene=True))


@query(sql("e1", ", v AS (SELECT gene, value, count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 2) AS b FROM e1 WHERE label IN (1, 2) GROUP BY 1, 2), f AS (SELECT gene, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY gene) - sum(b) OVER w / sum(b) OVER (PARTITION BY gene)) * (lead(value) OVER w - value) AS d FROM v WINDOW w AS (PARTITION BY gene ORDER BY value)) SELECT gene, round(sum(d), 6) + 0.0 AS wasserstein FROM f GROUP BY gene"))
def wasserstein_per_gene(spark, d):
    return rounded(metrics.wasserstein(*_triplet(spark, d)[:2], per_gene=True))


def _overlap_sql(tops: list[int], p_values: list[float], fdrs: list[float]) -> str:
    part = lambda name, column, cuts: f"SELECT '{name}<0' || replace(CAST(c AS VARCHAR), '.', '') || '_DEG_Overlap', round((SELECT count(*) FROM a JOIN b USING (feature) WHERE a.{column} < c AND b.{column} < c) / nullif((SELECT count(*) FROM b WHERE {column} < c), 0)::DOUBLE, 6) + 0.0 FROM (SELECT unnest({cuts}::DOUBLE[]) AS c)"
    return sql("c1 obs", _DE + f""", a AS (SELECT * FROM tab WHERE target = '1-URGENT'), b AS (SELECT * FROM tab WHERE target = '2-HIGH'),
ra AS (SELECT feature, row_number() OVER (ORDER BY p_value, feature) AS r FROM a), rb AS (SELECT feature, row_number() OVER (ORDER BY p_value, feature) AS r FROM b)
SELECT 'Top' || n || '_DEG_Overlap' AS metric, CASE WHEN n <= 25 THEN round((SELECT count(*) FROM ra JOIN rb USING (feature) WHERE ra.r <= n AND rb.r <= n) / n::DOUBLE, 6) + 0.0 END AS value FROM (SELECT unnest({tops}) AS n)
UNION ALL {part("P", "p_value", p_values)} UNION ALL {part("FDR", "fdr", fdrs)}""")


@query(_overlap_sql([5, 10, 50], [0.5, 0.25], [0.95]))
def deg_overlap(spark, d):
    table = _de(spark, d)
    return rounded(metrics.deg_overlap(table.filter("target = '1-URGENT'"), table.filter("target = '2-HIGH'"), (5, 10, 50), (0.5, 0.25), (0.95,)))


_CONF = "WITH c AS (SELECT CAST(quality AS VARCHAR) AS orig, CAST(toxic AS VARCHAR) AS new, count(*)::DOUBLE AS c FROM labels GROUP BY 1, 2), l AS (SELECT orig AS l FROM c UNION SELECT new FROM c), g AS (SELECT a.l AS orig, b.l AS new FROM l a, l b), f AS (SELECT g.orig, g.new, coalesce(c, 0.0) AS c FROM g LEFT JOIN c ON c.orig = g.orig AND c.new = g.new)"


@query(_CONF + " SELECT orig, new, c AS value FROM f")
def confusion_counts(spark, d):
    return metrics.confusion_matrix(t.table(spark, d, "labels"), "quality", "toxic", False)


@query(_CONF + " SELECT orig, new, round(c / sum(c) OVER (PARTITION BY orig), 6) + 0.0 AS value FROM f")
def confusion_normalized(spark, d):
    return rounded(metrics.confusion_matrix(t.table(spark, d, "labels"), "quality", "toxic"))


_SPACE = ", s AS (SELECT gene AS variable, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM e1 GROUP BY 1), j AS (SELECT a.gene AS variable, a.value AS x, b.value AS y, weight AS w FROM ring JOIN e1 a ON a.cell = source JOIN e1 b ON b.cell = target AND b.gene = a.gene)"


def _nodes(spark, d):
    return t.vectors(spark, d).select(F.col("cell").alias("node"), F.col("gene").alias("variable"), "value")


@query(sql("e1 ring", _SPACE + " SELECT variable, round(any_value(n) / sum(w) * sum(w * (x - m) * (y - m)) / any_value(ss), 6) + 0.0 AS morans_i FROM j JOIN s USING (variable) GROUP BY 1"))
def morans_i(spark, d):
    return rounded(metrics.morans_i(t.ring(spark, d), _nodes(spark, d)))


@query(sql("e1 ring", _SPACE + " SELECT variable, round((any_value(n) - 1) * sum(w * (x - y) * (x - y)) / (2 * sum(w) * any_value(ss)), 6) + 0.0 AS gearys_c FROM j JOIN s USING (variable) GROUP BY 1"))
def gearys_c(spark, d):
    return rounded(metrics.gearys_c(t.ring(spark, d), _nodes(spark, d)))


@query(sql("e1", ", m AS (SELECT label, gene, avg(value) AS v FROM e1 GROUP BY 1, 2), k AS (SELECT a.label, a.v AS p, b.v AS t FROM m a JOIN m b ON a.gene = b.gene AND b.label = 0) SELECT label AS perturbation, round(avg(power(t - p, 2)), 6) + 0.0 AS mse, round(corr(p, t), 6) + 0.0 AS pearson, round(1 - sum(power(t - p, 2)) / (var_pop(t) * count(*)), 6) + 0.0 AS r2, round(avg(abs(t - p)), 6) + 0.0 AS mae FROM k GROUP BY 1"))
def perturbation_metrics(spark, d):
    x = t.vectors(spark, d)
    base = x.filter("label = 0").groupBy("gene").agg(F.avg("value").alias("true"))
    return rounded(metrics.perturbation_metrics(x.join(base, "gene").select("gene", F.col("label").alias("perturbation"), F.col("value").alias("pred"), "true")))


# Similarities and graphs

_PROJ = ", n AS (SELECT source AS s, count(*)::DOUBLE AS n FROM ann GROUP BY 1), p AS (SELECT a.source AS x, b.source AS y, count(*)::DOUBLE AS c FROM ann a JOIN ann b ON a.target = b.target AND a.source < b.source GROUP BY 1, 2), w AS (SELECT x, y, {f} AS weight FROM p JOIN n i ON i.s = x JOIN n j ON j.s = y), f AS (SELECT x AS source, y AS target, weight FROM w WHERE weight > {t} UNION ALL SELECT y, x, weight FROM w WHERE weight > {t})"
_FORMS = {"jaccard": "c / (i.n + j.n - c)", "overlap": "c / least(i.n, j.n)", "cosine": "c / sqrt(i.n * j.n)"}


def _projection(kind: str) -> None:
    def run(spark, d):
        return similarity.project(t.annotation(spark, d), kind, 0.15, digits=6)

    run.__name__ = f"set_similarity_{kind}"
    query(sql("ann", _PROJ.format(f=_FORMS[kind], t=0.15) + " SELECT source, target, round(weight, 6) + 0.0 AS weight FROM f"))(run)


for _kind in _FORMS:
    _projection(_kind)


@query(sql("ann", _PROJ.format(f=_FORMS["jaccard"], t=0.1) + " SELECT source, target, round(weight, 6) + 0.0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) AS r FROM f) WHERE r <= 3"))
def graph_top_k(spark, d):
    return rounded(similarity.annotation_graph(t.annotation(spark, d).toDF("gene", "term"), k=3))


_CORR = ", r AS (SELECT a.gene AS source, b.gene AS target, abs(corr(a.value, b.value)) AS weight FROM e1 a JOIN e1 b ON a.cell = b.cell WHERE a.label = 0 AND b.label = 0 GROUP BY 1, 2)"


@query(sql("e1", _CORR + " SELECT source, target, round(weight, 6) + 0.0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY source = target DESC, weight DESC, target) AS k FROM r) WHERE k <= 5 AND source <> target AND weight > 0.1"))
def coexpression(spark, d):
    x = t.labelled(spark, d, 0)
    return rounded(similarity.coexpression(x, x.select("cell").distinct(), 0.1, 5))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, d):
    e = t.table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("_e"))
    return rounded(e.withColumnRenamed("vec_id", "a").join(other, "a").select("a", "b", similarity.vector_cosine(F.col("embedding"), F.col("_e")).alias("cosine")))


@query("SELECT p_brand AS a, p_type AS b, round(sum(p_size), 6) + 0.0 AS weight FROM part GROUP BY 1, 2")
def graph_adjacency(spark, d):
    return rounded(graphs.adjacency(t.table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.col("p_size").cast("double").alias("weight"))).toDF("a", "b", "weight"))


@query(sql("ann", ", e AS (SELECT source, target FROM ann) SELECT c_custkey AS node, CAST(count(source) AS DOUBLE) AS degree FROM customer LEFT JOIN e ON source = c_custkey GROUP BY 1"))
def bipartite_degree(spark, d):
    return graphs.degree(t.annotation(spark, d), t.table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query("SELECT n_nationkey AS node, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS neighbors FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def bipartite_query(spark, d):
    e = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("target"))
    return graphs.neighbors(e, t.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))).withColumn("neighbors", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ","))


_CLOSURE = ", nodes AS (SELECT parent AS node FROM dag UNION SELECT child FROM dag), r(node, dist) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM dag) UNION SELECT child, dist + 1 FROM r JOIN dag ON node = parent)"


@query(sql("dag", _CLOSURE + " SELECT node, min(dist) AS level, max(dist) AS depth FROM r GROUP BY node", True))
def dag_levels(spark, d):
    return graphs.levels(t.hierarchy(spark, d))


@query(sql("dag", ", a(node, other) AS (SELECT child, parent FROM dag UNION SELECT node, parent FROM a JOIN dag ON other = child) SELECT node, other FROM a", True))
def dag_ancestors(spark, d):
    e = t.hierarchy(spark, d)
    return graphs.reachable(e, e.select(F.col("child").alias("node")).distinct(), True)


@query(sql("dag", ", nodes AS (SELECT parent AS node FROM dag UNION SELECT child FROM dag) SELECT node, 'root' AS kind FROM nodes WHERE node NOT IN (SELECT child FROM dag) UNION ALL SELECT node, 'leaf' FROM nodes WHERE node NOT IN (SELECT parent FROM dag)"))
def dag_roots_leaves(spark, d):
    e = t.hierarchy(spark, d)
    return graphs.roots(e).withColumn("kind", F.lit("root")).union(graphs.leaves(e).withColumn("kind", F.lit("leaf")))


@query(sql("dag", ", e AS (SELECT child AS x, parent AS y FROM dag), p AS (SELECT a.x AS source, b.x AS target FROM e a JOIN e b ON a.y = b.y AND a.x <> b.x) SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM p GROUP BY 1, 2"))
def hypergraph_clique(spark, d):
    h = t.hierarchy(spark, d).groupBy(F.col("parent").alias("edge_id")).agg(F.collect_list("child").alias("participants"))
    return graphs.clique_expansion(h)


# Vocabularies and gene maps


@query("SELECT c_name AS query, n_name AS symbol, n_nationkey AS id, (SELECT count(*) FROM customer b WHERE b.c_nationkey = n_nationkey) AS n_aliases FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'nobody', NULL, NULL, NULL")
def gene_map_query(spark, d):
    a, i = t.aliases(spark, d)
    asked = a.select(F.col("alias").alias("query")).union(spark.range(1).select(F.lit("nobody")))
    return vocab.gene_records(asked, a, i).select("query", "symbol", "id", F.when(F.col("aliases").isNotNull(), F.size("aliases").cast("long")).alias("n_aliases"))


@query("WITH a AS (SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT count(DISTINCT c_name) AS n_aliases, count(*) AS n_alias_edges, count(DISTINCT n_name) AS n_symbols, (SELECT count(DISTINCT n_nationkey) FROM nation) AS n_ids, (SELECT count(*) FROM nation) AS n_id_edges, round(count(DISTINCT c_name) / count(DISTINCT n_name)::DOUBLE, 6) + 0.0 AS aliases_per_symbol FROM a")
def gene_map_coverage(spark, d):
    return rounded(vocab.coverage(*t.aliases(spark, d)))


@query("WITH g AS (SELECT n_nationkey, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT true AS is_function, true AS is_total_function, true AS is_partial_function, max(c) <= 1 AS is_injective, min(c) >= 1 AS is_surjective, max(c) <= 1 AND min(c) >= 1 AND (SELECT count(*) FROM supplier) = (SELECT count(*) FROM nation) AS is_bijective FROM g")
def map_is_function(spark, d):
    s, n = t.table(spark, d, "supplier"), t.table(spark, d, "nation")
    return graphs.map_properties(s.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target")), s.select(F.col("s_suppkey").alias("node")), n.select(F.col("n_nationkey").alias("node")))


@query("WITH v AS (SELECT n_name AS token, row_number() OVER (ORDER BY n_name) - 1 AS idx FROM nation), q AS (SELECT DISTINCT n_name AS token FROM nation UNION SELECT p_brand FROM part) SELECT q.token, CAST(coalesce(idx, -1) AS BIGINT) AS idx FROM q LEFT JOIN v USING (token)")
def vocab_lookup(spark, d):
    n = t.table(spark, d, "nation")
    asked = n.select(F.col("n_name").alias("token")).union(t.table(spark, d, "part").select("p_brand")).distinct()
    return vocab.lookup_indices(asked, graphs.numbered(n, "n_name"))


_ALIGN = ", want AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT p_brand AS token FROM part WHERE p_brand LIKE '%1%' UNION ALL SELECT 'Absent'))"


@query(sql("c1", _ALIGN + " SELECT cell, CAST(idx AS BIGINT) AS gene, value FROM c1 JOIN want ON token = gene"))
def align_genes(spark, d):
    x = t.order_counts(spark, d)
    brands = t.table(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    want = graphs.numbered(brands.filter("gene LIKE '%1%'").union(spark.range(1).select(F.lit("Absent"))), "gene")
    return vocab.align_genes(x, brands.withColumn("gene_name", F.col("gene")), want)[0]


# Splits and samples

_HASH = "md5('{s}:' || CAST({k} AS VARCHAR))"


@query(sql("obs", f", p AS (SELECT cell, row_number() OVER (ORDER BY {_HASH.format(s=42, k='cell')}, cell) AS i, count(*) OVER () AS n FROM obs) SELECT cell, CASE WHEN i <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM p"))
def split_simple(spark, d):
    return splits.split_cells(t.order_obs(spark, d)).select("cell", "split")


@query(sql("obs", f", p AS (SELECT cell, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY {_HASH.format(s=42, k='cell')}, cell) AS i, count(*) OVER (PARTITION BY cell_type) AS n FROM obs) SELECT cell, CASE WHEN i <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM p"))
def split_stratified(spark, d):
    return splits.split_cells(t.order_obs(spark, d), stratify="cell_type").select("cell", "split")


@query(sql("obs", f", p AS (SELECT cell, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY {_HASH.format(s=42, k='cell')}, cell) AS i FROM obs) SELECT cell, cell_type FROM p WHERE i <= 50"))
def sample_balanced(spark, d):
    return splits.sample_by_group(t.order_obs(spark, d), "cell_type", 50, balance=True).select("cell", "cell_type")


_U01 = "((CAST('0x' || substr(md5('{s}:' || {k}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


@query("WITH o AS (SELECT o_orderkey AS cell, ln(" + _U01.format(s=42, k="CAST(o_orderkey AS VARCHAR)") + ") / o_totalprice AS k FROM orders WHERE o_totalprice > 0) SELECT cell FROM o ORDER BY k DESC, cell LIMIT 100")
def sample_weighted(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), "o_totalprice")
    return splits.sample_weighted(o, "o_totalprice", 100).select("cell")


_PERTS = """, lb AS (SELECT DISTINCT label AS perturbation FROM combo),
mk AS (SELECT perturbation, list_filter(list_transform(string_split(perturbation, '+'), lambda x: trim(x)), lambda x: x NOT IN ('', 'control')) AS genes, contains(perturbation, '+') AS combo FROM lb),
gs AS (SELECT DISTINCT unnest(genes) AS gene FROM mk WHERE NOT combo), gp AS (SELECT gene, row_number() OVER (ORDER BY md5('42:' || gene), gene) AS i, count(*) OVER () AS n FROM gs),
tr AS (SELECT gene FROM gp WHERE i <= floor(n * 0.7::DOUBLE)),
mg AS (SELECT DISTINCT perturbation, combo, unnest(genes) AS gene FROM mk),
cn AS (SELECT perturbation, count(*) AS n_genes, count(*) FILTER (WHERE gene IN (SELECT gene FROM tr)) AS n_trained FROM mg GROUP BY 1),
told AS (SELECT mk.perturbation, combo, coalesce(n_genes, 0) AS n_genes, coalesce(n_trained, 0) AS n_trained FROM mk LEFT JOIN cn USING (perturbation))"""
_DEALT = ", st AS ({states}), pl AS (SELECT perturbation, state, row_number() OVER (PARTITION BY state ORDER BY md5('44:' || perturbation), perturbation) AS i, count(*) OVER (PARTITION BY state) AS n FROM st) SELECT perturbation, CASE WHEN state = 'train' THEN 'train' WHEN i <= floor(n * ({share})::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pl"
_SIMULATED = "SELECT perturbation, CASE WHEN CASE WHEN b THEN i <= floor(n * 0.7::DOUBLE) ELSE NOT combo AND n_trained = n_genes END THEN 'train' ELSE 'held' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY md5('43:' || perturbation), perturbation) AS i, count(*) OVER (PARTITION BY b) AS n FROM (SELECT *, combo AND n_trained >= 2 AS b FROM told {where}))"


def _perturbations(spark, d):
    return t.combinations(spark, d).select(F.col("label").alias("perturbation"))


@query(sql("combo", _PERTS + _DEALT.format(states=_SIMULATED.format(where=""), share="0.1::DOUBLE / (0.2::DOUBLE + 0.1::DOUBLE)")))
def split_simulation(spark, d):
    return splits.split_perturbations(_perturbations(spark, d), ["control"], "simulation", val_size=0.1)


@query(sql("combo", _PERTS + _DEALT.format(states=_SIMULATED.format(where="WHERE NOT combo"), share="0")))
def split_simulation_single(spark, d):
    return splits.split_perturbations(_perturbations(spark, d), ["control"], "simulation_single")


@query(sql("combo", _PERTS + _DEALT.format(states="SELECT perturbation, CASE WHEN combo AND n_trained = 1 THEN 'held' ELSE 'train' END AS state FROM told WHERE combo OR n_trained = n_genes", share="0")))
def split_combo_seen(spark, d):
    return splits.split_perturbations(_perturbations(spark, d), ["control"], "combo_seen", seen=1)


_PLAIN = ", lb AS (SELECT DISTINCT label AS perturbation FROM combo), p AS (SELECT perturbation, row_number() OVER (ORDER BY md5('42:' || perturbation), perturbation) AS i, count(*) OVER () AS n FROM lb) SELECT perturbation, CASE WHEN i <= floor(n * {t}::DOUBLE) THEN 'test' WHEN i <= floor(n * {t}::DOUBLE) + floor(n * {v}::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM p"


@query(sql("combo", _PLAIN.format(t=0.2, v=0.1)))
def split_perturbations_simple(spark, d):
    return splits.split_perturbations(_perturbations(spark, d), ["control"], "simple", val_size=0.1)


@query(sql("combo", _PLAIN.format(t=0.0, v=0.2)))
def split_perturbations_no_test(spark, d):
    return splits.split_perturbations(_perturbations(spark, d), ["control"], "no_test", val_size=0.2)


@query(sql("obs", ", pool AS (SELECT cell, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY md5('42:' || cell), cell) AS i FROM obs WHERE pert = '" + CONTROL + "'), sz AS (SELECT cell_type, count(*) AS n FROM pool GROUP BY 1), dr AS (SELECT cell, cell_type, pert, unnest([0, 1]) AS draw FROM obs), wa AS (SELECT dr.*, CAST(floor(" + _U01.format(s=43, k="dr.cell || ':' || dr.draw") + " * n) AS BIGINT) + 1 AS want FROM dr JOIN sz USING (cell_type)) SELECT wa.cell, CAST(draw AS BIGINT) AS draw, CASE WHEN pert = '" + CONTROL + "' THEN wa.cell ELSE pool.cell END AS control_cell FROM wa LEFT JOIN pool ON pool.cell_type = wa.cell_type AND pool.i = wa.want"))
def pair_controls(spark, d):
    return splits.pair_controls(t.order_obs(spark, d), "pert", [CONTROL], 2, "cell_type")


# Labels and embeddings


@query(sql("combo", ", s AS (SELECT cell, label, list_sort(list_distinct(list_filter(list_transform(string_split(label, '+'), lambda x: trim(x)), lambda x: x <> ''))) AS p FROM combo) SELECT cell, label, CASE WHEN label = 'control' THEN 'ctrl' WHEN len(p) = 1 THEN p[1] || '+ctrl' ELSE array_to_string(p, '+') END AS condition FROM s"))
def condition_labels(spark, d):
    return labels.formatted(t.combinations(spark, d), "label").select("cell", "label", "condition")


@query(sql("combo", "SELECT DISTINCT gene FROM (SELECT unnest(list_transform(string_split(label, '+'), lambda x: trim(x))) AS gene FROM combo) WHERE gene NOT IN ('', 'control', 'ctrl')"))
def combo_genes(spark, d):
    return labels.genes_of(t.combinations(spark, d).select(F.col("label").alias("perturbation")))


@query(sql("c2", ", e AS (SELECT cell, quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM c2 GROUP BY 1) SELECT cell, gene, CAST(greatest(1, len(list_filter(q, lambda x: x <= value))) AS INTEGER) AS bin FROM c2 JOIN e USING (cell)"))
def expression_binning(spark, d):
    return embedding.expression_bins(t.user_counts(spark, d), 6)


_EMB = ", x AS (SELECT user_id AS cell, CAST(user_id % 7 AS BIGINT) * 50 + length(event_type) AS gene, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2), tt AS (SELECT cell, sum(value) AS t, count(*) FILTER (WHERE value > 0) AS k FROM x GROUP BY 1)"


def _embedded(spark, d, mode):
    x = t.table(spark, d, "events").groupBy(F.col("user_id").alias("cell"), (F.pmod("user_id", F.lit(7)) * 50 + F.length("event_type")).alias("gene")).agg(F.count("*").cast("double").alias("value"))
    return rounded(embedding.cell_embeddings(x, t.table(spark, d, "embeddings").select(F.col("vec_id").alias("gene"), F.col("embedding").alias("vector")), mode))


@query(sql("e1", _EMB + " SELECT x.cell, e1.gene AS dim, round(sum(x.value * e1.value) / greatest(any_value(t), 1e-8), 6) + 0.0 AS value FROM x JOIN e1 ON x.gene = e1.cell JOIN tt ON tt.cell = x.cell GROUP BY 1, 2"))
def cell_embedding_weighted(spark, d):
    return _embedded(spark, d, "weighted")


@query(sql("e1", _EMB + " SELECT x.cell, e1.gene AS dim, round(sum(x.value * e1.value) / greatest(any_value(k), 1), 6) + 0.0 AS value FROM x JOIN e1 ON x.gene = e1.cell JOIN tt ON tt.cell = x.cell GROUP BY 1, 2"))
def cell_embedding_average(spark, d):
    return _embedded(spark, d, "average")


@query(sql("e1", _BULK + " SELECT round(avg(power(p - t, 2)) + 0.001 * avg(power(sign(p - c)::DOUBLE - sign(t - c)::DOUBLE, 2)), 6) + 0.0 AS loss FROM k"))
def direction_loss(spark, d):
    p, q, c = _triplet(spark, d)
    v = metrics.evaluation_vectors(p, q).join(c.groupBy("gene").agg(F.avg("value").alias("ctrl")), "gene")
    return rounded(metrics.direction_loss(v))


@query(sql("c1 obs", "SELECT cell, cell_type, CAST(dense_rank() OVER (ORDER BY cell_type) - 1 AS INTEGER) AS cell_type_idx, coalesce(string_agg(gene, ',' ORDER BY gene), '') AS genes, round(coalesce(sum(value), 0), 6) + 0.0 AS total FROM obs LEFT JOIN c1 USING (cell) GROUP BY cell, cell_type"))
def cell_records(spark, d):
    r = embedding.records(t.order_counts(spark, d), t.order_obs(spark, d))
    total = F.aggregate(F.coalesce("values", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)
    return rounded(r.select("cell", "cell_type", "cell_type_idx", F.coalesce(F.array_join("indices", ","), F.lit("")).alias("genes"), total.alias("total")))


# Further surface


@query("SELECT 0 AS k, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS coefficient FROM lineitem UNION ALL SELECT 1, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 FROM lineitem")
def polynomial_fit(spark, d):
    points = t.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(spark.createDataFrame(list(enumerate(moments.polynomial_fit(points, 1))), "k int, coefficient double"), 4)


@query(sql("dag", _CLOSURE + ", lv AS (SELECT node, min(dist) AS level, max(dist) AS depth FROM r GROUP BY node) SELECT count(*) AS n_nodes, max(level) AS max_level, max(depth) AS max_depth, (SELECT count(*) FROM dag) AS n_edges, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT child FROM dag)) AS n_roots, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT parent FROM dag)) AS n_leaves, round((SELECT count(*) FROM dag) / count(*)::DOUBLE, 6) + 0.0 AS avg_children FROM lv", True))
def dag_stats(spark, d):
    return rounded(graphs.dag_stats(t.hierarchy(spark, d)))


@query("SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target, n_regionkey = r_regionkey AS connected FROM region, nation")
def dag_has_path(spark, d):
    pairs = t.table(spark, d, "region").crossJoin(t.table(spark, d, "nation")).select(F.concat(F.lit("r"), "r_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    return graphs.has_path(t.hierarchy(spark, d), pairs)


@query(sql("dag", ", e AS (SELECT child AS x, parent AS y FROM dag) SELECT DISTINCT a.x AS node, b.x AS neighbor FROM e a JOIN e b ON a.y = b.y AND a.x <> b.x"))
def hypergraph_neighbors(spark, d):
    h = t.hierarchy(spark, d).groupBy(F.col("parent").alias("edge_id")).agg(F.collect_list("child").alias("participants"))
    return graphs.co_participants(h)


@query(sql("ann", "SELECT a.source AS node, count(DISTINCT b.source) - 1 AS degree FROM ann a JOIN ann b USING (target) GROUP BY 1"))
def hypergraph_degrees(spark, d):
    return graphs.co_degrees(t.annotation(spark, d).groupBy(F.col("target").alias("edge_id")).agg(F.collect_list("source").alias("participants")))


@query(sql("dag", "SELECT parent AS source, child AS target FROM dag WHERE parent IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1) AND child LIKE 's%'"))
def graph_subgraph(spark, d):
    nations = t.table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    suppliers = t.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graphs.subgraph(t.hierarchy(spark, d).toDF("source", "target"), nations.union(suppliers))


@query("WITH e AS (SELECT DISTINCT c_nationkey AS a, o_custkey % 25 AS b FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a AS source, b AS target, 1.0::DOUBLE AS weight FROM e UNION ALL SELECT b, a, 1.0 FROM e WHERE a <> b AND NOT EXISTS (SELECT 1 FROM e x WHERE x.a = e.b AND x.b = e.a)")
def graph_from_table(spark, d):
    o = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graphs.graph_from_table(o.select(F.col("c_nationkey").cast("long").alias("source"), F.pmod("o_custkey", F.lit(25)).cast("long").alias("target")).distinct())


_VOCABS = "WITH a AS (SELECT p_type AS token, row_number() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)), b AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT p_type AS token FROM part WHERE p_type > 'L' UNION ALL SELECT 'other'))"


def _vocabs(spark, d):
    types = t.table(spark, d, "part").select("p_type").distinct()
    return graphs.numbered(types, "p_type"), graphs.numbered(types.filter("p_type > 'L'").union(spark.range(1).select(F.lit("other"))), "p_type")


@query(_VOCABS + " SELECT CAST(row_number() OVER (ORDER BY o, idx) - 1 AS BIGINT) AS idx, token FROM (SELECT 0 AS o, idx, token FROM a UNION ALL SELECT 1, idx, token FROM b WHERE token NOT IN (SELECT token FROM a))")
def vocab_union(spark, d):
    return vocab.union(*_vocabs(spark, d))


@query(_VOCABS + " SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS idx, token FROM a WHERE token IN (SELECT token FROM b)")
def vocab_intersection(spark, d):
    return vocab.intersection(*_vocabs(spark, d))


@query(sql("obs", "SELECT cell, pert = '5-LOW' AS is_control, pert NOT IN ('5-LOW', '3-MEDIUM') AS is_perturbed FROM obs"))
def perturbation_flags(spark, d):
    return labels.flags(t.order_obs(spark, d), "pert", [CONTROL], ["3-MEDIUM"]).select("cell", "is_control", "is_perturbed")


@query(sql("combo", "SELECT cell, label FROM combo WHERE len(list_filter(list_transform(string_split(label, '+'), lambda x: trim(x)), lambda x: x NOT IN ('control', 'F', '1-URGENT', '2-HIGH'))) = 0"))
def allowed_perturbations(spark, d):
    genes = spark.createDataFrame([("F",), ("1-URGENT",), ("2-HIGH",)], "gene string")
    return labels.allowed(t.combinations(spark, d).withColumnRenamed("label", "perturbation"), genes).select("cell", F.col("perturbation").alias("label"))


@query(sql("e1", _BULK + " SELECT gene, (p - c > 0) = (t - c > 0) AS same_direction FROM k"))
def direction_per_gene(spark, d):
    return metrics.direction_per_gene(*_triplet(spark, d))


def _long(oracle: str) -> str:
    return f"SELECT metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({oracle})) ON COLUMNS(*) INTO NAME metric VALUE value)"


def _exact(oracle: str) -> str:
    """The SQL of a query before it rounds, for one that rounds itself."""
    return oracle.replace(", 6) + 0.0", ", 15) + 0.0")


_FAMILIES = [_long(_exact(ORACLES["expression_metrics"])), _long(f"SELECT (SELECT avg(mmd) FROM ({_exact(ORACLES['mmd_per_gene'])})) AS mmd, (SELECT avg(wasserstein) FROM ({_exact(ORACLES['wasserstein_per_gene'])})) AS wasserstein"), _long(_exact(ORACLES["direction_metrics"])), f"SELECT metric, value FROM ({_overlap_sql([20, 50, 100, 200], [0.05, 0.01], [0.05, 0.01])})"]


@query("SELECT metric, round(value, 4) + 0.0 AS value FROM (" + " UNION ALL ".join(_FAMILIES) + ")")
def evaluate_prediction(spark, d):
    table = _de(spark, d)
    return rounded(metrics.evaluate_prediction(*_triplet(spark, d), table.filter("target = '1-URGENT'"), table.filter("target = '2-HIGH'")), 4)


from helixframe.plans import surface  # noqa: E402, F401  (registers the rest)
