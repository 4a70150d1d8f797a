"""Differential expression of every group against a control group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.special import normal_two_sided, student_two_sided_exact, student_two_sided_fast
from helixframe.operators.lineage import cut
from helixframe.operators.moments import group_mean_var, group_sums, invalid
from helixframe.operators.numbering import running

EPSILON = 1e-9
REST = "rest"
METHODS = {"wilcoxon": "rank_sum", "rank_sum": "rank_sum", "t-test": "student", "t-test_overestim_var": "student", "student": "student", "welch": "welch"}
CORRECTIONS = {"benjamini-hochberg": "bh", "bh": "bh", "by": "by", "benjamini-yekutieli": "by", "bonferroni": "by"}


def with_control(obs: DataFrame, group: str, control: str | None) -> DataFrame:
    """``obs`` with a missing label read as control where no control is named."""
    return obs if control is not None else obs.withColumn(group, F.coalesce(F.col(group), F.lit("control")))


def against_rest(obs: DataFrame, group: str, target: str) -> DataFrame:
    """Labels for comparing one group with all other cells."""
    return obs.withColumn(group, F.when(F.col(group) == target, target).otherwise("rest"))


def log_fold_change(X: DataFrame, obs: DataFrame, group: str, control: str, pseudocount: float = EPSILON) -> DataFrame:
    """``gene, target, mean_diff, log2_fold_change`` of each group against the control."""
    means = group_mean_var(X, obs, group).select("gene", "grp", "mean")
    ref = means.filter(F.col("grp") == control).select("gene", F.col("mean").alias("ref"))
    ratio = (F.col("mean") + pseudocount) / (F.col("ref") + pseudocount)
    return means.filter(F.col("grp") != control).join(ref, "gene").select("gene", F.col("grp").alias("target"), (F.col("mean") - F.col("ref")).alias("mean_diff"), F.log2(ratio).alias("log2_fold_change"))


def t_test(X: DataFrame, obs: DataFrame, group: str, control: str | None, method: str = "welch", p_mode: str = "fast") -> DataFrame:
    """Student's or Welch's test: ``gene, target, statistic, df, p_value, mean_diff, log2_fold_change``.

    Moments are those of the closed form over sums, so one aggregation serves all groups;
    without a control, each is compared with all other labelled cells, whose sums are the
    totals less its own. A vanishing standard error gives statistic 0 and p 1.
    """
    sums = group_sums(X, obs, group).withColumn("n", F.col("n").cast("double"))
    total = Window.partitionBy("gene")
    refs = {c: F.sum(F.col(c) if control is None else F.when(F.col("grp") == control, F.col(c))).over(total) - (F.col(c) if control is None else 0.0) for c in ("n", "s1", "s2")}
    sided = sums.withColumns({f"{c}_0": v for c, v in refs.items()}).filter("n_0 > 0")

    def moments_of(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
        return s1 / n, F.when(n > 1, F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n)) * n / (n - 1)).otherwise(0.0)

    (m1, v1), (m0, v0) = moments_of(F.col("n"), F.col("s1"), F.col("s2")), moments_of(F.col("n_0"), F.col("s1_0"), F.col("s2_0"))
    both = sided.select("gene", "grp", F.col("n").alias("n1"), m1.alias("m1"), v1.alias("v1"), F.col("n_0").alias("n0"), m0.alias("m0"), v0.alias("v0"))
    both = both if control is None else both.filter(F.col("grp") != control)
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "v0", "v1"))
    if method == "student":
        se = F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1))
        df = n0 + n1 - 2
    elif method == "welch":
        a, b = v0 / n0, v1 / n1
        se = F.sqrt(a + b)
        df = F.when(a + b > 1e-12, (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))).otherwise(1.0)
    else:
        raise ValueError("method is 'student' or 'welch'")
    diff = F.col("m1") - F.col("m0")
    tested = both.withColumn("df", df).withColumn("_se", se).withColumn("statistic", F.when(F.col("_se") > 1e-12, diff / F.col("_se")).otherwise(0.0))
    tail = {"fast": student_two_sided_fast, "exact": student_two_sided_exact}[p_mode]
    p = F.when(F.col("_se") > 1e-12, tail(F.col("statistic"), F.col("df"))).otherwise(1.0)
    ratio = (F.col("m1") + EPSILON) / (F.col("m0") + EPSILON)
    return tested.select("gene", F.col("grp").alias("target"), "statistic", "df", p.alias("p_value"), diff.alias("mean_diff"), F.log2(ratio).alias("log2_fold_change"))


def rank_sum(X: DataFrame, obs: DataFrame, group: str, control: str | None, continuity: bool = True, means: bool = False, min_samples: int = 1, groups: list[str] | None = None) -> DataFrame:
    """Two-sided rank-sum test with ties: ``gene, target, u, tie_sum, z, p_value``.

    Without a control every group is tested against all other labelled cells. Works on counts
    of distinct values per gene and group, zeros filled in by arithmetic; counts are cumulated
    over ranges of gene and value, so all targets are tested in one pass and a gene of very
    many values is many tasks. ``u`` belongs to the target. ``means`` adds the means of the target and of the cells it is compared with.
    Groups below ``min_samples`` cells, or not in ``groups``, take no part. Cells are read once:
    all else comes from the kept counts.
    """
    labels = obs.select("cell", F.col(group).alias("grp")).filter("grp IS NOT NULL")
    sizes = labels.groupBy("grp").agg(F.count("*").cast("double").alias("n")).filter(F.col("n") >= min_samples)
    sizes = cut(sizes if groups is None else sizes.filter(F.col("grp").isin(groups)))
    value = F.when(~invalid(F.col("value")) & (F.col("value") != 0), F.col("value").cast("double"))
    # entries that do not count stay as nulls, for the names of their genes
    seen = cut(X.select("cell", "gene", value.alias("v")).join(labels, "cell", "left").groupBy("gene", "grp", "v").agg(F.count("*").cast("double").alias("c")))
    found = seen.filter("v IS NOT NULL").join(sizes.select("grp"), "grp", "left_semi").select("gene", "grp", "v", "c")
    stored = found.groupBy("gene", "grp").agg(F.sum("c").alias("k"))
    spine = seen.select("gene").distinct().crossJoin(sizes)
    zeros = spine.join(stored, ["gene", "grp"], "left").select("gene", "grp", F.lit(0.0).alias("v"), (F.col("n") - F.coalesce("k", F.lit(0.0))).alias("c"))
    counts = found.unionByName(zeros.filter("c > 0"))
    is_ref = F.lit(True) if control is None else F.col("grp") == control  # with no control, ranks are among all cells
    ref = F.when(is_ref, F.col("c")).otherwise(0.0)
    spots = counts.groupBy("gene", "v").agg(F.sum(ref).alias("_equal"))
    spots = running(spots, "gene", "v", ["_equal"], {"_ties": F.col("_equal") ** 3 - F.col("_equal"), "_s": F.col("_equal") * F.col("v")}).withColumnsRenamed({"_upto__equal": "_up_to", "_all__equal": "n0"})
    c, e = F.col("c"), F.col("_equal")
    targets = counts if control is None else counts.filter(F.col("grp") != control)
    per = targets.join(spots, ["gene", "v"]).groupBy("gene", "grp").agg(
        F.sum(c * (F.col("_up_to") - e + 0.5 * e)).alias("u"),
        F.first("_ties").alias("_ties"),
        F.sum(((c + e) ** 3 - (c + e)) - (e**3 - e)).alias("_more"),
        F.sum("c").alias("n1"),
        F.first("n0").alias("n0"),
        F.sum(c * F.col("v")).alias("s1"),
        F.first("_s").alias("s0"),
    )
    if control is None:  # half of n1 squared is what the target's cells add to each other's ranks
        per = per.withColumns({"u": F.col("u") - F.col("n1") * F.col("n1") / 2, "n0": F.col("n0") - F.col("n1"), "s0": F.col("s0") - F.col("s1"), "tie_sum": F.col("_ties")})
    else:
        per = per.withColumn("tie_sum", F.col("_ties") + F.col("_more"))
    n = F.col("n0") + F.col("n1")
    mu = F.col("n0") * F.col("n1") / 2
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("n0") * F.col("n1") / 12 * ((n + 1) - F.col("tie_sum") / (n * (n - 1)))))
    z = F.when(F.col("_d") > 0, (F.abs(F.col("u") - mu) - (0.5 if continuity else 0.0)) / F.col("_d")).otherwise(0.0)
    scored = per.filter("n0 > 0").withColumn("_d", sigma).withColumn("z", z)
    more = [(F.col("s1") / F.col("n1")).alias("mean"), (F.col("s0") / F.col("n0")).alias("ref_mean")] if means else []
    return scored.select("gene", F.col("grp").alias("target"), "u", "tie_sum", "z", F.when(F.col("_d") > 0, normal_two_sided(F.col("z"))).otherwise(1.0).alias("p_value"), *more)


def _level(p: Column) -> Column:
    """A number that grows with p: 4,096 levels up to 1, and 64 an octave where p is small."""
    return F.when(p >= 2.0**-8, F.floor(p * 4096)).when(p > 0, F.floor(F.log2(p) * 64)).otherwise(-1_000_000)


def harmonic(m: Column) -> Column:
    """The sum of 1/k up to ``m``: its expansion sixteen steps ahead, less those steps."""
    far = m + 16
    ahead = F.log(far) + 0.5772156649015329 + 1 / (2 * far) - 1 / (12 * far**2) + 1 / (120 * far**4) - 1 / (252 * far**6)
    for k in range(1, 17):
        ahead = ahead - 1 / (m + k)
    return ahead


def adjusted(df: DataFrame, p: str = "p_value", out: str = "fdr", method: str = "bh") -> DataFrame:
    """Step-up adjusted p-values over all rows: ``bh``, ``by``, or ``bonferroni`` proper.

    Rows of one p are counted together first, so a p that many rows share is one row. Ranks
    and running minima are taken within levels of p (see ``_level``: uniform values spread
    over thousands of them) and carried over a table of levels, at most some ten thousand
    rows, so no window holds all rows. Invalid p stay as they are and take no part.
    """
    if method not in ("bh", "by", "bonferroni"):
        raise ValueError("method is 'bh', 'by' or 'bonferroni'")
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    counts = df.filter(ok).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")).withColumn("_level", _level(F.col("_p")))
    levels = counts.groupBy("_level").agg(F.sum("_c").alias("_n"))
    before = Window.orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    offsets = levels.select("_level", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    m = F.sum("_n").cast("double")
    total = F.broadcast(levels.agg(m.alias("_m"), (harmonic(m) if method == "by" else F.lit(1.0)).alias("_factor")))  # one row
    inside = Window.partitionBy("_level").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = counts.join(offsets, "_level").crossJoin(total).withColumn("_rank", F.col("_before") + F.sum("_c").over(inside))
    if method == "bonferroni":
        values = ranks.select("_p", F.least(F.lit(1.0), F.col("_p") * F.col("_m")).alias("_q"))
    else:
        ranks = ranks.withColumn("_q", F.col("_p") * F.col("_m") * F.col("_factor") / F.col("_rank"))
        after = Window.partitionBy("_level").orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        later = Window.orderBy("_level").rowsBetween(1, Window.unboundedFollowing)
        lows = ranks.groupBy("_level").agg(F.min("_q").alias("_low")).select("_level", F.min("_low").over(later).alias("_later"))
        values = ranks.withColumn("_q", F.min("_q").over(after)).join(lows, "_level").select("_p", F.least(F.lit(1.0), "_q", F.coalesce("_later", F.lit(1.0))).alias("_q"))
    return df.join(values, F.col(p) == F.col("_p"), "left").withColumn(out, F.coalesce("_q", F.col(p))).drop("_p", "_q")


def differential_expression(
    X: DataFrame, obs: DataFrame, group: str, control: str | None = None, groups: list[str] | None = None, method: str = "wilcoxon", min_samples: int = 2, clip: float = 20.0, fdr_method: str = "bh", p_mode: str = "fast"
) -> DataFrame:
    """The test table: ``target, feature, statistic, p_value, fold_change, log2_fold_change, fdr``.

    Every group of ``min_samples`` cells or more (of ``groups``, if given) is tested against
    the control, or against all other cells where that is ``rest``; every gene with each.
    P-values are adjusted over all rows together. The table of tests, a row for each gene and
    group, is computed once and cut off before it is adjusted.
    """
    if control == REST:
        ref = None
    else:
        obs, control = with_control(obs, group, control), control or "control"
        ref = control
    compared = [*groups, control] if groups is not None and ref is not None else None
    kind = METHODS[method]
    if kind == "rank_sum":
        ratio = (F.col("mean") + EPSILON) / (F.col("ref_mean") + EPSILON)
        tested = rank_sum(X, obs, group, ref, means=True, min_samples=min_samples, groups=compared).select("gene", "target", F.col("u").alias("statistic"), "p_value", F.log2(ratio).alias("log2_fold_change"))
    else:
        sizes = obs.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_samples)
        sizes = sizes if compared is None else sizes.filter(F.col("_g").isin(compared))
        kept = obs.join(sizes.select("_g"), F.col(group) == F.col("_g"), "left_semi")
        tested = t_test(X, kept, group, ref, kind, p_mode)
    if groups is not None:
        tested = tested.filter(F.col("target").isin(groups))
    change = F.coalesce(F.nanvl("log2_fold_change", F.lit(0.0)), F.lit(0.0))
    table = tested.withColumn("_l", F.greatest(F.lit(-clip), F.least(F.lit(clip), change)))
    table = table.select("target", F.col("gene").alias("feature"), "statistic", "p_value", F.pow(F.lit(2.0), "_l").alias("fold_change"), F.col("_l").alias("log2_fold_change"))
    return adjusted(cut(table), method=fdr_method)


def ranked(table: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of a test table with their rank in the target, best first, down to the ``n``-th."""
    order = Window.partitionBy("target").orderBy(F.col("p_value").asc(), F.col("statistic").desc(), F.col("feature"))
    out = table.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= n) if n else out


def expressing_fractions(X: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """Share of cells with an entry, in each group and in all others: ``gene, target, pts, pts_rest``."""
    counts = group_mean_var(X, obs, group).select("gene", "grp", F.col("nonzero").alias("k"), "n")
    total = counts.groupBy("gene").agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"))
    rest = F.when(F.col("all_n") > F.col("n"), (F.col("all_k") - F.col("k")) / (F.col("all_n") - F.col("n")))
    return counts.join(total, "gene").select("gene", F.col("grp").alias("target"), (F.col("k") / F.col("n")).alias("pts"), rest.alias("pts_rest"))


def rank_genes_groups(X: DataFrame, obs: DataFrame, group: str, reference: str | None = "rest", n_genes: int | None = None, method: str = "t-test", correction: str = "benjamini-hochberg", pts: bool = False, groups: list[str] | None = None, min_samples: int = 2) -> DataFrame:
    """Ranked test table of each group against ``reference``, with expressing fractions if asked.

    ``rest`` compares every group with all other cells, in one pass over the sums or counts of
    all groups; a name, with that group; None, with cells without a label. Of the corrections
    offered by name, ``bonferroni`` is Benjamini-Yekutieli, as users of this entry point know
    it; ``adjusted`` has the proper one. ``t-test_overestim_var`` is Student's test.
    """
    table = differential_expression(X, obs, group, reference, groups, method, min_samples, fdr_method=CORRECTIONS[correction])
    out = ranked(table, n_genes)
    if not pts:
        return out
    shares = expressing_fractions(X, obs, group).withColumnRenamed("gene", "feature")
    return out.join(shares, ["feature", "target"], "left")
