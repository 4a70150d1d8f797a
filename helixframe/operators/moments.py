"""Totals and moments of a sparse matrix ``X (cell, gene, value)``, zeros counted by arithmetic.

``X`` holds non-zero entries; ``obs`` has a row per cell, so cells without entries count too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invalid(value: Column) -> Column:
    """Null, NaN and infinite entries, which all kernels pass over."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def valid(X: DataFrame) -> DataFrame:
    return X.filter(~invalid(F.col("value")))


def cell_totals(X: DataFrame, obs: DataFrame) -> DataFrame:
    """Sum of each cell, 0 for cells without entries: ``cell, total``."""
    sums = X.groupBy("cell").agg(F.sum("value").alias("total"))
    return obs.select("cell").join(sums, "cell", "left").select("cell", F.coalesce("total", F.lit(0.0)).alias("total"))


def cell_totals_without(X: DataFrame, obs: DataFrame, genes: DataFrame) -> DataFrame:
    """Sum of each cell over genes that are not in ``genes (gene)``."""
    return cell_totals(X.join(genes.select("gene"), "gene", "left_anti"), obs)


def median_positive(totals: DataFrame, column: str = "total") -> DataFrame:
    """One row: the exact median of the positive values, 0 if there are none."""
    return totals.agg(F.coalesce(F.median(F.when(F.col(column) > 0, F.col(column))), F.lit(0.0)).alias("median"))


def dominating_genes(X: DataFrame, totals: DataFrame, max_fraction: float = 0.05) -> DataFrame:
    """Genes that exceed ``max_fraction`` of the total of any cell: ``gene``."""
    joined = X.join(totals, "cell").filter(F.col("value") > F.col("total") * max_fraction)
    return joined.select("gene").distinct()


def _variance(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance from a count, sum and sum of squares; 0 for a single value."""
    return F.when(n > 1, F.greatest(F.lit(0.0), (s2 - s1 * s1 / n) / (n - 1))).otherwise(0.0)


def mean_var(X: DataFrame, obs: DataFrame, include_zeros: bool = True) -> DataFrame:
    """Mean and sample variance of every gene with entries: ``gene, mean, variance``."""
    sums = valid(X).groupBy("gene").agg(F.count("*").alias("k"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    if include_zeros:
        sums = sums.crossJoin(F.broadcast(obs.agg(F.count("*").alias("n"))))
    else:
        sums = sums.withColumn("n", F.col("k"))
    n = F.col("n").cast("double")
    return sums.select("gene", (F.col("s1") / n).alias("mean"), _variance(n, F.col("s1"), F.col("s2")).alias("variance"))


def clipped_moments(X: DataFrame, clips: DataFrame) -> DataFrame:
    """Sum and sum of squares of ``min(value, clip)`` per gene: ``gene, total, squares``."""
    least = F.least("value", "clip")
    return valid(X).join(clips.select("gene", "clip"), "gene").groupBy("gene").agg(F.sum(least).alias("total"), F.sum(least * least).alias("squares"))


def clipped(X: DataFrame, clips: DataFrame) -> DataFrame:
    """``X`` with every entry cut at its gene's ``clip``."""
    return X.join(clips.select("gene", "clip"), "gene", "left").select("cell", "gene", F.least("value", "clip").alias("value"))


def group_sums(X: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """Every gene with every group: stored entries, sum, squares and group size.

    Rows are ``gene, grp, k, s1, s2, n``. The spine is genes times groups, both of them
    dimensions; cells are aggregated before any join but that with their label.
    """
    labels = obs.select("cell", F.col(group).alias("grp")).filter("grp IS NOT NULL")
    entries = valid(X).join(labels, "cell")
    sums = entries.groupBy("gene", "grp").agg(F.count("*").alias("k"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    sizes = labels.groupBy("grp").agg(F.count("*").alias("n"))
    spine = X.select("gene").distinct().crossJoin(sizes)
    return spine.join(sums, ["gene", "grp"], "left").select("gene", "grp", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("s1", F.lit(0.0)).alias("s1"), F.coalesce("s2", F.lit(0.0)).alias("s2"), "n")


def group_mean_var(X: DataFrame, obs: DataFrame, group: str, include_zeros: bool = True) -> DataFrame:
    """``gene, grp, n, nonzero, mean, variance``; without zeros an empty pair has mean 0."""
    sums = group_sums(X, obs, group)
    n = (F.col("n") if include_zeros else F.col("k")).cast("double")
    mean = F.when(n > 0, F.col("s1") / n).otherwise(0.0)
    return sums.select("gene", "grp", "n", F.col("k").alias("nonzero"), mean.alias("mean"), _variance(n, F.col("s1"), F.col("s2")).alias("variance"))


def pseudobulk(X: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean over the cells of ``obs`` for each gene: ``gene, mean``."""
    rows = obs.select("cell")
    sums = X.join(rows, "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("s1"))
    return sums.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("gene", (F.col("s1") / F.col("n")).alias("mean"))


def pseudobulk_delta(X: DataFrame, target: DataFrame, control: DataFrame) -> DataFrame:
    """Pseudobulk of target cells minus that of control cells: ``gene, delta``."""
    t, c = pseudobulk(X, target).withColumnRenamed("mean", "t"), pseudobulk(X, control).withColumnRenamed("mean", "c")
    return t.join(c, "gene", "full").select("gene", (F.coalesce("t", F.lit(0.0)) - F.coalesce("c", F.lit(0.0))).alias("delta"))


def polynomial_fit(points: DataFrame, degree: int = 2, weight: str | None = None) -> list[float]:
    """Least-squares coefficients of ``points (x, y)``, lowest order first.

    One pass of power sums; the normal equations of ``degree + 1`` unknowns are solved on the
    driver. Meant for low degrees and centred x.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    powers = [F.sum(w * F.pow("x", F.lit(float(k)))).alias(f"x{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(w * F.pow("x", F.lit(float(k))) * F.col("y")).alias(f"y{k}") for k in range(degree + 1)]
    s = points.agg(*powers, *mixed).first()
    left = np.array([[s[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    return np.linalg.lstsq(left, np.array([s[f"y{k}"] for k in range(degree + 1)], float), rcond=None)[0].tolist()
