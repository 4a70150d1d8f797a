"""Highly variable genes: two dispersion flavors, the regularized-variance flavor, and the simple ratio."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.moments import valid

#: Consistency factor of the median absolute deviation for normal data.
MAD_SCALE = 0.6744897501960817


def _batches(obs: DataFrame, batch: str | None) -> DataFrame:
    return obs.select("cell", (F.col(batch).cast("string") if batch else F.lit("all")).alias("batch"))


def _moments(X: DataFrame, cells: DataFrame) -> DataFrame:
    """``batch, gene, n, s1, s2, k`` for every gene of the matrix in every batch."""
    sums = valid(X).join(cells, "cell").groupBy("batch", "gene").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count("*").alias("k"))
    spine = cells.groupBy("batch").agg(F.count("*").cast("double").alias("n")).crossJoin(X.select("gene").distinct())
    return spine.join(sums, ["batch", "gene"], "left").fillna(0, ["s1", "s2", "k"])


def _mean_var(moments: DataFrame) -> DataFrame:
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    var = F.when(n > 1, F.greatest(F.lit(0.0), (s2 - s1 * s1 / n) / (n - 1))).otherwise(0.0)
    return moments.withColumn("mean", s1 / n).withColumn("variance", var)


def dispersions(X: DataFrame, obs: DataFrame, flavor: str = "seurat", n_bins: int = 20, batch: str | None = None, log_base: float | None = None) -> DataFrame:
    """Per batch and gene: ``batch, gene, means, dispersions, mean_bin, dispersions_norm``.

    ``seurat`` undoes a log1p, bins the means in equal widths and uses mean and deviation of
    log dispersions within a bin; a gene alone in its bin gets 1. ``cell_ranger`` bins by
    percentiles 10, 15, ... 100 and uses median and scaled absolute deviation. With batches,
    genes without entries in a batch are left out there.
    """
    if flavor == "seurat":
        X = X.select("cell", "gene", F.expm1(F.col("value") * float(np.log(log_base)) if log_base else F.col("value")).alias("value"))
    table = _mean_var(_moments(X, _batches(obs, batch)))
    if batch:
        table = table.filter("k > 0")
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    ratio = F.col("variance") / mean
    if flavor == "seurat":
        table = table.select("batch", "gene", F.log1p(mean).alias("means"), F.when(ratio > 0, F.log(ratio)).alias("dispersions"))
        every = Window.partitionBy("batch")
        low, high = F.min("means").over(every), F.max("means").over(every)
        width = (high - low) / n_bins
        place = F.when(high == low, F.lit(n_bins // 2)).otherwise(F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.ceil((F.col("means") - low) / width).cast("int") - 1)))
        table = table.withColumn("mean_bin", place)
        bins = Window.partitionBy("batch", "mean_bin")
        avg, std = F.avg("dispersions").over(bins), F.stddev_samp("dispersions").over(bins)
        norm = F.when(F.count("dispersions").over(bins) == 1, F.when(F.col("dispersions").isNotNull(), 1.0)).otherwise((F.col("dispersions") - avg) / F.nullif(std, F.lit(0.0)))
        return table.withColumn("dispersions_norm", norm)
    if flavor != "cell_ranger":
        raise ValueError("flavor is 'seurat' or 'cell_ranger'")
    table = table.select("batch", "gene", mean.alias("means"), F.when(ratio > 0, ratio).alias("dispersions"))
    edges = table.groupBy("batch").agg(F.expr("array_distinct(percentile(means, array(" + ", ".join(str(q / 100) for q in range(10, 101, 5)) + ")))").alias("_edges"))
    table = table.join(edges, "batch").withColumn("mean_bin", F.expr("size(filter(_edges, e -> e < means))")).drop("_edges")
    mid = table.groupBy("batch", "mean_bin").agg(F.median("dispersions").alias("_mid"))
    away = table.join(mid, ["batch", "mean_bin"]).withColumn("_away", F.abs(F.col("dispersions") - F.col("_mid")))
    mad = away.groupBy("batch", "mean_bin").agg((F.median("_away") / MAD_SCALE).alias("_mad"))
    return away.join(mad, ["batch", "mean_bin"]).select("batch", "gene", "means", "dispersions", "mean_bin", ((F.col("dispersions") - F.col("_mid")) / F.nullif("_mad", F.lit(0.0))).alias("dispersions_norm"))


def significant(value: Column, digits: int = 9) -> Column:
    """A number rounded to ``digits`` significant digits."""
    return F.format_string(f"%.{digits - 1}e", value).try_cast("double")


def highly_variable(X: DataFrame, obs: DataFrame, flavor: str = "seurat", n_top: int | None = None, min_disp: float = 0.5, max_disp: float = float("inf"), min_mean: float = 0.0125, max_mean: float = 3.0, n_bins: int = 20, batch: str | None = None) -> DataFrame:
    """Dispersion flavors with their verdict: ``gene, means, dispersions, dispersions_norm, n_batches, highly_variable``.

    ``n_top`` keeps genes at or above the n-th highest normalized dispersion, ties included:
    values equal in nine significant digits are a tie, so the order of summing decides
    nothing. Else strict bounds on mean and normalized dispersion decide. With batches, values are
    averaged, a batch's flags are summed, and ``n_top`` goes by flags, then dispersion.
    """
    table = dispersions(X, obs, flavor, n_bins, batch)
    d = F.coalesce("dispersions_norm", F.lit(0.0))
    bounds = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (d > min_disp) & (d < max_disp)
    if n_top:
        table = table.withColumn("_v", significant(F.col("dispersions_norm")))
        cut = F.row_number().over(Window.partitionBy("batch").orderBy(F.col("_v").desc_nulls_last(), "gene"))
        nth = table.withColumn("_r", cut).filter(F.col("_r") <= n_top).groupBy("batch").agg(F.min("_v").alias("_nth"))
        flagged = table.join(nth, "batch", "left").withColumn("_flag", F.coalesce(F.col("_v") >= F.col("_nth"), F.lit(False)))
    else:
        flagged = table.withColumn("_flag", bounds)
    if not batch:
        return flagged.select("gene", "means", "dispersions", "dispersions_norm", F.lit(1).alias("n_batches"), F.col("_flag").alias("highly_variable"))
    merged = flagged.groupBy("gene").agg(F.avg("means").alias("means"), F.avg("dispersions").alias("dispersions"), F.avg("dispersions_norm").alias("dispersions_norm"), F.sum(F.col("_flag").cast("int")).cast("int").alias("n_batches"))
    if n_top:
        best = merged.orderBy(F.desc("n_batches"), significant(F.col("dispersions_norm")).desc_nulls_last(), "gene").limit(n_top).select("gene", F.lit(True).alias("_in"))
        return merged.join(best, "gene", "left").select("gene", "means", "dispersions", "dispersions_norm", "n_batches", F.coalesce("_in", F.lit(False)).alias("highly_variable"))
    return merged.withColumn("highly_variable", bounds)


def simple_variable(X: DataFrame, obs: DataFrame, n_top: int = 2000) -> DataFrame:
    """The ``n_top`` genes of highest variance over mean: ``gene, means, variances, ratio, rank``."""
    table = _mean_var(_moments(X, _batches(obs, None))).select("gene", F.col("mean").alias("means"), F.col("variance").alias("variances"), (F.col("variance") / F.nullif("mean", F.lit(0.0))).alias("ratio"))
    top = table.orderBy(F.col("ratio").desc_nulls_last(), "gene").limit(n_top)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("ratio").desc_nulls_last(), "gene")))


def polynomial(x: np.ndarray, y: np.ndarray, degree: int = 2, weights: np.ndarray | None = None) -> np.ndarray:
    """Least-squares coefficients, lowest order first."""
    w = np.sqrt(np.ones_like(x) if weights is None else weights)
    return np.linalg.lstsq(np.vander(x, degree + 1, increasing=True) * w[:, None], y * w, rcond=None)[0]


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic regression at each x, tricube weights over the nearest ``span`` of points."""
    n = len(x)
    k = min(n, max(3, int(np.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    xs, ys, out, left = x[order], y[order], np.empty(n), 0
    for i in range(n):
        while left + k < n and xs[i] - xs[left] > xs[left + k] - xs[i]:
            left += 1
        d = xs[left : left + k] - xs[i]
        far = np.abs(d).max()
        w = (1 - (np.abs(d) / (far * 1.0000001)) ** 3) ** 3 if far > 0 else np.ones(k)
        c = polynomial(d / (far or 1.0), ys[left : left + k], min(2, len(np.unique(d)) - 1), w)
        out[order[i]] = c[0]
    return out


def regularized_variance(X: DataFrame, obs: DataFrame, n_top: int = 2000, span: float = 0.3, batch: str | None = None, by_batches: bool = False) -> DataFrame:
    """Variance after a mean-variance fit, clipped: ``gene, variances_norm, median_rank, n_batches, highly_variable``.

    Per batch the log variance is fitted on the log mean (one task a batch, which holds a
    row per gene), values are clipped at the fitted deviation times the root of the cells,
    and genes are ranked. Ranks below ``n_top`` have a median over batches; genes are chosen
    by it, then by their number of batches, or the other way round with ``by_batches``.
    """
    cells = _batches(obs, batch)
    table = _mean_var(_moments(X, cells))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = (pdf["variance"] > 0).to_numpy()
        pdf = pdf.assign(reg_std=1.0)
        if ok.sum() >= 3:
            at = np.log10(pdf["mean"].to_numpy(float)[ok])
            pdf.loc[ok, "reg_std"] = np.sqrt(10 ** local_quadratic(at, np.log10(pdf["variance"].to_numpy(float)[ok]), span))
        return pdf[["batch", "gene", "n", "mean", "reg_std"]]

    kind = dict(table.dtypes)["gene"]
    fitted = table.select("batch", "gene", "n", "mean", "variance").groupBy("batch").applyInPandas(fit, f"batch string, gene {kind}, n double, mean double, reg_std double")
    fitted = fitted.withColumn("clip", F.col("reg_std") * F.sqrt("n") + F.col("mean"))
    least = F.least("value", "clip")
    sums = valid(X).join(cells, "cell").join(fitted.select("batch", "gene", "clip"), ["batch", "gene"]).groupBy("batch", "gene").agg(F.sum(least).alias("s1"), F.sum(least * least).alias("s2"))
    n, mean, s1, s2 = F.col("n"), F.col("mean"), F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))
    normed = fitted.join(sums, ["batch", "gene"], "left").withColumn("norm", (n * mean * mean + s2 - 2 * mean * s1) / ((n - 1) * F.col("reg_std") * F.col("reg_std")))
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("norm"), "gene")) - 1
    per = normed.withColumn("_rank", F.when(rank < n_top, rank))
    merged = per.groupBy("gene").agg(F.avg("norm").alias("variances_norm"), F.median("_rank").alias("median_rank"), F.count("_rank").cast("int").alias("n_batches"))
    keys = [F.col("median_rank").asc_nulls_last(), F.desc("n_batches")]
    best = merged.orderBy(*(keys[::-1] if by_batches else keys), "gene").limit(n_top).select("gene", F.lit(True).alias("_in"))
    return merged.join(best, "gene", "left").select("gene", "variances_norm", "median_rank", "n_batches", F.coalesce("_in", F.lit(False)).alias("highly_variable"))


FLAVORS = ("seurat", "cell_ranger", "seurat_v3", "seurat_v3_paper")


def highly_variable_genes(X: DataFrame, obs: DataFrame, flavor: str = "seurat", n_top: int | None = None, batch: str | None = None, span: float = 0.3, check_values: bool = True, subset: bool = False, **bounds) -> DataFrame:
    """One entry for all flavors; ``subset`` leaves only the variable genes.

    ``seurat`` and ``cell_ranger`` expect logarithms and take ``highly_variable``'s bounds;
    ``seurat_v3`` expects counts (checked unless asked not to), wants ``n_top`` (2,000 where
    none is given) and chooses by median rank, then batches; its ``_paper`` form the other way round.
    """
    if flavor not in FLAVORS:
        raise ValueError(f"flavor must be one of {FLAVORS}")
    if flavor.startswith("seurat_v3"):
        if bounds:
            raise ValueError("bounds on mean and dispersion don't go with this flavor")
        if check_values and not valid(X).filter((F.col("value") < 0) | (F.col("value") % 1 != 0)).isEmpty():
            raise ValueError("this flavor expects counts")
        out = regularized_variance(X, obs, n_top or 2000, span, batch, flavor == "seurat_v3_paper")
    else:
        if n_top and bounds:
            warnings.warn("n_top decides, so bounds on mean and dispersion are passed over", stacklevel=2)
        out = highly_variable(X, obs, flavor, n_top, batch=batch, **bounds)
    return out.filter("highly_variable") if subset else out
