"""Library-size normalization and z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.moments import cell_totals, cell_totals_without, dominating_genes, mean_var, median_positive


def divide_rows(X: DataFrame, divisors: DataFrame, allow_zero: bool = False) -> DataFrame:
    """Each entry over its cell's ``divisor``; a zero divisor gives 0, or the entry if allowed."""
    zero = F.col("value") if allow_zero else F.lit(0.0)
    return X.join(divisors.select("cell", "divisor"), "cell").select("cell", "gene", F.when(F.col("divisor") == 0, zero).otherwise(F.col("value") / F.col("divisor")).alias("value"))


def size_factors(X: DataFrame, obs: DataFrame, target_sum: float | None = None, exclude_dominating: bool = False, max_fraction: float = 0.05) -> DataFrame:
    """``cell, total, divisor``: totals, without dominating genes if asked, over the target.

    The target is by default the median of the positive totals.
    """
    if not 0 <= max_fraction <= 1:
        raise ValueError("max_fraction is between 0 and 1")
    totals = cell_totals(X, obs)
    if exclude_dominating:
        totals = cell_totals_without(X, obs, dominating_genes(X, totals, max_fraction))
    if target_sum is not None:
        return totals.withColumn("divisor", F.col("total") / float(target_sum))
    median = F.broadcast(median_positive(totals))  # one row
    return totals.crossJoin(median).select("cell", "total", F.when(F.col("median") > 0, F.col("total") / F.col("median")).otherwise(0.0).alias("divisor"))


def normalize_total(X: DataFrame, obs: DataFrame, target_sum: float | None = None, exclude_dominating: bool = False, max_fraction: float = 0.05) -> DataFrame:
    """Every cell scaled to the same total; cells without a positive total become 0."""
    return divide_rows(X, size_factors(X, obs, target_sum, exclude_dominating, max_fraction))


def standardize(X: DataFrame, moments: DataFrame, zero_center: bool = True, max_value: float | None = None) -> DataFrame:
    """Stored entries as z-scores of ``moments (gene, mean, std)``; a zero or invalid std gives 0.

    With centering values are cut at both ends, without it at the upper end alone.
    """
    shifted = F.col("value") - F.col("mean") if zero_center else F.col("value")
    z = F.when((F.col("std") > 0) & ~F.isnan("std"), shifted / F.col("std")).otherwise(0.0)
    if max_value:
        z = F.least(z, F.lit(float(max_value)))
        z = F.greatest(z, F.lit(-float(max_value))) if zero_center else z
    return X.join(moments.select("gene", "mean", "std"), "gene").select("cell", "gene", z.alias("value"))


def scale(X: DataFrame, obs: DataFrame, zero_center: bool = True, max_value: float | None = None, mask: str | None = None, dense: bool = False) -> DataFrame:
    """z-scores per gene by the sample deviation.

    ``mask``: a condition on ``obs``; only those cells give moments and are scaled, others
    stay. ``dense``: absent entries are zeros that are shifted too, which fills the matrix.
    """
    chosen = obs.filter(mask) if mask else obs
    inside = X.join(chosen.select("cell"), "cell", "left_semi")
    moments = mean_var(inside, chosen).select("gene", "mean", F.sqrt("variance").alias("std"))
    if dense:
        spine = chosen.select("cell").crossJoin(moments.select("gene"))
        inside = spine.join(inside, ["cell", "gene"], "left").select("cell", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))
    out = standardize(inside, moments, zero_center, max_value)
    return out.unionByName(X.join(chosen.select("cell"), "cell", "left_anti").select("cell", "gene", "value")) if mask else out


def scale_arrays(obsm: DataFrame, obs: DataFrame, zero_center: bool = True, max_value: float | None = None, mask: str | None = None) -> DataFrame:
    """The same for an array per cell, as ``(cell, dim, value)`` with every entry there."""
    out = scale(obsm.select("cell", F.col("dim").alias("gene"), "value"), obs, zero_center, max_value, mask, dense=True)
    return out.withColumnRenamed("gene", "dim")


def log1p(X: DataFrame) -> DataFrame:
    return X.select("cell", "gene", F.log1p("value").alias("value"))
