"""Quality of predicted expression: vectors, distributions, directions, gene lists, graphs, labels.

Predictions, truth and control are long matrices ``(cell, gene, value)``; all entries are
meant to be there (a dense matrix) unless stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.numbering import running

_NAMES = ("r2", "pearson", "mse", "rmse", "mae", "cosine", "l2")


def vector_metrics(pairs: DataFrame, keys: list[str] | None = None, suffix: str = "") -> DataFrame:
    """Seven metrics of ``pairs (..., pred, true)``, one row, or one per ``keys``.

    One pass of sums. r2 is one minus residual over total squares (a constant truth gives 1
    where met exactly, else 0); an undefined correlation or cosine is 0.
    """
    p, t = F.col("pred"), F.col("true")
    d = t - p
    sums = pairs.groupBy(*(keys or [])).agg(
        F.count("*").cast("double").alias("_n"), F.sum(d * d).alias("_dd"), F.avg(F.abs(d)).alias("_mae"), F.covar_pop(p, t).alias("_cov"), F.var_pop(p).alias("_vp"),
        F.var_pop(t).alias("_vt"), F.sum(p * t).alias("_pt"), F.sum(p * p).alias("_pp"), F.sum(t * t).alias("_tt"),
    )
    n, dd = F.col("_n"), F.col("_dd")
    values = {
        "r2": F.when(F.col("_vt") > 0, 1 - dd / (F.col("_vt") * n)).otherwise(F.when(dd == 0, 1.0).otherwise(0.0)),
        "pearson": F.when((F.col("_vp") > 0) & (F.col("_vt") > 0), F.col("_cov") / F.sqrt(F.col("_vp") * F.col("_vt"))).otherwise(0.0),
        "mse": dd / n,
        "rmse": F.sqrt(dd / n),
        "mae": F.col("_mae"),
        "cosine": F.when((F.col("_pp") > 0) & (F.col("_tt") > 0), F.col("_pt") / F.sqrt(F.col("_pp") * F.col("_tt"))).otherwise(0.0),
        "l2": F.sqrt(dd),
    }
    return sums.select(*(keys or []), *(values[k].alias(k + suffix) for k in _NAMES))


def _bulk(X: DataFrame, name: str) -> DataFrame:
    return X.groupBy("gene").agg(F.avg("value").alias(name))


def evaluation_vectors(pred: DataFrame, true: DataFrame, ctrl: DataFrame | None = None) -> DataFrame:
    """Pseudobulks side by side: ``gene, pred, true`` or, with control, their deltas."""
    both = _bulk(pred, "pred").join(_bulk(true, "true"), "gene")
    if ctrl is None:
        return both
    return both.join(_bulk(ctrl, "ctrl"), "gene").select("gene", (F.col("pred") - F.col("ctrl")).alias("pred"), (F.col("true") - F.col("ctrl")).alias("true"))


def evaluate_perturbation(pred: DataFrame, true: DataFrame, ctrl: DataFrame | None = None, include_delta: bool = True) -> DataFrame:
    """One row of seven metrics on pseudobulks, and seven on deltas from control."""
    out = vector_metrics(evaluation_vectors(pred, true))
    if ctrl is None or not include_delta:
        return out
    return out.crossJoin(vector_metrics(evaluation_vectors(pred, true, ctrl), suffix="_delta"))  # a row each


#: Terms of the series within a bin, and bins of one kernel width on each side that count: what is left out is below 1e-11.
_TERMS, _REACH = 20, 6


def _kernel_series(offset: int) -> np.ndarray:
    """Chebyshev coefficients, by both places, of exp(-(x - y)^2) for x in one bin of width 1 and y in the bin ``offset`` on."""
    k = np.arange(_TERMS)
    node = np.cos(np.pi * (k + 0.5) / _TERMS)
    values = np.exp(-(((node[:, None] - node[None, :]) / 2 - offset) ** 2))
    basis = np.cos(np.outer(k, np.arccos(node))) * np.where(k == 0, 1, 2)[:, None] / _TERMS
    return basis @ values @ basis.T


def mmd(pred: DataFrame, true: DataFrame, gamma: float = 1.0, per_gene: bool = False) -> DataFrame:
    """Biased squared maximum mean discrepancy of each gene under a Gaussian kernel, or its mean.

    A fast Gauss sum: values fall into bins of the kernel's width, and of each bin the sums of
    Chebyshev polynomials are kept, one aggregation over all cells. Pairs of cells become pairs
    of bins, at most 13 a bin, weighed with the kernel's series; farther ones have no weight
    that a double would show. The result is the definition's to about 1e-10, in work linear in
    the number of cells.
    """
    x = F.col("value").cast("double") * float(np.sqrt(gamma))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (x - F.floor(x)) - 1)))

    def side(X: DataFrame, sign: float) -> DataFrame:
        sums = X.groupBy("gene", F.floor(x).alias("bin")).agg(*(F.sum(F.cos(angle * i)).alias(f"t{i}") for i in range(_TERMS)))
        n = F.sum("t0").over(Window.partitionBy("gene"))  # the first polynomial is 1
        return sums.select("gene", "bin", *((F.col(f"t{i}") * sign / n).alias(f"t{i}") for i in range(_TERMS)))

    both = side(pred, 1.0).unionByName(side(true, -1.0)).groupBy("gene", "bin").agg(F.array(*(F.sum(f"t{i}") for i in range(_TERMS))).alias("m"))
    near = both.select("gene", F.col("m").alias("m2"), F.col("bin").alias("bin2"), F.explode(F.sequence(F.lit(-_REACH), F.lit(_REACH))).alias("_d")).withColumn("bin", F.col("bin2") + F.col("_d")).drop("_d")
    series = np.stack([_kernel_series(d) for d in range(-_REACH, _REACH + 1)])

    def weighed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right, offset in batches:
            a, b = (np.stack(x.to_numpy()) if len(x) else np.zeros((0, _TERMS)) for x in (left, right))
            yield pd.Series(np.einsum("ni,nij,nj->n", a, series[offset.to_numpy() + _REACH], b, optimize=True))

    pairs = both.join(near, ["gene", "bin"]).select("gene", F.pandas_udf(weighed, "double")("m", "m2", (F.col("bin2") - F.col("bin")).cast("int")).alias("w"))
    genes = pairs.groupBy("gene").agg(F.sum("w").alias("mmd"))
    return genes if per_gene else genes.agg(F.avg("mmd").alias("mmd"))


def wasserstein(pred: DataFrame, true: DataFrame, per_gene: bool = False) -> DataFrame:
    """First-order earth mover's distance of each gene, or its mean; a gene of very many values is many tasks."""
    count = lambda X, name: X.groupBy("gene", F.col("value").alias("v")).agg(F.count("*").cast("double").alias(name))
    both = count(pred, "a").join(count(true, "b"), ["gene", "v"], "full").fillna(0.0, ["a", "b"])
    placed = running(both, "gene", "v", ["a", "b"], following="_next")
    gaps = placed.select("gene", F.abs(F.col("_upto_a") / F.col("_all_a") - F.col("_upto_b") / F.col("_all_b")).alias("d"), (F.col("_next") - F.col("v")).alias("gap"))
    genes = gaps.groupBy("gene").agg(F.coalesce(F.sum(F.col("d") * F.col("gap")), F.lit(0.0)).alias("wasserstein"))
    return genes if per_gene else genes.agg(F.avg("wasserstein").alias("wasserstein"))


def distribution_metrics(pred: DataFrame, true: DataFrame, gamma: float = 1.0) -> DataFrame:
    return mmd(pred, true, gamma).crossJoin(wasserstein(pred, true))  # a row each


def direction_metrics(pred: DataFrame, true: DataFrame, ctrl: DataFrame) -> DataFrame:
    """Share of genes that move to the same side of control, and the counts behind it."""
    up_p, up_t = F.col("pred") > 0, F.col("true") > 0
    n = lambda c: F.count_if(c).cast("long")
    return evaluation_vectors(pred, true, ctrl).agg(
        F.avg((up_p == up_t).cast("double")).alias("direction_accuracy"), F.count("*").alias("n_genes"), n(up_p == up_t).alias("n_correct"), n(up_p & up_t).alias("n_both_up"),
        n(~up_p & ~up_t).alias("n_both_down"), n(up_p != up_t).alias("n_opposite"),
    )


def direction_per_gene(pred: DataFrame, true: DataFrame, ctrl: DataFrame) -> DataFrame:
    return evaluation_vectors(pred, true, ctrl).select("gene", ((F.col("pred") > 0) == (F.col("true") > 0)).alias("same_direction"))


def deg_overlap(
    pred: DataFrame, true: DataFrame, top: tuple[int, ...] = (20, 50, 100, 200), p_values: tuple[float, ...] = (0.05, 0.01), fdrs: tuple[float, ...] = (0.05, 0.01), gene: str = "feature", p: str = "p_value", fdr: str = "fdr", sort_by: str = "p_value"
) -> DataFrame:
    """Overlap of two gene lists at every threshold: ``metric, value``, null where undefined.

    The first n of both over n, defined where both have n; genes under a p or fdr of both
    over those of the truth, defined where there are any. ``sort_by`` is a column, or
    ``log2_fold_change`` by absolute value, highest first.
    """
    key = F.abs(F.col(sort_by)).desc() if sort_by == "log2_fold_change" else F.col(sort_by).asc()
    deepest = max(top, default=0)

    def side(df: DataFrame, name: str) -> DataFrame:
        first = df.orderBy(key, F.col(gene)).limit(deepest).select(gene, F.row_number().over(Window.orderBy(key, F.col(gene))).alias("_r"))
        rows = [first.select(F.col(gene).alias("g"), F.explode(F.array(*(F.lit(float(n)) for n in top))).alias("t"), "_r").filter("_r <= t").select(F.lit("n").alias("kind"), "t", "g")] if top else []
        for kind, column, cuts in (("p", p, p_values), ("fdr", fdr, fdrs)):
            if cuts:
                rows.append(df.select(F.col(gene).alias("g"), F.explode(F.array(*(F.lit(c) for c in cuts))).alias("t"), F.col(column).alias("_v")).filter("_v < t").select(F.lit(kind).alias("kind"), "t", "g"))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.distinct().withColumn(name, F.lit(1))

    both = side(pred, "a").join(side(true, "b"), ["kind", "t", "g"], "full")
    counts = both.groupBy("kind", "t").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("c"))
    names = [(k, float(t), _overlap_name(k, t)) for k, ts in (("n", top), ("p", p_values), ("fdr", fdrs)) for t in ts]
    asked = pred.sparkSession.createDataFrame(names, "kind string, t double, metric string")
    value = F.when(F.col("kind") == "n", F.when((F.col("a") >= F.col("t")) & (F.col("b") >= F.col("t")), F.col("c") / F.col("t"))).otherwise(F.when(F.col("b") > 0, F.col("c") / F.col("b")))
    return asked.join(counts, ["kind", "t"], "left").select("metric", value.alias("value"))


def _overlap_name(kind: str, t: float) -> str:
    return f"Top{int(t)}_DEG_Overlap" if kind == "n" else f"{'P' if kind == 'p' else 'FDR'}<0{str(t).replace('.', '')}_DEG_Overlap"


def _spatial(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the values of both ends, and per variable its size, mean and squares."""
    stats = values.groupBy("variable").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    a = values.select(F.col("node").alias("source"), "variable", F.col("value").alias("x"))
    b = values.select(F.col("node").alias("target"), "variable", F.col("value").alias("y"))
    return edges.join(a, "source").join(b, ["target", "variable"]), stats


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Moran's I of each variable on a graph: ``variable, morans_i``, null where constant.

    ``edges (source, target, weight)``, ``values (node, variable, value)``.
    """
    joined, stats = _spatial(edges, values)
    sums = joined.join(stats, "variable").groupBy("variable").agg(F.sum(F.col("weight") * (F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))).alias("_c"), F.sum("weight").alias("_w"))
    return stats.join(sums, "variable", "left").select("variable", F.when((F.col("ss") > 0) & (F.col("_w") != 0), F.col("n") / F.col("_w") * F.col("_c") / F.col("ss")).alias("morans_i"))


def gearys_c(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Geary's C of each variable on a graph: ``variable, gearys_c``, null where constant."""
    joined, stats = _spatial(edges, values)
    sums = joined.groupBy("variable").agg(F.sum(F.col("weight") * (F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("_c"), F.sum("weight").alias("_w"))
    return stats.join(sums, "variable", "left").select("variable", F.when((F.col("ss") > 0) & (F.col("_w") != 0), (F.col("n") - 1) * F.col("_c") / (2 * F.col("_w") * F.col("ss"))).alias("gearys_c"))


def spatial_metrics(edges: DataFrame, values: DataFrame) -> DataFrame:
    return morans_i(edges, values).join(gearys_c(edges, values), "variable")


def confusion_matrix(pairs: DataFrame, orig: str, new: str, normalize: bool = True) -> DataFrame:
    """Every label of either side against every other: ``orig, new, value``.

    Counts, or shares of the row's sum; a row without pairs stays 0. ``label_order`` sorts
    labels with numbers in them as people do.
    """
    counts = pairs.groupBy(F.col(orig).cast("string").alias("orig"), F.col(new).cast("string").alias("new")).agg(F.count("*").cast("double").alias("c"))
    labels = counts.select(F.col("orig").alias("l")).union(counts.select("new")).distinct()
    grid = labels.select(F.col("l").alias("orig")).crossJoin(labels.select(F.col("l").alias("new")))  # labels of a classification
    full = grid.join(counts, ["orig", "new"], "left").fillna(0.0, ["c"])
    total = F.sum("c").over(Window.partitionBy("orig"))
    return full.select("orig", "new", (F.when(total > 0, F.col("c") / total).otherwise(0.0) if normalize else F.col("c")).alias("value"))


def label_order(column: str) -> list[Column]:
    """Sort keys for natural order: text before the first number, that number, the label."""
    number = F.expr(f"try_cast(nullif(regexp_extract({column}, '([0-9]+)', 1), '') AS DOUBLE)")
    return [F.regexp_extract(column, r"^(\D*)", 1), F.coalesce(number, F.lit(-1.0)), F.col(column)]


def evaluate_prediction(pred: DataFrame, true: DataFrame, ctrl: DataFrame, pred_degs: DataFrame | None = None, true_degs: DataFrame | None = None, gamma: float = 1.0, families: tuple[str, ...] = ("expression", "distribution", "direction", "deg_overlap")) -> DataFrame:
    """All families of metrics as ``metric, value``; gene lists are compared only where both are given."""
    wide = []
    if "expression" in families:
        wide.append(evaluate_perturbation(pred, true, ctrl))
    if "distribution" in families:
        wide.append(distribution_metrics(pred, true, gamma))
    if "direction" in families:
        wide.append(direction_metrics(pred, true, ctrl))
    long = [w.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in w.columns))).alias("s")).select("s.*") for w in wide]
    if "deg_overlap" in families and pred_degs is not None and true_degs is not None:
        long.append(deg_overlap(pred_degs, true_degs))
    out = long[0]
    for x in long[1:]:
        out = out.unionByName(x)
    return out


def perturbation_metrics(pairs: DataFrame, perturbation: str = "perturbation", control: str | None = "ctrl", de_flag: str | None = None) -> DataFrame:
    """mse, pearson, r2 and mae of mean predictions per perturbation, and over its marked genes.

    ``pairs (cell, gene, perturbation, pred, true)``; ``de_flag`` names a boolean column that
    marks a perturbation's expressed genes, for which controls have no value.
    """
    names = ["mse", "pearson", "r2", "mae"]
    means = pairs.groupBy(perturbation, "gene").agg(F.avg("pred").alias("pred"), F.avg("true").alias("true"), *([F.max(de_flag).alias("_de")] if de_flag else []))
    out = vector_metrics(means, [perturbation]).select(perturbation, *names)
    if not de_flag:
        return out
    marked = means.filter("_de") if control is None else means.filter(F.col("_de") & (F.col(perturbation) != control))
    return out.join(vector_metrics(marked, [perturbation]).select(perturbation, *(F.col(n).alias(f"{n}_de") for n in names)), perturbation, "left")


def de_gene_metrics(pairs: DataFrame, ranked: DataFrame, n_top: int = 20, perturbation: str = "perturbation") -> DataFrame:
    """The same over each perturbation's first ``n_top`` genes of a ranked test table."""
    best = ranked.filter(F.col("rank") <= n_top).select(F.col("target").alias(perturbation), F.col("feature").alias("gene"))
    return perturbation_metrics(pairs.join(best, [perturbation, "gene"], "left_semi"), perturbation, None)


def evaluation_pairs(pred: DataFrame, true: DataFrame, obs: DataFrame, perturbation: str = "perturbation", ranked: DataFrame | None = None, n_top: int = 20) -> DataFrame:
    """Predictions and truth side by side with each cell's label: ``cell, gene, perturbation, pred, true``.

    With a ranked test table, ``is_de`` marks the first ``n_top`` genes of the cell's label.
    """
    both = pred.select("cell", "gene", F.col("value").alias("pred")).join(true.select("cell", "gene", F.col("value").alias("true")), ["cell", "gene"])
    pairs = both.join(obs.select("cell", F.col(perturbation).alias("perturbation")), "cell")
    if ranked is None:
        return pairs.select("cell", "gene", "perturbation", "pred", "true")
    best = ranked.filter(F.col("rank") <= n_top).select(F.col("target").alias("perturbation"), F.col("feature").alias("gene"), F.lit(True).alias("is_de"))
    return pairs.join(best, ["perturbation", "gene"], "left").select("cell", "gene", "perturbation", "pred", "true", F.coalesce("is_de", F.lit(False)).alias("is_de"))


def direction_loss(rows: DataFrame, weight: float = 1e-3) -> DataFrame:
    """Squared error plus weighted squared error of signs of change: ``rows (pred, true, ctrl)``."""
    d, s = F.col("pred") - F.col("true"), F.signum(F.col("pred") - F.col("ctrl")) - F.signum(F.col("true") - F.col("ctrl"))
    return rows.agg((F.avg(d * d) + weight * F.avg(s * s)).alias("loss"))


def uncertainty_loss(rows: DataFrame, weight: float = 1.0, direction: float = 1e-3) -> DataFrame:
    """The same with squared error weighed by a predicted log variance: ``rows (pred, true, ctrl, log_var)``."""
    d, s = F.col("pred") - F.col("true"), F.signum(F.col("pred") - F.col("ctrl")) - F.signum(F.col("true") - F.col("ctrl"))
    return rows.agg((weight * F.avg(0.5 * F.exp(-F.col("log_var")) * d * d + 0.5 * F.col("log_var")) + direction * F.avg(s * s)).alias("loss"))
