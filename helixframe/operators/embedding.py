"""Per-cell quantile bins and cell embeddings from gene vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.splits import uniform


def expression_bins(X: DataFrame, n_bins: int = 51, spread: int | None = None) -> DataFrame:
    """Quantile bin of each non-zero entry within its cell: ``cell, gene, bin``, from 1.

    Edges are ``n_bins - 1`` evenly spaced quantiles of the cell's non-zero values; a value's
    bin is the number of edges at or below it, at least 1. Where edges tie that is the highest
    of the bins the value may have; with a seed in ``spread`` it is one of them by a hash of
    seed, cell and gene.
    """
    entries = X.filter("value <> 0")
    shares = ", ".join(repr(i / (n_bins - 2)) for i in range(n_bins - 1)) if n_bins > 2 else "0.0"
    edges = entries.groupBy("cell").agg(F.expr(f"percentile(value, array({shares}))").alias("_e"))
    placed = entries.join(edges, "cell").withColumn("_high", F.expr("size(filter(_e, e -> e <= value))"))
    if spread is not None:
        ties = F.col("_high") - F.expr("size(filter(_e, e -> e < value))")
        drawn = F.floor(uniform(F.concat_ws(":", F.col("cell").cast("string"), F.col("gene").cast("string")), spread) * ties).cast("int")
        placed = placed.withColumn("_high", F.col("_high") - F.when(ties > 0, drawn).otherwise(0))
    return placed.select("cell", "gene", F.greatest(F.lit(1), F.col("_high")).alias("bin"))


def cell_embeddings(X: DataFrame, vectors: DataFrame, mode: str = "weighted") -> DataFrame:
    """Sum of gene vectors times expression: ``cell, dim, value``.

    ``weighted`` divides by the cell's total (at least 1e-8), ``average`` by the number of its
    expressed genes (at least 1). Genes without a vector (``gene, vector``) add nothing but
    count in the divisor.
    """
    totals = X.groupBy("cell").agg(F.sum("value").alias("_t"), F.count_if(F.col("value") > 0).cast("double").alias("_k"))
    divisor = F.greatest(F.col("_t"), F.lit(1e-8)) if mode == "weighted" else F.greatest(F.col("_k"), F.lit(1.0))
    long = vectors.select("gene", F.posexplode("vector").alias("dim", "x"))
    sums = X.join(long, "gene").groupBy("cell", "dim").agg(F.sum(F.col("value") * F.col("x").cast("double")).alias("s"))
    return sums.join(totals.select("cell", divisor.alias("_d")), "cell").select("cell", "dim", (F.col("s") / F.col("_d")).alias("value"))


def vector_coverage(genes: DataFrame, vectors: DataFrame, shown: int = 20) -> DataFrame:
    """One row: genes with and without a vector, and the first unknown ones."""
    marked = genes.select("gene").join(vectors.select("gene", F.lit(1).alias("_v")), "gene", "left")
    first = marked.filter("_v IS NULL").orderBy("gene").limit(shown).agg(F.sort_array(F.collect_list("gene")).alias("unknown"))
    return marked.agg(F.count("_v").alias("n_matched"), F.count_if(F.col("_v").isNull()).alias("n_unknown")).crossJoin(first)  # a row each


def records(X: DataFrame, obs: DataFrame, cell_type: str = "cell_type") -> DataFrame:
    """Cells as records for batch export: sorted indices and values, type and its number."""
    types = obs.select(cell_type).distinct().withColumn("cell_type_idx", F.row_number().over(Window.orderBy(cell_type)) - 1)
    entries = X.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("_e"))
    out = obs.join(entries, "cell", "left").join(types, cell_type, "left")
    return out.select("cell", cell_type, "cell_type_idx", F.col("_e.gene").alias("indices"), F.col("_e.value").alias("values"))
