"""Perturbation labels: canonical conditions, genes of combinations, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.splits import parts_of

CONTROL = "ctrl"


def condition(label: Column, controls: Sequence[str], ignored: Sequence[str] = ()) -> Column:
    """``ctrl``, ``A+ctrl`` or ``A+B`` with sorted distinct parts; ignored labels stay as they are."""
    text = F.coalesce(label.cast("string"), F.lit("nan"))
    parts = parts_of(text, ())
    return (
        F.when(text.isin(list(controls)), CONTROL)
        .when(text.isin(list(ignored) or ["\0"]), text)
        .when(F.size(parts) == 0, CONTROL)
        .when(F.size(parts) == 1, F.concat(parts[0], F.lit(f"+{CONTROL}")))
        .otherwise(F.array_join(parts, "+"))
    )


def formatted(obs: DataFrame, perturbation: str = "perturbation", controls: Sequence[str] = ("control",), ignored: Sequence[str] = (), drop_ignored: bool = True, cell_type: str = "cell_type", fallback_cell_type: str = "K562") -> DataFrame:
    """``obs`` with ``condition`` and a cell type; ignored cells go unless kept."""
    kept = obs.filter(~F.coalesce(F.col(perturbation).isin(list(ignored)), F.lit(False))) if ignored and drop_ignored else obs
    out = kept.withColumn("condition", condition(F.col(perturbation), controls, ignored))
    return out if cell_type in obs.columns else out.withColumn(cell_type, F.lit(fallback_cell_type))


def condition_list(formatted_obs: DataFrame) -> DataFrame:
    """Distinct conditions but control, sorted."""
    return formatted_obs.select("condition").distinct().filter(F.col("condition") != CONTROL).orderBy("condition")


def allowed(perturbations: DataFrame, genes: DataFrame) -> DataFrame:
    """Perturbations whose parts but control are all in ``genes (gene)``; bare controls stay."""
    lower = lambda c: F.lower(c).isin("ctrl", "control")
    labels = perturbations.select("perturbation").distinct()
    parts = labels.select("perturbation", F.explode(F.transform(F.split("perturbation", r"\+"), lambda x: F.trim(x))).alias("gene")).filter(~lower(F.col("gene")))
    bad = parts.join(genes.select("gene"), "gene", "left_anti").select("perturbation").distinct()
    return perturbations.join(bad, "perturbation", "left_anti")


def genes_of(perturbations: DataFrame, exclude_control: bool = True) -> DataFrame:
    """Distinct genes of all labels: ``gene``."""
    genes = perturbations.select(F.explode(F.transform(F.split("perturbation", r"\+"), lambda x: F.trim(x))).alias("gene")).filter("gene <> ''").distinct()
    return genes.filter(~F.lower("gene").isin("ctrl", "control")) if exclude_control else genes


def flags(obs: DataFrame, perturbation: str, controls: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """``is_control`` and ``is_perturbed``; a missing label counts as perturbed, as in the data model."""
    c = F.coalesce(F.col(perturbation).isin(list(controls)), F.lit(False))
    i = F.coalesce(F.col(perturbation).isin(list(ignored) or ["\0"]), F.lit(False))
    return obs.withColumn("is_control", c).withColumn("is_perturbed", ~c & ~i)
