"""An experiment as three tables, with the operators as methods that return new experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import de, embedding, graphs, hvg, labels, moments, preprocess, splits, vocab
from helixframe.sources import roles


@dataclass(frozen=True)
class Experiment:
    """``X (cell, gene, value[, layer])`` without zeros, ``obs (cell, ...)``, ``var (gene, gene_name, ...)``."""

    X: DataFrame
    obs: DataFrame
    var: DataFrame
    perturbation: str = "perturbation"
    controls: tuple[str, ...] = ("control",)
    ignored: tuple[str, ...] = ()
    cell_type: str | None = None
    layer: str | None = None

    @classmethod
    def guessed(cls, X: DataFrame, obs: DataFrame, var: DataFrame, **options) -> Experiment:
        """Roles that are not given are guessed from column names."""
        found = roles.roles(obs, var)
        obs = obs.withColumnRenamed(found["cell_id"], "cell") if "cell" not in obs.columns and found["cell_id"] else obs
        name = roles.guess([c for c in var.columns if c != "gene"], roles.GENE_NAME)
        var = var.withColumnRenamed(name, "gene_name") if "gene_name" not in var.columns and name else var
        return cls(X, obs, var, **({"cell_type": found["cell_type"]} | options))

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options) -> Experiment:
        """The three tables below ``path`` and the roles written with them; ``options`` come first."""
        X, obs, var = (spark.read.parquet(f"{path}/{name}") for name in ("X", "obs", "var"))
        about = spark.read.json(f"{path}/roles").first().asDict()
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in about.items()}
        return cls(X, obs, var, **(known | options))

    def write(self, path: str) -> None:
        """The tables as Parquet, and the roles of columns and labels as one JSON row."""
        for name in ("X", "obs", "var"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        about = {"perturbation": self.perturbation, "controls": list(self.controls), "ignored": list(self.ignored), "cell_type": self.cell_type, "layer": self.layer}
        schema = "perturbation string, controls array<string>, ignored array<string>, cell_type string, layer string"
        self.X.sparkSession.createDataFrame([tuple(about.values())], schema).coalesce(1).write.option("ignoreNullFields", False).json(f"{path}/roles")

    @property
    def matrix(self) -> DataFrame:
        rows = self.X.filter(F.col("layer") == self.layer) if self.layer else self.X
        return rows.select("cell", "gene", "value")

    @property
    def shape(self) -> tuple[int, int]:
        return self.obs.count(), self.var.count()

    def use_layer(self, layer: str | None) -> Experiment:
        if layer is not None and ("layer" not in self.X.columns or self.X.filter(F.col("layer") == layer).isEmpty()):
            raise KeyError(layer)
        return replace(self, layer=layer)

    def where(self, condition: Column | str) -> Experiment:
        """Cells that meet a condition on ``obs``, and their entries."""
        obs = self.obs.filter(condition)
        return replace(self, obs=obs, X=self.X.join(obs.select("cell"), "cell", "left_semi"))

    def take(self, places: int | slice | Sequence[int] | Sequence[bool], order: str = "cell") -> Experiment:
        """Cells by position in the order of ``order``: a number, a slice, numbers, or a flag for every cell.

        Negative numbers count from the end; a cell asked for twice comes once.
        """
        numbered = splits.places(self.obs, order)
        total = self.obs.count()
        if isinstance(places, slice):
            start, stop, step = places.indices(total)
            step_, low, high = abs(step), min(start, stop + 1 if step < 0 else start), max(stop, start + 1 if step < 0 else stop)
            wanted = (F.col("_place") >= low) & (F.col("_place") < high) & (F.pmod(F.col("_place") - start, F.lit(step_)) == 0)
            kept = numbered.filter(wanted)
        else:
            numbers = [places] if isinstance(places, int) and not isinstance(places, bool) else list(places)
            if numbers and all(isinstance(x, bool) for x in numbers):
                if len(numbers) != total:
                    raise IndexError(f"{len(numbers)} flags for {total} cells")
                numbers = [i for i, x in enumerate(numbers) if x]
            if any(not -total <= x < total for x in numbers):
                raise IndexError("no such cell")
            rows = self.obs.sparkSession.createDataFrame([(x % total,) for x in dict.fromkeys(numbers)], "_place long")
            kept = numbered.join(rows, "_place", "left_semi")
        obs = kept.select(*self.obs.columns)
        return replace(self, obs=obs, X=self.X.join(obs.select("cell"), "cell", "left_semi"))

    def align(self, targets: DataFrame) -> Experiment:
        entries, genes = vocab.align_genes(self.matrix, self.var, targets)
        return replace(self, X=entries, var=genes, layer=None)

    def deduplicated(self, policy: str = "error") -> Experiment:
        var = vocab.deduplicated(self.var, policy, "gene_name", "gene")
        return replace(self, var=var, X=self.X.join(var.select("gene"), "gene", "left_semi"))

    def flagged(self) -> DataFrame:
        return labels.flags(self.obs, self.perturbation, self.controls, self.ignored)

    def unique_perturbations(self, with_controls: bool = True) -> DataFrame:
        left_out = [*self.ignored, *(() if with_controls else self.controls)]
        return self.obs.select(self.perturbation).distinct().filter(~F.col(self.perturbation).isin(left_out or ["\0"]))

    def n_perturbations(self, with_controls: bool = True) -> int:
        return self.unique_perturbations(with_controls).count()

    def normalized(self, key_added: str | None = None, **options) -> Experiment:
        """Cells scaled to one total; ``key_added`` names a column of ``obs`` for the divisors."""
        factors = preprocess.size_factors(self.matrix, self.obs, **options)
        obs = self.obs.join(factors.select("cell", F.col("divisor").alias(key_added)), "cell", "left") if key_added else self.obs
        return replace(self, X=preprocess.divide_rows(self.matrix, factors), obs=obs, layer=None)

    def scaled(self, **options) -> Experiment:
        return replace(self, X=preprocess.scale(self.matrix, self.obs, **options), layer=None)

    def differential_expression(self, **options) -> DataFrame:
        return de.differential_expression(self.matrix, self.obs, self.perturbation, self.controls[0], **options)

    def rank_genes_groups(self, group: str | None = None, **options) -> DataFrame:
        return de.rank_genes_groups(self.matrix, self.obs, group or self.perturbation, **options)

    def highly_variable(self, **options) -> DataFrame:
        """All flavors, see ``hvg.highly_variable_genes``."""
        return hvg.highly_variable_genes(self.matrix, self.obs, **options)

    def variable_only(self, **options) -> Experiment:
        """The highly variable genes alone."""
        genes = self.highly_variable(subset=True, **options).select("gene")
        return replace(self, X=self.X.join(genes, "gene", "left_semi"), var=self.var.join(genes, "gene", "left_semi"))

    def mean_var(self, **options) -> DataFrame:
        return moments.mean_var(self.matrix, self.obs, **options)

    def split(self, **options) -> Experiment:
        return replace(self, obs=splits.split_obs(self.obs, self.perturbation, self.controls, self.ignored, **options))

    def split_cells(self, stratify: bool = True, **options) -> Experiment:
        """Train and test cells, within cell types where there are any."""
        return replace(self, obs=splits.split_cells(self.obs, stratify=self.cell_type if stratify else None, **options))

    def sample(self, n: int | None = None, frac: float | None = None, by_cell_type: bool = False, balance: bool = False, weight: Column | str | None = None, seed: int = 42) -> Experiment:
        """Some cells: plainly, by weight, or within cell types; one way at a time, each cell once."""
        if (n is None) == (frac is None):
            raise ValueError("give either n or frac")
        if weight is not None and (by_cell_type or balance):
            raise ValueError("weights don't go with sampling by cell type")
        if by_cell_type or balance:
            if not self.cell_type:
                raise ValueError("no cell type is known")
            obs = splits.sample_by_group(self.obs, self.cell_type, n, frac, balance, seed)
        elif weight is not None:
            obs = splits.sample_weighted(self.obs, weight, n, frac, seed)
        else:
            obs = splits.sample_cells(self.obs, n, frac, seed)
        return replace(self, obs=obs, X=self.X.join(obs.select("cell"), "cell", "left_semi"))

    def vocabulary(self, policy: str = "error") -> DataFrame:
        """Gene names in the order of gene numbers."""
        return vocab.vocabulary(self.var.select(F.col("gene").alias("idx"), F.col("gene_name").alias("token")), policy, drop_empty=True)

    def gene_names(self) -> DataFrame:
        """``gene, gene_name`` in the order of gene numbers."""
        return self.var.select("gene", "gene_name").orderBy("gene")

    def cell_types(self) -> DataFrame:
        """Cell types with their numbers in sorted order."""
        types = self.obs.select(F.col(self.cell_type).alias("token"))
        return graphs.numbered(types, "token")

    def paired(self, **options) -> DataFrame:
        return splits.pair_controls(self.obs, self.perturbation, self.controls, ignored=self.ignored, **options)

    def formatted(self, **options) -> Experiment:
        obs = labels.formatted(self.obs, self.perturbation, self.controls, self.ignored, **options)
        return replace(self, obs=obs, perturbation="condition", controls=(labels.CONTROL,))

    def records(self, split: str | None = None) -> DataFrame:
        obs = self.obs.filter(F.col("split") == split) if split else self.obs
        return embedding.records(self.matrix, obs, self.cell_type or "cell_type")

    def cached(self) -> Experiment:
        return replace(self, X=self.X.persist())

