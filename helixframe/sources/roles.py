"""Guesses of column roles from names: equal without case first, then contained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Names tried in this order.
CELL_TYPE = ("cell_type", "celltype", "cell_types", "celltypes", "cell type", "type", "cluster", "clusters", "cell_annotation", "annotation", "cell_label", "label")
GENE_NAME = ("gene_name", "gene_names", "genename", "gene", "genes", "gene_symbol", "symbol", "symbols", "gene_id", "gene_ids", "geneid", "feature_name", "feature")
CELL_ID = ("cell_id", "cellid", "cell_ids", "cell_name", "cellname", "barcode", "barcodes")


def guess(columns: Sequence[str], names: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in columns}
    equal = next((lower[n] for n in names if n in lower), None)
    return equal or next((c for n in names for c in columns if n in c.lower()), None)


def roles(obs: DataFrame, var: DataFrame) -> dict[str, str | None]:
    return {"cell_type": guess(obs.columns, CELL_TYPE), "gene_name": guess(var.columns, GENE_NAME), "cell_id": guess(obs.columns, CELL_ID)}
