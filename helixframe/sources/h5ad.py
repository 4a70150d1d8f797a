"""Annotated matrices in HDF5 files: a Spark data source, a writer of parts, and experiments from both.

``spark.read.format("h5ad").option("table", t).load(path)`` reads one table of a file, or of a
folder of files that hold the cells of one experiment one after another. Tables: ``X`` or
``layers/<name>`` (``cell, gene, value`` without zeros), ``obs`` (``cell, cell_name`` and its
columns), ``var`` (``gene, gene_name`` and its columns), ``obsm/<name>`` (``cell, values``).
Cells and genes are numbered by position. Further options: ``rows`` of a batch (4096; where there
are very many batches, a task reads up to 16, one after another),
``columns`` of ``obs`` and ``var`` to be read, by comma (their types, and all columns there
are, are those of the first file; a column that another file lacks is null), ``pushdown`` (true: conditions on the
number leave out blocks; needs ``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from helixframe.operators.splits import places
from helixframe.plans.experiment import Experiment
from helixframe.sources import hdf5, roles

#: Fixed values of the layout: the index column's attribute, and its usual name.
INDEX, INDEX_NAME = "_index", "_index"
#: Tasks from which a task is given more than one batch, and batches of a task at most.
_TASKS, _BATCHES = 256, 16


def files_of(path: str) -> list[str]:
    """The file, or the files of a folder by name."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    lead = path[: len(path) - len(place)] if path.endswith(place) else ""
    return [lead + x.path for x in sorted(system.get_file_info(fs.FileSelector(place)), key=lambda x: x.path) if x.path.endswith(".h5ad")]


def _matrix(file: hdf5.File, place: str) -> tuple[hdf5.Node, tuple[int, int], bool, bool]:
    """A matrix, its shape, whether it is sparse, and whether it is stored by genes."""
    item = file[place]
    if not item.is_group:
        return item, item.shape, False, False
    shape = item.attrs.get("shape", item.attrs.get("h5sparse_shape"))
    kind = str(item.attrs.get("encoding-type", item.attrs.get("h5sparse_format", "csr")))
    return item, tuple(int(x) for x in shape), True, "csc" in kind


def _column_type(item: hdf5.Node) -> str:
    if item.is_group:  # categories, or values with a mask
        return "string" if "categories" in item else _column_type(item["values"])
    if item.type.flag:
        return "boolean"
    return "string" if item.type.text else {"f": "double"}.get(item.type.dtype.kind, "long")


def _column(item: hdf5.Node, a: int, b: int) -> list:
    if item.is_group and "categories" in item:
        names, codes = item["categories"].read(), item["codes"].read(a, b)
        return [str(names[c]) if c >= 0 else None for c in codes.tolist()]
    if item.is_group:
        return [None if gone else x for x, gone in zip(_column(item["values"], a, b), item["mask"].read(a, b).tolist(), strict=True)]
    return item.read(a, b).tolist()


def _frame(group: hdf5.Node, key: str, wanted: list[str]) -> tuple[str, dict[str, str]]:
    """The index column of ``obs`` or ``var`` and the types of the others."""
    index = str(group.attrs.get(INDEX, INDEX_NAME))
    listed = [str(x) for x in np.atleast_1d(group.attrs.get("column-order", []))]
    names = [c for c in [*listed, *(x for x in group.keys() if x not in listed)] if c in group and c != index and not c.startswith("__") and c not in (key, f"{key}_name")]
    return index, {c: _column_type(group[c]) for c in ([w for w in wanted if w in names] if wanted else names)}


@dataclass
class Block(InputPartition):
    """Rows ``start`` to ``stop`` of the stored axis of a file whose first cell has number ``first``."""

    path: str
    start: int
    stop: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.path, self.table, self.rows = options["path"], options.get("table", "X"), int(options.get("rows", 4096))
        self.wanted = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[Block]:
        parts, first = [], 0
        for path in files_of(self.path):
            with hdf5.File(path) as file:
                shape, by_gene = _matrix(file, "X")[1], False
                if self.table == "X" or self.table.startswith("layers/"):
                    _, shape, _, by_gene = _matrix(file, self.table)
            n = shape[1] if self.table == "var" or by_gene else shape[0]
            offset = 0 if self.table == "var" else first
            low, high = (0, n) if by_gene else (max(0, self.low - offset), min(n, self.high - offset))
            parts.append((path, low // self.rows * self.rows, high, offset))
            first += shape[0]
            if self.table == "var":
                break
        batches = sum(len(range(low, high, self.rows)) for _, low, high, _ in parts)
        step = self.rows * max(1, min(_BATCHES, batches // _TASKS))
        blocks = [Block(path, a, min(high, a + step), offset) for path, low, high, offset in parts for a in range(low, high, step)]
        return blocks or [Block("", 0, 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.path:
            return
        with hdf5.File(block.path) as file:
            for a in range(block.start, block.stop, self.rows):
                yield self._batch(file, Block(block.path, a, min(block.stop, a + self.rows), block.first))

    def _batch(self, file: hdf5.File, block: Block) -> pa.RecordBatch:
        if self.table in ("obs", "var"):
            return self._rows(file, block)
        if self.table.startswith("obsm/"):
            values = np.asarray(file[self.table].read(block.start, block.stop), float)
            number = pa.array(np.arange(block.start, block.start + len(values)) + block.first)
            return pa.RecordBatch.from_arrays([number, pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.float64()))], ["cell", "values"])
        return self._entries(file, block)

    def _rows(self, file: hdf5.File, block: Block) -> pa.RecordBatch:
        key = "cell" if self.table == "obs" else "gene"
        group = file[self.table]
        index, _ = _frame(group, key, self.wanted)
        types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        columns = [pa.array(np.arange(block.start, block.stop) + block.first), pa.array([str(x) for x in _column(group[index], block.start, block.stop)], pa.string())]
        for c in list(self.kinds)[2:]:  # types are those of the first file
            values = pa.array(_column(group[c], block.start, block.stop) if c in group else [None] * (block.stop - block.start))
            columns.append(values.cast(types[self.kinds[c]], safe=False))
        return pa.RecordBatch.from_arrays(columns, list(self.kinds))

    def _entries(self, file: hdf5.File, block: Block) -> pa.RecordBatch:
        item, _, sparse, by_gene = _matrix(file, self.table)
        if sparse:
            ends = item["indptr"].read(block.start, block.stop + 1).astype(np.int64)
            major = np.repeat(np.arange(block.start, block.stop), np.diff(ends))
            minor, value = item["indices"].read(ends[0], ends[-1]).astype(np.int64), item["data"].read(ends[0], ends[-1]).astype(float)
        else:
            dense = item.read(block.start, block.stop).astype(float)
            major, minor = np.nonzero(dense)
            value, major = dense[major, minor], major + block.start
        keep = value != 0
        cell, gene = (minor, major) if by_gene else (major, minor)
        return pa.RecordBatch.from_arrays([pa.array(cell[keep] + block.first), pa.array(gene[keep].astype(np.int64)), pa.array(value[keep])], ["cell", "gene", "value"])


class _PushingReader(_Reader):
    """Leaves out blocks that conditions on the number exclude; Spark still checks every row."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        key = "gene" if self.table == "var" else "cell"
        for f in filters:
            if getattr(f, "attribute", None) == (key,) and isinstance(getattr(f, "value", None), tuple | list | int):
                values = [int(x) for x in np.atleast_1d(f.value)]
                if isinstance(f, EqualTo | In) and values:
                    self.low, self.high = max(self.low, min(values)), min(self.high, max(values) + 1)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, values[0] + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, values[0] + isinstance(f, LessThanOrEqual))
            yield f


class H5ad(DataSource):
    """See the module. A damaged file, or a part of the format that is not read, is an error."""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> str:
        table = self.options.get("table", "X")
        if table == "X" or table.startswith("layers/"):
            return "cell long, gene long, value double"
        if table.startswith("obsm/"):
            return "cell long, values array<double>"
        if table not in ("obs", "var"):
            raise ValueError(f"no table {table!r}: X, layers/<name>, obs, var or obsm/<name>")
        key = "cell" if table == "obs" else "gene"
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        found = files_of(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no .h5ad file in {self.options['path']}")
        with hdf5.File(found[0]) as file:
            _, kinds = _frame(file[table], key, wanted)
        return ", ".join([f"`{key}` long", f"`{key}_name` string", *(f"`{c}` {k}" for c, k in kinds.items())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PushingReader if str(self.options.get("pushdown", "")).lower() == "true" else _Reader)(dict(self.options), schema)


def read_h5ad(spark: SparkSession, path: str, layer: str | None = None, rows: int = 4096, duplicates: str | None = "error", **options) -> Experiment:
    """An experiment from a file or a folder of parts that driver and executors share.

    The driver reads shapes and column types; tasks read blocks of ``rows`` cells (genes, where
    a matrix is stored by genes). ``layer`` takes a layer instead of the matrix. ``duplicates``
    says what to do with a gene name that comes twice: ``error``, ``first``, ``last``, ``remove``,
    or None to keep all. Roles that ``options`` do not give are guessed from column names; an
    empty ``cell_type`` is none.
    """
    spark.dataSource.register(H5ad)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()

    def table(name: str) -> DataFrame:
        return spark.read.format("h5ad").option("table", name).option("rows", rows).option("pushdown", pushed).load(path)

    obs, var = table("obs"), table("var")
    guessed = roles.guess([c for c in var.columns if c not in ("gene", "gene_name")], roles.GENE_NAME)
    if guessed:  # a column of names comes before the index
        var = var.drop("gene_name").withColumnRenamed(guessed, "gene_name")
    known = {"cell_type": roles.guess([c for c in obs.columns if c not in ("cell", "cell_name")], roles.CELL_TYPE)} | options
    found = Experiment(table(f"layers/{layer}" if layer else "X"), obs, var, **known)
    return found.deduplicated(duplicates) if duplicates else found


def _stored(values: pd.Series, kind: str) -> dict | np.ndarray:
    """A column as it is stored for its Spark type: numbers and flags as such, with a mask where some are missing, all else as categories."""
    missing = values.isna().to_numpy()
    if kind in ("double", "float") or kind.startswith("decimal"):
        return values.astype(float).to_numpy()
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        known = values.where(~missing, 0).astype(bool if kind == "boolean" else np.int64).to_numpy()
        encoding = "nullable-boolean" if kind == "boolean" else "nullable-integer"
        return {"@": {"encoding-type": encoding, "encoding-version": "0.1.0"}, "values": known, "mask": missing} if missing.any() else known
    codes, names = pd.factorize(values.map(str, na_action="ignore"), sort=True)
    return {"@": {"encoding-type": "categorical", "encoding-version": "0.2.0", "ordered": False}, "codes": codes.astype(np.int32), "categories": np.array(list(names), object)}


def _stored_frame(frame: pd.DataFrame, names: pd.Series, kinds: dict[str, str]) -> dict:
    held = {c: _stored(frame[c], kinds[c]) for c in frame.columns}
    about = {INDEX: INDEX_NAME, "encoding-type": "dataframe", "encoding-version": "0.2.0", "column-order": np.array(list(frame.columns), object)}
    return {"@": about, INDEX_NAME: (np.array(names.map(str).tolist(), object), {"encoding-type": "string-array", "encoding-version": "0.2.0"})} | held


def write_h5ad(experiment: Experiment, path: str, cells: int = 4096, name_col: str = "cell") -> DataFrame:
    """Write an experiment as a folder of files of ``cells`` cells each: ``file, cells, entries``, a row a file.

    Cells stand in the order of ``cell`` through the files, genes in the order of ``gene``. A
    task holds one file; the gene table, a row a gene, is in every file and goes through the
    driver. A file gets its name when it is whole, so a task that is run again replaces it.
    Repeated entries of a cell and gene add up; entries of unknown cells or genes are left out.
    """
    var = experiment.var.orderBy("gene").toPandas()
    genes = var["gene"].to_numpy()
    labels = var["gene_name"] if "gene_name" in var else var["gene"]
    about = _stored_frame(var.drop(columns=["gene", *(["gene_name"] if "gene_name" in var else [])]), labels, dict(experiment.var.dtypes))
    kinds = dict(experiment.obs.dtypes)
    obs = places(experiment.obs, "cell").withColumn("_part", F.floor(F.col("_place") / cells))
    entries = experiment.matrix.filter(F.col("value") != 0).join(obs.select("cell", F.col("_place").alias("_at"), F.col("_part").alias("_file")), "cell").select("_file", "_at", "gene", "value")

    def write(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_place")
        frame = left.drop(columns=["_place", "_part", *({"cell", "cell_name"} - {name_col}), *([name_col] if name_col in ("cell", "cell_name") else [])], errors="ignore")
        row, column = right["_at"].to_numpy() - int(key[0]) * cells, np.searchsorted(genes, right["gene"].to_numpy())
        known = (column < len(genes)) & (genes[np.minimum(column, len(genes) - 1)] == right["gene"].to_numpy()) if len(genes) else np.zeros(len(column), bool)
        place, which = np.unique(row[known] * len(genes) + column[known], return_inverse=True)
        data = np.bincount(which, right["value"].to_numpy(float)[known], len(place)) if len(place) else np.zeros(0)
        ends = np.searchsorted(place, np.arange(len(left) + 1) * len(genes)).astype(np.int64)
        matrix = {"@": {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": np.array([len(left), len(genes)], np.int64)}, "data": data, "indices": (place % max(1, len(genes))).astype(np.int32), "indptr": ends}
        out = f"{path.rstrip('/')}/part-{int(key[0]):08d}.h5ad"
        hdf5.save(out, {"@": {"encoding-type": "anndata", "encoding-version": "0.1.0"}, "X": matrix, "obs": _stored_frame(frame, left[name_col], kinds), "var": about})
        return pd.DataFrame({"file": [out], "cells": [len(left)], "entries": [len(data)]})

    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(place)
    made = obs.groupBy("_part").cogroup(entries.groupBy("_file")).applyInPandas(write, "file string, cells long, entries long")
    return experiment.obs.sparkSession.createDataFrame(sorted(made.collect()), made.schema)  # a row a file; a sort by Spark would write all twice, for its bounds
