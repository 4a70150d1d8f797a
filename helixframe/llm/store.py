"""Shared-folder tables, fixed-size id filters and id ranking for the operators here."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.operators.lineage import folder

#: Bits of the id filter: one megabyte, whatever the size of the table behind it.
FILTER_BITS = 1 << 23


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share; see ``lineage.folder``."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 400, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of few rows and bytes for the jobs run inside; the session's settings come back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only a reread of replicated files.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def cleared(spark: SparkSession) -> None:
    """Delete every table that operators of this application still hold in the shared folder.

    A lazy result reads some of them, so call this once all results are saved.
    """
    delete(spark, shared_folder(spark))


def _released() -> None:
    """Give back memory that the allocators of a Python worker keep after a task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = 400) -> DataFrame:
    """``df.mapInArrow`` with batches cut to ``rows`` rows; a worker gives its memory back after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))
        finally:
            _released()

    return df.mapInArrow(task, schema)


def fresh(taken: list[str], n: int) -> list[str]:
    """``n`` column names that clash with none of ``taken``."""
    used = {c.lower() for c in taken}
    return [x for k in range(len(taken) + n) if (x := f"_c{k}") not in used][:n]


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def only_ids(df: DataFrame, ids: DataFrame, id_col: str, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is in ``ids``, with few others, without shuffling ``df``.

    A bitmap of FILTER_BITS bits (at most 131,072 rows of 16 bytes, at any input size) is
    broadcast. Rows it lets through by chance must be harmless to the caller, who joins on
    the id anyway; when very many ids fill the bitmap it only filters less.
    """
    words = (
        ids.select(_bit(F.col(key)).alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")).alias("_bits"))
    )
    kept = df.withColumn("_bit", _bit(F.col(id_col))).join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_word"))
    return kept.filter(F.expr("(shiftright(_bits, CAST(_bit & 63 AS INT)) & 1L) = 1L")).drop("_bit", "_word", "_bits")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Add ``out``: a gapless number from 0 in each group, without a task that holds a group.

    Rows are dealt to ``salts`` parts of each group by a hash of ``order``, by default 64 or
    the number of shuffle partitions; a part is numbered by itself and shifted by the sizes
    of the parts before it.
    """
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inner) - 1)
    return numbered.join(starts, [*group, "_salt"]).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_salt", "_start", "_row")
