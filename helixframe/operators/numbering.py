"""Numbers in the order of any columns, from range partitions with carried counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.lineage import cut


def in_order(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: each row's number from 0 in the order given, of any sortable types.

    Rows are dealt to ranges by Spark's sampled bounds and sorted there; the sizes of the
    ranges before, one number a range, shift each range's own. Equal rows are told apart by
    where they were read, so a value that many rows share is dealt to several tasks too. The
    ranges are kept in the shared folder, as bounds sampled again could be others.
    """
    spark = df.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_k{i}" for i in range(len(keys))] + ["_read"]
    marked = df.withColumns(dict(zip(names, [*keys, F.monotonically_increasing_id()], strict=True)))
    placed = cut(marked.repartitionByRange(ranges, *names).sortWithinPartitions(*names).drop(*names).withColumn("_id", F.monotonically_increasing_id()))
    split = placed.withColumns({"_range": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = split.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return split.join(F.broadcast(starts), "_range").withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).select(*df.columns, out)  # a row a range


def running(df: DataFrame, key: str, order: str, sums: list[str], totals: dict[str, Column] | None = None, following: str | None = None) -> DataFrame:
    """Sums up to each row in the order of ``order`` within ``key``, of which one may hold any number of rows.

    Adds ``_upto_<c>`` and ``_all_<c>`` for each column of ``sums``, each of ``totals`` (an
    expression that is added up) and, as ``following``, the next value of ``order``. Rows are
    dealt to ranges of key and order, so a key of very many rows is many tasks; sums and first
    values of the ranges, a row a key and range, are carried from one to the next.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(ranges, key, order).withColumn("_range", F.spark_partition_id()))
    added = {**{f"_s_{c}": F.sum(c) for c in sums}, **{f"_t_{n}": F.sum(e) for n, e in (totals or {}).items()}}
    parts = placed.groupBy(key, "_range").agg(F.min(order).alias("_first"), *(e.alias(n) for n, e in added.items()))
    along, whole = Window.partitionBy(key).orderBy("_range"), Window.partitionBy(key)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col(key), "_range", F.lead("_first").over(along).alias("_next"),
        *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0.0)).alias(f"_b_{c}") for c in sums), *(F.sum(f"_s_{c}").over(whole).alias(f"_all_{c}") for c in sums), *(F.sum(f"_t_{n}").over(whole).alias(n) for n in totals or {}),
    )
    inside = Window.partitionBy(key, "_range").orderBy(order)
    here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({f"_upto_{c}": F.sum(c).over(here) for c in sums} | {"_lead": F.lead(order).over(inside)}).join(carried, [key, "_range"])
    more = [F.coalesce("_lead", "_next").alias(following)] if following else []
    return out.select(*df.columns, *((F.col(f"_upto_{c}") + F.col(f"_b_{c}")).alias(f"_upto_{c}") for c in sums), *(f"_all_{c}" for c in sums), *(totals or {}), *more)
