"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import ranked


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score for ``key`` is highest: -weight / ln(u), u drawn from key and shard.

    A further shard only takes keys that it wins itself; a removed one only gives its own.
    A weight of 0 takes nothing. Null keys go to one shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be 0 or more, and one above 0")

    def score(i: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.lit(-float(weights[i])) / F.log(u)).alias("score"), F.lit(i).alias("shard"))

    return F.array_max(F.array(*(score(i) for i in range(len(weights)) if weights[i] > 0)))["shard"]


def sharded(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to weighted shards by their key and number them within each shard.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: UTF-8 bytes plus 8,
    checksum of the text (of nothing for null), the law ``key``, the shard, a gapless number
    in it, and the shard under one more of the mean weight. Rows that repeat a key share a
    shard and have slots of their own, in any order where they are alike; equal scores go to
    the later shard. A null key is a key of its own. Texts of any length and any bytes are
    measured whole. Rows are numbered in salted parts of a shard, and no text is shuffled. An
    empty table gives an empty result; further columns are not read.
    """
    key = F.col(key_col).cast("long")
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"),
    )
    return ranked(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", file_bytes: int = 256 << 20) -> None:
    """Write whole rows to one folder per shard, in files of about ``file_bytes`` bytes of text, sorted by key.

    Rows without a key are one key and may share a file; null texts have no bytes. A shard
    without rows has no folder, and an empty table writes none.
    """
    dealt = docs.withColumn("shard", shard_of(F.col(key_col).cast("long"), weights))
    files = F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 64) / file_bytes))
    counts = dealt.groupBy("shard").agg(files.cast("int").alias("_files"))
    total = counts.agg(F.sum("_files")).first()[0] or 1  # one number
    parted = dealt.join(F.broadcast(counts), "shard").withColumn("_part", F.pmod(F.xxhash64(key_col, F.lit(0)), F.col("_files")))  # a row a shard
    parted.repartition(int(total), "shard", "_part").drop("_part", "_files").sortWithinPartitions("shard", key_col).write.partitionBy("shard").parquet(path)
