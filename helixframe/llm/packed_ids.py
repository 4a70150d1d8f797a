"""Token ids in files: fixed-width bit packing with block offsets."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.encoding import decodable, encoder, vocabulary_path, vocabulary_size
from helixframe.llm.store import mapped, shared_folder, small_batches
from helixframe.llm.words import texts_of

#: Ids of a block; a multiple of 8, so that a block ends on a byte at any width.
BLOCK = 1024


@dataclass(frozen=True)
class TokenFiles:
    """``vocabulary``: a tokenizers file. ``vocabulary_size`` sets the width, the fewest bits that
    hold every id; 0 takes it from the file. ``files``: how many are written, 0 for one a
    shuffle partition."""

    vocabulary: str = ""
    vocabulary_size: int = 0
    files: int = 0

    @property
    def bits(self) -> int:
        return max(1, ((self.vocabulary_size or vocabulary_size(self.path())) - 1).bit_length())

    def path(self) -> str:
        return self.vocabulary or vocabulary_path("word_bpe_49k.json")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, least bit first, padded with zeros to a whole byte; larger ids are an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise OverflowError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    out = []
    for i in range(0, len(ids), BLOCK * 64):
        part = ids[i : i + BLOCK * 64].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = np.arange(n, dtype=np.int64) * bits
    words = np.zeros(n, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        words |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def read_range(data: bytes, block_offsets: np.ndarray, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a segment, touching only the blocks that hold them."""
    first = start // BLOCK
    base = int(block_offsets[first])
    ids = unpack(memoryview(data)[base : base + ((start + n - first * BLOCK) * bits + 7) // 8], bits, start + n - first * BLOCK)
    return ids[start - first * BLOCK :]


def write_ids(docs: DataFrame, path: str, p: TokenFiles = TokenFiles(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole documents and write their ids in ascending id order.

    Documents are dealt to files by ranges of their id and encoded there. A row of a file is
    a segment of about a million characters: packed ids of whole documents, block offsets, the
    documents' ids and ends, and the least and greatest id, which a reader can prune by.
    Rows without an id come first. Spark's writer commits files, so lost tasks are redone.
    """
    spark = docs.sparkSession
    n = p.files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path_, bits = p.path(), p.bits
    schema = "file long, segment long, bits int, n_ids long, least long, greatest long, block_offsets array<bigint>, docs array<bigint>, ends array<bigint>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = 0
        with encoder(path_) as known:
            for batch in batches:
                for i, j, texts in texts_of(batch.column(1)):
                    ids, bounds = known.encode_documents(decodable(texts))
                    names = batch.column(0).slice(i, j - i).to_pylist()
                    given = [x for x in names if x is not None]
                    offsets = np.arange(0, len(ids), BLOCK) * bits // 8
                    row = {"file": batch.column(2)[0].as_py(), "segment": segment, "bits": bits, "n_ids": len(ids), "least": min(given, default=None), "greatest": max(given, default=None)}
                    row |= {"block_offsets": offsets.tolist(), "docs": names, "ends": bounds[1:].tolist(), "data": pack(ids, bits)}
                    segment += 1
                    yield pa.RecordBatch.from_pylist([row], _ARROW)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id, or of none, may be very many: a hash of the text lets them be dealt to several files
    dealt = slim.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").withColumn("file", F.spark_partition_id().cast("long"))
    with small_batches(spark):
        mapped(dealt, run, schema).write.option("compression", "none").parquet(path)


_ARROW = pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("block_offsets", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it: those before in the segment, plus
    the segment's own start, summed over file and segment counts.
    """
    segments = spark.read.parquet(path)
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_file_start"))
    inside = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = segments.select("file", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_start"))
    index = index.join(starts, "file").select("file", "segment", (F.col("_start") + F.col("_file_start")).alias("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, segment, bits, n, docs, ends, data = (batch.column(c)[row] for c in range(7))
                ids = unpack(data.as_buffer(), bits.as_py(), n.as_py()).astype("<u4", copy=False)
                view = memoryview(ids).cast("B")
                e = np.asarray(ends.values)
                s = np.append(0, e[:-1])
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(s, e, strict=True)]
                k = len(e)
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(s), pa.array(e - s), pa.array(crc, pa.int64()), pa.array([file.as_py()] * k, pa.int64()), pa.array([segment.as_py()] * k, pa.int64())], ["doc_id", "_local", "n_tokens", "ids_crc32", "file", "segment"])

    read = mapped(segments.select("file", "segment", "bits", "n_ids", "docs", "ends", "data"), run, "doc_id long, _local long, n_tokens long, ids_crc32 long, file long, segment long", 8)
    return read.join(index, ["file", "segment"]).select("doc_id", (F.col("_first") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The ids of some documents, ``doc_id, ids``: random access to the files.

    Only segments whose range of ids may hold a wanted one are read, and of those only the
    blocks of the wanted documents are unpacked. An id that is not there gives no row; a
    repeated one a row each.
    """
    wanted = set(ids)
    if not wanted:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    segments = spark.read.parquet(path).filter((F.col("greatest") >= min(wanted)) & (F.col("least") <= max(wanted)))
    names = spark.createDataFrame([(x,) for x in wanted], "_doc long")
    holding = segments.select("file", "segment", F.explode("docs").alias("_doc")).join(names, "_doc", "left_semi").select("file", "segment").distinct()
    segments = segments.join(holding, ["file", "segment"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out, names = 0, [], []
                for name, end in zip(row["docs"], row["ends"], strict=True):
                    if name in wanted:
                        names.append(name)
                        out.append(read_range(row["data"], row["block_offsets"], row["bits"], start, end - start))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return mapped(segments.select("bits", "block_offsets", "docs", "ends", "data"), run, "doc_id long, ids array<long>", 8)


def token_files(docs: DataFrame, p: TokenFiles = TokenFiles(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` to new files in the shared folder and read them back.

    A null or empty text is the end id alone. Rows without an id come first, rows that
    repeat an id stand side by side in any order. Bytes that are no UTF-8 are read as U+FFFD;
    a text of any length is encoded whole and is a segment of its own. An empty table gives
    an empty result; further columns are not read.
    """
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, p, id_col, text_col)
    return read_ids(docs.sparkSession, path)
