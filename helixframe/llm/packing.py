"""Packing documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.encoding import decodable, encoder, vocabulary_path
from helixframe.llm.store import mapped, ranked, written
from helixframe.llm.words import texts_of


@dataclass(frozen=True)
class Packing:
    """``length``: tokens of a sequence. ``vocabulary``: a tokenizers file."""

    length: int = 2048
    vocabulary: str = ""

    def path(self) -> str:
        return self.vocabulary or vocabulary_path("byte_bpe_50k.json")


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns ``(count, lengths)`` for a histogram of lengths up to ``length``.

    Lengths are placed longest first, each into the pack with most room (the shortest); of a
    pattern that is used only in part, the rest stays as it was. Whatever finds no room opens
    new packs. Work and memory depend on the number of different lengths alone.
    """
    room: dict[int, list[list]] = {}  # room left -> patterns of that room: [count, lengths]
    rooms: list[int] = []  # sorted

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(rooms, space)
        room[space].append([count, lengths])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            widest = rooms[-1] if rooms and rooms[-1] >= size else 0
            if not widest:  # open packs, holding one length each
                put(length - size, left, (size,))
                break
            pattern = room[widest].pop()
            if not room[widest]:
                del room[widest]
                rooms.pop()
            used = min(left, pattern[0])
            if used < pattern[0]:
                put(widest, pattern[0] - used, pattern[1])
            put(widest - size, used, (*pattern[1], size))
            left -= used
    merged: dict[tuple[int, ...], int] = {}
    for patterns in room.values():
        for count, lengths in patterns:
            merged[lengths] = merged.get(lengths, 0) + count
    return [(n, k) for k, n in sorted(merged.items())]


def _intervals(spark: SparkSession, patterns: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """For each length, which ranks go to which pattern, place and first sequence."""
    rows, taken, sequence = [], {}, 0
    for count, lengths in patterns:
        for size in dict.fromkeys(lengths):
            many = lengths.count(size)
            start = taken.get(size, 0)
            rows.append((size, start, start + count * many, many, sequence, sum(lengths[: lengths.index(size)])))
            taken[size] = start + count * many
        sequence += count
    return spark.createDataFrame(rows, "length long, low long, high long, many long, first long, place long")


def pieces(docs: DataFrame, p: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, cut at multiples of the sequence length: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    path, n = p.path(), p.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as known:
            for batch in batches:
                for i, j, texts in texts_of(batch.column(1)):
                    ids, bounds = known.encode_documents(decodable(texts))
                    data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    row, start, size, crc, total = [], [], [], [], []
                    for k in range(j - i):
                        a, b = int(bounds[k]), int(bounds[k + 1])
                        for s in range(a, b, n):
                            e = min(s + n, b)
                            row.append(k), start.append(s - a), size.append(e - s), total.append(b - a)
                            crc.append(zlib.crc32(data[4 * s : 4 * e]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(slim, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, p: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``length`` tokens that hold every id of every document once.

    A document is encoded whole, ended with id 1, and cut at multiples of ``length``; full
    pieces are sequences of their own, the rest is packed by ``shortest_pack_first`` over
    the histogram of lengths (at most ``length`` rows reach the driver). Pieces of a length
    are numbered in salted parts, so a length that many documents share is no single task,
    and a number's pattern is found by joining the patterns' rank intervals.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.
    A null or empty text is one piece of the end id alone. Repeated rows and rows without an
    id are packed like others; pieces of one length that are alike in id, start and checksum
    may change places. Bytes that are no UTF-8 are read as U+FFFD. A text longer than a
    sequence, however long, is cut and shares its last sequence only. An empty table gives an
    empty result; further columns are not read.
    """
    cut = written(pieces(docs, p, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _intervals(docs.sparkSession, shortest_pack_first(histogram, p.length))
    numbered = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank")
    near = numbered.join(F.broadcast(places.withColumnRenamed("length", "_size")), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    within = F.col("_rank") - F.col("low")
    return near.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(within / F.col("many"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(within, F.col("many")) * F.col("length")).cast("long").alias("offset"),
    )
