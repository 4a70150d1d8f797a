"""Filter interaction audit: what every order of five filters removes, part by part, from mask counts alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.encoding import decodable
from helixframe.llm.store import mapped
from helixframe.llm.words import own, repeats, sums, texts_of, words_of

LETTERS = "ABCDE"
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True


@dataclass(frozen=True)
class Filters:
    """Failure conditions: A: fewer than ``words`` words; B: distinct words below ``distinct``
    percent of them; C: capitals above ``capitals`` percent of the code points; D: a symbol;
    E: the text of a smaller id. Each has the bit of its letter in a mask."""

    words: int = 50
    distinct: int = 65
    capitals: int = 5


def own_failures(docs: DataFrame, p: Filters = Filters(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, id, digest, failed``: a row for each row of ``docs``, with the mask of its failures of A to D.

    A null text is empty and a null part the empty string; bytes that are no UTF-8 are U+FFFD.
    ``digest`` (128 bits) stands for the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(2)):
                texts = decodable(texts)
                words = words_of(texts)
                n = words.counts
                _, before = repeats(own(words.hashes, words.owner))
                points = sums((texts.data & 0xC0) != 0x80, texts.bounds)
                failed = (n < p.words).astype(np.int32)
                failed |= (100 * sums(~before, words.bounds) < p.distinct * n).astype(np.int32) << 1
                failed |= (100 * sums(_CAPITAL[texts.data], texts.bounds) > p.capitals * points).astype(np.int32) << 2
                failed |= (sums(_SYMBOL[texts.data], texts.bounds) > 0).astype(np.int32) << 3
                digests = [hashlib.blake2b(texts.text(k), digest_size=16).digest() for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(digests, pa.binary()), pa.array(failed)], ["part", "id", "digest", "failed"])

    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "part string, id long, digest binary, failed int")


def mask_counts(docs: DataFrame, labels: DataFrame, p: Filters = Filters(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, failed, n, good, toxic``: documents of each part that fail exactly the filters of a mask.

    Repeated rows count each. A row without an id fails E never and is no smaller id; rows of
    one id do not fail by each other. A document is good or toxic if any of its labels says so;
    a label without an id belongs to none.
    Copies of a text are counted by part, mask and label before they meet, so a text that a
    third of all rows share is a few rows.
    """
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = own_failures(docs, p, id_col, text_col, part_col).join(flags, "id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "failed", "good", "toxic"]
    by_id = rows.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    copies = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose")
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    passing = copies.withColumn("passing", F.col("loose") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0))
    both = passing.select("part", "good", "toxic", F.explode(F.array(F.struct("failed", F.col("passing").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("passing")).alias("n")))).alias("_x"))
    return both.select("part", "good", "toxic", "_x.*").groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficients, one a set of filters, of the multilinear extension of "how many documents do these filters remove".

    A document of mask m is removed unless none of m's filters is used: 1 - prod(1 - x_i, i in m).
    Multiplied out, the coefficient of a set T other than the empty one is the count of masks
    that hold T, negative where T has an even number of filters.
    """
    sets = range(1 << filters)
    return [0] + [(1 if t.bit_count() % 2 else -1) * sum(c for m, c in counts.items() if m & t == t) for t in sets[1:]]


def corner(polynomial: list[int], used: int) -> int:
    """The polynomial where the filters of ``used`` are 1 and the others 0: the documents that they remove."""
    return sum(a for t, a in enumerate(polynomial) if t & used == t)


def shapley(polynomial: list[int], filters: int, which: int) -> Fraction:
    """The integral of the partial derivative by ``which`` along the diagonal, exactly."""
    derivative = [0] * filters  # coefficients of t ** k on the diagonal
    for t, a in enumerate(polynomial):
        if t >> which & 1:
            derivative[t.bit_count() - 1] += a
    return sum((Fraction(d, k + 1) for k, d in enumerate(derivative)), Fraction(0))


def interactions(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> Iterator[tuple]:
    """Rows of one part: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n, every = len(letters), (1 << len(letters)) - 1
    removed, good, toxic = ([corner(a, s) for s in range(every + 1)] for a in (removal_polynomial({m: c[k] for m, c in counts.items()}, n) for k in range(3)))
    total = sum(c[0] for c in counts.values())
    extension = removal_polynomial({m: c[0] for m, c in counts.items()}, n)
    shares = [shapley(extension, n, i) * factorial(n) for i in range(n)]
    if any(s.denominator != 1 for s in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    for order in permutations(range(n)):
        used = 0
        for step, i in enumerate(order, 1):
            after = used | 1 << i
            here = removed[after] - removed[used]
            yield "".join(letters[k] for k in order), step, total - removed[after], here, removed[1 << i] - here, removed[every] - removed[every ^ 1 << i], good[after] - good[used], toxic[after] - toxic[used], int(shares[i])
            used = after


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(masks: DataFrame) -> DataFrame:
    """Every order and step of each part of ``mask_counts``; a part's 32 counts are one row, so parts are independent tasks.

    Parts without documents do not occur, so an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(interactions({x["failed"]: (x["n"], x["good"], x["toxic"]) for x in entries}))
                columns = [[part] * len(found), *zip(*found, strict=True)]
                types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return mapped(masks.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("masks")), run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, p: Filters = Filters(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a part, order of the five filters and step; see ``mask_counts`` for nulls, repeats and ties.

    Very long texts are read whole, in runs of about a megabyte of whole texts.
    """
    return audited(mask_counts(docs, labels, p, id_col, text_col, part_col))
