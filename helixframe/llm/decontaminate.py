"""Benchmark decontamination by word suffix arrays over shards of the training documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import mapped, written
from helixframe.llm.words import ITEM_WORD, LOWER, Texts, sums, texts_of, words_of


@dataclass(frozen=True)
class Decontaminate:
    """``window``: words of a match that counts. ``shard_mb``: text under one suffix array.
    ``block_bytes``: benchmark text of a block (an item is never cut). ``at_once``: blocks that
    a pass over the documents searches; more benchmark, more passes, and never more memory."""

    window: int = 10
    shard_mb: int = 1
    block_bytes: int = 8 << 20
    at_once: int = 4


@dataclass
class _Items:
    """A block of benchmark items as word numbers, one after another, 0 after each."""

    ids: list[int]
    vocabulary: np.ndarray  # sorted word fingerprints; a word's number is its place plus 1
    numbers: np.ndarray
    starts: np.ndarray  # test suffixes that start a window
    lengths: np.ndarray  # and that window's words
    owner: np.ndarray


def _items(rows: list, p: Decontaminate) -> _Items:
    ids, texts = [r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())
    hashes, lengths = [], []
    for _, _, t in texts_of(texts, 1 << 62):
        words = words_of(t, ITEM_WORD, LOWER)
        hashes, lengths = words.hashes, words.counts
    vocabulary = np.unique(np.asarray(hashes, np.uint64))
    numbers, starts, sizes, owner, at, k = [], [], [], [], 0, 0
    for i, n in enumerate(np.asarray(lengths)):
        numbers.append(np.searchsorted(vocabulary, hashes[k : k + n]) + 1)
        numbers.append(np.zeros(1, np.int64))
        if n:
            w = min(int(n), p.window)
            starts.append(np.arange(at, at + n - w + 1))
            sizes.append(np.full(n - w + 1, w)), owner.append(np.full(n - w + 1, i))
        at, k = at + n + 1, k + n
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return _Items(ids, vocabulary, join(numbers), join(starts), join(sizes), join(owner))


def suffix_array(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` in the order of the suffixes of ``numbers`` that start there; a 0 ends a suffix.

    Prefix doubling: ranks of the first k words give ranks of the first 2k, until no two
    suffixes that can go on share a rank.
    """
    n = len(numbers)
    if not len(at):
        return at
    stop = np.flatnonzero(np.append(numbers, 0) == 0)
    left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)  # words before the next 0
    rank, k = np.append(numbers, 0).astype(np.int64), 1
    live = np.flatnonzero(numbers)
    while True:
        second = np.where(left[live] > k, rank[np.minimum(live + k, n)], 0)
        pairs = (rank[live] << 32) | second
        order = np.argsort(pairs, kind="stable")
        new = np.ones(len(order), np.int64)
        new[1:] = pairs[order][1:] != pairs[order][:-1]
        dense = np.empty(len(order), np.int64)
        dense[order] = np.cumsum(new)
        rank[live] = dense
        k *= 2
        tied = np.zeros(len(order), bool)
        tied[1:] |= new[1:] == 0
        tied[:-1] |= new[1:] == 0
        if not (tied & (left[live[order]] > k)).any():
            break
    return at[np.argsort(rank[at], kind="stable")]


def _below(numbers: np.ndarray, suffixes: np.ndarray, items: _Items, q: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each test window: how many suffixes come before it (or, after, not behind its matches)."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(suffixes), np.int64)
    padded = np.append(numbers, np.zeros(int(items.lengths.max()) + 1, np.int64))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = suffixes[np.minimum(mid, len(suffixes) - 1)]
        order, alive = np.zeros(len(q), np.int64), np.ones(len(q), bool)
        for j in range(int(items.lengths.max())):
            here = alive & (j < items.lengths[q])
            if not here.any():
                break
            d = padded[at[here] + j] - items.numbers[items.starts[q[here]] + j]
            order[here] = np.sign(d)
            alive[np.flatnonzero(here)[d != 0]] = False
        go = open_ & ((order < 0) | (after & (order == 0)))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def _matches(numbers: np.ndarray, items: _Items) -> tuple[np.ndarray, np.ndarray]:
    """Test windows and the places where they occur in one shard."""
    least = int(items.lengths.min())
    numbers = np.append(numbers, 0)
    stop = np.flatnonzero(numbers == 0)
    run = np.diff(np.append(-1, stop)) - 1
    numbers[np.repeat(run < least, run + 1)] = 0  # runs too short for any window
    last = np.repeat(stop, run + 1)
    suffixes = suffix_array(numbers, np.flatnonzero(last - np.arange(len(numbers)) >= least))
    if not len(suffixes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q = np.arange(len(items.starts))
    q = q[np.isin(items.numbers[items.starts], numbers[suffixes])]
    if not len(q):
        return q, q
    low, high = _below(numbers, suffixes, items, q, False), _below(numbers, suffixes, items, q, True)
    count = high - low
    which = np.repeat(q, count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return which, suffixes[np.repeat(low, count) + inside]


def _longest(numbers: np.ndarray, items: _Items, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of the longest verbatim match that begins with each found window."""
    length = items.lengths[which].copy()
    going = np.arange(len(which))
    a, b = np.append(numbers, 0), items.numbers
    while len(going):
        x, y = a[at[going] + length[going]], b[items.starts[which[going]] + length[going]]
        going = going[(x == y) & (x > 0)]
        length[going] += 1
    return length


def _numbers(texts: Texts, blocks: list, p: Decontaminate) -> Iterator[tuple]:
    """The shard's words as numbers of each block's vocabulary, 0 for others and between documents."""
    words = words_of(texts, ITEM_WORD, LOWER)
    places = np.arange(len(words)) + words.owner  # one place is left free after each document
    for handle in blocks:
        items: _Items = handle.value
        numbers = np.zeros(len(words) + len(texts), np.int64)
        if len(items.starts):
            near = np.searchsorted(items.vocabulary, words.hashes)
            near[near == len(items.vocabulary)] = 0
            numbers[places] = np.where(items.vocabulary[near] == words.hashes, near + 1, 0)
        yield words, items, numbers


def _passes(docs: DataFrame, benchmark: DataFrame, p: Decontaminate, item_col: str, text_col: str) -> Iterator[list]:
    """Lists of broadcast benchmark blocks, for one pass over the documents each.

    Repeated item rows are dropped first; the driver holds one block at a time.
    """
    slim = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    total = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / p.block_bytes))
    dealt = slim.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    context = docs.sparkSession.sparkContext
    for first in range(0, n, p.at_once):
        yield [context.broadcast(_items(sorted(dealt.filter(F.col("b") == b).select("i", "t").collect(), key=str), p)) for b in range(first, min(n, first + p.at_once))]


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("tag"), text.alias("text"))


def _judged(column: pa.Array, blocks: list, p: Decontaminate) -> Iterator[tuple]:
    """Shards: first and end row, words of each document, which places are hit, first place of each document, the items found in it."""
    for i, j, texts in texts_of(column, p.shard_mb << 20):
        found: list[set] = [set() for _ in range(j - i)]
        hit = None
        for words, items, numbers in _numbers(texts, blocks, p):
            hit = np.zeros(len(numbers) + 1, np.int64) if hit is None else hit
            if not len(items.starts) or not numbers.any():
                continue
            which, at = _matches(numbers, items)
            np.add.at(hit, at, 1), np.add.at(hit, at + items.lengths[which], -1)
            owner = np.searchsorted(words.bounds[1:] + np.arange(1, j - i + 1), at, "right")
            for pair in np.unique(owner * len(items.ids) + items.owner[which]):
                if (item := items.ids[pair % len(items.ids)]) is not None:
                    found[pair // len(items.ids)].add(item)
        yield i, j, words.counts, np.cumsum(hit)[:-1] > 0, words.bounds + np.arange(len(words.bounds)), found


def _hits(docs: DataFrame, blocks: list, p: Decontaminate) -> DataFrame:
    """``doc_id, tag, n_words``, the runs of hit words as ``starts`` and ``ends``, and the ``items`` found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts, hit, edge, found in _judged(batch.column(2), blocks, p):
                step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))  # a free place after each document parts their runs
                first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                bounds = np.searchsorted(first, edge).astype(np.int32)
                base = np.repeat(edge[:-1], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array((x - base).astype(np.int64))) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(counts, pa.int64()), *lists, pa.array([sorted(f) for f in found], pa.list_(pa.string()))], ["doc_id", "tag", "n_words", "starts", "ends", "items"])

    return mapped(docs, run, "doc_id long, tag int, n_words long, starts array<long>, ends array<long>, items array<string>", 4000)


def contamination(docs: DataFrame, benchmark: DataFrame, p: Decontaminate = Decontaminate(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What each document shares with the benchmark.

    Documents are shards of ``shard_mb`` text, each with a suffix array of its words. Every
    test suffix that starts a window is binary-searched in every shard; words inside a found
    window are hit. Benchmark items come in blocks of bounded size, ``at_once`` of them in a
    pass; what later passes find is written and joined to the first one's rows. Words outside
    a block's vocabulary end a suffix, and suffixes too short for any window are not indexed,
    since no match can hold them. With one pass nothing is shuffled.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per
    input row in any order. A null or wordless text has no words and is clean. Items without
    words never match; those without an id mark words but are not listed; items of one id
    count once. An item of fewer words than a window is one window. Rows that repeat an id are
    judged each by its own text; a text of any length is a shard of its own and not cut; bytes
    that are no UTF-8 are bytes of words. Empty tables give an empty result or clean rows;
    further columns are not read.
    """
    slim = _scan(docs, id_col, text_col)
    first, more = None, []
    for blocks in _passes(docs, benchmark, p, item_col, item_text_col):
        found = _hits(slim, blocks, p)
        if first is None:
            first = found
        else:
            more.append(written(found.filter("size(starts) > 0"), "hits"))
            for block in blocks:
                block.destroy()
    if more:
        later = more[0]
        for rows in more[1:]:
            later = later.union(rows)
        lists = {c: F.flatten(F.collect_list(c)) for c in ("starts", "ends", "items")}
        # rows that repeat an id and a text found the same
        later = later.dropDuplicates(["doc_id", "tag", "starts", "ends", "items"]).groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).agg(*(v.alias(f"_{c}") for c, v in lists.items()))
        joined = first.join(later, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
        first = joined.select("doc_id", "n_words", *(F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"_{c}")).alias(c) for c in lists))
    runs = F.array_sort(F.arrays_zip("starts", "ends"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    joined_up = F.aggregate(runs, none, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["ends"] - F.greatest(a["end"], r["starts"]))).alias("n"), F.greatest(a["end"], r["ends"]).alias("end")))
    names = F.array_sort(F.array_distinct("items"))
    return first.select(
        "doc_id", "n_words", joined_up["n"].alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, p: Decontaminate = Decontaminate(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where test suffixes occur: ``doc_id, doc_word, item_id, item_word, length`` in words.

    ``length`` is the longest verbatim match from those two words on; matches that only
    continue a match one word earlier are left out.
    """
    out = None
    for blocks in _passes(docs, benchmark, p, item_col, item_text_col):
        found = _places(_scan(docs, id_col, text_col), blocks, p)
        out = found if out is None else out.union(found)
    return out


def _places(docs: DataFrame, blocks: list, p: Decontaminate) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(2), p.shard_mb << 20):
                for words, items, numbers in _numbers(texts, blocks, p):
                    if not len(items.starts) or not numbers.any():
                        continue
                    which, at = _matches(numbers, items)
                    a, b = np.append(0, numbers)[at], np.append(0, items.numbers)[items.starts[which]]
                    new = (a != b) | (a == 0)
                    which, at = which[new], at[new]
                    owner = np.searchsorted(words.bounds[1:] + np.arange(1, j - i + 1), at, "right")
                    first = np.searchsorted(items.owner, items.owner[which])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i).take(pa.array(owner)), pa.array(at - words.bounds[owner] - owner, pa.int64()), pa.array([items.ids[k] for k in items.owner[which]], pa.string()), pa.array(items.starts[which] - items.starts[first], pa.int64()), pa.array(_longest(numbers, items, which, at), pa.int64())],
                        ["doc_id", "doc_word", "item_id", "item_word", "length"],
                    )

    return mapped(docs, run, "doc_id long, doc_word long, item_id string, item_word long, length long", 4000)


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: Decontaminate = Decontaminate(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns.

    Rows are judged as in ``contamination`` where they are read; a null text stays.
    """
    place = docs.columns.index(text_col)
    out, earlier = docs, None
    for blocks in _passes(docs, benchmark, p, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], blocks: list = blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, _, hit, edge, _ in _judged(batch.column(place), blocks, p):
                    yield batch.slice(i, j - i).filter(pa.array(sums(hit, edge) == 0))

        if earlier is not None:  # the pass before is written, so that one pass's blocks are held at a time
            out = written(out, "clean")
            for block in earlier:
                block.destroy()
        out, earlier = mapped(out, run, docs.schema, 4000), blocks
    return out
