"""Phrases of words that stand together more often than their parts suggest, from position bitmaps.

A shard is a run of whole documents of one language. Its words have bitmaps of the positions
where they stand; pieces of a text are apart by a position that no word has, so no phrase
crosses their border. A bitmap is compressed: the chunks of 16 positions that hold a bit, and
their bits. A phrase's bitmap says where its last word stands: shifted by one and joined with a
word's by AND, it is that of the phrase with this word behind it, and its popcount is the
phrase's frequency in the shard. Frequencies are summed over shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.encoding import _ranges, decodable
from helixframe.llm.store import delete, mapped, shared_folder, small_batches, written
from helixframe.llm.words import _MIX, _U, LOWER, Texts, mix, texts_of, words_of

_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *map(ord, ".,;:!?")]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
#: Positions of a chunk.
CHUNK = 16
#: Chunks that are joined with the words of a shard at a time.
TOGETHER = 1 << 16


@dataclass(frozen=True)
class Collocations:
    """``shortest`` to ``longest`` words a phrase; ``least``: its frequency, at least; ``top``: the
    phrases reported of each language; ``missing``: the name of a language that is null;
    ``shard``: words of a shard, about (a longer text makes a longer one); ``batch``: chunks of
    first words whose phrases are extended together; ``part``: words of the corpus for each
    part of the keys that is summed up at once."""

    shortest: int = 2
    longest: int = 5
    least: int = 100
    top: int = 2000
    missing: str = "und"
    shard: int = 3 << 20
    batch: int = 1 << 17
    part: int = 1 << 21


@dataclass
class Bitmaps:
    """Compressed bitmaps, one after another: an entry is a bitmap's number, a chunk and its bits."""

    owner: np.ndarray
    chunk: np.ndarray
    bits: np.ndarray

    def of(self, keep: np.ndarray) -> Bitmaps:
        return Bitmaps(self.owner[keep], self.chunk[keep], self.bits[keep])

    def counts(self, n: int) -> np.ndarray:
        """The popcount of each of ``n`` bitmaps."""
        return np.bincount(self.owner, np.bitwise_count(self.bits), n).astype(np.int64)

    def shifted(self) -> Bitmaps:
        """All bits a position on."""
        on = self.bits.astype(np.uint32) << 1
        carry = np.flatnonzero(on >> CHUNK)
        stay = np.flatnonzero(on & 0xFFFF)
        return Bitmaps(np.concatenate([self.owner[stay], self.owner[carry]]), np.concatenate([self.chunk[stay], self.chunk[carry] + 1]), np.concatenate([on[stay] & 0xFFFF, on[carry] >> CHUNK]).astype(np.uint16))


class Words:
    """The bitmaps of a shard's words, to be found by chunk."""

    def __init__(self, maps: Bitmaps):
        order = np.argsort(maps.chunk, kind="stable")
        self.maps = maps.of(order)
        self.first = np.searchsorted(self.maps.chunk, np.arange(int(self.maps.chunk[-1]) + 3 if len(order) else 2))

    def extended(self, phrases: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """Every phrase with every word that follows it: phrase, word, and the bitmaps of the phrases so made.

        Only words with bits in a chunk of the shifted bitmap are tried, at most 16 a chunk.
        """
        on, found = phrases.shifted(), []
        for i in range(0, len(on.chunk), TOGETHER):
            chunk = on.chunk[i : i + TOGETHER]
            size = self.first[chunk + 1] - self.first[chunk]
            at, word = np.repeat(np.arange(i, i + len(size)), size), _ranges(self.first[chunk], size)
            bits = on.bits[at] & self.maps.bits[word]
            hit = np.flatnonzero(bits)
            found.append((at[hit], self.maps.owner[word[hit]], bits[hit]))
        at, word, bits = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        pairs, owner = np.unique(on.owner[at] << 32 | word, return_inverse=True)
        return pairs >> 32, pairs & 0xFFFFFFFF, Bitmaps(owner, on.chunk[at], bits)


class _Shard:
    """Texts of one language that are gathered until they are a shard."""

    def __init__(self) -> None:
        self.known, self.sizes, self.raw, self.hashes, self.at, self.end, self.n = [], [], [], [], [], 0, 0

    def add(self, texts: Texts) -> int:
        words = words_of(texts, _WORD, LOWER)
        if len(words):
            breaks = np.concatenate([[0], np.cumsum(_BREAK[texts.data])])
            apart = np.zeros(len(words), bool)
            apart[1:] = breaks[words.starts[1:]] != breaks[words.ends[:-1]]
            first = words.bounds[:-1]
            apart[first[first < len(words)]] = True
            at = self.end + np.arange(len(words)) + np.cumsum(apart)
            self.end = int(at[-1]) + 1
            known, firsts = np.unique(words.hashes, return_index=True)
            sizes = words.ends[firsts] - words.starts[firsts]
            self.known.append(known)
            self.sizes.append(sizes)
            self.raw.append(LOWER[texts.data[_ranges(words.starts[firsts], sizes)]])
            self.hashes.append(words.hashes)
            self.at.append(at.astype(np.int32 if at[-1] < 1 << 31 else np.int64))
            self.n += len(words)
        return self.n

    def row(self, lang: str, number: int) -> pa.RecordBatch:
        known, owner = np.unique(np.concatenate(self.hashes), return_inverse=True)
        at = np.concatenate(self.at)
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] // CHUNK != at[:-1] // CHUNK)
        new = np.flatnonzero(new)
        bits = np.bitwise_or.reduceat((1 << (at % CHUNK)).astype(np.uint16), new)
        _, firsts = np.unique(np.concatenate(self.known), return_index=True)
        sizes, raw = np.concatenate(self.sizes), np.concatenate(self.raw)
        starts = np.cumsum(sizes) - sizes
        names = pa.LargeStringArray.from_buffers(len(known), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes[firsts])])), pa.py_buffer(raw[_ranges(starts[firsts], sizes[firsts])])).cast(pa.string())
        keys = mix(known + _U(zlib.crc32(lang.encode()) * int(_MIX[0]) % (1 << 64)))
        packed = [_packed(x, t) for x, t in ((keys, np.uint64), (np.bincount(owner, minlength=len(known)), np.int64), (np.bincount(owner[new], minlength=len(known)), np.int32), (at[new] // CHUNK, np.int32), (bits, np.uint16))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number]), pa.array([len(at)]), pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), names), *packed], ["lang", "shard", "n", "words", "keys", "counts", "sizes", "chunks", "bits"])


def _packed(values: np.ndarray, kind: type) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


SHARDS = "lang string, shard long, n long, words array<string>, keys binary, counts binary, sizes binary, chunks binary, bits binary"


def shards(docs: DataFrame, p: Collocations = Collocations(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The vertical form of whole texts: a row a shard with its words, their counts and bitmaps.

    A task has one open shard a language and closes the largest once they hold twice
    ``p.shard`` words together. Numbers come from the task, so write the table before use.
    Keys of words are 64-bit fingerprints of word and language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return held.pop(lang).row(lang, number)

        for batch in batches:
            langs = np.array([x if x is not None else p.missing for x in batch.column(0).to_pylist()], object)
            for lang in sorted(set(langs)):
                for _, _, texts in texts_of(batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))):
                    held.setdefault(lang, _Shard()).add(decodable(texts))
                    while held and (max(x.n for x in held.values()) >= p.shard or sum(x.n for x in held.values()) >= 2 * p.shard):
                        yield closed(max(held, key=lambda x: held[x].n))
        for lang in [x for x in held if held[x].n]:
            yield closed(lang)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return mapped(rows, run, SHARDS)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Keys in order of their part of all keys, their order, and each part with where it starts and ends."""
    part = (keys % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return keys[order], order, list(zip(part[order][starts].tolist(), starts.tolist(), np.append(starts, len(part))[1:].tolist(), strict=True))


def _cells(shard: int, batch: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys of a batch of a shard and their counts, a row for each of ``parts`` parts of all keys that has some.

    Counts take a byte where all of a row are below 256.
    """
    keys, order, cut = _dealt(keys, parts)
    counts = counts[order]
    lists = [counts[i:j].astype(np.uint8 if counts[i:j].max() < 256 else np.int64).tobytes() for _, i, j in cut]
    arrays = [pa.array([x for x, _, _ in cut], pa.int64()), pa.array([shard] * len(cut), pa.int64()), pa.array([batch] * len(cut), pa.int32()), pa.array([keys[i:j].tobytes() for _, i, j in cut], pa.binary()), pa.array(lists, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["part", "shard", "batch", "keys", "counts"])


CELLS = "part long, shard long, batch int, keys binary, counts binary"
FOUND = "shard long, batch int, part long, kept binary, own binary, totals binary"


def _summed(least: int, table: pa.Table) -> pa.Table:
    """Which keys of the rows of a part have counts that sum up to ``least``: see ``_frequent``."""
    table = table.sort_by([("shard", "ascending"), ("batch", "ascending")])
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
    raw = [x.as_py() for x in table["counts"]]
    counts = np.concatenate([np.frombuffer(c, np.uint8 if len(c) == len(k) else np.int64).astype(np.int64) for c, k in zip(raw, lists, strict=True)])
    keys, ends = np.concatenate(lists), np.cumsum([len(x) for x in lists])
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    sums = np.add.reduceat(counts[order], starts)
    kept, totals, own = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    kept[order] = np.repeat(sums >= least, np.diff(np.append(starts, len(keys))))
    own[order[starts]], totals[order[starts]] = sums >= least, sums
    rows = []
    for k, (i, j) in enumerate(zip(np.append(0, ends), ends, strict=False)):
        if kept[i:j].any():
            at = np.flatnonzero(own[i:j])
            rows.append((k, np.packbits(kept[i:j]).tobytes(), at.astype(np.int32).tobytes(), totals[i:j][at].tobytes()))
    chosen, *columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.Table.from_arrays([table[c].combine_chunks().take(pa.array(chosen, pa.int64())) for c in ("shard", "batch", "part")] + [pa.array(c, pa.binary()) for c in columns], ["shard", "batch", "part", "kept", "own", "totals"])


def _frequent(cells: DataFrame, least: int) -> DataFrame:
    """``shard, found``: which keys of each shard have counts of ``least`` or more over all shards.

    For each row of ``cells`` with such keys: a bit a key, in their order, and places and totals
    of those that this shard answers for as the first one that has them. A task sums up a part
    of the keys, with one entry a shard for each of them, however frequent it is.
    """
    found = cells.groupBy("part").applyInArrow(lambda table: _summed(least, table), FOUND)
    return found.groupBy("shard").agg(F.collect_list(F.struct("batch", "part", "kept", "own", "totals")).alias("found"))


class _Found:
    """What ``_frequent`` says of a shard."""

    def __init__(self, rows: list[dict] | None):
        self.rows = {(x["batch"], x["part"]): x for x in rows or ()}

    def of(self, batch: int, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the keys of a batch, as they were dealt to cells: which are frequent, which this shard answers for, and the totals of those."""
        _, order, cut = _dealt(keys, parts)
        kept, own, totals = np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for part, i, j in cut:
            if row := self.rows.get((batch, part)):
                kept[order[i:j]] = np.unpackbits(np.frombuffer(row["kept"], np.uint8), count=j - i).astype(bool)
                at = order[i + np.frombuffer(row["own"], np.int32)]
                own[at], totals[at] = True, np.frombuffer(row["totals"], np.int64)
        return kept, own, totals


def _maps(row: dict, keep: np.ndarray) -> Bitmaps:
    """The bitmaps of the words ``keep`` of a shard, numbered in this order."""
    sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    entries = _ranges(starts[keep], sizes[keep])
    return Bitmaps(np.repeat(np.arange(len(keep)), sizes[keep]), np.frombuffer(row["chunks"], np.int32)[entries].astype(np.int64), np.frombuffer(row["bits"], np.uint16)[entries])


def _batches(maps: Bitmaps, n: int, size: int) -> Iterator[np.ndarray]:
    """Entries of ``n`` bitmaps, in order of the bitmaps, in batches of whole bitmaps of about ``size`` entries."""
    ends = np.searchsorted(maps.owner, np.arange(n), "right")
    i = 0
    while i < n:
        begin = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, begin + size, "right")))
        yield np.arange(begin, int(ends[j - 1]))
        i = j


def _key(words: np.ndarray) -> np.ndarray:
    """Keys of phrases from the keys of their words, a phrase a row."""
    return mix((words * _MIX[: words.shape[1]]).sum(1, dtype=np.uint64) + _U(words.shape[1]))


class _Tree:
    """The phrases of a shard, depth first.

    Words are those that are frequent over all shards. A batch of first words is followed down
    to the longest phrases before the next is begun, so beside the pairs a task holds one branch
    of the tree only.
    """

    def __init__(self, row: dict, p: Collocations, parts: int):
        known = np.frombuffer(row["keys"], np.uint64)
        kept, _, _ = _Found(row["word"]).of(0, known, parts)
        keep = np.flatnonzero(kept)
        self.p, self.parts, self.keys = p, parts, known[keep]
        self.maps = _maps(row, keep)
        self.words = Words(self.maps)

    def pairs(self) -> Iterator[tuple[int, np.ndarray, Bitmaps]]:
        """Number of a batch, its pairs of words and their bitmaps."""
        for k, part in enumerate(_batches(self.maps, len(self.keys), self.p.batch)):
            a, b, here = self.words.extended(self.maps.of(part))
            yield k, np.stack([a, b], 1), here

    def longer(self, found: _Found) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Number, words, keys and frequencies here of the phrases all of whose pairs are frequent.

        The frequent pairs come first, with totals of those that this shard answers for.
        """
        starts = []
        for k, path, here in self.pairs():
            kept, own, totals = found.of(k, _key(self.keys[path]), self.parts)
            yield -1, self.keys[path[own]], _key(self.keys[path[own]]), here.counts(len(path))[own], totals[own]
            starts.append((path[kept], _only(here, kept)))
        allowed = np.unique(np.concatenate([np.zeros(0, np.int64), *(path[:, 0] << 32 | path[:, 1] for path, _ in starts)]))
        for k, (path, here) in enumerate(starts):
            for length in range(3, self.p.longest + 1):
                phrase, word, here = self.words.extended(here)
                pair = path[phrase, -1] << 32 | word
                at = np.minimum(np.searchsorted(allowed, pair), max(0, len(allowed) - 1))
                kept = allowed[at] == pair if len(allowed) else np.zeros(len(pair), bool)
                path, here = np.concatenate([path[phrase[kept]], word[kept][:, None]], 1), _only(here, kept)
                if not len(path):
                    break
                yield k * 64 + length, self.keys[path], _key(self.keys[path]), here.counts(len(path)), None


def _only(maps: Bitmaps, kept: np.ndarray) -> Bitmaps:
    """The bitmaps that are kept, numbered anew."""
    number, entries = np.cumsum(kept) - 1, kept[maps.owner]
    return Bitmaps(number[maps.owner[entries]], maps.chunk[entries], maps.bits[entries])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def frequent_phrases(docs: DataFrame, p: Collocations = Collocations(), lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages ``lang, n``; frequent words ``lang, word, id, n``; frequent phrases ``lang, words, n`` with words' ids.

    Words that are rare over all shards, then pairs, are left out before longer phrases are
    tried. What is frequent comes back to each shard as a bit for each key that it sent, and
    shards are stored in buckets, so that they are not moved; no table of all words or pairs is
    held in one place. Ids are 64-bit fingerprints.
    """
    spark, tables = docs.sparkSession, []
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        """A table by buckets of shards: two of them are joined where they lie."""
        name = f"{name}_{uuid.uuid4().hex}"
        tables.append(name)
        with small_batches(spark):
            df.write.bucketBy(buckets, "shard").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        return spark.table(name)

    found = bucketed(shards(docs, p, lang_col, text_col), "shards")
    languages = written(found.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    parts = max(4 * buckets, -(-(languages.agg(F.sum("n")).first()[0] or 0) // p.part))  # one number

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _cells(row["shard"], 0, np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64), parts)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            tree = _Tree(row, p, parts)
            for k, path, here in tree.pairs():
                yield _cells(row["shard"], k, _key(tree.keys[path]), here.counts(len(path)), parts)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            for k, _, keys, counts, _ in _Tree(row, p, parts).longer(_Found(row["pair"])):
                if k >= 0:
                    yield _cells(row["shard"], k, keys, counts, parts)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            more = _Found(row["phrase"])
            for k, path, keys, _, totals in _Tree(row, p, parts).longer(_Found(row["pair"])):
                if k >= 0:
                    _, own, totals = more.of(k, keys, parts)
                    path, totals = path[own], totals[own]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, path.shape[1], dtype=np.int32)), pa.array(path.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(path), pa.string()), lists, pa.array(totals)], ["lang", "words", "n"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, known = batch.column(1)[k].values, np.frombuffer(batch.column(2)[k].as_py(), np.uint64)
                _, own, totals = _Found(batch.column(3)[k].as_py()).of(0, known, parts)
                own = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), pa.string()), names.take(pa.array(own)), pa.array(known[own].view(np.int64)), pa.array(totals[own])], ["lang", "word", "id", "n"])

    def back(cells: DataFrame, as_: str) -> DataFrame:
        return bucketed(_frequent(cells, p.least).withColumnRenamed("found", as_), as_)

    one = back(mapped(found.select("shard", "keys", "counts"), words, CELLS, 1), "word")
    rows = found.select("lang", "shard", "keys", "sizes", "chunks", "bits").join(one, "shard")
    two = back(mapped(rows, pairs, CELLS, 1), "pair")
    rows = rows.join(two, "shard")
    more = back(mapped(rows, longer, CELLS, 1), "phrase")
    phrases = written(mapped(rows.join(more, "shard", "left"), named, "lang string, words array<long>, n long", 1), "phrases")
    names = written(mapped(found.select("shard", "lang", "words", "keys").join(one, "shard").select("lang", "words", "keys", "word"), texts, "lang string, word string, id long, n long", 1), "words")
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
        delete(spark, f"{shared_folder(spark)}/{name}")
    return languages, names, phrases


def _largest(df: DataFrame, order: list[Column], n: int, out: str) -> DataFrame:
    """The first ``n`` rows of each language, numbered from 1; parts of a language are cut to ``n`` before they meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_r") <= n).drop("_r", "_salt")
    return near.withColumn(out, F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col(out) <= n)


def collocations(docs: DataFrame, p: Collocations = Collocations(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``p.top`` phrases.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of its parts at the cut with the least
    score, floor(1000 a n / (l r)), the earliest among equals. A phrase that stands in a longer
    one of the same frequency is left out: then it also stands in one a word longer of that
    frequency, as its first or last words. Null and empty texts have no words, repeated rows
    count each, bytes that are no UTF-8 are U+FFFD; an empty table has no phrases. Equal scores
    go by frequency, then by the phrase's bytes.
    """
    languages, words, phrases = frequent_phrases(docs, p, lang_col, text_col)
    counts = phrases.unionByName(words.select("lang", F.array("id").alias("words"), "n"))
    size = F.size("words")
    inner = phrases.filter(size > 2).select("lang", F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1))).alias("words"), "n").distinct()
    kept = phrases.filter(size >= p.shortest).join(inner, ["lang", "words", "n"], "left_anti").withColumnRenamed("n", "a")
    cuts = kept.select("lang", "words", "a", F.posexplode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(F.slice("words", F.lit(1), k).alias("_left"), F.slice("words", k + 1, size - k).alias("_right")))).alias("k", "_c"))
    cuts = cuts.select("lang", "words", "a", "k", "_c._left", "_c._right")
    scored = cuts.join(counts.select("lang", F.col("words").alias("_left"), F.col("n").alias("l")), ["lang", "_left"]).join(counts.select("lang", F.col("words").alias("_right"), F.col("n").alias("r")), ["lang", "_right"]).join(languages, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("_top", (wide("a") * wide("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(38,0)")).withColumn("_under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("CAST(_top div _under AS BIGINT)"))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b")).select("lang", "words", "a", "n", "_b.score", "_b.l", "_b.r")
    names = best.select("lang", "words", F.posexplode("words").alias("_i", "id")).join(words.select("lang", "id", "word"), ["lang", "id"]).groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("_i", "word"))).alias("_w")).select("lang", "words", F.array_join("_w.word", " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    return _largest(best.join(names, ["lang", "words"]), order, p.top, "rank").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
