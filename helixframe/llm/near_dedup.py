"""MinHash near-duplicate classes: many universal minima, bands, verification, star components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.store import dropped, fresh, mapped, only_ids, written
from helixframe.llm.words import LOWER, TEXT_WORD, Texts, mix, texts_of, words_of


@dataclass(frozen=True)
class NearDedup:
    """Parameters. ``bands * rows`` universal hashes; a pair of similarity s shares a band
    with probability 1 - (1 - s**rows)**bands, above 0.9999997 at s = 0.8 by default.

    ``agree`` is the least number of equal minima that a pair needs before its sets are
    compared; at s = 0.8 a true pair falls below 205 of 300 with probability under 1e-6.
    A signature keeps the low byte of each minimum: equal minima stay equal.
    ``block``, ``block_bytes``: documents of a bucket that a task holds against as many others,
    and about the bytes that they may have.
    """

    shingle: int = 2
    per_cent: int = 80
    bands: int = 50
    rows: int = 6
    agree: int = 205
    block: int = 256
    block_bytes: int = 4 << 20
    seed: int = 11

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        k = self.bands * self.rows
        return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def _sets(texts: Texts, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    words = words_of(texts, TEXT_WORD, LOWER)
    at, grams = words.windows(shingle)
    bounds = np.searchsorted(at, words.bounds)
    for i, n in enumerate(words.counts):
        if n >= shingle:
            yield np.unique(grams[bounds[i] : bounds[i + 1]])
        elif n:  # fewer words: the whole sequence is one shingle
            h = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            yield mix(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(h)) % (1 << 64)], np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def _minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256] * a
        h += b
        np.minimum(least, h.min(axis=0), out=least)
    return least


def _band_keys(minima: np.ndarray, p: NearDedup) -> np.ndarray:
    rows = minima.reshape(p.bands, p.rows).astype(np.uint64)
    key = np.arange(1, p.bands + 1, dtype=np.uint64)
    for j in range(p.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _signed(docs: DataFrame, p: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """One row a document: set size, digest of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = p.multipliers()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for _, _, texts in texts_of(batch.column(1)):
                for items in _sets(texts, p.shingle):
                    sizes.append(len(items))
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    keys.append(_band_keys(_minima(items, a, b), p) if len(items) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "n_shingles", "digest", "keys"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_shingles long, digest binary, keys array<bigint>")


def _with_sets(docs: DataFrame, ids: DataFrame, p: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """Full sets, signatures and band keys of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = p.multipliers()
        for batch in batches:
            at = 0
            for _, _, texts in texts_of(batch.column(1)):
                sets = list(_sets(texts, p.shingle))
                minima = [_minima(s, a, b) for s in sets]
                columns = [[s.tobytes() for s in sets], [m.astype(np.uint8).tobytes() for m in minima], [_band_keys(m, p).tobytes() for m in minima]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "items", "minima", "bands"])
                at += len(sets)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(only_ids(texts, ids, "doc_id").select("doc_id", "text"), run, "doc_id long, items binary, minima binary, bands binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right, sl, sr = (batch.column(i) for i in range(6))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                agree = (np.frombuffer(sl[i].as_buffer(), np.uint8) == np.frombuffer(sr[i].as_buffer(), np.uint8)).sum()
                keep[i] = agree >= p.agree and _similar(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right)), p)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"items_{c}"), F.col("minima").alias(f"minima_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return mapped(joined.select("a", "b", "items_a", "items_b", "minima_a", "minima_b"), run, "a long, b long")


_PLACE = ["key", "main", "i", "j"]


def _groups(placed: DataFrame) -> DataFrame:
    """Whom to hold against whom: ``key, main, doc_id, component, inside`` of ``placed (key, doc_id, component)``.

    The component with most members of a bucket is its main one. Documents outside it are
    held against those inside once for all buckets of that main component (``key`` is the
    component), and against each other by bucket. So a large component that a few others meet
    in many buckets is dealt once, and buckets that a common passage fills stay apart.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("_main"), (F.sum("n") - F.max("n")).alias("_rest"))
    mains = written(mains.filter("_rest > 0"), "mains")  # read apart, so that a join can split a bucket of very many documents
    marked = placed.join(mains, "key").withColumn("inside", F.col("component") == F.col("_main"))
    once = marked.select(F.col("_main").alias("key"), F.lit(True).alias("main"), "doc_id", "component", "inside").distinct()
    groups = written(once.unionByName(marked.filter("NOT inside AND _rest > 1").select("key", F.lit(False).alias("main"), "doc_id", "component", "inside")), "groups")
    dropped(mains)
    return groups


def _dealt(groups: DataFrame, p: NearDedup, used: list[DataFrame]) -> DataFrame:
    """Deal each group to pairs of blocks of about ``block`` documents and ``block_bytes`` bytes: ``groups`` with ``bytes``.

    The table of numbers of blocks joins ``used``, to be dropped once what is dealt is written.
    """
    sizes = groups.groupBy("key", "main").agg(*(f(F.when(F.col("inside") if side else ~F.col("inside"), v)).alias(n) for f, v, n, side in ((F.count, F.lit(1), "_m", True), (F.sum, F.col("bytes"), "_mb", True), (F.count, F.lit(1), "_r", False), (F.sum, F.col("bytes"), "_rb", False))))
    blocks = lambda n, b: F.greatest(F.ceil(F.col(n) / p.block), F.ceil(F.coalesce(b, F.lit(0)) / p.block_bytes), F.lit(1)).cast("int")
    sizes = written(sizes.filter("_r > 1 OR (_r = 1 AND _m > 0)").select("key", "main", blocks("_m", "_mb").alias("_m"), blocks("_r", "_rb").alias("_r")), "sizes")
    used.append(sizes)
    placed = groups.join(sizes, ["key", "main"]).withColumn("at", F.pmod(F.xxhash64("doc_id", "key"), F.when(F.col("inside"), F.col("_m")).otherwise(F.col("_r"))).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "main", "doc_id", "component", "at"]
    inside = placed.filter("main AND inside").select(*cols, upto("_r").alias("i"), F.col("at").alias("j"), F.lit(1).alias("right"))
    against = placed.filter("main AND NOT inside").select(*cols, F.col("at").alias("i"), upto("_m").alias("j"), F.lit(0).alias("right"))
    among = placed.filter("NOT main").select(*cols, upto("_r").alias("_o")).select(*cols, F.least("at", "_o").alias("i"), F.greatest("at", "_o").alias("j"), (F.col("at") > F.col("_o")).cast("int").alias("right"))
    return inside.unionByName(against).unionByName(among).select(*_PLACE, "doc_id", "component", "right")


def _by_blocks(dealt: DataFrame, judge: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``judge`` over whole pairs of blocks: a table of some of them, and the bounds of each in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # of the last pair of blocks, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            cols = [table.column(c).to_numpy() for c in _PLACE]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            if len(new):
                yield judge(table.slice(0, new[-1]), np.append(0, new))
            rest = table.slice(new[-1] if len(new) else 0)
        if rest is not None and len(rest):
            yield judge(rest, np.array([0, len(rest)]))

    return mapped(dealt.repartition(*_PLACE).sortWithinPartitions(*_PLACE), run, schema)


def _pairs(table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """For each row that is held against others: the bounds of its pair of blocks, the row, and those rows."""
    side, main, i, j = (table.column(c).to_numpy() for c in ("right", "main", "i", "j"))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        rows = np.arange(s, e)
        if not main[s] and i[s] == j[s]:
            yield from ((s, x, rows[rows > x]) for x in rows[:-1])
        else:
            right = rows[side[s:e] == 1]
            yield from ((s, x, right) for x in rows[side[s:e] == 0])


def _fixed(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """A binary column of one width as a matrix."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind).reshape(len(table), -1)


def _alike(groups: DataFrame, sets: DataFrame, p: NearDedup, used: list[DataFrame]) -> DataFrame:
    """The rows of ``groups`` that agree, in enough minima, with one of another component.

    Pairs that are held against each other by bucket count in the first bucket that they
    share, so that their sets are compared once.
    """

    def judge(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        key, main, ids, comps, side = (table.column(c).to_numpy() for c in ("key", "main", "doc_id", "component", "right"))
        sig, bands = _fixed(table, "minima", np.uint8), _fixed(table, "bands", np.int64)
        named = np.zeros(len(ids), bool)
        for _, x, right in _pairs(table, bounds):
            ok = right[comps[right] != comps[x]]
            ok = ok[(sig[ok] == sig[x]).sum(axis=1) >= p.agree] if len(ok) else ok
            if len(ok) and not main[x]:
                ok = ok[bands[x][(bands[ok] == bands[x]).argmax(axis=1)] == key[x]]
            named[ok] = True
            named[x] |= len(ok) > 0
        at = np.flatnonzero(named)
        return pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (key, main, ids, comps)), pa.array(main[at] & (side[at] == 1))], ["key", "main", "doc_id", "component", "inside"])

    dealt = _dealt(groups.withColumn("bytes", F.lit(9 * p.bands + p.bands * p.rows).cast("long")), p, used)
    found = _by_blocks(dealt.join(sets.select("doc_id", "minima", "bands"), "doc_id"), judge, "key long, main boolean, doc_id long, component long, inside boolean")
    return found.distinct()


def _between(groups: DataFrame, sets: DataFrame, p: NearDedup, used: list[DataFrame]) -> DataFrame:
    """Links ``a, b`` that join components of a group.

    Pairs that agree in enough minima are compared on their full sets where both blocks are;
    a task gives only the links that join components, at most one fewer than it holds.
    """

    def judge(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        ids, comps = (table.column(c).to_numpy() for c in ("doc_id", "component"))
        sig = _fixed(table, "minima", np.uint8)
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        ends = np.append(bounds[1:], 0)[np.searchsorted(bounds, np.arange(len(ids)), "right") - 1]
        found, last, now = [], -1, comps
        for s, x, right in _pairs(table, bounds):
            if s != last:
                last, now = s, comps[s : ends[s]].copy()  # components as joined so far
            ok = right[now[right - s] != now[x - s]]
            if not len(ok):
                continue
            same = (sig[ok] == sig[x]).sum(axis=1)
            for y in ok[np.argsort(-same, kind="stable")[: int((same >= p.agree).sum())]]:
                if now[y - s] != now[x - s] and _similar(sets_[x], sets_[y], p):
                    found.append((ids[x], ids[y]))
                    now[now == now[y - s]] = now[x - s]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    sized = sets.select("doc_id", (F.octet_length("items") + p.bands * p.rows).cast("long").alias("bytes"))
    dealt = _dealt(groups.join(sized, "doc_id"), p, used)
    return _by_blocks(dealt.join(sets.select("doc_id", "minima", "items"), "doc_id"), judge, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, p: NearDedup) -> bool:
    if 100 * min(len(x), len(y)) < p.per_cent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= p.per_cent * (len(x) + len(y) - shared)


def _most(shared: DataFrame, k: int) -> DataFrame:
    """For each document the ``k`` bucket heads it shares most bands with; it shares ``bands`` at most."""
    best = shared.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("b")).alias("m"))), False).alias("s"))
    return best.select("a", F.explode(F.slice("s", 1, k)).alias("s")).select("a", (-F.col("s.m")).alias("b"))


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate component of every document.

    Documents with the same shingle set form one class, held by its smallest id. Bands put
    classes into buckets. First each class is compared with the smallest member of the bucket
    it shares most bands with, then with those of some buckets of other components; this
    links almost all copies with a few comparisons each. In a bucket that still spans two
    components, each document outside its largest one is held against all others of the
    bucket, in blocks: first by signatures, then, where these agree, by full sets. Every pair
    that shares a bucket is so linked, in one component already, or compared; none is left
    out, and no stage emits all pairs of a bucket.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row. A null or
    wordless text has an empty set, is linked with nothing and kept. A document of fewer
    words than a shingle has its whole sequence as one shingle. Rows that repeat an id and a
    text share component and verdict; an id with different texts is one document with the
    links of each. A row without an id is never dropped. Ties in similarity change nothing, as
    a link counts from ``per_cent`` on. Texts of any length give their whole set, held by one
    task. Bytes that are no UTF-8 are bytes of words. An empty table gives an empty result;
    further columns of ``docs`` are not read.
    """
    base = written(_signed(docs, p, id_col, text_col), "signatures")
    named = base.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"))
    # classes of two or more; read apart, so that a join can split a text of very many copies
    classes = written(firsts.filter("rep < _last").drop("_last"), "classes")
    later = written(named.select("digest", "doc_id").join(classes, "digest").filter("doc_id > rep").select("doc_id", "digest"), "later")
    held = named.select("digest", "doc_id", "keys").join(later, ["doc_id", "digest"], "left_anti")
    members = held.select("doc_id", F.explode("keys").alias("key"))
    pivots = members.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_last")).filter("pivot < _last").select("key", "pivot")
    bucketed = written(members.join(pivots, "key"), "buckets")

    ids = bucketed.select("doc_id").distinct()
    sets = written(_with_sets(docs, ids, p, id_col, text_col).join(ids, "doc_id", "left_semi"), "sets")

    shared = bucketed.filter("doc_id <> pivot").groupBy(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("n"))
    shared = written(shared, "shared")
    tested = written(_most(shared, 1), "candidates")
    links = written(_confirmed(tested, sets, p), "links")
    parts = components(links)

    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    apart = shared.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    used = [later, bucketed, sets, shared, tested, links, parts]
    new = written(_most(apart, 4).join(tested, ["a", "b"], "left_anti"), "candidates")
    found = written(_confirmed(new, sets, p), "links")
    links = links.union(found)
    parts = components(links)
    used += [new, found, parts]

    placed = bucketed.select("key", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = written(placed, "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a < _b").select("key")
    split = written(split, "split")
    groups = _groups(placed.join(split, "key"))
    alike = written(_alike(groups, sets, p, used), "alike")
    last = written(_between(alike, sets, p, used), "links")
    parts = components(links.union(last))
    used += [placed, split, groups, alike, last]
    dropped(*used)
    whole = parts.select(F.col("node").alias("rep"), "component")
    found = base.join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(whole, "rep", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce(F.coalesce("component", "rep") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever these are called.

    Of each component the rows of its smallest id stay; rows without an id or without words
    stay as well.
    """
    (key,) = fresh(docs.columns, 1)
    gone = near_duplicates(docs, p, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
