"""Substring dedup: greedy relative Lempel-Ziv parsing of documents against indexed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import dropped, fresh, mapped, only_ids, written
from helixframe.llm.words import Words, covered, own, repeats, sums, texts_of, windows_of, words_of

NOTHING = hashlib.sha256(b"").hexdigest()
#: Stand after each document and each reference stretch; no word matches them, nor they each other.
_DOC_END, _REF_END = np.uint64(0), np.uint64(1)
#: Words that one step of a match comparison looks ahead at most.
_AHEAD = 4096


@dataclass(frozen=True)
class SubstringDedup:
    """``length``: words of the shortest factor that is a duplicate span. ``anchor``: words
    of the grams that stand for the windows around them when repeats are looked for.
    ``block``: words of a reference block, which is what a document is sent to be parsed against."""

    length: int = 20
    anchor: int = 8
    block: int = 256


def _anchors(words: Words, p: SubstringDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each window's fingerprint, and its anchor: the least gram inside it.

    Equal windows have equal anchors, so a window can only come twice if its anchor does.
    """
    at, windows = words.windows(p.length)
    m = len(words) - p.anchor + 1
    if not len(at):
        return at, windows, windows
    grams = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    where, values = words.windows(p.anchor)
    grams[where] = values
    width, least, span = p.length - p.anchor + 1, grams[:m], 1
    while 2 * span <= width:  # minimum over runs of doubling length
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return at, windows, least[at]


@dataclass
class _References:
    """Stretches of reference text: runs of neighbouring blocks of one source, sent to one document."""

    hashes: np.ndarray
    bounds: np.ndarray  # one more than stretches
    owner: np.ndarray  # row of the document each stretch was sent to
    source: np.ndarray
    start: np.ndarray  # first word in the source

    @classmethod
    def of(cls, refs: pa.Array, p: SubstringDedup) -> _References:
        """From each document's sorted list of ``source, stag, block, words``; a block overlaps the next by ``length - 1`` words."""
        hashes, size, owner, source, start, last = [], [], [], [], [], None
        for row in range(len(refs)):
            for ref in refs[row].as_py() or ():
                words, this = np.frombuffer(ref["words"], np.uint64), (row, ref["source"], ref["stag"], ref["block"])
                if this == last:  # rows that repeat an id and a text give their blocks twice
                    continue
                if last is not None and this[:3] == last[:3] and this[3] == last[3] + 1:
                    words = words[p.length - 1 :]
                    size[-1] += len(words)
                else:
                    size.append(len(words)), owner.append(row), source.append(ref["source"]), start.append(ref["block"] * p.block)
                hashes.append(words)
                last = this
        whole = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        return cls(whole, np.concatenate([[0], np.cumsum(np.array(size, np.int64))]), *(np.array(x, np.int64) for x in (owner, source, start)))


@dataclass
class Factors:
    """Factors of some documents: row, first word, words, and where they stand: a source, or -1 for the document itself, and a first word there."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    stretch: np.ndarray
    source_start: np.ndarray


#: Places of equal windows a word, on average, from which on suffixes are sorted.
_MANY = 8


def _longest(text: np.ndarray, i: int, places: np.ndarray) -> tuple[int, np.ndarray]:
    """Words that the longest match of ``text[i:]`` at one of ``places`` has, and the places that have it."""
    length, step = 0, 32
    while True:
        step = max(1, min(step, _AHEAD, (1 << 18) // len(places)))
        same = text[places[:, None] + (length + np.arange(step))] == text[i + length : i + length + step]
        full = same.all(axis=1)
        if full.any():
            places, length, step = places[full], length + step, 2 * step
            continue
        ahead = same.argmin(axis=1)
        return length + int(ahead.max()), places[ahead == ahead.max()]


class _Suffixes:
    """The suffixes of a row of numbers in order, for the longest match of one of them with an earlier one.

    Prefix doubling sorts them in as many rounds as the longest repeat has bits. Each suffix
    knows the nearest ones before and behind it in this order that start earlier; the longest
    match with any earlier one is with one of these two.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
        self.ranks, step = [rank], 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) > 0)
            if rank[order[-1]] == n - 1 or step >= n:
                break
            self.ranks.append(rank)
            step *= 2
        self.before, self.behind = self._earlier(order.tolist()), self._earlier(order[::-1].tolist())

    @staticmethod
    def _earlier(order: list[int]) -> list[int]:
        """The nearest suffix passed that starts earlier, or -1."""
        out, open_ = [-1] * len(order), []
        for at in order:
            while open_ and open_[-1] > at:
                open_.pop()
            if open_:
                out[at] = open_[-1]
            open_.append(at)
        return out

    def common(self, i: int, j: int) -> int:
        """How many values two suffixes begin with alike."""
        length, n = 0, len(self.before)
        for k in range(len(self.ranks) - 1, -1, -1):
            if max(i, j) + length < n and self.ranks[k][i + length] == self.ranks[k][j + length]:
                length += 1 << k
        return length

    def longest(self, i: int) -> tuple[int, int]:
        """The longest match of suffix ``i`` with an earlier one, and the earliest that has it."""
        near = [(self.common(i, j), -j) for j in (self.before[i], self.behind[i]) if j >= 0]
        if not near:
            return 0, -1
        length, at = max(near)
        at = -at
        while nearer := [j for j in (self.before[at], self.behind[at]) if j >= 0 and self.common(i, j) >= length]:
            at = min(nearer)
        return length, at


def parse(words: Words, refs: _References, p: SubstringDedup) -> Factors:
    """Factor each document against its reference blocks and its own earlier words.

    From left to right, a factor is the longest match of the words from here on with any
    stretch, or with the document from an earlier word on; the earliest source among equals.
    Words with no match of ``length`` words are passed over. Behind a factor the parse goes on
    ``length - 1`` words before its end, so windows across the boundary are checked as well.
    Places are compared one by one; a document with more than ``_MANY`` of them a word takes
    its matches from sorted suffixes instead, so the work stays near linear.
    """
    n, count = p.length, len(words.texts)
    at, keys = words.windows(n)
    owner = words.owner[at]
    keys = own(keys, owner)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    spot = np.arange(len(order))
    first, earlier = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    first[order] = np.maximum.accumulate(np.where(new, spot, 0))  # place in order of the window's first equal
    earlier[order] = spot - first[order]

    ref_at, ref_keys = windows_of(refs.hashes, refs.bounds, n)
    ref_stretch = np.repeat(np.arange(len(refs.owner)), np.diff(refs.bounds))[ref_at]
    ref_keys = own(ref_keys, refs.owner[ref_stretch])
    ref_order = np.argsort(ref_keys, kind="stable")
    low, high = (np.searchsorted(ref_keys[ref_order], keys, side) for side in ("left", "right"))

    here = len(words) + count
    text = np.full(here + len(refs.hashes) + len(refs.owner) + _AHEAD, _DOC_END, np.uint64)
    text[np.arange(len(words)) + words.owner] = words.hashes
    text[here : here + len(refs.hashes) + len(refs.owner)] = _REF_END
    text[here + np.arange(len(refs.hashes)) + np.repeat(np.arange(len(refs.owner)), np.diff(refs.bounds))] = refs.hashes
    at_text, ref_text = at + owner, here + ref_at + ref_stretch

    hits = np.flatnonzero((earlier > 0) | (high > low))
    edges = np.searchsorted(owner[hits], np.arange(count + 1))
    rows, starts, lengths, places = [], [], [], []
    ref_edges = np.searchsorted(refs.owner, np.arange(count + 1))
    begin = refs.bounds[:-1] + np.arange(len(refs.owner))
    for row in np.flatnonzero(np.diff(edges)):
        k, end = int(edges[row]), int(edges[row + 1])
        spots = at[hits[k:end]]
        j, suffixes = 0, None
        if int((earlier[hits[k:end]] + high[hits[k:end]] - low[hits[k:end]]).sum()) > _MANY * int(words.counts[row]):
            one, other = (int(begin[x]) if x < len(begin) else len(refs.hashes) + len(refs.owner) for x in ref_edges[row : row + 2])
            doc = int(words.bounds[row]) + int(row)
            joined = np.concatenate([text[here + one : here + other], text[doc : doc + int(words.counts[row]) + 1]])
            ends = np.flatnonzero((joined == _DOC_END) | (joined == _REF_END))
            _, numbers = np.unique(joined, return_inverse=True)
            numbers[ends] = numbers.max() + 1 + np.arange(len(ends))  # no two ends are alike
            suffixes, shift = _Suffixes(numbers), other - one
        while j < len(spots):
            w = hits[k + j]
            if suffixes is not None:
                size, place = suffixes.longest(int(at_text[w]) - doc + shift)
                place = here + one + place if place < shift else doc + place - shift
            else:
                options = np.concatenate([at_text[order[first[w] : first[w] + earlier[w]]], ref_text[ref_order[low[w] : high[w]]]])
                size, best = _longest(text, int(at_text[w]), options)
                outside = best[best >= here]
                place = int(outside.min() if len(outside) else best.min())
            if size < n:  # equal fingerprints of different words
                j += 1
                continue
            rows.append(row), starts.append(int(at[w])), lengths.append(size), places.append(place)
            j = int(np.searchsorted(spots, spots[j] + size - n + 1))
    rows, starts, lengths, places = (np.array(x, np.int64) for x in (rows, starts, lengths, places))
    stretch = np.where(places >= here, np.searchsorted(begin, places - here, "right") - 1, -1)
    base = words.bounds[rows]
    inside = places - rows - base
    if len(refs.owner):
        inside = np.where(stretch >= 0, places - here - begin[stretch] + refs.start[stretch], inside)
    return Factors(rows, starts - base, lengths, stretch, inside)


def _kept(words: Words, i: int, gone: np.ndarray) -> bytes:
    a, b = words.bounds[i], words.bounds[i + 1]
    data = words.texts.data
    return b" ".join([data[s:e].tobytes() for s, e, g in zip(words.starts[a:b], words.ends[a:b], gone[a:b], strict=True) if not g])


def _gone(words: Words, factors: Factors) -> np.ndarray:
    return covered(factors.start + words.bounds[factors.row], factors.length, len(words))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, and a tag that tells rows of one id and different texts apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("tag"), text.alias("text"))


_NO_REFERENCES = pa.array([], pa.list_(pa.struct([("source", pa.int64()), ("stag", pa.int32()), ("block", pa.int32()), ("words", pa.binary())])))


def _local(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """Each document by itself: words, digest of the words, and what its own repeats remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(2)):
                words = words_of(texts)
                gone = _gone(words, parse(words, _References.of(_NO_REFERENCES, p), p))
                same = [hashlib.blake2b(words.hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                kept = [hashlib.sha256(_kept(words, k, gone)).hexdigest() for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(words.counts, pa.int64()), pa.array(same, pa.binary()), pa.array(sums(gone, words.bounds), pa.int64()), pa.array(kept)], ["doc_id", "tag", "n_words", "digest", "n_removed", "kept_sha256"])

    return mapped(docs, run, "doc_id long, tag int, n_words long, digest binary, n_removed long, kept_sha256 string")


def _anchor_rows(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(2)):
                words = words_of(texts)
                at, _, anchors = _anchors(words, p)
                owner = words.owner[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
                ids, tags = (batch.column(c).slice(i, j - i).take(pa.array(owner[new])) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64)), ids, tags], ["anchor", "doc_id", "tag"])

    return mapped(docs, run, "anchor long, doc_id long, tag int")


def _window_rows(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """Windows around the anchors listed with each document, each window of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for i, j, texts in texts_of(batch.column(2)):
                words = words_of(texts)
                at, windows, anchors = _anchors(words, p)
                owner = words.owner[at]
                wanted = np.zeros(len(at), bool)
                edges = np.searchsorted(owner, np.arange(j - i + 1))
                for k in range(j - i):
                    a, b = edges[k], edges[k + 1]
                    wanted[a:b] = np.isin(anchors[a:b].view(np.int64), np.asarray(lists[i + k].values))
                wanted &= ~repeats(own(windows, owner))[1]
                pos = at[wanted] - words.bounds[owner[wanted]]
                ids, tags = (batch.column(c).slice(i, j - i).take(pa.array(owner[wanted])) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(windows[wanted].view(np.int64)), ids, tags, pa.array(pos, pa.int32())], ["phrase", "doc_id", "tag", "pos"])

    return mapped(docs, run, "phrase long, doc_id long, tag int, pos int")


def _runs(found: DataFrame) -> DataFrame:
    """Windows that follow each other in a document and in one source, as one row each.

    A run is cut where an Arrow batch ends, which changes nothing for the blocks it names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, pos, source, stag, spos = (np.asarray(batch.column(c)).astype(np.int64) for c in range(6))
            same = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (source[1:] == source[:-1]) & (stag[1:] == stag[:-1])
            new = np.append(True, ~(same & (np.diff(pos) == 1) & (np.diff(spos) == 1)))
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(doc)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tag[first], pa.int32()), pa.array(source[first]), pa.array(stag[first], pa.int32()), pa.array(spos[first], pa.int32()), pa.array(many, pa.int32())], ["doc_id", "tag", "source", "stag", "spos", "n"])

    sorted_ = found.repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "pos")
    return mapped(sorted_, run, "doc_id long, tag int, source long, stag int, spos int, n int", 10_000)


def _block_rows(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """The wanted reference blocks of each source: ``block`` words and the ``length - 1`` after them, as fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for i, j, texts in texts_of(batch.column(2)):
                words = words_of(texts)
                row, block, data = [], [], []
                for k in range(j - i):
                    hashes = words.hashes[words.bounds[k] : words.bounds[k + 1]]
                    for b in lists[i + k].as_py():
                        row.append(k), block.append(b), data.append(hashes[b * p.block : (b + 1) * p.block + p.length - 1].tobytes())
                ids, tags = (batch.column(c).slice(i, j - i).take(pa.array(row, pa.int64())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, tags, pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["source", "stag", "block", "words"])

    return mapped(docs, run, "source long, stag int, block int, words binary")


def _copies(base: DataFrame, p: SubstringDedup) -> DataFrame:
    """Later whole copies of a document, with the first one as their source."""
    named = base.filter(f"doc_id IS NOT NULL AND n_words >= {p.length}")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("source"), F.min_by("tag", "doc_id").alias("stag"), F.max("doc_id").alias("_last")).filter("source < _last")
    firsts = written(firsts, "firsts")  # read apart, so that a join can split a text of very many copies
    copies = written(named.join(firsts, "digest").filter("doc_id > source").select("doc_id", "tag", "source", "stag", "n_words"), "copies")
    dropped(firsts)
    return copies


def _references(docs: DataFrame, base: DataFrame, p: SubstringDedup) -> tuple[DataFrame, DataFrame]:
    """The reference blocks that each document is parsed against: ``doc_id, tag, refs``, and the table behind them.

    Windows are indexed by fingerprint with the place where they stand first; the blocks that
    hold these places, for every window of a document that stands in an earlier one too, are
    all it takes to find each of its duplicate windows. A whole copy is sent its source.
    """
    copies = _copies(base, p)
    long = docs.filter("doc_id IS NOT NULL")
    anchors = written(_anchor_rows(long, p), "anchors")
    again = written(anchors.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b").select("anchor"), "again")
    listed = anchors.join(again, "anchor").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors"))
    listed = written(listed.join(copies, ["doc_id", "tag"], "left_anti"), "listed")
    dropped(anchors, again)

    near = only_ids(long, listed, "doc_id").select("doc_id", "tag", "text").join(listed, ["doc_id", "tag"])
    windows = written(_window_rows(near.select("doc_id", "tag", "text", "anchors"), p), "windows")
    index = windows.groupBy("phrase").agg(F.min("doc_id").alias("source"), F.min_by("tag", "doc_id").alias("stag"), F.min_by("pos", "doc_id").alias("spos"), F.max("doc_id").alias("_last"))
    index = written(index.filter("source < _last").drop("_last"), "index")  # read apart from the windows, so that a join can split a phrase that very many documents hold
    found = windows.join(index, "phrase").filter("source < doc_id").select("doc_id", "tag", "pos", "source", "stag", "spos")
    runs = written(_runs(found), "runs")
    dropped(listed, windows, index)

    blocks = lambda first, last: F.explode(F.expr(f"sequence(CAST({first} DIV {p.block} AS INT), CAST({last} DIV {p.block} AS INT))")).alias("block")
    key = ["doc_id", "tag", "source", "stag"]
    needs = runs.select(*key, blocks("spos", "(spos + n - 1)")).union(copies.select(*key, blocks("0", f"(n_words - {p.length})")))
    needs = written(needs.distinct(), "needs")
    sources = needs.select("source", "stag", "block").distinct().groupBy("source", "stag").agg(F.collect_list("block").alias("blocks"))
    held = only_ids(long, needs, "doc_id", "source").join(sources, (F.col("doc_id") == F.col("source")) & (F.col("tag") == F.col("stag")))
    sent = written(_block_rows(held.select("doc_id", "tag", "text", "blocks"), p), "blocks")
    refs = needs.join(sent, ["source", "stag", "block"]).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("source", "stag", "block", "words"))).alias("refs"))
    refs = written(refs, "refs")
    dropped(copies, runs, sent)
    return refs, needs


def _parsed(docs: DataFrame, p: SubstringDedup) -> DataFrame:
    """Words that the factors of each document cover, and the digest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(2)):
                words = words_of(texts)
                gone = _gone(words, parse(words, _References.of(batch.column(3).slice(i, j - i), p), p))
                kept = pa.array([hashlib.sha256(_kept(words, k, gone)).hexdigest() for k in range(j - i)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(sums(gone, words.bounds), pa.int64()), kept], ["doc_id", "tag", "removed", "sha"])

    return mapped(docs, run, "doc_id long, tag int, removed long, sha string")


def substring_duplicates(docs: DataFrame, p: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a factor of ``length`` words or more with an earlier source.

    The reference is the corpus itself, in blocks of ``block`` words. An index from windows of
    ``length`` words to the place where each stands first tells which blocks of earlier
    documents a document is parsed against (windows are looked up only where their anchor
    gram occurs in two documents); its own earlier words are a block too. Each document is
    then factored greedily against all its blocks in one task, see ``parse``. Whole copies
    are sent their source's blocks and are one factor.

    Returns ``doc_id, n_words, n_removed, kept_sha256``, one row per input row. A null or
    wordless text has no words and the digest of an empty text. Rows without an id are
    neither source nor copy of another row; only their own repeats go. Rows that repeat an
    id are no source for each other: neither is earlier; each is parsed by its own text.
    Equally long matches of a factor change nothing in the result. A text of any length is
    parsed whole, in one task, with at most the blocks that its windows name. Bytes that are
    no UTF-8 are bytes of words. An empty table gives an empty result; further columns are
    not read.
    """
    docs = _columns(docs, id_col, text_col)
    base = written(_local(docs, p), "local")
    refs, needs = _references(docs, base, p)
    near = only_ids(docs.filter("doc_id IS NOT NULL"), needs, "doc_id").select("doc_id", "tag", "text").join(refs, ["doc_id", "tag"])
    late = written(_parsed(near.select("doc_id", "tag", "text", "refs"), p).dropDuplicates(["doc_id", "tag"]), "late")
    dropped(refs, needs)
    joined = base.join(late, ["doc_id", "tag"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("removed", "n_removed").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


def duplicate_spans(docs: DataFrame, p: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The factors behind the removals: ``doc_id, start, length, source, source_start``, in words.

    A factor is the longest match within the blocks that the document was sent: it ends where
    the words differ, or at the end of a text or of a stretch of blocks. Own repeats name the
    document itself as source.
    """
    docs = _columns(docs, id_col, text_col)
    base = written(_local(docs, p), "local")
    refs, needs = _references(docs, base, p)
    dropped(base, needs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(1)):
                sent = _References.of(batch.column(2).slice(i, j - i), p)
                f = parse(words_of(texts), sent, p)
                ids = batch.column(0).slice(i, j - i).take(pa.array(f.row))
                source = pa.array([ids[k].as_py() if s < 0 else int(sent.source[s]) for k, s in enumerate(f.stretch)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (f.start, f.length)), source, pa.array(f.source_start, pa.int64())], ["doc_id", "start", "length", "source", "source_start"])

    all_ = docs.join(refs, ["doc_id", "tag"], "left").select("doc_id", "text", "refs")
    return mapped(all_, run, "doc_id long, start long, length long, source long, source_start long")


def without_duplicate_spans(docs: DataFrame, p: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the texts that are left, in the same columns; documents left without a word go.

    Texts that lose nothing stay as they are, wordless and null ones too; others become their
    kept words joined by spaces, and ``chars_col``, if there is one, their new length. Rows
    are judged as in ``substring_duplicates``, whatever other columns are called.
    """
    slim = _columns(docs, id_col, text_col)
    base = written(_local(slim, p), "local")
    refs, needs = _references(slim, base, p)
    dropped(base, needs)
    key, tag, sent = fresh(docs.columns, 3)
    renamed = refs.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("refs").alias(sent))
    joined = docs.join(renamed, (F.col(id_col).cast("long") == F.col(key)) & (F.hash(F.col(text_col).cast("string")) == F.col(tag)), "left").select(*(docs[c] for c in docs.columns), sent)
    text, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch.column(text)):
                words = words_of(texts)
                gone = _gone(words, parse(words, _References.of(batch.column(len(docs_columns)).slice(i, j - i), p), p))
                lost = sums(gone, words.bounds)
                new = {k: _kept(words, k, gone) for k in np.flatnonzero(lost)}
                columns = [batch.column(c).slice(i, j - i) for c in range(len(docs_columns))]
                old = columns[text].cast(pa.binary()).to_pylist()
                columns[text] = pa.array([new.get(k, t) for k, t in enumerate(old)], pa.binary()).view(pa.string()).cast(columns[text].type)
                if chars is not None:
                    counts = columns[chars].to_pylist()
                    columns[chars] = pa.array([len(new[k].decode("utf-8", "replace")) if k in new else n for k, n in enumerate(counts)], columns[chars].type)
                stays = pa.array((lost == 0) | (lost < words.counts))
                yield pa.RecordBatch.from_arrays([c.filter(stays) for c in columns], docs_columns)

    docs_columns = docs.columns
    return mapped(joined, run, docs.schema)
