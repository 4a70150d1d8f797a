"""Words, their fingerprints and windows over Arrow batches of texts, in numpy.

Word classes hold every byte from 0x80 up, so words can be cut on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd base of the byte polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_MIX = np.random.default_rng(977).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

#: Bytes outside [^\x20\x09-\x0D] are the six ASCII spaces.
TEXT_WORD = np.ones(256, bool)
TEXT_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z is lower-cased.
ITEM_WORD = np.zeros(256, bool)
ITEM_WORD[0x30:0x3A] = ITEM_WORD[0x61:0x7B] = ITEM_WORD[0x80:] = True

PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes that are hashed at a time; the powers of the base never grow beyond it.
CHUNK = 1 << 16


def _powers(base: int) -> np.ndarray:
    x = np.full(CHUNK + 1, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _long_span(data: np.ndarray) -> int:
    """The polynomial of a span of any length, a chunk after the other."""
    total = 0
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        total += int((_BYTE[part] * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64)
    return total % (1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte spans ``data[start:end]``, which lie in order and do not overlap.

    Spans are hashed in chunks of ``CHUNK`` bytes with positions counted from the chunk's
    start, so tables and scratch arrays have a fixed size however long the texts are.
    """
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + CHUNK, "right"))
        if j <= i:
            out[i] = _long_span(data[base : int(ends[i])])
            i += 1
            continue
        part = data[base : int(ends[j - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * _DOWN[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


@dataclass
class Texts:
    """Some whole texts, end to end: bytes, and where each text starts and ends."""

    data: np.ndarray
    bounds: np.ndarray  # one more than texts
    valid: np.ndarray  # False for null

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


@dataclass
class Words:
    """Words of some texts in order: byte spans, fingerprints, and each text's word range."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of ``n`` words of one text, and the runs' fingerprints."""
        return windows_of(self.hashes, self.bounds, n)


def windows_of(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the runs of ``n`` words that lie within two neighbouring ``bounds``."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(bounds[1:] - n, np.diff(bounds))[:m]
    at = np.flatnonzero(np.arange(m) <= last)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * _MIX[j]
    return at, mix(total[at] + _U(n))


def texts_of(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """``column`` in runs of whole texts of about ``size`` bytes: first row, end row, texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    valid = ~np.asarray(column.is_null())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not valid.all():  # a null may own bytes in the buffer
        column = column.fill_null("")
        _, o, d = column.buffers()
        offsets, data = np.frombuffer(o, np.int64)[column.offset : column.offset + n + 1], np.frombuffer(d, np.uint8) if d is not None else data
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], valid[i:j])
        i = j


def words_of(texts: Texts, table: np.ndarray = TEXT_WORD, fold: np.ndarray = PLAIN) -> Words:
    data = texts.data if fold is PLAIN else fold[texts.data]
    inside = table[data]
    first = texts.bounds[:-1][np.diff(texts.bounds) > 0]
    last = texts.bounds[1:][np.diff(texts.bounds) > 0] - 1
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1]
    e[:-1] &= ~inside[1:]
    s[first], e[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return Words(texts, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, texts.bounds))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it come again anywhere, and has it come before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, before


def own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys told apart by their text, so that equal keys of two texts differ."""
    return mix(keys + mix(owner.astype(np.uint64) + _U(1)))


def covered(at: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``length`` words from one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each range of ``bounds``; empty ranges give 0."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
