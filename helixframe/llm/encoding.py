"""Whole-text encoding with the tokenizers library, reusing the ids of pieces seen before.

A tokenizer that splits texts into words and punctuation before it merges gives a text the
ids of its pieces, one after another, if the cuts are where it would split anyway. The
words of a corpus repeat, so most pieces are looked up and only new ones are encoded. Texts
with white space other than single blanks and line feeds are encoded whole, where case is
dropped also those with a mark that may compose with a capital, and so is every text where the
tokenizer is not one of the two kinds whose splits are known here.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa

from helixframe.llm.words import LOWER, Texts, span_hashes, texts_of

END = 1
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not _ALNUM[c] and chr(c) not in "'_"]] = True
#: Last bytes of the letters that UTF-8 writes as 0xC3 and another byte: all but the two signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
#: Other white space, which Python and the tokenizers may not see alike, in one, two and three bytes.
_ODD_ONE = np.zeros(256, bool)
_ODD_ONE[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
_ODD_TWO = (0xC285, 0xC2A0)
_ODD_THREE = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pieces that are encoded together.
_TOGETHER = 200


class _Places(dict):
    """Numbers of pieces; an unknown piece gets the next one and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


#: The split pattern and normalization of the known kind that drops white space and case.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def known_kind(settings: dict) -> str | None:
    """``bytes`` or ``words`` for a tokenizer whose splits ``Encoder`` knows, or None."""
    split, normal = settings["pre_tokenizer"] or {}, settings["normalizer"]
    if normal is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return "bytes"
    steps = split.get("pretokenizers", [])
    if (normal or {}).get("normalizers") == _WORD_NORMAL and len(steps) == 2:
        first, second = steps
        if first.get("pattern") == {"Regex": _WORD_PATTERN} and first["behavior"] == "Removed" and first["invert"] and second["type"] == "ByteLevel" and not second["use_regex"] and not second["add_prefix_space"]:
            return "words"
    return None


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file, END included."""
    from tokenizers import Tokenizer

    return max(END, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


class Encoder:
    """Encodes batches of texts.

    About ``remembered`` pieces are kept; when there are more, and at the end of a task, those
    that were used only once are forgotten.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path) as file:
            self.kind = known_kind(json.load(file))
        mark = {"bytes": "\n", "words": " \x01 "}.get(self.kind)
        ids = self._library([mark])[0] if mark else []
        self.mark = (mark, ids[0]) if len(ids) == 1 else (None, None)
        self._start(remembered)

    def _start(self, remembered: int) -> None:
        self.remembered = remembered
        self.places = _Places()
        self.ids, self.edges, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.remembered // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.remembered // 2]])
        names = list(self.places)
        size = self.edges[keep + 1] - self.edges[keep]
        self.ids = self.ids[_ranges(self.edges[keep], size)]
        self.edges, self.uses = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(keep), np.int64)
        self.places = _Places()
        self.places.update(zip([names[k] for k in keep], range(len(keep)), strict=True))

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has.

        Some hundred pieces are encoded as one text, with a mark between them that the tokenizer
        splits off and that has one id of its own. Pieces that hold the mark go one by one.
        """
        mark, own_id = self.mark
        if mark is not None and not any(mark.strip(" ") in p for p in pieces):
            texts = [mark.join(pieces[i : i + _TOGETHER]) + mark for i in range(0, len(pieces), _TOGETHER)]
            ids = np.fromiter(chain.from_iterable(self._library(texts)), np.uint32)
            ends = np.flatnonzero(ids == own_id)
            if len(ends) == len(pieces):
                return ids[ids != own_id], np.diff(np.append(-1, ends)) - 1
        lists = self._library(pieces)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _learn(self) -> None:
        if self.places.new:
            pieces = [p.decode() for p in self.places.new]
            alone = [k for k, p in enumerate(pieces) if self.mark[0] is not None and self.mark[0].strip(" ") in p]
            many = pieces if not alone else [p for p in pieces if self.mark[0].strip(" ") not in p]
            ids, size = self._of_pieces(many)
            if alone:  # put where they belong
                rest, sizes = self._of_pieces([pieces[k] for k in alone])
                order = np.argsort(np.concatenate([np.setdiff1d(np.arange(len(pieces)), alone), alone]), kind="stable")
                whole, all_sizes = np.concatenate([ids, rest]), np.concatenate([size, sizes])
                starts = np.cumsum(all_sizes) - all_sizes
                ids, size = whole[_ranges(starts[order], all_sizes[order])], all_sizes[order]
            self.ids = np.concatenate([self.ids, ids])
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(size)])
            self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
            self.places.new = []

    def _unsure(self, texts: Texts) -> np.ndarray:
        """Which texts the tokenizer may split elsewhere: white space other than single blanks and line feeds inside them."""
        data, some = texts.data, np.diff(texts.bounds) > 0
        out = np.zeros(len(texts), bool)
        if self.kind is None:
            return some
        blank = _BLANK[data]
        wide = data[data >= 0xC2] if len(data) else data
        odd = [np.flatnonzero(_ODD_ONE[data]), np.flatnonzero(blank[1:] & blank[:-1])]
        if len(wide):
            lead = np.flatnonzero(data[:-1] == 0xC2)
            odd.append(lead[np.isin((np.int64(0xC2) << 8) | data[lead + 1], _ODD_TWO)])
            lead = np.flatnonzero(np.isin(data[:-2], (0xE1, 0xE2, 0xE3)))
            odd.append(lead[np.isin((data[lead].astype(np.int64) << 16) | (data[lead + 1].astype(np.int64) << 8) | data[lead + 2], _ODD_THREE)])
        if self.kind == "words":  # a mark behind a capital: composed or not before the capital becomes small
            odd.append(np.flatnonzero(_CAPITAL[data[:-1]] & (data[1:] >= 0xCC)))
        out[np.searchsorted(texts.bounds, np.concatenate(odd), "right") - 1] = True
        out[some] |= blank[texts.bounds[:-1][some]] | blank[texts.bounds[1:][some] - 1]
        return out

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts, and where they are cut into pieces: starts and ends.

        The tokenizer splits in any case before a blank and around a line feed between other
        characters, and before ASCII punctuation (but the apostrophe) that follows a letter or
        digit.
        """
        data = texts.data if self.kind == "bytes" else LOWER[texts.data]
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
        feed, after = data == 10, _ALNUM[data[:-1]]
        after[1:] |= _LATIN[data[1:-1]] & (data[:-2] == 0xC3)
        cut = feed | (data == 32)
        cut[1:] |= feed[:-1] | (after & _PUNCTUATION[data[1:]])
        cut[texts.bounds[:-1][texts.bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if self.kind == "words":  # blanks and line feeds go
            starts = starts + _BLANK[data[starts]]
            starts, ends = starts[starts < ends], ends[starts < ends]
        return data, starts, ends

    def encode(self, texts: Texts | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids start and end.

        Pieces are told apart by fingerprint among these texts (64 bits, some ten thousand of
        them), and by their bytes among those remembered.
        """
        if not isinstance(texts, Texts):
            texts = joined(pa.array(texts, pa.string()))
        if len(self.places) > self.remembered:
            self.forget()
        unsure = self._unsure(texts)
        data, starts, ends = self._pieces(texts)
        owner = np.searchsorted(texts.bounds, starts, "right") - 1
        sure = ~unsure[owner]
        starts, ends, owner = starts[sure], ends[sure], owner[sure]
        _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        at = np.fromiter((self.places[raw[s:e]] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.int64, len(first))
        self._learn()
        at = at[which]
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.edges[at + 1] - self.edges[at]
        ids = self.ids[_ranges(self.edges[at], size)]
        sizes = np.bincount(owner, size, len(texts)).astype(np.int64)
        whole = np.flatnonzero(unsure)
        if len(whole):
            encoded = dict(zip(whole.tolist(), self._library([texts.text(i).decode() for i in whole]), strict=True))
            before, parts = np.concatenate([[0], np.cumsum(sizes)]), []
            for i in range(len(texts)):
                parts.append(np.array(encoded[i], np.uint32) if i in encoded else ids[before[i] : before[i + 1]])
                sizes[i] = len(parts[-1])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def encode_documents(self, texts: Texts | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same with the id END after each text."""
        ids, bounds = self.encode(texts)
        out = np.full(len(ids) + len(texts), END, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = ids
        return out, bounds + np.arange(len(bounds))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + size`` of each pair, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


_ENCODERS: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str, kind: type[Encoder] = Encoder) -> Iterator[Encoder]:
    """The worker's encoder of a vocabulary; after a task it keeps only pieces that came more than once."""
    if path not in _ENCODERS:
        _ENCODERS.clear()  # one vocabulary at a time
        _ENCODERS[path] = kind(path)
    found = _ENCODERS[path]
    try:
        yield found
    finally:
        found.forget()


def texts_in(column: pa.Array) -> list[str | None]:
    """The texts of an Arrow column; bytes that are no UTF-8 become U+FFFD."""
    return [None if t is None else bytes(t).decode("utf-8", "replace") for t in column.cast("binary").to_pylist()]


def decodable(texts: Texts) -> Texts:
    """The same texts, with U+FFFD for bytes that are no UTF-8."""
    try:
        str(texts.data, "utf-8")
    except UnicodeDecodeError:
        return joined(pa.array([texts.text(k).decode("utf-8", "replace") if texts.valid[k] else None for k in range(len(texts))], pa.string()))
    return texts


def joined(column: pa.Array) -> Texts:
    """All texts of a column as one run."""
    return next((t for _, _, t in texts_of(column, 1 << 62)), Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)))


def runs(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` characters."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        total += len(t or "")
        if total >= size or j + 1 == len(texts):
            yield i, j + 1
            i, total = j + 1, 0
