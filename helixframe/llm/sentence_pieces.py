"""Exact encoding and decoding with merge-type SentencePiece models, whole texts at a time.

A text is merged pair by pair, the best score first and the leftmost among equals. A
sequence of pieces is the result just if every piece merges to itself and every two
neighbours merge to those two: the first merge across a border would be the first across it
in the text of the two neighbours alone as well. So the sequence can be searched for
directly, see ``PieceEncoder.pieces_of``.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.encoding import Encoder, _ranges, decodable, encoder, joined, vocabulary_path
from helixframe.llm.store import mapped
from helixframe.llm.words import Texts, texts_of

#: Fixed value: the character that stands for a blank within pieces.
BLANK = "▁"
NEVER = float("-inf")
#: Pairs whose compatibility is remembered; beyond it they are all forgotten.
PAIRS = 300_000

codecs.register_error("bytewise", lambda e: ("�", e.start + 1))  # U+FFFD for each byte that does not decode


@dataclass(frozen=True)
class Model:
    """``path``: a SentencePiece model of merge type that changes nothing but blanks, puts one
    before each text and keeps all others."""

    path: str = ""

    def file(self) -> str:
        return self.path or vocabulary_path("piece_bpe_32k.model")


class PieceEncoder(Encoder):
    """Encodes batches of texts, reusing the ids of spans seen before.

    Texts are cut where no piece holds the two neighbouring bytes, so no merge crosses a cut.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  x ") != "▁ﬁ▁▁x▁":
            raise ValueError("a model is needed that leaves texts as they are but for blanks, with one before each text")
        kinds = range(model.get_piece_size())
        plain = [i for i in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.n = len(kinds)
        self.names = [model.id_to_piece(i).replace(BLANK, " ") for i in kinds]
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.unknown = model.unk_id()
        self.of_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in kinds if model.is_byte(i)}
        self.inner = {c for name in self.score for c in name}
        whole = {self.names[i]: i for i in plain if self.merged(self.names[i]) == [self.names[i]]}
        whole |= {c: self.n + ord(c) for c in self.inner if c not in self.score}  # characters that only occur in larger pieces
        self.shorter = {i: next((whole[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in whole), None) for name, i in whole.items()}
        self.length = [len(name) for name in self.names]
        self.automaton = ahocorasick.Automaton()
        for name, i in whole.items():
            self.automaton.add_word(name[::-1], i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.traces: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.held = np.zeros((256, 256), bool)  # neighbouring bytes of some piece
        for raw in (name.encode() for name in self.score):
            self.held[list(raw[:-1]), list(raw[1:])] = True
        self.held[:, 0x80:0xC0] = True  # a character is not cut
        out = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if i == self.unknown else self.names[i].encode() for i in kinds]
        self.bytes_of, self.at_byte = np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])
        self.leads = np.array([not model.is_byte(i) and o.startswith(b" ") and i != self.unknown for i, o in zip(kinds, out, strict=True)])
        self.mark = (None, None)
        self._start(remembered)

    def _steps(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """The parts of a short text before each merge, with the merge's score, and at the end."""
        parts = list(text)
        while True:
            scores = [self.score.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores, default=NEVER)
            yield best, parts
            if best == NEVER:
                return
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives, straight from its definition; for short texts."""
        return [parts for _, parts in self._steps(text)][-1]

    def _trace(self, token: int) -> tuple[list[float], list[str], list[str]]:
        """Of each merge within a piece: its score, and the first and the last part before it."""
        if token not in self.traces:
            steps = [(score, parts[0], parts[-1]) for score, parts in self._steps(self.names[token] if token < self.n else chr(token - self.n))]
            self.traces[token] = tuple(map(list, zip(*steps, strict=True)))
        return self.traces[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the texts of two neighbouring pieces merge to these two again.

        The merges of both are made anew in the order of their scores, and at each step the
        last part of one and the first of the other are the pair across the border. That pair
        is merged if its score is the best one, on equal scores after those to its left.
        """
        (left, _, tails), (right, heads, _) = self._trace(a), self._trace(b)
        i = j = 0
        while True:
            x, y, across = left[i], right[j], self.score.get(tails[i] + heads[j], NEVER)
            if across > x and across >= y:
                return False
            if x >= y:
                if x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def pieces_of(self, text: str, longest: list[int], start: int, end: int) -> list[int]:
        """The pieces of ``text[start:end]``, of which ``longest`` gives the longest piece from each place.

        The longest piece that suits its neighbour is taken; where none does, the place is
        marked as failed, the piece before it is taken back and a shorter one is tried. As an
        encoding is unique, so are the pieces that lead to a place, and a failed place need not
        be tried again: each place is left at most once for each piece that starts there.
        """
        path: list[int] = []
        at, token, last = start, longest[start], -1
        failed = bytearray((end - start >> 3) + 1)
        pairs, length, shorter, n = self.pairs, self.length, self.shorter, self.n
        while True:
            while token is not None:
                stop = at + (length[token] if token < n else 1)
                k = stop - start
                if not failed[k >> 3] >> (k & 7) & 1:
                    if last < 0:
                        break
                    pair = last << 22 | token
                    fit = pairs.get(pair)
                    if fit is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fit = pairs[pair] = self.fits(last, token)
                    if fit:
                        break
                token = shorter.get(token)
            if token is None:
                failed[at - start >> 3] |= 1 << (at - start & 7)
                token = path.pop()
                at -= length[token] if token < n else 1
                last = path[-1] if path else -1
                token = shorter.get(token)
                continue
            path.append(token)
            if stop == end:
                return path
            at, last, token = stop, token, longest[stop]

    def _ids(self, token: int) -> list[int]:
        """A piece's id; a character without one is its bytes, or unknown where the model has no bytes."""
        return [token] if token < self.n else [self.of_byte[b] for b in chr(token - self.n).encode()] if self.of_byte else [self.unknown]

    def _library(self, texts: list[str]) -> list[list[int]]:
        text = "\n".join(texts)  # a line feed may stand in texts too: spans are known by place
        longest = [self.n + ord(c) for c in text]
        seen, last = -1, len(text) - 1
        for stop, token in self.automaton.iter(text[::-1]):  # backwards: what ends at a place there starts at it here
            if stop != seen:  # the longest comes first
                longest[last - stop] = token
                seen = stop
        out, at = [], 0
        for span in texts:
            tokens = self.pieces_of(text, longest, at, at + len(span))
            out.append(tokens if max(tokens) < self.n else list(chain.from_iterable(map(self._ids, tokens))))
            at += len(span) + 1
        return out

    def _unsure(self, texts: Texts) -> np.ndarray:
        return np.zeros(len(texts), bool)

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = texts.data
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.held[data[:-1], data[1:]]
        cut[texts.bounds[:-1][texts.bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return data, starts, np.append(starts[1:], len(data))

    def encode(self, texts: Texts | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids start and end."""
        if not isinstance(texts, Texts):
            texts = joined(pa.array(texts, pa.string()))
        return super().encode(_with_blanks(texts))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids: no blank before the first piece, U+FFFD for bytes that do not decode."""
        size = self.at_byte[ids + 1] - self.at_byte[ids]
        raw = self.bytes_of[_ranges(self.at_byte[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first = i + int(np.argmax(size[i:j] > 0)) if j > i else i  # control pieces have no text
            out.append(raw[ends[i] + bool(j > i and self.leads[ids[first]]) : ends[j]].decode("utf-8", "bytewise"))
        return out


def _with_blanks(texts: Texts) -> Texts:
    """The texts with a blank before each that is not empty, and blanks for the character that stands for one."""
    raw = texts.data.tobytes()
    if BLANK.encode() in raw:
        texts = joined(pa.array([texts.text(k).decode().replace(BLANK, " ") for k in range(len(texts))], pa.string()))
    some = np.diff(texts.bounds) > 0
    data = np.insert(texts.data, texts.bounds[:-1][some], 32)
    return Texts(data, texts.bounds + np.concatenate([[0], np.cumsum(some)]), texts.valid)


def _mapped(rows: DataFrame, p: Model, both: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path, PieceEncoder) as enc:
            for batch in batches:
                for i, j, texts in texts_of(batch.column(1)):
                    ids, bounds = enc.encode(decodable(texts))
                    columns = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                    if both:
                        columns.append(pa.array(enc.decode(ids.astype(np.int64), bounds), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    path, names = p.file(), ["doc_id", "ids", "text"][: 2 + both]
    return mapped(rows, run, "doc_id long, ids array<int>" + ", text string" * both)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded(docs: DataFrame, p: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of whole texts, a row for each row of ``docs``, without a shuffle.

    A null or empty text has no ids. Repeated rows are encoded each, bytes that are no UTF-8
    as U+FFFD. A text without cuts is searched as one span, in time and memory linear in it.
    """
    return _mapped(_rows(docs, id_col, text_col), p, False)


def round_trip(docs: DataFrame, p: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text that the ids decode to: the document's own, with blanks for U+2581."""
    return _mapped(_rows(docs, id_col, text_col), p, True)


def decoded(ids: DataFrame, p: Model = Model(), id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of lists of ids; null or no ids give an empty text, an id out of range is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path, PieceEncoder) as enc:
            for batch in batches:
                lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
                bounds = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[bounds[0] : bounds[-1]]
                if len(flat) and not (flat.min() >= 0 and flat.max() < enc.n):
                    raise ValueError(f"ids lie between 0 and {enc.n - 1}")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.decode(flat, bounds - bounds[0]), pa.string())], ["doc_id", "text"])

    path = p.file()
    return mapped(ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, text string")
