"""Token counts of sections, from the spans of tokens of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.encoding import encoder, runs, texts_in, vocabulary_path
from helixframe.llm.store import mapped

RULES = ("first", "last", "most")


@dataclass(frozen=True)
class TokenCounts:
    """``vocabulary``: a byte-level BPE file of the tokenizers library. ``rule``: the section
    that a token across a boundary belongs to, by its first character, its last one, or most
    of its characters (the earlier section where equal)."""

    vocabulary: str = ""
    rule: str = "first"

    def path(self) -> str:
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")
        return self.vocabulary or vocabulary_path("byte_bpe_50k.json")


_LENGTHS: dict[str, np.ndarray] = {}


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id: a byte-level vocabulary writes one character for a byte."""
    if path not in _LENGTHS:
        with encoder(path) as known:
            vocabulary = known.tokenizer.get_vocab(with_added_tokens=True)
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            lengths[i] = len(token)
        _LENGTHS[path] = lengths
    return _LENGTHS[path]


def allocate(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Join token spans to the sections that begin at ``cuts`` (sorted, the first at 0).

    Gives each token's section and whether it crosses a boundary.
    """
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, np.maximum(ends - 1, starts), "right") - 1
    crossing = last > first
    if rule == "last":
        return last, crossing
    if rule == "most":
        out = first.copy()
        for t in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[t]], cuts[first[t] + 1 : last[t] + 1], [ends[t]]])
            out[t] = first[t] + int(np.argmax(np.diff(edges)))
        return out, crossing
    return first, crossing


def section_tokens(docs: DataFrame, p: TokenCounts = TokenCounts(), id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None) -> DataFrame:
    """Tokens of each section of each document, encoded once as a whole.

    Sections are the lines of the text, a line feed belonging to the line it ends; or, with
    ``fields``, those columns, joined by line feeds into one text (a null field is empty).
    Byte spans of tokens come from the vocabulary, whose tokens lose no byte, and become
    spans of characters; a token that holds part of a character counts as holding it.
    Spans are joined to sections by binary search and crossing tokens follow ``rule``.

    Returns ``doc_id, section, field, start, chars, n_tokens, n_crossing``: section number
    from 0, field name (null for lines), first character, characters, tokens, and how many
    of these tokens cross a boundary. A document's counts sum to its tokens. A null or empty
    text is one empty section without tokens. Repeated rows and rows without an id are counted
    each for itself; bytes that are no UTF-8 are read as U+FFFD; a text of any length is
    encoded whole; an empty table gives an empty result; further columns are not read.
    """
    path, rule = p.path(), p.rule
    names = list(fields) if fields else None
    columns = [F.col(c).cast("string") for c in (names or [text_col])]

    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_bytes(path)
        with encoder(path) as known:
            for batch in batches:
                parts = [texts_in(batch.column(1 + k)) for k in range(width)]
                texts = ["\n".join(t or "" for t in row) for row in zip(*parts, strict=True)]
                for i, j in runs(texts):
                    yield counted(batch.column(0).slice(i, j - i), texts[i:j], [p[i:j] for p in parts], *known.encode(texts[i:j]), lengths)

    def counted(doc_ids: pa.Array, texts: list[str], parts: list[list], ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        row, section, start, chars, tokens, crossing = ([] for _ in range(6))
        for k, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            size = lengths[ids[bounds[k] : bounds[k + 1]]]
            ends = np.cumsum(size)
            if len(raw) != (ends[-1] if len(ends) else 0):
                raise ValueError("the vocabulary is not byte-level: its tokens lose bytes")
            number = np.cumsum((raw & 0xC0) != 0x80) - 1  # each byte's character
            if names:
                lens = [len((part[k] or "").encode()) + 1 for part in parts]
                cuts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
            else:
                cuts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                cuts = cuts[: -1 if len(cuts) > 1 and cuts[-1] == len(raw) else None]
            char_at = np.append(number, number[-1] + 1 if len(number) else 0)
            cuts = char_at[np.minimum(cuts, len(raw))]
            s = number[ends - size] if len(ends) else ends
            e = number[ends - 1] + 1 if len(ends) else ends
            to, cross = allocate(s, e, cuts, rule)
            n = len(cuts)
            row.append(np.full(n, k)), section.append(np.arange(n)), start.append(cuts)
            chars.append(np.diff(np.append(cuts, char_at[-1])))
            tokens.append(np.bincount(to, minlength=n)), crossing.append(np.bincount(to[cross], minlength=n))
        row, section, start, chars, tokens, crossing = (np.concatenate(x).astype(np.int64) for x in (row, section, start, chars, tokens, crossing))
        field = pa.array([names[x] for x in section] if names else [None] * len(section), pa.string())
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(section), field, pa.array(start), pa.array(chars), pa.array(tokens), pa.array(crossing)], ["doc_id", "section", "field", "start", "chars", "n_tokens", "n_crossing"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(f"t{k}") for k, c in enumerate(columns)))
    return mapped(slim, run, "doc_id long, section long, field string, start long, chars long, n_tokens long, n_crossing long")
