"""Quality rules: base statistics, a calibrated hashed n-gram logistic regression, and one on tell-tale words for toxic texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.encoding import decodable
from helixframe.llm.store import mapped
from helixframe.llm.words import ITEM_WORD, LOWER, TEXT_WORD, Texts, Words, covered, own, repeats, span_hashes, sums, texts_of, words_of

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Quality:
    """``sample``: labelled rows the model is fitted on, those of least hashed id: a bound that
    does not grow with the data. ``longest``: bytes of a text that is still fitted on, so that
    the sample is bounded in bytes too; longer texts are scored like others. ``bits``: hash buckets per kind of n-gram. ``keep_at``: the
    calibrated probability of good quality from which a document is kept. ``toxic_at``: the
    calibrated probability from which it is toxic. ``surprise``: the least G statistic between a
    word's presence and the toxic label (30: chance under 1e-7 a word)."""

    sample: int = 2000
    longest: int = 250_000
    bits: int = 16
    keep_at: float = 0.5
    toxic_at: float = 0.5
    surprise: float = 30.0
    scale: float = 64.0
    decay: float = 1e-4
    steps: int = 80
    seed: int = 5


@dataclass
class Model:
    """Weights of words, word pairs and character n-grams, and the two calibration numbers."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Toxic:
    """Fingerprints of tell-tale words in order, their weights, and the two calibration numbers."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


def _features(texts: Texts, words: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the bucket of each occurrence, and each text's range of them."""
    low = words_of(texts, TEXT_WORD, LOWER)
    shift = np.uint64(64 - bits)
    yield (low.hashes >> shift).astype(np.int64), low.bounds
    at, pairs = low.windows(2)
    yield (pairs >> shift).astype(np.int64) + (1 << bits), np.searchsorted(at, low.bounds)
    chars = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.bounds]
    for kind, n in ((2, 1), (3, 3)):
        if len(chars) < n:
            yield np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
            continue
        total = np.zeros(len(chars) - n + 1, np.uint64)
        for j in range(n):
            total += chars[j : len(chars) - n + 1 + j] * _ODD[j]
        total *= _ODD[3]
        ok = np.ones(len(total), bool)
        for b in bounds[1:-1]:  # n-grams don't cross texts
            ok[max(0, b - n + 1) : b] = False
        at = np.flatnonzero(ok)
        yield (total[at] >> shift).astype(np.int64) + (kind << bits), np.searchsorted(at, bounds)


def _scores(texts: Texts, words: Words, model: Model, p: Quality) -> np.ndarray:
    z = np.full(len(texts), model.bias)
    for buckets, bounds in _features(texts, words, p.bits):
        total = np.concatenate([[0.0], np.cumsum(model.weights[buckets], dtype=np.float64)])
        z += p.scale * (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))


def _samples(docs: DataFrame, labels: DataFrame, p: Quality, id_col: str, text_col: str, label_cols: tuple[str, ...]) -> list[list[dict]]:
    """For each label, the labelled rows that its model is fitted on, by id; the documents are read once for all of them."""
    chosen = []
    for label_col in label_cols:
        if label_col not in labels.columns:
            chosen.append([])
            continue
        known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)")
        chosen.append(known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(p.sample).collect())
    ids = docs.sparkSession.createDataFrame(sorted({(r["_id"],) for rows in chosen for r in rows}), "_id long")  # a row for each sampled label at most
    slim = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text")).filter(F.coalesce(F.octet_length("_text"), F.lit(0)) <= p.longest)
    least = slim.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min(F.coalesce("_text", F.lit("")).cast("binary")).alias("_text"))
    texts = {r["_id"]: bytes(r["_text"]) for r in least.collect()}  # of several texts of an id the least, so a row for each sampled label at most
    out = []
    for rows in chosen:
        label = {r["_id"]: r["_label"] for r in sorted(rows, key=lambda r: (r["_id"], r["_label"]), reverse=True)}  # the least label
        out.append([{"_label": label[i], "_text": texts[i].decode("utf-8", "replace")} for i in sorted(label) if i in texts])
    return out


def fitted(docs: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, str] = ("quality", "toxic")) -> tuple[Model, Toxic]:
    """Both models, from bounded samples of the labelled rows."""
    good, bad = _samples(docs, labels, p, id_col, text_col, label_cols)
    return fit(good, p), fit_toxic(bad, p)


def fit(rows: list[dict], p: Quality = Quality()) -> Model:
    """Fit on sampled rows, each a ``_label`` and a ``_text``; a fifth of them only calibrates (Platt's method).

    Fewer than ten rows, or rows of one class only, give a model that keeps everything.
    """
    y = np.array([r["_label"] for r in rows], np.float64)
    d = 4 << p.bits
    if len(y) < 10 or y.min() == y.max():
        return Model(np.zeros(d, np.float32), 8.0)
    rng = np.random.default_rng(p.seed)
    held = rng.permutation(len(y)) < len(y) // 5
    index, value, owner = [], [], []
    for i, _, texts in texts_of(pa.array([r["_text"] for r in rows], pa.string())):
        for buckets, bounds in _features(texts, words_of(texts), p.bits):
            sizes = np.diff(bounds)
            key, n = np.unique((np.repeat(np.arange(len(sizes)), sizes) << 32) | buckets, return_counts=True)
            who = key >> 32
            index.append(key & 0xFFFFFFFF), owner.append(who + i), value.append(p.scale * n / np.maximum(sizes[who], 1))
    index, value, owner = np.concatenate(index), np.concatenate(value), np.concatenate(owner)
    train = ~held[owner]
    weight = np.where(y > 0, 0.5 / (y[~held] > 0).mean().clip(0.01, 0.99), 0.5 / (y[~held] == 0).mean().clip(0.01, 0.99)) * ~held
    i_t, v_t, o_t = index[train], value[train], owner[train]
    w, b, m, s = np.zeros(d), 0.0, np.zeros(d), np.zeros(d)
    for t in range(1, p.steps + 1):  # Adam on the full sample
        z = np.bincount(o_t, v_t * w[i_t], len(y)) + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / weight.sum()
        g = np.bincount(i_t, v_t * r[o_t], d) + p.decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        b -= r.sum()
    z = np.bincount(owner, value * w[index], len(y)) + b
    slope, shift = _platt(z[held], y[held])
    return Model(w.astype(np.float32), float(b), slope, shift)


def _present(texts: Texts, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct words among the sorted fingerprints ``known``: text and place in ``known``."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = words_of(texts, ITEM_WORD, LOWER)
    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    hit = known[at] == words.hashes
    key = np.unique(words.owner[hit] * len(known) + at[hit])
    return key // len(known), key % len(known)


def _toxicity(texts: Texts, model: Toxic) -> np.ndarray:
    who, at = _present(texts, model.words)
    z = model.bias + np.bincount(who, model.weights[at], len(texts))
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))


def fit_toxic(rows: list[dict], p: Quality = Quality()) -> Toxic:
    """Fit a logistic regression on tell-tale words; sample and calibration as in ``fit``.

    One word makes a text toxic whatever its length, so the presence of words counts, not their
    share. Words (runs of letters and digits, lower case) are taken that toxic texts hold more
    often, in five or more of the texts, by the G statistic. Fewer than ten rows, or rows of one
    class only, give a model that calls nothing toxic.
    """
    y = np.array([r["_label"] for r in rows], np.float64)
    if len(y) < 10 or y.min() == y.max():
        return Toxic(bias=-8.0)
    held = np.random.default_rng(p.seed).permutation(len(y)) < len(y) // 5
    pairs, runs = [], list(texts_of(pa.array([r["_text"] for r in rows], pa.string())))
    for i, j, texts in runs:
        words = words_of(texts, ITEM_WORD, LOWER)
        pairs.append(np.unique(np.rec.fromarrays([words.owner[~held[i:j][words.owner]] + i, words.hashes[~held[i:j][words.owner]]], names="who,word")))
    pairs = np.concatenate(pairs)
    known, place = np.unique(pairs["word"], return_inverse=True)
    n, bad, size, all_bad = np.bincount(place), np.bincount(place, y[pairs["who"]], len(known)), (~held).sum(), y[~held].sum()
    g = np.zeros(len(known))
    for seen, row, column in ((bad, n, all_bad), (n - bad, n, size - all_bad), (all_bad - bad, size - n, all_bad), (size - n - all_bad + bad, size - n, size - all_bad)):
        g += 2 * seen * np.log(np.maximum(seen, 1e-12) * size / np.maximum(row * column, 1e-12))
    known = known[(g >= p.surprise) & (n >= 5) & (bad * size > n * all_bad)]
    x = np.zeros((len(y), len(known)))
    for i, _, texts in runs:
        who, at = _present(texts, known)
        x[who + i, at] = 1
    w, m, s = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    x1 = np.concatenate([x, np.ones((len(y), 1))], axis=1)
    for t in range(1, 5 * p.steps + 1):  # Adam on the full sample
        r = (1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40))) - y) * ~held / size
        d = r @ x1 + p.decay * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * d, 0.99 * s + 0.01 * d * d
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    slope, shift = _platt((x1 @ w)[held], y[held])
    return Toxic(known, w[:-1], float(w[-1]), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The two calibration numbers by Newton's method with step halving, on Platt's softened targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, t = np.stack([z, np.ones_like(z)], 1), np.array([0.0, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))])
    loss = lambda t: float((np.logaddexp(0, x @ t) - target * (x @ t)).sum())
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        g = x.T @ (q - target)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-9 * np.eye(2), g)
        size = 1.0
        while size > 1e-8 and loss(t - size * step) > loss(t) - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-8 or np.abs(g).max() < 1e-6:
            break
        t = t - size * step
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def _lines(texts: Texts, words: Words) -> np.ndarray:
    """Per text: lines with a word that are equal to an earlier line."""
    data, n = texts.data, len(texts.data)
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([texts.bounds[:-1], cut + 1]))
    owner = np.searchsorted(texts.bounds[1:], starts, "right")
    ok = (owner < len(texts)) & (starts <= n)
    starts, owner = starts[ok], owner[ok]
    keep = np.ones(len(starts), bool)
    keep[1:] = starts[1:] != starts[:-1]
    starts, owner = starts[keep], owner[keep]
    ends = np.minimum(np.append(np.append(cut, n), n)[np.searchsorted(cut, starts)], texts.bounds[owner + 1])
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[has], ends[has], owner[has]
    _, before = repeats(own(span_hashes(data, starts, ends), owner))
    return np.bincount(owner[before], minlength=len(texts))


def quality(docs: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics, the model's calibrated probability and the verdict for every document.

    Words are runs of characters other than the six ASCII spaces. Base rules: fewer than 50
    words, or more than half of the words inside three-word windows that come twice or more,
    fail. Others are kept where the probability of good quality is ``keep_at`` or more.
    ``toxic`` is a verdict of its own: ``kept`` judges quality, and ``kept_documents`` asks for both.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality_probability, toxic_probability, toxic``, one row per input row.
    A null text has no words and fails. Repeated rows and rows without an id are judged like
    others; where labels or texts of an id differ, the least label and text are fitted on. A
    probability equal to its threshold counts as reaching it. Bytes that are no UTF-8 are read
    as U+FFFD; texts of any length are scored whole. An empty table gives an empty result;
    further columns are not read. Texts are scored in Arrow batches with weights of fixed
    size; nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, p, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, failed, good, toxic in _judged(batch.column(1), *model.value, p):
                columns = [batch.column(0).slice(i, j - i), *(pa.array(v, pa.int64()) for v in values), pa.array(failed), pa.array(~failed & (good >= p.keep_at)), pa.array(good), pa.array(toxic), pa.array(toxic >= p.toxic_at)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability", "toxic_probability", "toxic"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(slim, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double, toxic_probability double, toxic boolean")


def kept_documents(docs: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps and does not call toxic, with all their columns; judged where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, p, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, failed, good, toxic in _judged(batch.column(place), *model.value, p):
                yield batch.slice(i, j - i).filter(pa.array(~failed & (good >= p.keep_at) & (toxic < p.toxic_at)))

    return mapped(docs, run, docs.schema)


def _judged(column: pa.Array, model: Model, toxic: Toxic, p: Quality) -> Iterator[tuple]:
    """Runs of texts: first, end, the five statistics, base verdict, probabilities of good quality and of a toxic text."""
    for i, j, texts in texts_of(column, 1 << 18):  # n-grams of characters take some sixty bytes a byte
        texts = decodable(texts)
        words = words_of(texts)
        inside = np.concatenate([[0], np.cumsum(((texts.data & 0xC0) != 0x80) & TEXT_WORD[texts.data])])
        at, grams = words.windows(3)
        again, _ = repeats(own(grams, words.owner[at]))
        repeated = sums(covered(at[again], 3, len(words)), words.bounds)
        counts = words.counts
        failed = (counts < 50) | (100 * repeated > 50 * counts)
        values = [counts, inside[texts.bounds[1:]] - inside[texts.bounds[:-1]], sums(_SYMBOLS[texts.data], texts.bounds), _lines(texts, words), repeated]
        yield i, j, values, failed, _scores(texts, words, model, p), _toxicity(texts, toxic)
