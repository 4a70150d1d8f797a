"""Collocations, filter audit and piece encoding against brute force and the library."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from helixframe.llm import collocations as co
from helixframe.llm import filter_audit as fa
from helixframe.llm import queries
from helixframe.llm import sentence_pieces as sp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, p):
    """The contract, straight from its words: ``rows`` are language and text."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, p.longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: c for g, c in counts.items() if p.shortest <= len(g) and c >= p.least}
        inside = {h for g, c in found.items() for k in range(p.shortest, len(g)) for i in range(len(g) - k + 1) if found.get(h := g[i : i + k]) == c}
        scored = []
        for g, a in found.items():
            if g not in inside:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, g.decode(), -a, left, right, n[lang], -s) for i, (s, a, g, left, right) in enumerate(sorted(scored)[: p.top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(8)
    words = [*"abcdefgh", "É", "ß", "日本", "x\x0e", "the", "The", "#"]
    rows = [(rng.choice(["en", "en", "en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ".", "\n", ", ", "\x1c", "\x85 "]) for _ in range(rng.randint(0, 60)))) for _ in range(400)]
    rows += [("en", "one two three four five six. " * 7)] * 3 + [("en", "go go go go go go")] * 4
    return [*rows, ("en", None), ("fr", ""), (None, "Only here"), ("und", "only here"), ("en", "w " * 70_000)]


@pytest.mark.parametrize("p", [co.Collocations(least=9), co.Collocations(least=5, shard=150, batch=40, top=25), co.Collocations(shortest=3, longest=4, least=4, shard=1000)])
def test_collocations(spark, phrase_rows, p):
    docs = spark.createDataFrame([(i, lang, t, 1, "c") for i, (lang, t) in enumerate(phrase_rows)], "doc_id long, lang string, text string, n long, shard string").repartition(3)
    want = brute_collocations(phrase_rows, p)
    assert len(want) > 10
    assert sorted(map(tuple, co.collocations(docs, p).collect())) == want


def test_collocation_query(spark, phrase_rows, tmp_path):
    rows = phrase_rows * 12
    spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_collocations(rows, co.Collocations())
    assert sorted(map(tuple, queries.op11_collocations(spark, str(tmp_path)).collect())) == want and len(want) > 40


def test_collocations_across_chunks_and_batches():
    """Every place of a pair within a chunk and across its border, in one batch and in many."""
    words = np.array([0, 1] * 40 + [1, 0, 0] * 11)
    at = np.arange(len(words))
    maps = [co.Bitmaps(np.full((words == k).sum(), k), at[words == k] // co.CHUNK, (1 << at[words == k] % co.CHUNK).astype(np.uint16)) for k in (0, 1)]
    both = co.Bitmaps(*(np.concatenate([getattr(m, c) for m in maps]) for c in ("owner", "chunk", "bits")))
    a, b, made = co.Words(both).extended(both)
    want = Counter(zip(words[:-1].tolist(), words[1:].tolist(), strict=True))
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), made.counts(len(a)).tolist(), strict=True)) == want
    assert [x.tolist() for x in co._batches(both, 2, 1)] == [list(range((words == 0).sum())), list(range((words == 0).sum(), len(words)))]


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Frequencies of a large corpus: 1000 * a * n passes 64 bits, l * r too."""
    big = 4_000_000_000_000
    tables = (spark.createDataFrame([("en", big * 50)], "lang string, n long"), spark.createDataFrame([("en", "a", 1, big * 3), ("en", "b", 2, big + 7)], "lang string, word string, id long, n long"), spark.createDataFrame([("en", [1, 2], big)], "lang string, words array<long>, n long"))
    monkeypatch.setattr(co, "frequent_phrases", lambda *_: tables)
    row = co.collocations(None).collect()[0]
    assert row["score"] == 1000 * big * big * 50 // (big * 3 * (big + 7)) and row["phrase"] == "a b"


def fails(rows):
    """Sets of failing letters of ``(id, text)`` rows, straight from the contract."""
    low = {}
    for i, t in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and low[t] < i]
        out.append({c for c, x in zip("ABCDE", checks, strict=True) if x})
    return out


def brute_audit(rows, labels):
    """Every order applied to every document in turn; ``rows`` are id, text and part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = fails([r[:2] for r in rows])
    out, shapley = {}, Counter()
    for part in {p or "" for _, _, p in rows}:
        docs = [(i, f) for (i, _, p), f in zip(rows, failing, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                failed = sum(c in f for _, f in docs)
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), failed - len(gone), sum(f == {c} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(3)
    texts = ["", None, "word " * 60, "Aa " * 49, "#", *[" ".join(rng.choice(["Ab", "cd", "ef", "é", "日", f"w{rng.randint(0, 99)}", "|x", "GH"][: rng.randint(2, 8)]) for _ in range(rng.choice([3, 49, 50, 51, 80, 200]))) for _ in range(120)]]
    rows = [(rng.choice([None, rng.randint(0, 300)]) if rng.random() < 0.1 else i, rng.choice(texts), rng.choice(["a", "a", "b", None, "", "C"])) for i in range(700)]
    rows += [(5, texts[7], "a"), (5, texts[7], "a"), (5, texts[7], "b"), (-1, "x" * 2_000_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 700, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 1, "d", 7) for i, t, p in rows], "doc_id long, text string, source string, failed int, digest string, good int").repartition(4)
    got = fa.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    assert found == brute_audit(rows, labels) and len(found) == 600 * 5


def test_removal_polynomial():
    """Values between the corners and exact shares, against expectations over random sets and averages over orders."""
    rng = random.Random(1)
    counts = {m: rng.randint(0, 50) for m in range(32)}
    a = fa.removal_polynomial(counts, 5)
    x = [Fraction(rng.randint(0, 9), 9) for _ in range(5)]
    value = sum(c * np.prod([x[i] if t >> i & 1 else Fraction(1) for i in range(5)]) for t, c in enumerate(a))
    expected = sum(c * (1 - np.prod([1 - x[i] if m >> i & 1 else Fraction(1) for i in range(5)])) for m, c in counts.items())
    assert value == expected
    for i in range(5):
        assert fa.shapley(a, 5, i) == sum(Fraction(c, m.bit_count()) for m, c in counts.items() if m >> i & 1)
    assert fa.corner(a, 31) == sum(counts.values()) - counts[0] and sum(fa.shapley(a, 5, i) for i in range(5)) == fa.corner(a, 31)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.Model().file())


@pytest.fixture(scope="module")
def encoder():
    return sp.PieceEncoder(sp.Model().file(), remembered=3000)


def odd_texts(encoder):
    rng = random.Random(77)
    names, letters = list(encoder.score), "abcdefghi thenrs  .,'\"()[]{}<>|\n\t0123é漢字▁ß́​🙂\x00"
    fixed = ["", " ", "   ", "▁", "▁▁a ▁", "<s>", "<0x41>", "</s> <unk>", "the   the", " " * 100 + "the", "a" * 20_000, " " * 3001, "=-" * 3000, "퟿", "￿", "�", "the\nthe"]
    out = list(fixed)
    for _ in range(6000):
        kind, n = rng.random(), rng.randint(1, 60)
        if kind < 0.3:
            out.append("".join(rng.choice(letters) for _ in range(n)))
        elif kind < 0.7:
            out.append("".join(rng.choice(names) for _ in range(n // 4 + 1)))
        elif kind < 0.8:
            out.append("".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(n)))
        else:
            out.append("".join(rng.choice("abcdetionrs ") for _ in range(n)))
    return out


def test_pieces_equal_the_library(encoder, library):
    texts = odd_texts(encoder)
    want = library.encode(texts)
    for k in range(0, len(texts), 1500):
        part = texts[k : k + 1500]
        ids, bounds = encoder.encode(part)
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == want[k : k + 1500]
        assert encoder.decode(ids.astype(np.int64), bounds) == library.decode(want[k : k + 1500])


def test_pieces_by_merging(encoder):
    """The search against merging by definition, for pieces side by side, whole spans and without cuts."""
    rng = random.Random(4)
    names = [n for n in encoder.score if len(n) < 9]
    whole = {n: i for i, n in enumerate(encoder.names) if n in encoder.score}
    for _ in range(1500):
        a, b = rng.choice(names), rng.choice(names)
        if encoder.merged(a) == [a] and encoder.merged(b) == [b]:
            assert encoder.fits(whole[a], whole[b]) == (encoder.merged(a + b) == [a, b]), (a, b)
    for _ in range(600):
        text = "".join(rng.choice(names) for _ in range(rng.randint(1, 6)))
        assert encoder._library([text])[0] == [whole[x] for x in encoder.merged(text)]


def test_decoding_of_any_ids(spark, encoder, library):
    rng = random.Random(6)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))] for _ in range(3000)] + [[1, 2, 35], [], [0], [35], [29871], [1, 29871, 29871]]
    bounds = np.cumsum([0, *map(len, lists)])
    assert encoder.decode(np.array([i for x in lists for i in x]), bounds) == [library.decode(x) for x in lists]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists[-40:])] + [(99, None)], "doc_id long, ids array<int>")
    assert {r[0]: r[1] for r in sp.decoded(df).collect()} == {**{i: library.decode(x) for i, x in enumerate(lists[-40:])}, 99: ""}
    with pytest.raises(Exception, match="ids lie between"):
        sp.decoded(spark.createDataFrame([(1, [32000])], "doc_id long, ids array<int>")).collect()


def test_piece_query(spark, encoder, library, tmp_path):
    texts = [*odd_texts(encoder)[:200], None, "x y " * 300_000]
    spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in enumerate(library.encode([t or "" for t in texts]))}
    assert {r[0]: tuple(r)[1:] for r in queries.op13_sentence_pieces(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    back = sp.decoded(sp.encoded(docs)).filter(F.col("doc_id") < 200)
    assert {r[0]: r[1] for r in back.collect()} == {i: library.decode(library.encode(t)) for i, t in enumerate(texts[:200])}


def test_long_span_without_cuts(encoder, library):
    """A text that can be cut nowhere is searched in time linear in it."""
    rng = random.Random(2)
    text = "".join(rng.choice("etaonrishdl") for _ in range(300_000))
    assert len(encoder._pieces(sp._with_blanks(sp.joined(pa.array([text]))))[1]) == 1
    ids, _ = encoder.encode([text])
    assert ids.tolist() == library.encode(text)
