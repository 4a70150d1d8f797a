"""Every registered operator on odd tables: nulls, repeats, ties, long and broken texts, clashing columns, no rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import ITEM, WORD, brute_base, brute_components, brute_contamination, brute_substring, lower, passage

from helixframe.llm import collocations, queries
from helixframe.llm.encoding import Encoder, vocabulary_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tag int, kept string, key string, _doc string, component string, _c0 string"
QUERIES = [f"op{n}" for n in range(1, 14)] + ["pipeline"]


def query(name):
    found = queries.queries()
    return found[next(q for q in found if q.split("_")[0] == name)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(41)
    base, shared = passage(rng, 150), passage(rng, 60)
    long = passage(rng, 200_000)
    assert len(long) > 1_000_000
    near = base.split()
    near[70] = "other"
    texts = [base, base, " ".join(near), shared + "\n" + passage(rng, 80), passage(rng, 70) + " " + shared, long, long + " end", "", " \n\t", None, "one", "one", "Tie tie", "tie TIE", "<|im_end|> \x1c x", passage(rng, 90) + " " + " ".join(base.split()[20:35])]
    out = [(3 * i, t) for i, t in enumerate(texts)]
    return out + [(0, base), (3 * len(texts), base), (None, base), (None, None)]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """A folder of tables like the driver's, one more row with bytes that are no UTF-8, and columns with clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(i, t, "x", "s", None if t is None else len(t), 1, "k", None, "d", "c", "z") for i, t in rows], DOCUMENTS)
    broken = docs.limit(1).withColumns({"doc_id": F.lit(999).cast("long"), "text": F.expr("CAST(unhex('61FF6220') AS STRING)"), "n_chars": F.lit(4).cast("long")})
    docs.unionByName(broken).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(k % 3 > 0), int(k % 5 == 0)) for k, (i, _) in enumerate(rows)] + [(0, 0, 0), (0, None, None), (777, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    passages = " ".join(rows[0][1].split()[40:60])
    bench = [(1, passages), (1, passages), (2, "Tie tie"), (2, "one"), (None, rows[4][1]), (4, None), (5, " .,"), (10, passages)]
    spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, text_id string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "http://a℀b/", "<p>x", "t", "c"), (1, "http://a℀b/", "<p>x", "t", "c"), (2, None, None, None, None), (None, "http://[x", "<![if", "t", "c"), (3, "http://y.org/", "<b>" + "w " * 500_000, "t", "c")]
    spark.createDataFrame(pages, "page_id long, url string, html string, type string, content string").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", "a", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (2, 0, None, "<|im_start|>", "x"), (None, 0, "assistant", "z", "x"), (3, None, "assistant", "y" * 1_000_000, "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder), bench


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def collected(spark, name, tables):
    return query(name)(spark, tables[0]).collect()


def whole(rows):
    """Documents as the operators see them, the broken one with its replacement character."""
    return [*rows, (999, "a�b ")]


@pytest.mark.parametrize("name", QUERIES)
def test_no_rows(spark, empty, name):
    assert query(name)(spark, empty).count() == (1 if name == "op9" else 0)  # the fixed conversation


@pytest.fixture(autouse=True)
def settings_stay(spark):
    """No query leaves a setting of the session changed."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    yield
    assert [spark.conf.get(k) for k in keys] == before


def test_op1(spark, rows, tables):
    out = query("op1")(spark, tables[0])
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = out.collect()
    want = Counter((i, *brute_base(t)) for i, t in whole(rows))
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert sorted(map(str, query("op1")(spark, tables[0]).collect())) == sorted(map(str, got))  # clashing labels are settled the same way


def _ids(name, texts):
    known = Encoder(vocabulary_path(name)).tokenizer
    return [known.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_op2(spark, rows, tables):
    want = defaultdict(list)
    for (i, t), ids in zip(whole(rows), _ids("byte_bpe_50k.json", [t for _, t in whole(rows)]), strict=True):
        want[i].append([*ids, 1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in collected(spark, "op2", tables):
        assert list(r.asDict()) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        ids = next(x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(r["length"])
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    for i, lists in want.items():
        for ids in {tuple(x) for x in lists}:
            found = {s: n for (d, k, s), n in pieces.items() if d == i and k == len(ids)}
            assert sum(map(sum, found.values())) == sum(len(x) for x in lists if len(x) == len(ids))


def test_op3(spark, rows, tables):
    total = Counter()
    for r in collected(spark, "op3", tables):
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for (i, _), ids in zip(whole(rows), _ids("byte_bpe_50k.json", [t for _, t in whole(rows)]), strict=True):
        want[i] += len(ids)
    assert total == want


def test_op4(spark, tables):
    got = collected(spark, "op4", tables)
    assert Counter(r["type"] for r in got) == {"response": 5, "metadata": 5, "conversion": 5}
    ids = {r["record_id"] for r in got}
    assert all(r["refers_to"] in ids for r in got if r["type"] != "response")
    assert max(len(r["content"]) for r in got if r["type"] == "conversion") == 999_999


def test_op5(spark, rows, tables):
    bench = [(None if i is None else i, t) for i, t in tables[1]]
    texts = [*rows, (999, "a\xffb")]
    want = Counter((i, *w, w[1] > 0) for (i, _), w in zip(texts, brute_contamination([t for _, t in texts], bench), strict=True))
    assert Counter(tuple(r) for r in collected(spark, "op5", tables)) == want


def test_op6(spark, rows, tables):
    got = Counter(tuple(r) for r in collected(spark, "op6", tables) if r["doc_id"] != 999)
    named = sorted(((i, t) for i, t in {(i, t) for i, t in rows if i is not None}), key=lambda x: x[0])
    by = {i: w for (i, _), w in zip(named, brute_substring([t for _, t in named]), strict=True)}
    want = Counter()
    for i, t in rows:
        want[(i, *(brute_substring([t])[0] if i is None else by[i]))] += 1
    assert got == want


def test_op7(spark, rows, tables):
    texts = [t for _, t in whole(rows)]
    lists = defaultdict(list)
    for (i, _), ids in zip(whole(rows), _ids("word_bpe_49k.json", texts), strict=True):
        lists[i].append([*ids, 1])
    got = sorted(map(tuple, collected(spark, "op7", tables)), key=lambda r: r[1])
    at = 0
    for i, start, n, crc in got:
        assert start == at
        at += n
        match = next(x for x in lists[i] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        lists[i].remove(match)
    assert not any(lists.values()) and [r[0] is None for r in got] == sorted((r[0] is None for r in got), reverse=True)
    ids = [r[0] for r in got if r[0] is not None]
    assert ids == sorted(ids)


def test_op8(spark, rows, tables):
    named = [(i, t) for i, t in rows if i is not None]
    sets, low = brute_components([t for _, t in named])
    ids = [i for i, _ in named]
    want = Counter((i, len(s), min(ids[k] for k in range(len(ids)) if low[k] == c)) for i, s, c in zip(ids, sets, low, strict=True))
    got = [r for r in collected(spark, "op8", tables) if r["doc_id"] != 999]
    assert Counter(tuple(r)[:3] for r in got if r["doc_id"] is not None) == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_op9(spark, tables):
    got = {r["conv_id"]: r for r in collected(spark, "op9", tables)}
    assert {k: r["n_turns"] for k, r in got.items()} == {-1: 2, 1: 3, 2: 1, 3: 1, None: 1}
    control = queries.CONTROL_TEXT
    assert got[-1]["loss_sha256"] == hashlib.sha256(control.encode()).hexdigest() and got[-1]["loss_chars"] == len(control)
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{control}\nassistant\n{control}\n".encode()).hexdigest()
    assert got[3]["loss_chars"] == 1_000_000 and got[2]["loss_chars"] == 0


def _shard(key, n):
    """The winner of weighted rendezvous hashing, by another implementation of the hash."""

    def score(i):
        h = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)
        return -1 / math.log(((h >> 11) + 0.5) / (1 << 53))

    return max(range(n), key=lambda i: (score(i), i))


def test_op10(spark, rows, tables):
    slots = defaultdict(list)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").encode())
    texts[999] = [b"a\xffb "]
    for r in collected(spark, "op10", tables):
        assert list(r.asDict()) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert (r["size"], r["text_crc32"]) in [(len(b) + 8, zlib.crc32(b)) for b in texts[r["doc_id"]]]
        assert (r["law"], r["shard"], r["grown_shard"]) == ("key", _shard(r["doc_id"], 24), _shard(r["doc_id"], 25))
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(rows) + 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op11(spark, rows, tables):
    from test_new import brute_collocations

    want = brute_collocations([("x", t) for _, t in whole(rows)], collocations.Collocations())
    assert sorted(map(tuple, collected(spark, "op11", tables))) == want


def test_op12(spark, rows, tables):
    from test_new import brute_audit

    labels = [tuple(r) for r in spark.read.parquet(f"{tables[0]}/labels.parquet").collect()]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in collected(spark, "op12", tables)}
    assert got == brute_audit([(i, t, "s") for i, t in whole(rows)], labels)


def test_op13(spark, rows, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in whole(rows):
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, collected(spark, "op13", tables))) == want


def test_pipeline(spark, rows, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables[0])
        assert after.dtypes == docs.dtypes, name
        assert after.count() <= docs.count()
    out = collected(spark, "pipeline", tables)
    assert all(WORD.search(dict(rows)[r["doc_id"]]) and ITEM.search(dict(rows)[r["doc_id"]].translate(lower)) for r in out)


def test_each_stage_on_all_odd_rows(spark, rows, tables):
    """Near-duplicates, repeated passages and benchmark passages on the whole odd table, not only on what quality keeps."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    near = Counter(r[0] for r in stages["MinHash near-dedup"](spark, docs, tables[0]).select("doc_id").collect())
    assert near[None] == 2 and near[0] == 2 and not near[3] and not near[48] and near[27] == 1  # a row without an id stays, and so does a null text
    passages = {(r[0], r[1]): r for r in stages["substring dedup"](spark, docs.filter("doc_id <> 999"), tables[0]).collect()}
    left = {i for i, _ in passages}
    assert not left & {3, 48} and {0, 27} <= left
    assert all(r["n_chars"] == len(r["text"]) and r["_c0"] == "z" for r in passages.values() if r["text"])
    clean = {r[0] for r in stages["benchmark decontamination"](spark, docs, tables[0]).select("doc_id").collect()}
    assert not clean & {0, 3, 12, 30, 36} and {21, 24, 27, 999} <= clean


def test_capitals_with_marks(spark, tmp_path):
    """A capital and a mark compose before the capital becomes small: ids of op7 equal the library's for every such pair."""
    from helixframe.llm import queries as q

    marks = [chr(c) for c in (*range(0x300, 0x370), 0x591, 0x20D0, 0x1AB0)]
    texts = [f"{chr(c)}{m}" for c in range(65, 91) for m in marks] + ["a T̈ b", "aT̈̆c J̌ Ĥ", "T֑̈ x", "Ẅ̇", "Éa İ Iı", "TИ T恤 É"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())) for i, ids in enumerate(_ids("word_bpe_49k.json", texts))}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in q.op7_packed_ids(spark, str(tmp_path)).collect()} == want
