"""Training-data operators against brute force, round trips, and held-out labels."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, decontaminate, near_dedup, packed_ids, packing, quality, sharding, store, substring_dedup, token_counts, warc
from helixframe.llm.encoding import Encoder, vocabulary_path
from helixframe.llm.words import texts_of, words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EMPTY = hashlib.sha256(b"").hexdigest()
DOCS = "doc_id long, text string, lang string, kept string, key string, digest string"
lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def passage(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéü"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats in a text, ties, and odd texts."""
    rng = np.random.default_rng(7)
    base, shared = passage(rng, 120), passage(rng, 30)
    words = base.split()
    out = [base, base, base.upper(), " ".join(words[:-4] + ["new"] * 4), " ".join(["x"] * 3 + words[3:]), passage(rng, 40) + " " + shared + " " + passage(rng, 10), shared + "\n" + passage(rng, 60), passage(rng, 25) + " " + " ".join(words[10:31])]
    out += [shared + " " + shared, "a b c", "a b c", "one", "one", "", " \n\t ", None, None, "ab " * 400, "é" * 30, "<|endoftext|> \x1c  x y", passage(rng, 3000)]
    chain = passage(rng, 60).split()  # each like the next, the ends not like each other
    out += [" ".join(chain[2 * k :] + [f"t{j}" for j in range(2 * k)]) for k in range(8)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "x", "clash", None, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Repeated rows and rows without an id."""
    rows = [(1, texts[0], None, None, None, None)] * 2 + [(None, texts[0], None, None, None, None), (None, None, None, None, None, None), (5, "a b", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text, n=2):
    w = WORD.findall((text or "").translate(lower))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n=2):
    sets = [shingles(t, n) for t in texts]
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if c and 100 * c >= 80 * len(sets[i] | sets[j]) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return sets, low


def brute_substring(texts, n=20):
    words = [WORD.findall(t or "") for t in texts]
    seen, out = set(), []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                gone[i : i + n] = [True] * n
            seen.add(g)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, d in zip(w, gone, strict=True) if not d).encode()).hexdigest()))
    return out


def test_near_duplicates(docs, texts):
    sets, low = brute_components(texts)
    for p in (near_dedup.NearDedup(), near_dedup.NearDedup(block=2)):
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, p).collect()}
        assert len(got) == len(texts)
        for i in range(len(texts)):
            r = got[i * 3]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), low[i] * 3, low[i] == i)


def test_near_duplicates_of_odd_rows(spark, odd):
    out = [tuple(r) for r in near_dedup.near_duplicates(odd).collect()]
    assert len(out) == 5 and sum(r[3] for r in out) == 5
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_residual_search_finds_links_between_components(spark):
    rng = np.random.default_rng(3)
    base = passage(rng, 100).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(100, 6, replace=False):
            w[k] = f"w{i}_{k}"
        rows.append(" ".join(w))
    _, low = brute_components(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, near_dedup.NearDedup(block=16)).collect()}
    assert got == dict(enumerate(low))


def test_substring_duplicates(docs, texts):
    want = brute_substring(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_duplicates(docs).collect()}
    assert got == {i * 3: w for i, w in enumerate(want)}
    kept = {r["doc_id"]: r for r in substring_dedup.without_duplicate_spans(docs).collect()}
    for i, (n, removed, digest) in enumerate(want):
        if removed == n and n:
            assert i * 3 not in kept
        elif removed:
            assert hashlib.sha256(kept[i * 3]["text"].encode()).hexdigest() == digest and kept[i * 3]["kept"] == "clash"
        else:
            assert kept[i * 3]["text"] == texts[i]


@pytest.mark.parametrize("block", [256, 24])
def test_substring_spans_are_factors(docs, texts, block):
    words = {i * 3: WORD.findall(t or "") for i, t in enumerate(texts)}
    spans = substring_dedup.duplicate_spans(docs, substring_dedup.SubstringDedup(block=block)).collect()
    want = {i * 3: w[1] for i, w in enumerate(brute_substring(texts))}
    covered = defaultdict(list)
    for s in spans:
        text, source = words[s["doc_id"]], words[s["source"]]
        i, j, n = s["start"], s["source_start"], s["length"]
        assert n >= 20 and (s["source"], j) < (s["doc_id"], i) and text[i : i + n] == source[j : j + n]
        # as long as can be: the words differ behind it, or a text ends, or the blocks that were sent do
        ends = s["source"] != s["doc_id"] and (j + n) % block == 19
        assert ends or i + n == len(text) or j + n == len(source) or text[i + n] != source[j + n]
        covered[s["doc_id"]].append(range(i, i + n))
    for d, n in want.items():
        assert len(set().union(*covered[d])) == n
        for k in range(len(covered[d])):  # each factor counts
            assert len(set().union(*(r for j, r in enumerate(covered[d]) if j != k))) < n
    whole = {s["doc_id"]: s for s in spans if s["length"] == len(words[s["doc_id"]])}
    assert block < 256 or tuple(whole[3])[1:] == (0, 120, 0, 0)  # a whole copy is one factor


def test_substring_of_one_id_and_two_texts(spark):
    rng = np.random.default_rng(23)
    a, b = passage(rng, 60), passage(rng, 400)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, passage(rng, 5) + " " + " ".join(b.split()[350:390])), (4, b), (4, a + " x")]
    out = substring_dedup.substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in out.collect()) == [(1, 60, 0), (1, 400, 0), (1, 400, 0), (2, 60, 60), (3, 45, 40), (4, 61, 60), (4, 400, 400)]


def test_substring_keeps_clashing_columns(spark, texts):
    rows = [(i, t, i, "x", 7, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc int, tag string, source int, _c0 string")
    kept = substring_dedup.without_duplicate_spans(docs)
    assert kept.dtypes == docs.dtypes
    for r in kept.collect():
        assert (r["_doc"], r["tag"], r["source"], r["_c0"]) == (r["doc_id"], "x", 7, "r")


def test_parse_takes_the_longest_match(spark):
    rng = np.random.default_rng(29)
    w = passage(rng, 200).split()
    rows = [" ".join(w[:30]), " ".join(w[10:80]), " ".join(w[5:75]), " ".join((w[60:100] + w[0:70]) * 2)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.duplicate_spans(df).collect())
    assert got[:2] == [(1, 0, 20, 0, 10), (2, 0, 25, 0, 5)] or got[0] == (1, 0, 20, 0, 10)
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_duplicates(df).collect()} == {(i, x[1]) for i, x in enumerate(brute_substring(rows))}
    assert (3, 110, 110, 3, 0) in got  # the second half is one factor of the text itself


def test_substring_of_odd_rows(odd):
    out = sorted((r["n_words"], r["n_removed"]) for r in substring_dedup.substring_duplicates(odd).collect())
    assert out == [(0, 0), (2, 0), (120, 0), (120, 0), (120, 0)]
    assert substring_dedup.substring_duplicates(odd.limit(0)).count() == 0


def brute_contamination(texts, items, n=10):
    windows = defaultdict(set)
    for item, t in items:
        w = ITEM.findall((t or "").translate(lower))
        k = min(len(w), n)
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    for t in texts:
        w = ITEM.findall((t or "").translate(lower))
        hit, found = set(), set()
        for k in {len(g) for g in windows}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[g]
        yield len(w), len(hit), len(found - {None}), hashlib.sha256(",".join(sorted(str(x) for x in found - {None})).encode()).hexdigest()


@pytest.mark.parametrize("p", [decontaminate.Decontaminate(), decontaminate.Decontaminate(shard_mb=0, block_bytes=900), decontaminate.Decontaminate(block_bytes=300, at_once=2)])
def test_contamination(spark, docs, texts, p):
    w = texts[5].split()
    items = [(1, " ".join(w[5:30])), (2, "A, b-C!"), (10, texts[6].upper()), (3, ""), (4, None), (None, " ".join(w[50:65])), (9, "zz " * 4), (11, "ab " * 12), (12, " ".join(w[5:30])), (2, "c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in decontaminate.contamination(docs, bench, p).collect()}
    assert got == {i * 3: r for i, r in enumerate(brute_contamination(texts, items))}
    kept = {r["doc_id"] for r in decontaminate.decontaminated(docs, bench, p).collect()}
    assert kept == {d for d, r in got.items() if not r[1]}


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40))), (2, "none here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "zz " + " ".join(f"w{i}" for i in range(5, 25)) + " yy")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()] == [(1, 5, "7", 1, 20)]


def test_contamination_of_empty_tables(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.contamination(odd, bench).collect()] == [False] * 5
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 300)
    at = np.flatnonzero(x)
    key = lambda i: tuple(x[i : i + next(k for k in range(301) if i + k == 300 or x[i + k] == 0)])
    keys = [key(i) for i in decontaminate.suffix_array(x, at)]
    assert keys == sorted(keys)


def brute_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    spots = defaultdict(list)
    for i in range(len(w) - 2):
        spots[tuple(w[i : i + 3])].append(i)
    rep = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_quality_base(spark, texts):
    more = [*texts, "a\nb\na\n\n\na", "x\ny\r\nx", "#a <b>\n#a <b>\n"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(more)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.quality(docs, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(more[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    out = quality.quality(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").filter("NOT base_failed").toPandas()
    assert ((out["quality_probability"] >= 0.5) == (out["quality"] == 1)).mean() >= 0.95
    assert out[out["quality"] == 1]["kept"].mean() >= 0.98
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


@pytest.fixture(scope="module")
def byte_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_packing(docs, byte_ids):
    p = packing.Packing(length=256)
    rows = packing.packed(docs, p).collect()
    sequences, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = byte_ids[r["doc_id"] // 3]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(seen) == len(byte_ids)
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(byte_ids[d // 3])
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256


def test_shortest_pack_first_fills_packs():
    rng = np.random.default_rng(0)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 2048, 20000), return_counts=True)), strict=True))
    patterns = packing.shortest_pack_first(histogram, 2048)
    back = defaultdict(int)
    for n, lengths in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            back[x] += n
    assert dict(back) == histogram
    total = sum(k * n for k, n in histogram.items())
    assert total / (2048 * sum(n for n, _ in patterns)) > 0.97


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 11, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5000).astype(np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == (5000 * bits + 7) // 8 and (packed_ids.unpack(data, bits, 5000) == ids).all()
    offsets = np.arange(0, 5000, packed_ids.BLOCK) * bits // 8
    for start, n in ((0, 10), (1020, 9), (3071, 1500), (4999, 1)):
        assert (packed_ids.read_range(data, offsets, bits, start, n) == ids[start : start + n]).all()


def test_token_files(spark, docs, texts, odd):
    e = Encoder(vocabulary_path("word_bpe_49k.json")).tokenizer
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = e.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i * 3, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, packed_ids.token_files(docs).collect())) == want
    wide = packed_ids.TokenFiles(vocabulary_size=1 << 17)
    assert sorted(map(tuple, packed_ids.token_files(docs, wide).collect())) == want
    assert packed_ids.token_files(odd).count() == 5 and packed_ids.token_files(odd.limit(0)).count() == 0


def test_encoder_equals_library(texts):
    rng = np.random.default_rng(3)
    alphabet = list("ab  \n\t.,'1é\x1c\x85<|>Σ") + ["<|endoftext|>", " \n", "'s ", " ", "\0"]
    many = [*texts, *("".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000))]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        e = Encoder(vocabulary_path(name), remembered=50)
        assert e.kind == ("words" if drops else "bytes")
        for lot in (many[:1500], many[1500:]):
            ids, bounds = e.encode(lot)
            for i, x in enumerate(e.tokenizer.encode_batch([t or "" for t in lot], add_special_tokens=False)):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == x.ids


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    texts = ["one\n\n\ntwo é ü\n \n x", "", None, "a\r\nb\n", "\n\n", "日本語\n\n 🙂🙂"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = Encoder(vocabulary_path("byte_bpe_50k.json")).tokenizer
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs, token_counts.TokenCounts(rule=rule)).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["start"], r["chars"], r["n_tokens"], r["n_crossing"]))
    for i, t in enumerate(texts):
        t = t or ""
        lines = t.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or not t else [])
        cuts = np.cumsum([0] + [len(x) for x in lines])
        count = [[int(cuts[k]), len(x), 0, 0] for k, x in enumerate(lines)]
        for s, n in e.encode(t, add_special_tokens=False).offsets:
            share = [max(0, min(n, cuts[k + 1]) - max(s, cuts[k])) for k in range(len(lines))]
            touched = [k for k, x in enumerate(share) if x]
            k = {"first": touched[0], "last": touched[-1], "most": int(np.argmax(share))}[rule]
            count[k][2] += 1
            count[k][3] += len(touched) > 1
        assert got[i] == [tuple(c) for c in count]


def test_field_tokens(spark):
    docs = spark.createDataFrame([(1, "a title", None, "some body")], "doc_id long, title string, lead string, body string")
    out = token_counts.section_tokens(docs, fields=["title", "lead", "body"]).orderBy("section").collect()
    e = Encoder(vocabulary_path("byte_bpe_50k.json")).tokenizer
    assert [r["field"] for r in out] == ["title", "lead", "body"] and sum(r["n_tokens"] for r in out) == len(e.encode("a title\n\nsome body", add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, token_counts.TokenCounts(rule="none"), text_col="body")


def warc_records(raw):
    """A second parser of uncompressed WARC text: header pairs and block of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        head = [tuple(x.split(": ", 1)) for x in lines]
        n = int(dict(head)["Content-Length"])
        assert first == "WARC/1.1" and raw[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        yield head, raw[end + 4 : end + 4 + n]
        at = end + 8 + n


def test_warc(spark, tmp_path):
    import glob
    import gzip

    html = "<html><head><title>T &amp; x</title><script>no</script></head><body><p>Hé &lt;b</p><a href='u'>l</a><br>z</body>"
    rows = [(1, "http://x.org/a b", html, "c"), (2, None, None, "c"), (3, "http://[bad", "<![if", "c"), (4, "http://a℀b/", "<p>y", "c"), (5, "http://[::1]:80/", "<p>x", "c"), (5, "http://[::1]:80/", "<p>x", "c"), (None, "a:b", "é" * 90_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string")
    warc.write_warc(warc.responses(pages), str(tmp_path / "r"))
    back = warc.read_warc(spark, str(tmp_path / "r"))
    assert sorted(map(str, back.collect())) == sorted(map(str, warc.responses(pages).collect()))
    out = warc.derivatives(back)
    by = {(r["page_id"], r["type"]): r for r in out.collect()}
    assert len(by) == 18 and out.count() == 21
    r, m, c = (by[1, k] for k in ("response", "metadata", "conversion"))
    assert c["content"].decode() == "Hé <b\nl\nz" and c["refers_to"] == m["refers_to"] == m["concurrent_to"] == r["record_id"] and r["refers_to"] is None
    assert c["payload_digest"] == r["payload_digest"] == warc.digest(html.encode()) and c["block_digest"] == warc.digest(c["content"])
    assert c["source_headers"] == {"content-type": "text/html; charset=utf-8", "content-length": str(len(html.encode()))}
    assert r["target_uri"] == "http://x.org/a%20b" and b"title: T & x" in m["content"] and b"source-header-content-length: " in m["content"] and by[2, "conversion"]["content"] == b""
    hosts = {k: re.search(rb"host: (.*?)\r\n", by[k, "metadata"]["content"])[1] for k in (1, 3, 4, 5)}
    assert hosts == {1: b"x.org", 3: b"", 4: b"", 5: b"::1"}
    warc.write_warc(out.coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w/part-*")))
    seen = list(warc_records(raw))
    assert len(seen) == 21
    for head, block in seen:
        assert warc.digest(block) == dict(head)["WARC-Block-Digest"]
    heads = {dict(h)["WARC-Record-ID"]: h for h, _ in seen}
    assert ("X-Source-Header", "content-type: text/html; charset=utf-8") in heads[c["record_id"]] and dict(heads[c["record_id"]])["WARC-Refers-To"] in heads
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_files_of_others(spark, tmp_path):
    import gzip
    import zlib as z

    def record(kind, rid, block, more=()):
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-05-06T07:08:09Z", "WARC-Target-URI: http://h.example/p", *more, f"Content-Length: {len(block)}"]
        return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    def http(headers, body, status="HTTP/1.1 200 OK"):
        return (status + "\r\n" + headers + "\r\n\r\n").encode() + body

    text = "<p>caf\xe9</p>"
    packed = gzip.compress(text.encode())
    chunks = b"%x\r\n%s\r\n%x;x=y\r\n%s\r\n0\r\n\r\n" % (10, packed[:10], len(packed) - 10, packed[10:])
    made = [
        record("warcinfo", "<i>", b"software: other"),
        record("response", "<a>", http("Content-Type: text/html; charset=latin-1\r\nX-Twice: 1\r\nx-twice: 2", text.encode("latin-1")), ["WARC-Payload-Digest: sha1:GIVEN"]),
        record("response", "<b>", http("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunks)),
        record("response", "<c>", http("Content-Type: image/png", b"\x89PNG", "HTTP/1.1 404 Not Found")),
        record("response", "<d>", http("Content-Type: text/plain; charset=none", b"a <b> \xff\n")),
        record("response", "<e>", b"no http"),
        record("request", "<q>", b"GET /"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(made[:2]))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(made[2:4])))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made[4:]) + b"\x1f\x8bbroken")
    assert z.crc32(b"") == 0
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 7
    by = {(r["refers_to"], r["type"]): r for r in warc.derivatives(records, with_response=False).collect()}
    assert {k: r["content"].decode() for k, r in by.items() if k[1] == "conversion"} == {("<a>", "conversion"): "café", ("<b>", "conversion"): "café", ("<d>", "conversion"): "a <b> \ufffd\n", ("<e>", "conversion"): "no http"}
    a, c = by["<a>", "metadata"], by["<c>", "metadata"]
    assert a["date"] == "2024-05-06T07:08:09Z" and a["source_headers"]["x-twice"] == "1, 2" and b"source-header-x-twice: 1, 2" in a["content"]
    assert by["<a>", "conversion"]["payload_digest"] == "sha1:GIVEN" and b"source-status: HTTP/1.1 404 Not Found" in c["content"]
    pages = spark.createDataFrame([(1, "u:", "<p>x", "2020-01-01T00:00:00Z", 404, {"Server": "s"}, "<given>"), (2, "u:", None, None, None, None, None)], "page_id long, url string, html string, date string, status int, headers map<string,string>, record_id string")
    r1, r2 = warc.responses(pages).orderBy("page_id").collect()
    assert r1["record_id"] == "<given>" and r1["date"][:4] == "2020" and r1["content"].startswith(b"HTTP/1.1 404") and r1["source_headers"]["server"] == "s"
    assert r2["date"] == warc.Warc().date and r2["content"].startswith(b"HTTP/1.1 200 OK")


def test_warc_of_any_bytes():
    """Broken files end, raise nothing and give records that can be derived from."""
    import gzip
    import random
    import zlib

    rng = random.Random(12)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"<p>one") + gzip.compress(b" two</p>")
    made = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nX-Page-ID: 5\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"] * 3
    whole = b"".join(made)
    assert [next(iter(d["content"] for d in warc._derived(r) if d["type"] == "conversion")) for r in warc._parsed(whole)] == [b"one two"] * 3
    for length in (b"-37", b"x", b"", b"1e3", b"9" * 30, "٣".encode()):
        assert list(warc._parsed(b"WARC/1.0\r\nContent-Length: " + length + b"\r\n\r\n" + whole)) == []
    assert [r["page_id"] for x in (b"x", b"9" * 40, b"-7") for r in warc._parsed(made[0].replace(b"ID: 5", b"ID: " + x))] == [None, None, -7]
    noise = [b"\r\n", b"\r\n\r\n", b":", b"-1", b"WARC/1.0", b"Content-Length: 5", b"charset=undefined", b"charset=idna", b"br", b"deflate", b"Transfer-Encoding: chunked", b"\x1f\x8b", b"\xff", b"http://[", b"<", b"0"]
    for _ in range(10_000):
        data = bytearray(whole if rng.random() < 0.5 else made[0])
        for _ in range(rng.randint(1, 6)):
            i, part = rng.randrange(len(data)), rng.choice(noise)
            data[i : i + rng.choice([0, len(part), 40])] = part
        found = [r for m in warc._members(gzip.compress(bytes(data))[: rng.choice([1 << 20, 90])]) for r in warc._parsed(m)]
        assert len(found) <= 6
        warc._rows(x for r in found for x in (r, *warc._derived(r)))
    text = "é<b>".encode() * 40
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(text) + raw.flush()
    zeros = gzip.compress(b"\0" * 3_000_000)
    for coding, payload, want in (
        ("br", text, None), ("gzip, br", text, None), ("gzip", gzip.compress(text)[:-9], None), ("gzip", zeros, None), ("gzip", text, text), ("deflate", zlib.compress(text), text), ("deflate", raw, text),
        ("gzip, deflate", zlib.compress(gzip.compress(text)), text), ("identity", text, text), ("x-gzip", gzip.compress(text) + gzip.compress(b"!") + b"\0" * 9, text + b"!"), ("deflate", b"no", None),
    ):
        got = warc.readable({"content-encoding": coding}, payload, 1 << 20)
        assert got == (None if want is None else want.decode()), coding


NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x", "", None, "a<", "|b", "\n", "é<|nl|>é", "<<|im_start|>"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", None, "assis\ntant", "system<|", "assistant"]
    rows = [(c, i, roles[(c + i) % len(roles)], NASTY[(3 * c + i) % len(NASTY)], "x") for c in range(12) for i in range(c)]
    rows += [(99, 0, "assistant", "again", "x")] * 2 + [(None, 0, "user", "no id", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    made = chat.examples(turns)
    want = defaultdict(list)
    for c, i, role, text, _ in rows:
        want[c].append((i, role or "", text or ""))
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(back) == set(want)
    by = defaultdict(list)
    for r in made.orderBy("example").collect():
        by[r["conv_id"]].append(r)
    for c, ts in want.items():
        ts = [t[1:] for t in ts]
        assert [tuple(t) for t in back[c]["turns"]] == ts
        assert back[c]["loss"] == "".join(t for r, t in ts if r == "assistant")
        assert back[c]["formatted_chars"] == sum(len(r["text"]) for r in by[c])
        stops = [k for k, t in enumerate(ts) if t[0] == "assistant"]
        assert [r["loss_chars"] is not None for r in by[c]] == [True] * len(stops) + [False] * (len(ts) - 1 not in stops)
        whole = by[c][-1]["text"]
        for r, k in zip(by[c], stops, strict=False):  # all turns before the reply, and the reply alone under the loss
            assert whole.startswith(r["text"]) and r["text"].count(chat.START) == k + 1 and r["text"].endswith(chat.END)
            inside = r["text"][r["loss_start"] - 1 : r["loss_start"] - 1 + r["loss_chars"]]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", inside) == ts[k][1] and r["text"].endswith(inside + chat.END)
    assert chat.examples(turns.limit(0)).count() == 0


def test_chat_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.examples(turns))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sharding(spark, docs, odd):
    out = sharding.sharded(docs, [1.0] * 5).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    many = sharding.sharded(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), [1.0] * 24).toPandas()
    moved = many[many["shard"] != many["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and abs(len(moved) / 20000 - 1 / 25) < 0.01
    assert many.groupby("shard").size().between(650, 1020).all()
    heavy = sharding.sharded(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), [1.0, 3.0, 0.0]).toPandas()
    assert abs((heavy["shard"] == 1).mean() - 0.75) < 0.02 and not (heavy["shard"] == 2).any()
    assert sharding.sharded(odd, [1.0, 1.0]).groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("x"), [0.0])


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("kept"), str(tmp_path / "s"), [1.0, 2.0], file_bytes=2000)
    files = list((tmp_path / "s").rglob("*.parquet"))
    assert len(files) > 4 and all(len(spark.read.parquet(str(f)).head(2)) for f in files)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_id_filter_keeps_all_ids(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    got = store.only_ids(df, df.filter("doc_id % 7 = 0"), "doc_id")
    assert got.columns == ["doc_id"] and got.filter("doc_id % 7 = 0").count() == 715 and got.count() < 730


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    for _, g in store.ranked(df, ["g"], ["id"], "r", 8).toPandas().groupby("g"):
        assert sorted(g["r"]) == list(range(len(g)))


def test_long_text(spark):
    rng = np.random.default_rng(5)
    text = passage(rng, 200_000)
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "short")], "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3]
    assert [r["n_removed"] for r in substring_dedup.substring_duplicates(docs).orderBy("doc_id").collect()] == [0, 200_000, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas().sort_values("doc_id")
        docs = store.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == start.columns and dict(docs.dtypes) == dict(start.dtypes), name
        after = docs.toPandas().sort_values("doc_id")
        assert set(after["doc_id"]) <= set(before["doc_id"]) and after["doc_id"].is_unique
        texts, ids = before["text"].tolist(), before["doc_id"].tolist()
        if name == "quality rules":
            assert not any(brute_base(t)[-1] for t in after["text"])
        elif name == "MinHash near-dedup":
            _, low = brute_components(texts, 5)
            assert after["doc_id"].tolist() == [d for k, d in enumerate(ids) if low[k] == k]
        elif name == "substring dedup":
            want = {d: r for d, r in zip(ids, brute_substring(texts), strict=True) if r[1] < r[0] or not r[0]}
            assert set(after["doc_id"]) == set(want)
            for d, t, n in zip(after["doc_id"], after["text"], after["n_chars"], strict=True):
                assert len(t) == n and (not want[d][1] or hashlib.sha256(t.encode()).hexdigest() == want[d][2])
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [d for d, r in zip(ids, brute_contamination(texts, items), strict=True) if not r[1]]
            assert after["doc_id"].tolist() == clean
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", ["op5_decontamination", "op6_substring_dedup", "op8_near_dedup", "op9_chat", "op11_collocations", "op12_filter_audit"])
def test_matches_sql(spark, name):
    from compare import duck, rows

    from helixframe.llm import queries

    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck(SF).sql(queries.oracle_sql()[name]).df())


def test_pipeline_near_duplicates_take_five_words(spark):
    import corpus_pipeline

    base = passage(np.random.default_rng(13), 100).split()
    spread, once = list(base), list(base)
    for k in (10, 28, 46, 64, 82):  # alike on two words (89 of 109), not on five (71 of 121)
        spread[k] = f"s{k}"
    once[50] = "o"
    rows = [" ".join(w) for w in (base, spread, once)]
    alike = lambda x, y, n: 100 * len(shingles(x, n) & shingles(y, n)) >= 80 * len(shingles(x, n) | shingles(y, n))
    assert alike(rows[0], rows[1], 2) and not alike(rows[0], rows[1], 5) and not alike(rows[1], rows[2], 5) and alike(rows[0], rows[2], 5)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == [0, 1]


def test_toxic_texts_are_found_and_dropped(spark):
    rng = np.random.default_rng(17)
    rows = [passage(rng, 80).split() for _ in range(240)]
    for k in range(0, 240, 4):  # one word in eighty, with punctuation and in capitals, in texts of good quality
        rows[k][int(rng.integers(80))] = ["vile,", "Vile", "scum.", "SCUM!"][k // 4 % 4]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert {i for i, r in out.items() if r["toxic"]} == {i for i in range(240) if i % 4 == 0}
    assert all(r["toxic"] == (r["toxic_probability"] >= 0.5) for r in out.values())
    kept = {r["doc_id"] for r in quality.kept_documents(docs, labels).collect()}
    assert kept == {i for i, r in out.items() if r["kept"] and not r["toxic"]} and any(r["kept"] and r["toxic"] for r in out.values())
    assert not any(r["toxic"] for r in quality.quality(docs, labels.drop("toxic")).collect())


@pytest.mark.parametrize(("html", "text"), [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>one</p>two</body></html>", "one\ntwo"),
    ("<head><title>T</title><style>s</style><p>one<p>two", "one\ntwo"),
    ("<head><title>T</title>one<br>two", "one\ntwo"),
    ("<head><noscript><link href=x></head><body>one</body>", "one"),
    ("<head><noscript><style>s</style><body><p>one", "one"),
    ("<body>one<noscript><img src=x><p>two</body>", "one\ntwo"),
    ("<body><noscript>one<p>two<noscript>no</noscript><p>three", "one\ntwo\nthree"),
    ("<head><noscript>no<img></noscript><script>no</script></head><body>one<svg><p>no</p></svg>two<template><b>no</b></template>", "one\ntwo"),
    ("<p>one<script>no", "one"),
])
def test_open_elements_hide_no_text(html, text):
    assert warc.plain_text(html)[0] == text


def test_plain_markup_is_read_as_the_parser_reads_it(monkeypatch):
    import random

    rng = random.Random(1)
    parts = ["<p>", "</p>", "<br>", "<br/>", "<a href='x'>", '<a href="">', "<A HREF = 'é'>", "</A >", "<title>", "</title>", "t &amp; u", " &lt;", "&", "&notit; ", "<script>", "</script>", "</SCRIPT>", "x='</p><b>'", "<style>", "</style>", "<!-- c -->", "<!-->", "<!-- a -- b -->", "<!DOCTYPE html>", "<head>", "</head>", "<body>", '<div class="a b" id=x>', "</div>", "text", "\n", "é", "<template>", "</template>", "<noscript>", '<img src="a>b">', "<p", "< p>", "</", "<li data-x='1'>", "<title/>", "</p x>", "<?php ?>", "</titlex>", "<template id=a/>", "<div class=b />", "<li data-x=1/ >", "<a href=u/>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    plain = [x for x in texts if warc._read_plainly(warc._Text(), x)]
    assert len(plain) > 3000
    quick = [warc.plain_text(x) for x in plain]
    monkeypatch.setattr(warc, "_read_plainly", lambda parser, html: False)
    assert quick == [warc.plain_text(x) for x in plain]


def _parsed(texts, refs, many, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_MANY", many)
    words = words_of(next(texts_of(pa.array(texts), 1 << 40))[2])
    p = substring_dedup.SubstringDedup()
    return substring_dedup.parse(words, substring_dedup._References.of(pa.array(refs, substring_dedup._NO_REFERENCES.type), p), p)


def test_sorted_suffixes_give_the_same_factors(monkeypatch):
    """Matches from sorted suffixes against places compared one by one, with stretches and own repeats."""
    rng = np.random.default_rng(1)
    draw = lambda n, k: " ".join(str(x) for x in rng.integers(0, k, rng.integers(0, n)))
    found = 0
    for _ in range(60):
        k = rng.choice([2, 3, 6])
        base = [draw(300, k) for _ in range(3)]
        texts = [f"{base[rng.integers(3)]} {draw(150, k)} {base[rng.integers(3)]}" for _ in range(3)]
        refs = []
        for text in base:
            hashes = words_of(next(texts_of(pa.array([text]), 1 << 40))[2]).hashes
            refs.append([{"source": s, "stag": 1, "block": b, "words": h.tobytes()} for s, b, h in ((7, 0, hashes), (9, 2, hashes[:40]))] if rng.random() < 0.7 and len(hashes) else None)
        one, two = (_parsed(texts, refs, many, monkeypatch) for many in (1 << 40, -1))
        for name in ("row", "start", "length", "stretch", "source_start"):
            assert np.array_equal(getattr(one, name), getattr(two, name))
        found += len(one.row)
    assert found > 100


def test_parse_of_many_repeats_is_near_linear(monkeypatch):
    """A phrase and another word, over and over: every repeat but the first goes, in time that grows with the text."""
    import time

    phrase = " ".join(f"w{i}" for i in range(20))
    seconds = []
    for k in (4000, 16_000):
        began = time.process_time()
        out = _parsed([" ".join(f"{phrase} x{i}" for i in range(k))], [None], 8, monkeypatch)
        seconds.append(time.process_time() - began)
        assert out.start.tolist() == [21 * i for i in range(1, k)] and set(out.length) == {20} and not out.source_start.any()
    assert seconds[1] < 10 * seconds[0] and seconds[1] < 12


def test_sampled_ids_with_many_texts(spark):
    """An id that repeats is one row for the fit, with its least text, however often it comes."""
    docs = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text")).union(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    rows = quality._samples(docs, labels, quality.Quality(), "doc_id", "text", ("quality", "toxic"))
    assert sorted((r["_label"], r["_text"]) for r in rows[0]) == [(0, ""), (0, "t0002"), (1, "t0000")] and rows[1] == []


def test_reading_documents_by_many_ids(spark, docs, tmp_path):
    packed_ids.write_ids(docs, str(tmp_path / "i"))
    every = {r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None}
    some = packed_ids.read_documents(spark, str(tmp_path / "i"), [*range(-500, 40), 10**9])
    assert {r["doc_id"] for r in some.collect()} == {i for i in every if i < 40}
    assert packed_ids.read_documents(spark, str(tmp_path / "i"), []).count() == 0
