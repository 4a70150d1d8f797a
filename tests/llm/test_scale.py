"""Bounds that hold at any size: memory a worker keeps, rows dealt for families of unlikely pairs, ids that fit, unknown tokenizers."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from test_llm import passage

from helixframe.llm import near_dedup, packed_ids, store
from helixframe.llm.encoding import Encoder, vocabulary_path, vocabulary_size

_KEPT = """
import re
import numpy as np, pyarrow as pa
from helixframe.llm import decontaminate, near_dedup, quality, store, substring_dedup, words

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

rng = np.random.default_rng(1)
vocabulary = np.array(["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(20000)])
batch = lambda: pa.array([" ".join(rng.choice(vocabulary, n)) for n in (160_000, *[400] * 20)])
class Block: value = decontaminate._items([("1", " ".join(rng.choice(vocabulary, 50_000)))], decontaminate.Decontaminate())
model, toxic, near, sub = quality.Model(np.zeros(4 << 16, np.float32)), quality.Toxic(), near_dedup.NearDedup(), substring_dedup.SubstringDedup()

def work(column):
    for _ in quality._judged(column, model, toxic, quality.Quality()): pass
    for _ in decontaminate._judged(column, [Block], decontaminate.Decontaminate()): pass
    for _, _, texts in words.texts_of(column):
        for items in near_dedup._sets(texts, 5): near_dedup._minima(items, *near.multipliers())
        w = words.words_of(texts)
        substring_dedup.parse(w, substring_dedup._References.of(substring_dedup._NO_REFERENCES, sub), sub)

start, size = held(), 0
while size < 20_000_000:
    column = batch()
    size += column.nbytes
    work(column)
del column
store._released()
print(held() - start)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_memory_a_worker_keeps():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", _KEPT], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert float(out.stdout) < 60


def test_families_of_unlikely_pairs_are_dealt_in_proportion(spark, monkeypatch):
    """A chain of documents, each alike its neighbours enough to share buckets and too little to be linked."""
    dealt, real = [], near_dedup._dealt

    def counted(groups, p, used):
        out = real(groups, p, used)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_dealt", counted)
    words = passage(np.random.default_rng(31), 20 * 130 + 100).split()
    rows = []
    for n in (60, 120):
        df = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 100])) for i in range(n)], "doc_id long, text string")
        out = near_dedup.near_duplicates(df, near_dedup.NearDedup(block=16)).collect()
        assert all(r["kept"] for r in out)
        rows.append(dealt[0])
        dealt.clear()
    assert 60 < rows[0] and rows[1] < 2.6 * rows[0]


def test_ids_must_fit(spark):
    with pytest.raises(OverflowError):
        packed_ids.pack(np.array([70_000], np.uint32), 16)
    assert packed_ids.TokenFiles().bits == 16 and vocabulary_size(vocabulary_path("word_bpe_49k.json")) == 49_408
    assert packed_ids.TokenFiles(vocabulary=vocabulary_path("byte_bpe_50k.json")).bits == 16


def test_documents_are_read_from_files(spark, tmp_path):
    rng = np.random.default_rng(37)
    texts = {3 * i: passage(rng, int(rng.integers(1, 3000))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (0, 1 << 17):
        p = packed_ids.TokenFiles(vocabulary_size=size, files=3)
        path = str(tmp_path / f"ids{size}")
        packed_ids.write_ids(df, path, p)
        known = Encoder(p.path()).tokenizer
        got = {r["doc_id"]: list(r["ids"]) for r in packed_ids.read_documents(spark, path, [9, 60, 117, 5]).collect()}
        assert got == {k: [*known.encode(texts[k], add_special_tokens=False).ids, 1] for k in (9, 60, 117)}
    assert packed_ids.read_documents(spark, path, []).count() == 0


def test_unknown_tokenizers_encode_whole_texts(tmp_path):
    with open(vocabulary_path("byte_bpe_50k.json")) as f:
        settings = json.load(f)
    settings["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(settings, f)
    e = Encoder(path)
    texts = ["one two, three", "a b", "", "x\ny"]
    ids, bounds = e.encode(texts)
    assert e.kind is None
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId, held = "spark://somewhere:7077", "a", None

        def getCheckpointDir(self):
            return self.held

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        store.shared_folder(Session())
    Context.held = "hdfs://shared/checkpoints"  # set with sparkContext.setCheckpointDir
    assert store.shared_folder(Session()) == "hdfs://shared/checkpoints/a"


def test_written_tables_are_cleared(spark):
    df = store.written(spark.range(3), "cleared")
    assert df.count() == 3
    store.cleared(spark)
    assert not os.path.exists(df.written_to.removeprefix("file:"))
