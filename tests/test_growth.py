"""Queries at values and sizes that larger tables have."""

from __future__ import annotations

import random

import random

import pandas as pd
import pytest
import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from helixframe.operators import graphs, similarity
from helixframe.operators import graphs, similarity
from helixframe.plans.catalogue import ORACLES, QUERIES


def test_training_matrices_keep_stored_zeros(spark, tmp_path):
    d = str(tmp_path)
    pd.DataFrame({"c_custkey": [0, 1, 2, 3], "c_nationkey": pd.Series([1, 0, 1, 2], dtype="int32"), "c_acctbal": [5.5, 0.0, -1.25, -0.0]}).to_parquet(f"{d}/customer.parquet")
    pd.DataFrame({"n_nationkey": pd.Series([0, 1, 2], dtype="int32"), "n_name": ["a", "b", "c"]}).to_parquet(f"{d}/nation.parquet")
    ours = QUERIES["training_matrices"](spark, d).toPandas()
    assert rows(ours) == rows(duck(d).sql(ORACLES["training_matrices"]).df()) and len(ours) == 4


def hyperedges(spark, seed):
    """Random edges, some nodes in the same ones, one edge repeated; as a table and as sets."""
    r = random.Random(seed)
    edges = {f"e{i}": {r.randrange(30) for _ in range(r.randrange(1, 9))} for i in range(12)}
    edges["big"] = set(range(20, 60))
    return spark.createDataFrame([(k, sorted(v), float(i)) for i, (k, v) in enumerate(edges.items())], "edge_id string, participants array<int>, w double"), edges


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [2, 1024])
def test_degrees_do_not_shuffle_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "_CHUNK", chunk, raising=False)
    h, edges = hyperedges(spark, 1)
    out = graphs.co_degrees(h)
    nodes = set().union(*edges.values())
    assert dict(map(tuple, out.collect())) == {n: len(set().union(*(e for e in edges.values() if n in e))) - 1 for n in nodes}
    assert "keys=[edges" not in plan(out)  # pairs of lists were made distinct


@pytest.mark.parametrize("chunk", [2, 1024])
def test_neighbours_are_written_where_they_are_made(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "_CHUNK", chunk, raising=False)
    h, edges = hyperedges(spark, 2)
    out = graphs.co_participants(h)
    want = {(a, b) for e in edges.values() for a in e for b in e if a != b}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Generate" in (found := plan(out)) and not any(x in found[: found.index("Generate")] for x in ("Exchange", "HashAggregate"))  # nothing comes after the pairs


@pytest.mark.parametrize("chunk", [2, 1024])
def test_cliques_are_written_where_they_are_made(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "_CHUNK", chunk, raising=False)
    h, edges = hyperedges(spark, 3)
    want = {}
    for w, e in enumerate(edges.values()):
        for a, b in ((a, b) for a in e for b in e if a != b):
            want[a, b] = want.get((a, b), 0.0) + w
    out = graphs.clique_expansion(h, "w")
    assert {(r[0], r[1]): r[2] for r in out.collect()} == want and out.count() == len(want)
    assert "Generate" in (found := plan(out)) and not any(x in found[: found.index("Generate")] for x in ("Exchange", "HashAggregate"))  # nothing comes after the pairs


def hyperedges(spark, seed):
    """Random edges, some nodes in the same ones, one edge repeated; as a table and as sets."""
    r = random.Random(seed)
    edges = {f"e{i}": {r.randrange(30) for _ in range(r.randrange(1, 9))} for i in range(12)}
    edges["big"] = set(range(20, 60))
    return spark.createDataFrame([(k, sorted(v), float(i)) for i, (k, v) in enumerate(edges.items())], "edge_id string, participants array<int>, w double"), edges


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [2, 1024])
def test_degrees_do_not_shuffle_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "_CHUNK", chunk, raising=False)
    h, edges = hyperedges(spark, 1)
    out = graphs.co_degrees(h)
    nodes = set().union(*edges.values())
    assert dict(map(tuple, out.collect())) == {n: len(set().union(*(e for e in edges.values() if n in e))) - 1 for n in nodes}
    assert "keys=[edges" not in plan(out)  # pairs of lists were made distinct


@pytest.mark.parametrize("chunk", [2, 1024])
def test_neighbours_are_written_where_they_are_made(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "_CHUNK", chunk, raising=False)
    h, edges = hyperedges(spark, 2)
    out = graphs.co_participants(h)
    want = {(a, b) for e in edges.values() for a in e for b in e if a != b}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Generate" in (found := plan(out)) and not any(x in found[: found.index("Generate")] for x in ("Exchange", "HashAggregate"))  # nothing comes after the pairs


@pytest.mark.parametrize("chunk", [2, 1024])
def test_cliques_are_written_where_they_are_made(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "_CHUNK", chunk, raising=False)
    h, edges = hyperedges(spark, 3)
    want = {}
    for w, e in enumerate(edges.values()):
        for a, b in ((a, b) for a in e for b in e if a != b):
            want[a, b] = want.get((a, b), 0.0) + w
    out = graphs.clique_expansion(h, "w")
    assert {(r[0], r[1]): r[2] for r in out.collect()} == want and out.count() == len(want)
    assert "Generate" in (found := plan(out)) and not any(x in found[: found.index("Generate")] for x in ("Exchange", "HashAggregate"))  # nothing comes after the pairs


@pytest.mark.parametrize("k", [1, 3])
def test_strongest_edges_of_equal_sets(spark, k):
    """The same as from all pairs; 30,000 equal sets, of 900 million pairs, are a row and k each."""
    r = random.Random(4)
    kinds = [sorted({r.randrange(12) for _ in range(r.randrange(1, 5))}) for _ in range(25)]
    table = spark.createDataFrame([(f"s{i:02}", t) for i in range(60) for t in kinds[r.randrange(25)]], "gene string, term int")
    want = similarity.strongest(similarity.project(table, "jaccard", 0.1, "gene", "term"), k)
    assert sorted(map(tuple, similarity.annotation_graph(table, k=k).select("source", "target", "weight").collect())) == sorted(map(tuple, want.select("source", "target", "weight").collect()))
    many = spark.range(30_000).select(F.col("id").alias("gene"), F.explode(F.array(F.lit(1), F.lit(2))).alias("term"))
    found = similarity.annotation_graph(many, k=k)
    assert found.count() == 30_000 * k
    assert {r[0] for r in found.filter("target = 29999").select("source").collect()} == set(range(k)) and {r[0] for r in found.filter("target = 0").select("source").collect()} == set(range(1, k + 1))


def test_annotations_of_a_shared_name_are_joined_once(spark, monkeypatch):
    from helixframe.plans import training
    from helixframe.plans.experiment import Experiment

    seen = []
    monkeypatch.setattr(training.similarity, "annotation_graph", lambda a, *_: seen.append(a) or a)
    var = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "gene long, gene_name string")
    X = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0)], "cell long, gene long, value double")
    obs = spark.createDataFrame([(1, "control"), (2, "control")], "cell long, perturbation string")
    training.graphs(Experiment(X, obs, var), spark.createDataFrame([("x", "t")] * 3 + [("y", "t")], "gene string, term string"))
    assert sorted(map(tuple, seen[0].collect())) == [(1, "t"), (2, "t"), (3, "t"), (4, "t")]


@pytest.mark.parametrize("both", [True, False])
def test_similar_pairs_are_written_where_they_are_made(spark, both):
    table = spark.createDataFrame([(s, t) for s in range(30) for t in range(s % 5 + 1)], "source int, target int")
    sets = {s: set(range(s % 5 + 1)) for s in range(30)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.45}
    out = similarity.project(table, "jaccard", 0.45, both_ways=both)
    assert sorted((r[0], r[1]) for r in out.collect()) == sorted(want | ({(b, a) for a, b in want} if both else set()))
    assert "Generate" in (found := plan(out)) and not any(x in found[: found.index("Generate")] for x in ("Exchange", "Union"))  # nothing comes after the pairs


def test_ranks_sort_packed_batches(spark):
    """What goes to the ranks are parts of batches, not cells, and each is opened to the cells it was made of."""
    import pyarrow as pa

    from helixframe.plans import training
    from helixframe.plans.experiment import Experiment

    obs = spark.range(500).withColumnRenamed("id", "cell")
    X = spark.createDataFrame([(c, g, float(c + g)) for c in range(0, 500, 2) for g in range(3)], "cell long, gene long, value double")

    def step(rank, lots):
        for lot in lots:
            yield pa.RecordBatch.from_arrays([pa.array(lot.cells, pa.int64()), pa.array(lot.values.sum(axis=1))], ["cell", "total"])

    out = training.each_rank(Experiment(X, obs, spark.range(3).select(F.col("id").alias("gene"))), step, "cell long, total double", 2, 64)
    assert dict(map(tuple, out.collect())) == {c: 3.0 * c + 3 if c % 2 == 0 else 0.0 for c in range(500)}
    assert "packed(" in plan(out).split("Exchange")[1]


@pytest.mark.parametrize("kind", ["jaccard", "overlap", "cosine"])
def test_weights_are_rounded_before_pairs_are_written(spark, tmp_path, kind):
    """Rounding costs more than all else of a row, and a pair of sets has one weight for all its rows."""
    d, name = str(tmp_path), f"set_similarity_{kind}"
    orders = [(s, f"2020-{m:02}-01", "x") for s in range(24) for m in range(1 + s % 3, 3 + s % 4)]
    table = pd.DataFrame(orders, columns=["o_custkey", "o_orderdate", "o_orderpriority"]).assign(o_orderdate=lambda x: pd.to_datetime(x["o_orderdate"]).astype("datetime64[us]"))
    table.to_parquet(f"{d}/orders.parquet")
    out = QUERIES[name](spark, d)
    assert rows(out.toPandas()) == rows(duck(d).sql(ORACLES[name]).df()) and out.count() > 24
    assert "Generate" in (found := plan(out)) and "round(" not in found[: found.index("Generate explode(_x")]


def test_lists_of_equal_sets_are_written_in_either_order(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_CHUNK", 3)
    table = spark.createDataFrame([(s, t) for s in range(40) for t in range(s % 2 + 1)], "source int, target int")
    found = list(map(tuple, similarity.project(table, "jaccard", 0.4, digits=2).collect()))
    assert sorted(found) == [(a, b, 1.0 if a % 2 == b % 2 else 0.5) for a in range(40) for b in range(40) if a != b]
    once = [(r[0], r[1]) for r in similarity.project(table, "jaccard", 0.4, both_ways=False).collect()]
    assert sorted(once) == [(a, b) for a in range(40) for b in range(40) if a < b]


def test_test_tables_read_entries_once(spark):
    """One pass over the entries, genes without a counted entry, cells without a label and small groups included."""
    from helixframe.operators import de

    r, read = random.Random(5), spark.sparkContext.accumulator(0)
    entries = [(c, g, r.choice([0.0, 1.0, 2.0, 3.0, float("nan")])) for c in range(60) for g in range(4)] + [(c, 4, r.choice([0.0, float("nan"), float("inf")])) for c in range(60)] + [(59, 5, 7.0)]
    labels = {c: None if c == 59 else "tiny" if c == 58 else "ctrl" if c % 3 == 0 else "a" if c % 3 == 1 else "b" for c in range(60)}

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    X = spark.createDataFrame(entries, "cell long, gene long, value double").mapInArrow(counted, "cell long, gene long, value double")
    obs = spark.createDataFrame(list(labels.items()), "cell long, pert string")
    out = de.differential_expression(X, obs, "pert", "ctrl").collect()
    assert read.value == len(entries)
    assert sorted((x["target"], x["feature"]) for x in out) == [(t, g) for t in "ab" for g in range(6)]
    held = {(c, g): v for c, g, v in entries if v == v and v != float("inf")}
    for x in out:
        p, q = ([held.get((c, x["feature"]), 0.0) for c in labels if labels[c] == t] for t in (x["target"], "ctrl"))
        assert x["statistic"] == sum((i > j) + 0.5 * (i == j) for i in p for j in q)


def test_files_of_many_batches_are_read_by_fewer_tasks(tmp_path, monkeypatch):
    """A task goes through a file's batches in one opening, and undoes a chunk once."""
    import numpy as np
    from pyspark.sql.types import StructType

    from helixframe.sources import h5ad, hdf5

    monkeypatch.setattr(h5ad, "_TASKS", 5, raising=False)
    undone, want = [], []
    monkeypatch.setattr(hdf5.zlib, "decompress", lambda raw, *a, f=hdf5.zlib.decompress: undone.append(1) or f(raw, *a))
    for k, n in enumerate((100, 33)):
        ends = np.arange(n + 1, dtype=np.int64) * 2
        x = {"@": {"encoding-type": "csr_matrix", "shape": np.array([n, 3])}, "data": np.arange(2.0 * n) + 1, "indices": np.arange(2 * n, dtype=np.int32) % 2, "indptr": ends}
        hdf5.save(tmp_path / f"part-{k}.h5ad", {"X": x})
        want += [(i // 2 + 100 * k, i % 2, i + 1.0) for i in range(2 * n)]
    reader = h5ad._Reader({"path": str(tmp_path), "rows": "2"}, StructType.fromDDL("cell long, gene long, value double"))
    blocks = reader.partitions()
    batches = [b for block in blocks for b in reader.read(block)]
    assert len(blocks) < 10 and len(batches) == 67 and max(b.num_rows for b in batches) == 4
    assert [(r["cell"], r["gene"], r["value"]) for b in batches for r in b.to_pylist()] == want
    assert len(undone) <= 3 * len(blocks)


def test_files_are_written_once(spark, tmp_path, monkeypatch):
    """No sort by ranges comes after the files are written, as its bounds would have all written twice."""
    from helixframe.plans.experiment import Experiment
    from helixframe.sources import h5ad

    obs = spark.range(9).select(F.col("id").alias("cell"))
    e = Experiment(obs.select("cell", F.lit(0).alias("gene"), F.lit(1.0).alias("value")), obs, spark.range(1).select(F.col("id").alias("gene")))
    plans = []
    monkeypatch.setattr(type(obs), "collect", lambda df, f=type(obs).collect: plans.append(plan(df)) or f(df))
    made = h5ad.write_h5ad(e, str(tmp_path / "w"), cells=2)
    assert [r["cells"] for r in made.collect()] == [2, 2, 2, 2, 1]
    assert any("write(" in x for x in plans) and not any("write(" in x and "rangepartitioning" in x for x in plans)


@pytest.mark.parametrize("asked", [False, True])
def test_degrees_of_sets_that_all_differ_are_counted_in_blocks(spark, monkeypatch, asked):
    """Most pairs of nodes meet, at edges of many and of few nodes; no pair is made a row."""
    r = random.Random(6)
    own = {n: {r.randrange(40) for _ in range(8)} | ({40 + n % 700} if n % 3 else set()) for n in range(3000)}
    edges = {}
    for n, found in own.items():
        for e in found:
            edges.setdefault(e, set()).add(n)
    h = spark.createDataFrame([(e, sorted(v)) for e, v in edges.items()], "edge_id int, participants array<int>")
    if hasattr(graphs, "blocks"):
        monkeypatch.setattr(graphs.blocks, "_COLUMNS", 1100)
    out = graphs.co_degrees(h, spark.range(0, 3003, 7).select(F.col("id").cast("int").alias("node")) if asked else None)
    want = {n: len(set().union(*(edges[e] for e in found))) - 1 for n, found in own.items()}
    assert dict(map(tuple, out.collect())) == ({n: want.get(n, 0) for n in range(0, 3003, 7)} if asked else want)
    assert "array_intersect" not in plan(out)


@pytest.mark.parametrize("chunk", [2, 1024])
def test_pairs_of_nodes_are_written_by_a_hash_join(spark, monkeypatch, chunk):
    """Opening lists takes ten times as long a row."""
    monkeypatch.setattr(graphs, "_CHUNK", chunk)
    h, edges = hyperedges(spark, 7)
    want = {(a, b) for e in edges.values() for a in e for b in e if a != b}
    for out in (graphs.co_participants(h), graphs.clique_expansion(h)):
        assert sorted((r[0], r[1]) for r in out.collect()) == sorted(want)
        assert "explode(_t" not in (found := plan(out)) and "ShuffledHashJoin" in found[: found.index("Exchange")]


@pytest.mark.parametrize("kind", ["jaccard", "overlap", "cosine"])
def test_sets_that_all_differ_are_counted_in_blocks(spark, monkeypatch, kind):
    """The same as by definition, pairs and the heaviest of them, some sets equal, some members rare, and no candidate is a row."""
    r = random.Random(8)
    sets = {s: {r.randrange(30) for _ in range(r.randrange(1, 9))} | ({30 + s % 500} if s % 4 else set()) for s in range(2600)}
    sets |= {s: sets[s % 40] for s in range(2600, 2700)}
    if hasattr(similarity, "blocks"):
        monkeypatch.setattr(similarity.blocks, "_COLUMNS", 1100)
        monkeypatch.setattr(similarity.blocks, "_PAIRS", 100_000)
    table = spark.createDataFrame([(s, t) for s, found in sets.items() for t in found], "source int, target int")
    form = {"jaccard": lambda c, a, b: c / (a + b - c), "overlap": lambda c, a, b: c / min(a, b), "cosine": lambda c, a, b: c / (a * b) ** 0.5}[kind]
    want = {(a, b): w for a in sets for b in sets if a < b and (w := form(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))) > 0.5}
    want |= {(b, a): w for (a, b), w in want.items()}
    out = similarity.project(table, kind, 0.5)
    found = [tuple(x) for x in out.collect()]
    assert len(found) == len(want) and dict(((a, b), w) for a, b, w in found) == pytest.approx(want, abs=1e-12)
    assert "array_intersect" not in plan(out)
    once = similarity.project(table, kind, 0.5, both_ways=False, digits=2)
    assert sorted((a, b) for a, b, _ in once.collect()) == sorted(p for p in want if p[0] < p[1])
    assert once.filter("weight <> round(weight, 2)").isEmpty()
    best = similarity.project(table, kind, 0.5, k=2)
    by = {}
    for (a, b), w in want.items():
        by.setdefault(b, []).append((-w, a))
    assert sorted((a, b) for a, b, _ in best.collect()) == sorted((a, b) for b, x in by.items() for _, a in sorted(x)[:2])


def test_weights_are_rounded_as_spark_does(spark):
    from helixframe.operators import blocks

    x = sorted({a / (b + 7) for a in range(1, 40) for b in range(a, 60)} | {(a / (b * c)) for a in range(1, 9) for b in range(1, 9) for c in range(1, 9)} | {0.1234565, 0.5, 1.0, 0.0000005, 2.5e-7})
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6) + F.lit(0.0)).collect()]
    import numpy as np

    assert blocks._round(np.array(x), 6).tolist() == want
