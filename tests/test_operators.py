"""Operators on small fixtures against numpy, and their rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.functions.special import student_two_sided
from helixframe.operators import de, graphs, hvg, labels, metrics, moments, preprocess, similarity, splits, vocab


def long(spark, dense):
    i, j = np.nonzero(dense)
    pdf = pd.DataFrame({"cell": i.astype("int64"), "gene": j.astype("int64"), "value": dense[i, j].astype(float)})
    return spark.createDataFrame(pdf, "cell long, gene long, value double")


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(42)
    dense = rng.integers(1, 100, (40, 12)) * (rng.random((40, 12)) < 0.4)
    dense[3] = 0
    obs = spark.createDataFrame([(i, ["ctrl", "a", "b"][i % 3], ["T", "B"][i % 2]) for i in range(40)], "cell long, pert string, cell_type string")
    return dense.astype(float), long(spark, dense), obs


def test_normalize_total(spark, counts):
    dense, X, obs = counts
    out = preprocess.normalize_total(X, obs, 100.0).groupBy("cell").agg(F.sum("value").alias("t")).toPandas()
    assert np.allclose(out["t"], 100.0) and 3 not in set(out["cell"])
    median = preprocess.normalize_total(X, obs).groupBy("cell").agg(F.sum("value").alias("t")).toPandas()
    totals = dense.sum(1)
    assert np.allclose(median["t"], np.median(totals[totals > 0]))


def test_zero_total_gives_zero(spark):
    X = spark.createDataFrame([(0, 0, 2.0), (0, 1, -2.0)], "cell long, gene long, value double")
    obs = spark.createDataFrame([(0,)], "cell long")
    assert [r["value"] for r in preprocess.normalize_total(X, obs, 10.0).collect()] == [0.0, 0.0]


def test_mean_var_counts_absent_cells(counts):
    dense, X, obs = counts
    out = moments.mean_var(X, obs).toPandas().set_index("gene").sort_index()
    assert np.allclose(out["mean"], dense.mean(0)) and np.allclose(out["variance"], dense.var(0, ddof=1))


def test_scale_dense_matches_numpy(counts):
    dense, X, obs = counts
    out = preprocess.scale(X, obs, dense=True).toPandas().pivot(index="cell", columns="gene", values="value").to_numpy()
    assert np.allclose(out, (dense - dense.mean(0)) / dense.std(0, ddof=1))


def test_scale_of_a_constant_gene_is_zero(spark):
    X = spark.createDataFrame([(0, 0, 5.0), (1, 0, 5.0)], "cell long, gene long, value double")
    assert {r["value"] for r in preprocess.scale(X, X.select("cell")).collect()} == {0.0}


def test_rank_sum_matches_average_ranks(counts):
    dense, X, obs = counts
    group = np.array([i % 3 for i in range(40)])
    out = de.rank_sum(X, obs, "pert", "ctrl").toPandas().set_index(["gene", "target"])
    for gene in range(12):
        for k, name in ((1, "a"), (2, "b")):
            a, b = dense[group == k, gene], dense[group == 0, gene]
            u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
            _, c = np.unique(np.concatenate([a, b]), return_counts=True)
            assert out.loc[(gene, name), "u"] == u and out.loc[(gene, name), "tie_sum"] == (c**3 - c).sum()
            assert 0 <= out.loc[(gene, name), "p_value"] <= 1


def test_negative_values_rank_below_zeros(spark):
    X = spark.createDataFrame([(0, 0, -1.0), (2, 0, 3.0)], "cell long, gene long, value double")
    obs = spark.createDataFrame([(0, "t"), (1, "t"), (2, "c"), (3, "c")], "cell long, pert string")
    assert de.rank_sum(X, obs, "pert", "c").first()["u"] == 0.5


def test_student_tail_known_values():
    t, df = np.array([2.0, 1.0, 0.0, 12.706204736]), np.array([10.0, 2.0, 5.0, 1.0])
    assert np.allclose(student_two_sided(t, df), [0.0733880347, 0.4226497308, 1.0, 0.05], atol=1e-8)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, None, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    out = {r["i"]: r["fdr"] for r in de.adjusted(df).collect()}
    want = {6: 0.0, 0: 0.03, 2: 0.048, 1: 0.048, 3: 0.048, 4: 0.5}
    assert out[5] is None and all(abs(out[i] - v) < 1e-12 for i, v in want.items())
    by = {r["i"]: r["fdr"] for r in de.adjusted(df, method="by").collect()}
    assert abs(by[0] - 0.03 * sum(1 / k for k in range(1, 7))) < 1e-12


def test_missing_control_label_is_control(counts):
    _, X, obs = counts
    missing = obs.withColumn("pert", F.when(F.col("pert") != "ctrl", F.col("pert")))
    a = de.differential_expression(X, missing, "pert").orderBy("target", "feature").toPandas()
    b = de.differential_expression(X, obs, "pert", "ctrl").orderBy("target", "feature").toPandas()
    assert np.allclose(a["p_value"], b["p_value"])


def test_local_quadratic_reproduces_a_parabola():
    x = np.linspace(-1, 2, 50)
    assert np.allclose(hvg.local_quadratic(x, 1 + 2 * x - 3 * x * x), 1 + 2 * x - 3 * x * x)


def test_regularized_variance_prefers_the_noisy_gene(spark):
    rng = np.random.default_rng(1)
    dense = rng.poisson(np.linspace(5, 50, 100), (200, 100)).astype(float)
    dense[:, 50] = rng.choice([0, 55], 200)
    obs = spark.range(200).withColumnRenamed("id", "cell")
    top = hvg.regularized_variance(long(spark, dense), obs, 1).filter("highly_variable").collect()
    assert [r["gene"] for r in top] == [50]


def test_vector_metrics_known_values(spark):
    one = metrics.vector_metrics(spark.createDataFrame([(0.0, 3.0), (0.0, 4.0)], "pred double, true double")).first()
    assert one["l2"] == 5.0 and one["mse"] == 12.5 and one["cosine"] == 0.0 and one["pearson"] == 0.0
    same = metrics.vector_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "pred double, true double")).first()
    assert same["r2"] == 1.0 and same["pearson"] == 0.0


def test_distribution_metrics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(40, 3)) + 1
    A, B = long(spark, a), long(spark, b)
    w = metrics.wasserstein(A, B, True).toPandas().set_index("gene")["wasserstein"]
    m = metrics.mmd(A, B, per_gene=True).toPandas().set_index("gene")["mmd"]
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2)).mean()
    grid = lambda x, q: np.quantile(x, q, method="inverted_cdf")
    q = (np.arange(120000) + 0.5) / 120000
    for g in range(3):
        assert abs(m[g] - (k(a[:, g], a[:, g]) + k(b[:, g], b[:, g]) - 2 * k(a[:, g], b[:, g]))) < 1e-9
        assert abs(w[g] - np.abs(grid(a[:, g], q) - grid(b[:, g], q)).mean()) < 1e-3


def test_spatial_metrics_of_a_constant_are_null(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "source long, target long, weight double")
    values = spark.createDataFrame([(0, 0, 2.0), (1, 0, 2.0)], "node long, variable long, value double")
    row = metrics.spatial_metrics(edges, values).first()
    assert row["morans_i"] is None and row["gearys_c"] is None


def test_deg_overlap_of_short_lists_is_null(spark):
    df = spark.createDataFrame([("a", 0.01, 0.02), ("b", 0.2, 0.3)], "feature string, p_value double, fdr double")
    out = {r["metric"]: r["value"] for r in metrics.deg_overlap(df, df, (1, 3)).collect()}
    assert out["Top1_DEG_Overlap"] == 1.0 and out["Top3_DEG_Overlap"] is None and out["P<0005_DEG_Overlap"] == 1.0


def test_confusion_matrix(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B")], "orig string, new string")
    out = {(r["orig"], r["new"]): r["value"] for r in metrics.confusion_matrix(pairs, "orig", "new").collect()}
    assert out == {("A", "A"): 0.5, ("A", "B"): 0.5, ("B", "A"): 0.0, ("B", "B"): 1.0}
    order = spark.createDataFrame([("x10",), ("x2",), ("a",)], "l string").orderBy(*metrics.label_order("l"))
    assert [r[0] for r in order.collect()] == ["a", "x2", "x10"]


def test_projection_and_sets(spark):
    ann = spark.createDataFrame([("g1", "t1"), ("g1", "t2"), ("g2", "t1"), ("g2", "t1"), ("g3", "t9")], "source string, target string")
    out = {(r["source"], r["target"]): r["weight"] for r in similarity.project(ann).collect()}
    assert out == {("g1", "g2"): 0.5, ("g2", "g1"): 0.5}
    with pytest.raises(ValueError):
        similarity.project(ann, threshold=-1)
    arrays = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"])], "x array<string>, y array<string>")
    assert [r[0] for r in arrays.select(similarity.set_similarity(F.col("x"), F.col("y"), "overlap")).collect()] == [1.0, 0.0]


def test_correlation_paths_agree(spark, counts):
    dense, X, obs = counts
    want = np.corrcoef(dense.T)
    for tile in (1024, 7):
        for r in similarity.correlation(X, obs, tile).collect():
            assert abs(r["r"] - want[r["gene_a"], r["gene_b"]]) < 1e-9


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "parent string, child string")
    assert {r["node"]: (r["level"], r["depth"]) for r in graphs.levels(edges).collect()} == {"a": (0, 0), "b": (1, 1), "c": (1, 2), "d": (2, 3)}
    assert graphs.is_acyclic(edges) and not graphs.is_acyclic(edges.union(spark.createDataFrame([("d", "a")], edges.schema)))
    with pytest.raises(ValueError):
        graphs.levels(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], edges.schema))
    below = graphs.reachable(edges, spark.createDataFrame([("b",)], "node string"))
    assert {r["other"] for r in below.collect()} == {"c", "d"}
    assert [r["node"] for r in graphs.topological_order(edges).collect()] == ["a", "b", "c", "d"]
    assert graphs.dag_stats(edges).first()["n_leaves"] == 1
    table = spark.createDataFrame([("x", "y", None), ("y", "x", 2.0), ("x", "z", 3.0)], "source string, target string, weight double")
    both = {(r["source"], r["target"]): r["weight"] for r in graphs.graph_from_table(table).collect()}
    assert both == {("x", "y"): 1.0, ("y", "x"): 2.0, ("x", "z"): 3.0, ("z", "x"): 3.0}


def test_vocabulary_policies(spark):
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "idx long, token string")
    tokens = lambda df: [r["token"] for r in df.orderBy("idx").collect()]
    assert tokens(vocab.vocabulary(v, "first")) == ["a", "b"] and tokens(vocab.vocabulary(v, "last")) == ["b", "a"] and tokens(vocab.vocabulary(v, "remove")) == ["b"]
    with pytest.raises(ValueError):
        vocab.vocabulary(v)
    other = spark.createDataFrame([(0, "b"), (1, "c")], "idx long, token string")
    first = vocab.vocabulary(v, "first")
    assert tokens(vocab.union(first, other)) == ["a", "b", "c"] and tokens(vocab.intersection(first, other)) == ["b"]
    with pytest.raises(ValueError):
        vocab.checked_gene_map(spark.createDataFrame([("x", "S"), ("x", "T")], "alias string, symbol string"), spark.createDataFrame([("S", 1), ("T", 2)], "symbol string, id int"))


def test_splits(spark):
    obs = spark.createDataFrame([(i, "AB"[i % 5 == 0]) for i in range(103)], "cell long, g string")
    out = splits.split_cells(obs).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"test": 21, "train": 82}
    per = splits.split_by_group(obs, "g", 0.25).filter("split = 'test'").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in per} == {"A": 20, "B": 5}
    assert splits.sample_cells(obs, 10).count() == 10 and splits.sample_cells(obs, 300, replace=True).count() == 300
    heavy = splits.sample_weighted(obs.withColumn("w", F.when(F.col("cell") < 5, 1000.0).otherwise(0.001)), "w", 5)
    assert {r["cell"] for r in heavy.collect()} == {0, 1, 2, 3, 4}


def test_split_perturbations_rules(spark):
    names = [f"g{i}" for i in range(10)] + ["g0+g1", "g2+g9", "g3+ctrl", "ctrl"]
    p = spark.createDataFrame([(n,) for n in names], "perturbation string")
    table = splits.split_perturbations(p.filter("perturbation <> 'ctrl'"), ["ctrl"], "simulation", val_size=0.2)
    found = {r["perturbation"]: r["split"] for r in table.collect()}
    assert len(found) == 13 and sum(found[f"g{i}"] == "train" for i in range(10)) == 7
    seen = {r["perturbation"]: r["split"] for r in splits.split_perturbations(p.filter("perturbation <> 'ctrl'"), ["ctrl"], "combo_seen", seen=2).collect()}
    trained = {g for g in (f"g{i}" for i in range(10)) if seen.get(g) == "train"}
    for combo in ("g0+g1", "g2+g9"):
        assert (seen[combo] == "test") == (len(set(combo.split("+")) & trained) == 2)
    obs = splits.split_obs(p.withColumnRenamed("perturbation", "pert"), "pert", ["ctrl"], test_size=0.5)
    assert obs.filter("pert = 'ctrl'").first()["split"] == "train"


def test_pair_controls(spark):
    obs = spark.createDataFrame([(0, "c", "T"), (1, "c", "B"), (2, "x", "T"), (3, "x", "Z"), (4, "skip", "T"), (5, None, "T")], "cell long, pert string, t string")
    out = {}
    for r in splits.pair_controls(obs, "pert", ["c"], 3, "t", ["skip"]).collect():
        out.setdefault(r["cell"], []).append(r["control_cell"])
    assert out[0] == [0] * 3 and out[2] == [0] * 3 and set(out[3]) <= {0, 1} and out[4] == [None] * 3 and out[5] == [None] * 3


def test_labels(spark):
    obs = spark.createDataFrame([("control",), ("B+A",), ("A",), ("A+A",), ("bad",), ("+",)], "perturbation string")
    out = [r["condition"] for r in labels.formatted(obs, ignored=["bad"]).collect()]
    assert out == ["ctrl", "A+B", "A+ctrl", "A+ctrl", "ctrl"]
    genes = spark.createDataFrame([("A",)], "gene string")
    assert {r[0] for r in labels.allowed(obs, genes).collect()} == {"control", "A", "A+A"}


def test_rest_tests_by_brute_force(spark):
    rng = np.random.default_rng(8)
    dense = rng.integers(0, 4, (40, 3)).astype(float)
    label = rng.choice(["a", "b", "c"], 40)
    X = spark.createDataFrame([(i, g, float(dense[i, g])) for i in range(40) for g in range(3) if dense[i, g]], "cell long, gene long, value double")
    obs = spark.createDataFrame([(i, str(label[i])) for i in range(40)], "cell long, grp string")
    got = {(r["gene"], r["target"]): r for r in de.rank_sum(X, obs, "grp", None, means=True).collect()}
    assert len(got) == 9
    for (g, t), r in got.items():
        x, y = dense[label == t, g], dense[label != t, g]
        u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        _, ties = np.unique(dense[:, g], return_counts=True)
        assert r["u"] == u and r["tie_sum"] == (ties**3 - ties).sum() and abs(r["mean"] - x.mean()) < 1e-12 and abs(r["ref_mean"] - y.mean()) < 1e-12
    for r in de.t_test(X, obs, "grp", None, "welch").collect():
        x, y = dense[label == r["target"], r["gene"]], dense[label != r["target"], r["gene"]]
        assert abs(r["statistic"] - (x.mean() - y.mean()) / np.sqrt(x.var(ddof=1) / len(x) + y.var(ddof=1) / len(y))) < 1e-9
    table = de.rank_genes_groups(X, obs, "grp", n_genes=2, pts=True)
    assert table.count() == 6 and "pts_rest" in table.columns
    assert {r["target"] for r in de.rank_genes_groups(X, obs, "grp", "a", method="wilcoxon").collect()} == {"b", "c"}


def test_adjusted_p_values_of_uniform_draws(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.uniform(size=400), rng.uniform(size=50) ** 20, [0.0, 1.0, 1.0]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p_value double")
    order = np.argsort(p)
    m = len(p)
    for method, factor in (("bh", 1.0), ("by", (1 / np.arange(1, m + 1)).sum())):
        want = np.empty(m)
        want[order] = np.minimum(1, np.minimum.accumulate((p[order] * m * factor / np.arange(1, m + 1))[::-1])[::-1])
        got = {r["i"]: r["fdr"] for r in de.adjusted(df, method=method).collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in range(m))


def test_harmonic_sum_at_any_size(spark):
    sizes = [1.0, 2.0, 10.0, 9999.0, 10001.0, 250000.0]
    df = spark.createDataFrame([(x,) for x in sizes], "m double")
    for r in df.select("m", de.harmonic(F.col("m")).alias("h")).collect():
        assert abs(r["h"] - (1 / np.arange(1, int(r["m"]) + 1)).sum()) < 1e-11


def test_deep_hierarchy(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(0, 60)], "parent long, child long")
    got = {r["node"]: (r["level"], r["depth"]) for r in graphs.levels(edges).collect()}
    assert got[60] == (1, 60) and got[59] == (59, 59) and len(got) == 61


def test_draws_with_replacement(spark):
    obs = spark.createDataFrame([(i, "g" if i < 30 else "h", 10.0 if i == 7 else 0.1) for i in range(40)], "cell long, grp string, w double")
    drawn = splits.sample_weighted(obs, "w", 200, replace=True).toPandas()
    assert len(drawn) == 200 and drawn["draw"].is_unique and 110 < (drawn["cell"] == 7).sum() < 180
    each = splits.sample_by_group(obs, "grp", 25, balance=True, replace=True).toPandas()
    assert each.groupby("grp").size().to_dict() == {"g": 25, "h": 25} and each[each["grp"] == "h"]["cell"].nunique() <= 10
    with pytest.raises(ValueError):
        splits.sample_weighted(obs, "w")


def test_projection_in_small_chunks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    sets = {f"s{i}": set(rng.choice(12, rng.integers(1, 8), replace=False).tolist()) | ({99} if i % 2 else set()) for i in range(30)}
    ann = spark.createDataFrame([(s, str(t)) for s, ts in sets.items() for t in ts], "source string, target string")
    monkeypatch.setattr(similarity, "_CHUNK", 4)
    for kind, f in (("jaccard", lambda c, a, b: c / (a + b - c)), ("overlap", lambda c, a, b: c / min(a, b)), ("cosine", lambda c, a, b: c / np.sqrt(a * b))):
        want = {(x, y): f(len(sets[x] & sets[y]), len(sets[x]), len(sets[y])) for x in sets for y in sets if x != y and sets[x] & sets[y]}
        got = {(r["source"], r["target"]): r["weight"] for r in similarity.project(ann, kind, 0.3).collect()}
        assert got.keys() == {k for k, w in want.items() if w > 0.3} and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    own = similarity.project(ann, lambda c, a, b: c, 2.0, both_ways=False)
    assert own.count() == sum(len(sets[x] & sets[y]) > 2 for x in sets for y in sets if x < y)


def test_variable_genes_by_any_flavor(spark, counts):
    _, X, obs = counts
    for flavor in hvg.FLAVORS:
        x = preprocess.log1p(X) if flavor in ("seurat", "cell_ranger") else X
        assert hvg.highly_variable_genes(x, obs, flavor, 5, subset=True).count() >= 1
    with pytest.raises(ValueError):
        hvg.highly_variable_genes(preprocess.log1p(X), obs, "seurat_v3", 5)
    with pytest.raises(ValueError):
        hvg.highly_variable_genes(X, obs, "other")
    with pytest.raises(ValueError):
        preprocess.normalize_total(X, obs, max_fraction=1.5)


def brute_projection(sets, weigh, threshold):
    out = {}
    for a in sets:
        for b in sets:
            if a != b and (c := len(sets[a] & sets[b])) and (w := weigh(c, len(sets[a]), len(sets[b]))) > threshold:
                out[a, b] = round(w, 9)
    return out


WEIGHTS = {"jaccard": lambda c, a, b: c / (a + b - c), "overlap": lambda c, a, b: c / min(a, b), "cosine": lambda c, a, b: c / (a * b) ** 0.5}


@pytest.mark.parametrize("kind", list(WEIGHTS))
@pytest.mark.parametrize(("threshold", "long"), [(0.0, 4096), (0.5, 4096), (0.8, 5), (0.5, 3), (1 / 3, 8)])
def test_projection(spark, kind, threshold, long, monkeypatch):
    """Equal sets, a target that most have, targets nobody shares, chunks of two sets, sets too long to be sent."""
    import random

    monkeypatch.setattr(similarity, "_CHUNK", 2)
    rng = random.Random(9)
    sets = {f"s{i}": set(rng.sample("abcdefghijkl", rng.randint(0, 8))) | ({"hot"} if rng.random() < 0.8 else set()) for i in range(60)}
    sets |= {f"e{i}": {"hot"} for i in range(7)} | {f"f{i}": {"x", "y", "hot"} for i in range(5)} | {"own": {"alone"}}
    rows = [(s, t) for s, ts in sets.items() for t in ts] * 2 + [(None, "a"), ("s1", None)]
    got = similarity.project(spark.createDataFrame(rows, "source string, target string"), kind, threshold, long=long).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert {(r[0], r[1]): round(r[2], 9) for r in got} == brute_projection(sets, WEIGHTS[kind], threshold)


def test_projection_by_functions(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9), ("d", 2), ("d", 1)]
    df = spark.createDataFrame(rows, "source string, target int")
    counted = similarity.project(df, lambda c, a, b: c / F.greatest(a, b), 0.4, both_ways=False)
    python = similarity.project(df, threshold=0.4, both_ways=False, of_sets=lambda x, y: len(x & y) / max(len(x), len(y)))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, python.collect())) == [("a", "b", 0.5), ("a", "d", 1.0), ("b", "d", 0.5)]
    with pytest.raises(ValueError):
        similarity.project(df, threshold=-0.1)
    with pytest.raises(ValueError):
        similarity.project(df, "none")


def test_projection_of_a_common_target_is_linear(spark):
    """A target of many sources costs nothing where the threshold asks for more than it."""
    n = 40_000
    own = spark.range(n).select(F.col("id").alias("source"), F.explode(F.array(F.lit(-1).cast("long"), F.col("id") * 2 + 10, F.col("id") * 2 + 11)).alias("target"))
    extra = spark.createDataFrame([(n + 1, 10), (n + 1, 11), (n + 1, -1)], "source long, target long")
    assert sorted(map(tuple, similarity.project(own.union(extra), "jaccard", 0.5).collect())) == [(0, n + 1, 1.0), (n + 1, 0, 1.0)]


@pytest.mark.parametrize("kind", ["string", "decimal(9,3)", "date", "double", "boolean"])
def test_places_of_any_type(spark, kind):
    import random

    rng = random.Random(3)
    raw = {
        "string": [None, "a", "aЖ", "b", "", "Ж", "日本", "cell_1", "cell_10", "cell_2", "\U0001f600", "￿", "A"] + [f"cell_{i}" for i in range(300)],
        "decimal(9,3)": ["-1", "10", "9", "9.5", None, "0", "-10.25"], "date": ["2020-01-02", "1999-12-31", None, "2020-01-01"], "double": [1.5, float("nan"), None, -0.5, float("inf")], "boolean": [True, False, None] * 3,
    }[kind]
    rows = [(i, x if x is None or not isinstance(x, str) else x) for i, x in enumerate(raw * 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"i int, x {'string' if kind in ('decimal(9,3)', 'date') else kind}").select("i", F.col("x").cast(kind).alias("x"))
    got = [(r["i"], r["x"]) for r in splits.places(df, "x").orderBy("_place").collect()]
    assert list(map(str, got)) == [str((r["i"], r["x"])) for r in df.orderBy("x", "i").collect()]
    assert sorted(r[0] for r in splits.places(df, "x").select("_place").collect()) == list(range(len(rows)))


def test_places_split_one_prefix_and_one_value(spark):
    """Names that begin alike, and a value that all rows share, are dealt to several tasks."""
    from helixframe.operators.numbering import in_order

    for column in (F.concat(F.lit("barcode_"), F.col("id")), F.lit("same")):
        df = spark.range(20_000).select(column.alias("cell"))
        out = in_order(df, ["cell"], "n")
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        assert out.agg(F.max("n"), F.countDistinct("n")).first() == (19_999, 20_000)
        assert len(parts) > 1 and max(r["count"] for r in parts) < 15_000


def brute_below(edges):
    below, nodes = {}, {n for e in edges for n in e}
    for n in nodes:
        todo, seen = [n], set()
        while todo:
            for c in {b for a, b in edges if a == todo[-1]} - seen if todo else ():
                seen.add(c)
                todo.insert(0, c)
            todo.pop()
        below[n] = seen
    return below


@pytest.mark.parametrize("seed", range(3))
def test_reachability_and_levels_with_chains(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(a, b) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.06}
    edges |= {(100 + i, 101 + i) for i in range(9)} | {(3, 200), (200, 201), (201, 202), (202, 20)} | {(300, 301)} | {(5, 400), (400, 24), (5, 24)}
    df = spark.createDataFrame(sorted(edges) * 2, "parent int, child int")
    nodes = sorted({n for e in edges for n in e})
    below = brute_below(edges)
    start = spark.createDataFrame([(n,) for n in nodes] + [(999,)], "node int")
    got = graphs.reachable(df, start).collect()
    assert len(got) == len(set(got)) and {(r[0], r[1]) for r in got} == {(n, c) for n in nodes for c in below[n]}
    up = graphs.reachable(df, start, upward=True).collect()
    assert {(r[1], r[0]) for r in up} == {(n, c) for n in nodes for c in below[n]}
    short, long_ = {}, {}
    for n in nodes:  # sorted order is topological but for the chain to 20
        if not any(b == n for _, b in edges):
            short[n] = long_[n] = 0
    for _ in nodes:
        for a, b in edges:
            if a in short:
                short[b], long_[b] = min(short.get(b, 1 << 30), short[a] + 1), max(long_.get(b, 0), long_[a] + 1)
    assert {(r["node"], r["level"], r["depth"]) for r in graphs.levels(df).collect()} == {(n, short[n], long_[n]) for n in nodes}
    assert graphs.is_acyclic(df)
    for extra in ([(24, 3)], [(500, 501), (501, 502), (502, 500)], [(109, 100)]):
        bad = df.union(spark.createDataFrame(extra, "parent int, child int"))
        closed = brute_below(edges | set(extra))
        assert graphs.is_acyclic(bad) == (not any(n in x for n, x in closed.items()))
        some = spark.createDataFrame([(extra[0][0],), (3,)], "node int")
        assert {(r[0], r[1]) for r in graphs.reachable(bad, some).collect()} == {(n, c) for n in (extra[0][0], 3) for c in closed[n] if c != n}
        if any(n in x for n, x in closed.items()):
            with pytest.raises(ValueError, match="cycle"):
                graphs.levels(bad)


def test_a_long_chain_takes_few_jobs(spark):
    """10,000 nodes one below the other, in any order of their names."""
    n = 10_000
    name = lambda c: F.md5(c.cast("string"))
    df = spark.range(n - 1).select(name(F.col("id")).alias("parent"), name(F.col("id") + 1).alias("child"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = graphs.levels(df).agg(F.max("level"), F.count("*"), F.sum("depth")).first()
    below = graphs.reachable(df, spark.range(1).select(name(F.lit(7)).alias("node"))).count()
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert tuple(got) == (n - 1, n, n * (n - 1) // 2) and below == n - 8
    assert jobs <= 300  # every exchange of the adaptive planner is one; a level at a time they were some 40,000


@pytest.mark.parametrize("gamma", [1.0, 0.03, 40.0])
def test_mmd_is_the_definition(spark, gamma):
    rng = np.random.default_rng(8)
    A, B = rng.normal(size=(70, 3)) * [1, 30, 1e-3], rng.normal(size=(50, 3)) * [2, 30, 1e-3] + [0.5, -3, 1e6]
    A[:20, 0] = np.arange(-10, 10) / np.sqrt(gamma)  # on the borders of bins
    frame = lambda M: spark.createDataFrame([(i, j, float(M[i, j])) for i in range(len(M)) for j in range(3)], "cell int, gene int, value double")
    k = lambda x, y: np.exp(-gamma * (x[:, None] - y[None, :]) ** 2).mean()
    want = {j: k(A[:, j], A[:, j]) + k(B[:, j], B[:, j]) - 2 * k(A[:, j], B[:, j]) for j in range(3)}
    got = {r["gene"]: r["mmd"] for r in metrics.mmd(frame(A), frame(B), gamma, per_gene=True).collect()}
    assert all(abs(got[j] - want[j]) < 1e-9 for j in range(3)), (got, want)
    assert abs(metrics.mmd(frame(A), frame(B), gamma).first()[0] - np.mean(list(want.values()))) < 1e-9


def test_neighbours_without_all_pairs(spark):
    """An edge of many nodes answers for some of them, and counts for all, without its pairs."""
    big = spark.range(1).select(F.lit("big").alias("edge_id"), F.sequence(F.lit(0), F.lit(60_000)).alias("participants"))
    h = big.union(spark.createDataFrame([("a", [1, 2, 70_000]), ("b", [70_000, 70_001]), ("c", [5, 5])], "edge_id string, participants array<int>"))
    asked = spark.createDataFrame([(70_000,), (70_001,), (-1,)], "node int")
    assert sorted(map(tuple, graphs.co_participants(h, asked).collect())) == [(70_000, 1), (70_000, 2), (70_000, 70_001), (70_001, 70_000)]
    assert {r[0]: r[1] for r in graphs.co_degrees(h, asked).collect()} == {70_000: 3, 70_001: 1, -1: 0}
    every = graphs.co_degrees(h).groupBy("degree").count().collect()
    assert {r[0]: r[1] for r in every} == {60_000: 59_999, 60_001: 2, 3: 1, 1: 1}


@pytest.mark.parametrize(("ranks", "size", "cells"), [(1, 4, 11), (2, 3, 25), (3, 2, 25), (3, 50, 7), (4, 2, 1), (2, 2, 0)])
def test_each_rank_gets_its_batches(spark, ranks, size, cells):
    """Every cell once an epoch, the same number of batches on every rank, the rank's own number, and another order each epoch."""
    import pyarrow as pa

    from helixframe.plans import training
    from helixframe.plans.experiment import Experiment

    obs = spark.createDataFrame([(i, "train" if i % 5 else "test") for i in range(cells)], "cell int, split string")
    X = spark.createDataFrame([(i, g, float(i + g)) for i in range(cells) for g in range(i % 3)], "cell int, gene int, value double")
    e = Experiment(X, obs, spark.range(4).select(F.col("id").cast("int").alias("gene")))

    def step(rank, lots):
        for lot in lots:
            assert lot.values.shape == (len(lot.cells), 4)
            for cell, row in zip(lot.cells, lot.values, strict=True):
                assert row.tolist() == [float(cell + g) if g < cell % 3 else 0.0 for g in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([lot.number], pa.int64()), pa.array([lot.cells], pa.list_(pa.int32()))], ["rank", "number", "cells"])

    seen = []
    for number in (0, 1):
        rows = training.each_rank(e, step, "rank int, number long, cells array<int>", ranks, size, number).collect()
        lots = -(-cells // (ranks * size))
        assert sorted((r["rank"], r["number"]) for r in rows) == [(k, n) for k in range(ranks) for n in range(lots)]
        assert sorted(c for r in rows for c in r["cells"]) == list(range(cells)) and all(len(r["cells"]) <= size for r in rows)
        want = {r["cell"]: (r["rank"], r["batch"]) for r in training.epoch(e, ranks, size, number).collect()}
        assert {c: (r["rank"], r["number"]) for r in rows for c in r["cells"]} == want
        seen.append([c for r in sorted(rows, key=lambda r: (r["number"], r["rank"])) for c in r["cells"]])
    assert cells < 7 or seen[0] != seen[1]
    train = training.epoch(e, ranks, size, split="train").collect()
    assert sorted(r["cell"] for r in train) == [i for i in range(cells) if i % 5]


def test_one_gene_is_many_tasks(spark):
    """Running sums over one key: right at the borders of ranges, and no task holds all of it."""
    from helixframe.operators.numbering import running

    df = spark.range(3000).select(F.lit("g").alias("gene"), (F.col("id") * 7 % 3000).cast("double").alias("v"), F.lit(2.0).alias("c"))
    out = running(df, "gene", "v", ["c"], {"squares": F.col("c") * F.col("c")}, "next")
    rows = out.orderBy("v").collect()
    assert [r["_upto_c"] for r in rows] == [2.0 * (i + 1) for i in range(3000)] and {r["_all_c"] for r in rows} == {6000.0} and {r["squares"] for r in rows} == {12_000.0}
    assert [r["next"] for r in rows] == [float(i + 1) for i in range(2999)] + [None]
    sizes = [r["count"] for r in df.repartitionByRange(4, "gene", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500
    one = spark.createDataFrame([(i, 0, float(i % 97 - 40)) for i in range(500)], "cell long, gene long, value double")
    obs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(500)], "cell long, pert string")
    got = de.rank_sum(one, obs, "pert", "a").first()
    x, y = ([float(i % 97 - 40) for i in range(k, 500, 2)] for k in (1, 0))
    assert got["u"] == sum((p > q) + 0.5 * (p == q) for p in x for q in y)
