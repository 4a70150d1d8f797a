"""Readers and catalog on small files."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from helixframe.plans.experiment import Experiment
from helixframe.sources import catalog, hdf5, readers, roles
from helixframe.sources.h5ad import read_h5ad, write_h5ad

OBO = """format-version: 1.2

[Term]
id: GO:1
name: root
namespace: bp
def: "All of it." [x]

[Term]
id: GO:2
name: child
is_a: GO:1 ! root
alt_id: GO:9

[Term]
id: GO:3
name: old
is_obsolete: true

[Typedef]
id: part_of
"""


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text(OBO)
    terms, edges = readers.read_obo(spark, str(tmp_path / "x.obo"))
    got = {r["id"]: r for r in terms.collect()}
    assert set(got) == {"GO:1", "GO:2"} and got["GO:1"]["definition"] == "All of it." and got["GO:2"]["alt_ids"] == ["GO:9"]
    assert [tuple(r) for r in edges.collect()] == [("GO:1", "GO:2")]
    assert readers.read_obo(spark, str(tmp_path / "x.obo"), True)[0].count() == 3
    assert {tuple(r) for r in readers.main_terms(terms).collect()} == {("GO:1", "GO:1"), ("GO:2", "GO:2"), ("GO:9", "GO:2")}


def test_gaf(spark, tmp_path):
    row = ["DB", "1", "TP53", "", "GO:1", "r", "IDA", "", "P", "", "", "", "", "2020", "x"]
    (tmp_path / "x.gaf").write_text("!c\n" + "\t".join(row) + "\n" + "\t".join(row[:5]) + "\n" + "\t".join(row[:4] + ["GO:2"] + row[5:]) + "\textra\tlast\n")
    gaf = readers.read_gaf(spark, str(tmp_path / "x.gaf"))
    assert gaf.count() == 2 and len(gaf.columns) == 17
    assert readers.gene_terms(gaf).first()["terms"] == ["GO:1", "GO:2"]
    assert readers.read_gaf(spark, str(tmp_path / "x.gaf"), evidence=["IEA"]).count() == 0


def test_gtf(spark, tmp_path):
    (tmp_path / "x.gtf").write_text('#!v\n1\tsrc\tgene\t10\t20\t.\t+\t.\tgene_id "G1"; gene_name "A";\n1\tsrc\texon\t10\t12\t.\t+\t.\tgene_id "G1";\n')
    gtf = readers.read_gtf(spark, str(tmp_path / "x.gtf"))
    assert {(r["feature"], r["gene_id"], r["gene_name"], r["end"]) for r in gtf.collect()} == {("gene", "G1", "A", 20), ("exon", "G1", None, 12)}
    assert readers.read_gtf(spark, str(tmp_path / "x.gtf"), "gene", ["gene_id"]).columns[-1] == "gene_id"


def test_nomenclature_and_writers(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"response": {"docs": [{"symbol": "A", "hgnc_id": "1"}, {"symbol": "B", "hgnc_id": "2"}]}}')
    docs = readers.read_nomenclature(spark, str(tmp_path / "h.json"), ["symbol", "none"])
    assert docs.columns == ["symbol"] and docs.count() == 2
    for kind in ("json", "csv", "tsv", "parquet"):
        readers.write_table(docs, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 2
    with pytest.raises(ValueError):
        readers.write_table(docs, str(tmp_path / "no"), "xml")


def test_vocabulary_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, token string")
    readers.save_vocabulary(str(tmp_path / "v"), v)
    assert sorted(map(tuple, readers.load_vocabulary(spark, str(tmp_path / "v")).collect())) == [(0, "a"), (1, "b")]


def test_roles_and_catalog(spark, tmp_path):
    assert roles.guess(["n", "Cell_Type"], roles.CELL_TYPE) == "Cell_Type" and roles.guess(["my_barcode_x"], roles.CELL_ID) == "my_barcode_x" and roles.guess(["z"], roles.GENE_NAME) is None
    c = catalog.Catalog()
    spark.range(3).write.parquet(str(tmp_path / "d"))
    c.register("screens/one", str(tmp_path / "d"))
    c.register("screens/sub/two", str(tmp_path / "e"))
    assert c.names() == ["screens/one", "screens/sub/two"] and c.names("screens", False) == ["one", "sub"] and c.load(spark, "screens/one").count() == 3
    with pytest.raises(ValueError):
        c.place("one")
    with pytest.raises(KeyError):
        c.place("screens/none")


def test_experiment(spark):
    X = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 0, 4.0)], "cell long, gene long, value double")
    obs = spark.createDataFrame([(0, "control", "T"), (1, "A", "T"), (2, None, "B")], "cell long, perturbation string, celltype string")
    var = spark.createDataFrame([(0, "g0"), (1, "g1")], "gene long, symbol string")
    e = Experiment.guessed(X, obs, var)
    assert e.cell_type == "celltype" and e.shape == (3, 2)
    assert [r["is_perturbed"] for r in e.flagged().orderBy("cell").collect()] == [False, True, True]
    part = e.where("celltype = 'T'")
    assert part.matrix.count() == 2
    want = spark.createDataFrame([(0, "g1"), (1, "new")], "idx long, token string")
    aligned = e.align(want)
    assert [tuple(r) for r in aligned.matrix.collect()] == [(1, 0, 2.0)] and [r["is_virtual"] for r in aligned.var.orderBy("gene").collect()] == [False, True]
    with pytest.raises(KeyError):
        e.use_layer("none")
    assert e.records().count() == 3 and e.split(test_size=0.5).obs.filter("split = 'train'").count() >= 1
    assert e.sample(2).obs.count() == 2 and e.sample(1, balance=True).obs.count() == 2
    with pytest.raises(ValueError):
        e.sample()
    assert [r["token"] for r in e.vocabulary().orderBy("idx").collect()] == ["g0", "g1"] and [r["token"] for r in e.cell_types().orderBy("idx").collect()] == ["B", "T"]
    assert e.split_cells(test_size=0.5).obs.filter("split = 'test'").count() == 2


def _tree(rng, cells=11, genes=4):
    """An annotated matrix as it is stored: sparse by cells, by genes and dense, with columns of all kinds."""
    dense = rng.integers(0, 3, (cells, genes)).astype(np.float32)
    i, j = np.nonzero(dense)
    k, m = np.nonzero(dense.T)
    shape = np.array([cells, genes])
    csr = {"@": {"encoding-type": "csr_matrix", "shape": shape}, "data": dense[i, j], "indices": j.astype(np.int32), "indptr": np.append(0, np.cumsum((dense != 0).sum(1)))}
    csc = {"@": {"encoding-type": "csc_matrix", "shape": shape}, "data": dense.T[k, m], "indices": m, "indptr": np.append(0, np.cumsum((dense != 0).sum(0)))}
    codes = (np.arange(cells) % 3 - 1).astype(np.int8)
    obs = {
        "@": {"_index": "names", "column-order": np.array(["ok", "cell_type"], object)}, "names": np.array([f"cé{x}" for x in range(cells)], object), "cell_type": {"codes": codes, "categories": np.array(["T", "B"], object)},
        "n": np.arange(cells, dtype=np.uint16), "x": np.arange(cells) / 4, "ok": np.arange(cells) > 4, "gap": {"values": np.arange(cells), "mask": np.arange(cells) == 2}, "cell": np.arange(cells),
    }
    var = {"@": {"_index": "_index"}, "_index": np.array([f"g{x}" for x in range(genes)], object)}
    return {"X": csr, "obs": obs, "var": var, "layers": {"byte": csc, "full": dense}, "obsm": {"pca": np.arange(cells * 2.0).reshape(cells, 2)}}, {(int(a), int(b)): float(dense[a, b]) for a, b in zip(i, j, strict=True)}


def test_h5ad(spark, tmp_path):
    tree, want = _tree(np.random.default_rng(3))
    path = str(tmp_path / "a.h5ad")
    hdf5.save(path, tree, chunk_bytes=64)
    for layer in (None, "byte", "full"):
        e = read_h5ad(spark, path, layer, rows=3, controls=("c",))
        assert {(r["cell"], r["gene"]): r["value"] for r in e.matrix.collect()} == want
    assert e.shape == (11, 4) and e.cell_type == "cell_type" and e.controls == ("c",)
    rows = e.obs.orderBy("cell").collect()
    assert [(r["cell"], r["cell_name"], r["cell_type"], r["n"], r["x"], r["ok"], r["gap"]) for r in rows[2:5]] == [(2, "cé2", "B", 2, 0.5, False, None), (3, "cé3", None, 3, 0.75, False, 3), (4, "cé4", "T", 4, 1.0, False, 4)]
    assert e.obs.columns[:4] == ["cell", "cell_name", "ok", "cell_type"]
    assert [r["gene_name"] for r in e.var.orderBy("gene").collect()] == ["g0", "g1", "g2", "g3"]
    load = lambda **o: spark.read.format("h5ad").options(rows=2, **o).load(f"file:{path}")
    assert load(table="obs", columns="n, gap").columns == ["cell", "cell_name", "n", "gap"]
    assert [tuple(r) for r in load(table="obsm/pca").orderBy("cell").limit(2).collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0])]
    with pytest.raises(Exception, match="no table"):
        load(table="uns").count()
    (tmp_path / "no.h5ad").write_bytes(b"no")
    with pytest.raises(Exception, match="no HDF5 file"):
        spark.read.format("h5ad").load(str(tmp_path / "no.h5ad")).count()


def test_h5ad_parts_pushdown_and_duplicates(spark, tmp_path):
    """A folder of parts, conditions that leave out blocks, and names that come twice."""
    rng, want, first = np.random.default_rng(5), {}, 0
    for part, cells in enumerate((5, 9, 1)):
        tree, entries = _tree(rng, cells)
        tree["var"]["_index"] = np.array(["g0", "g1", "g0", "g3"], object)
        hdf5.save(tmp_path / f"part-{part}.h5ad", tree)
        want |= {(c + first, g): v for (c, g), v in entries.items()}
        first += cells
    path = str(tmp_path)
    assert {(r["cell"], r["gene"]): r["value"] for r in read_h5ad(spark, path, rows=4, duplicates=None).matrix.collect()} == want
    with pytest.raises(ValueError, match="repeated"):
        read_h5ad(spark, path)
    assert {r["gene"] for r in read_h5ad(spark, path, duplicates="remove").var.collect()} == {1, 3}
    assert {r["gene"] for r in read_h5ad(spark, path, duplicates="last").matrix.collect()} == {1, 2, 3}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = read_h5ad(spark, path, rows=2, duplicates=None).matrix.filter("cell >= 6 AND cell < 9 AND gene > 0")
        assert {(r["cell"], r["gene"]): r["value"] for r in some.collect()} == {k: v for k, v in want.items() if 6 <= k[0] < 9 and k[1] > 0}
        assert some.rdd.getNumPartitions() == 2  # of nine blocks
        assert read_h5ad(spark, path, duplicates=None).matrix.filter("cell IN (0, 14)").select("cell").distinct().count() == len({k[0] for k in want} & {0, 14})
        assert read_h5ad(spark, path, duplicates=None).matrix.filter("cell = 99").isEmpty()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_h5ad_is_written_in_parts(spark, tmp_path):
    X = spark.createDataFrame([("c", "b", 1.0), ("a", "b", 2.0), ("a", "b", 0.5), ("a", "z", 3.0), ("a", "none", 9.0), ("x", "b", 9.0)], "cell string, gene string, value double")
    obs = spark.createDataFrame([("c", None, 1, True, 0.5), ("a", "T", 2, False, None), ("b", "B", None, True, 1.5)], "cell string, cell_type string, n int, ok boolean, w double")
    var = spark.createDataFrame([("b", "Gene B", 7), ("z", "Gene Z", 8)], "gene string, gene_name string, at long")
    made = write_h5ad(Experiment(X, obs, var), str(tmp_path / "w"), cells=2)
    assert [tuple(r)[1:] for r in made.orderBy("file").collect()] == [(2, 2), (1, 1)]
    e = read_h5ad(spark, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in e.matrix.collect()) == [(0, 0, 2.5), (0, 1, 3.0), (2, 0, 1.0)]
    found = {r["cell_name"]: (r["cell_type"], r["ok"]) for r in e.obs.collect()}
    assert found == {"a": ("T", False), "b": ("B", True), "c": (None, True)}
    assert [tuple(r) for r in e.var.orderBy("gene").collect()] == [(0, "Gene B", 7), (1, "Gene Z", 8)]


def test_hdf5_of_both_generations(tmp_path):
    rng = np.random.default_rng(1)
    tree = {
        "@": {"a": "text é", "n": np.int64(5), "s": np.array([3, 4]), "l": np.array(["x", "yy", ""], object)}, "f32": rng.normal(size=(100, 7)).astype(np.float32), "big": rng.integers(0, 1000, 100_000), "u8": np.arange(40, dtype=np.uint8),
        "flag": rng.random(300) > 0.5, "text": np.array([f"name é {i}" for i in range(10_000)], object), "empty": np.zeros(0), "one": np.float64(2.5), "g": {"x": (np.arange(5), {"k": "v"}), "none": {}}, "many": {f"c{i:04d}": np.arange(i % 5 + 1.0) for i in range(700)},
    }
    hdf5.save(tmp_path / "a.h5", tree, chunk_bytes=1 << 12)
    with hdf5.File(str(tmp_path / "a.h5")) as f:
        assert f.attrs["a"] == "text é" and f.attrs["n"] == 5 and f.attrs["l"].tolist() == ["x", "yy", ""] and f.keys() == sorted(set(tree) - {"@"})
        for name in ("f32", "big", "u8", "flag", "text", "empty"):
            for a, b in ((0, None), (13, 57), (39, 40), (5, 5)):
                assert np.array_equal(f[name].read(a, b), tree[name][a:b]), name
        assert f["one"].read() == 2.5 and f["g/x"].attrs == {"k": "v"} and f["g/none"].keys() == [] and len(f["many"].keys()) == 700 and f["many/c0009"].read().tolist() == [0, 1, 2, 3, 4]
        with pytest.raises(KeyError):
            f["g/y"]
    w = hdf5.Writer()
    at = w._dataset(np.arange(1000.0), {"unit": "m"})
    link = b"\1\0\4data" + struct.pack("<Q", at)
    compact = struct.pack("<BB", 4, 0) + struct.pack("<H", 12) + np.arange(3, dtype="<i4").tobytes()
    small = w._put(b"OHDR\2\0" + bytes([0]) + b"")
    body = b"".join(struct.pack("<BHB", k, len(x), 0) + x for k, x in ((hdf5.SPACE, struct.pack("<BBBBQ", 2, 1, 0, 1, 3)), (hdf5.TYPE, w._type(np.zeros(1, np.int32))[0]), (hdf5.LAYOUT, compact)))
    small = w._put(b"OHDR\2\0" + bytes([len(body)]) + body + b"sum!")
    second = b"\1\0\5small" + struct.pack("<Q", small)
    more = w._put(b"OCHK" + struct.pack("<BHB", hdf5.LINK, len(second), 0) + second + b"sum!")
    body = struct.pack("<BHB", hdf5.LINK, len(link), 0) + link + struct.pack("<BHBQQ", hdf5.MORE, 16, 0, more, 4 + len(second) + 8)
    root = w._put(b"OHDR\2\0" + bytes([len(body)]) + body + b"sum!")
    w.out[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ4s", 2, 8, 8, 0, 0, hdf5.NOWHERE, len(w.out), root, b"sum!")
    (tmp_path / "b.h5").write_bytes(b"\0" * 512 + bytes(w.out))  # behind a user block
    with hdf5.File(str(tmp_path / "b.h5")) as f:
        assert f.keys() == ["data", "small"] and f["data"].attrs == {"unit": "m"} and np.array_equal(f["data"].read(10, 900), np.arange(10.0, 900)) and f["small"].read().tolist() == [0, 1, 2]


def test_catalogs_are_merged(spark):
    a, b = catalog.Catalog({"x/1": "p", "x/sub/2": "q"}), catalog.Catalog({"x/1": "new", "y/3": "r"})
    assert a.nested() == {"x": {"1": "p", "sub": {"2": "q"}}}
    with pytest.raises(ValueError):
        a.merge(b)
    a.merge(b, "first")
    assert a.places == {"x/1": "p", "x/sub/2": "q", "y/3": "r"}
    a.merge(b, "last")
    assert a.place("x/1") == "new" and a.remove("y/3") == "r" and a.names() == ["x/1", "x/sub/2"]
    with pytest.raises(ValueError):
        a.merge(b, "other")
