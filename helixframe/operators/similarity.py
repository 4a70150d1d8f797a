"""Set and vector similarities, projections of annotations, and co-expression graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import blocks
from helixframe.operators.lineage import cut
from helixframe.operators.numbering import in_order

#: Built-in set similarities as functions of common members and both sizes.
SET_SIMILARITIES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "jaccard": lambda c, a, b: c / (a + b - c),
    "overlap": lambda c, a, b: c / F.least(a, b),
    "cosine": lambda c, a, b: c / F.sqrt(a * b),
}


def set_similarity(left: Column, right: Column, kind: str = "jaccard") -> Column:
    """Similarity of two array columns taken as sets; 0 where either is empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    c = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), SET_SIMILARITIES[kind](c, F.size(a).cast("double"), F.size(b).cast("double"))).otherwise(0.0)


def vector_cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns of numbers, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(norms > 0, dot(left, right) / norms).otherwise(0.0)


#: Of each built-in similarity above t: how many of a set's members are common at least, as a share, and how small a partner may be, as a share of its size.
_LEAST = {"jaccard": lambda t: (t, t), "cosine": lambda t: (t * t, t * t), "overlap": lambda t: (t, 0.0)}
#: Sets of a target that meet in one task, and the size from which a set is not sent with its members.
_CHUNK, _LONG = 1024, 4096


def project(
    annotation: DataFrame, kind: str | Callable[[Column, Column, Column], Column] = "jaccard", threshold: float = 0.1, source: str = "source", target: str = "target", both_ways: bool = True,
    of_sets: Callable[[set, set], float] | None = None, long: int = _LONG, k: int | None = None, digits: int | None = None,
) -> DataFrame:
    """One-mode projection: pairs of sources whose target sets are similar above ``threshold``.

    Returns ``source, target, weight``, in both directions. ``kind`` is a name or a function of
    common members and both sizes; ``of_sets`` is a Python function of two sets instead, called
    for pairs that share a target. A similarity above 0 needs one, so a negative threshold is
    refused.

    Targets are ordered from rare to common. Sets similar above the threshold share one of the
    first targets of each (of the smaller, for ``overlap``), so they meet at these only, and a
    pair is judged at its rarest common target, once. Sizes and places in the sets leave out
    pairs that can't be similar before the sets are compared. Sources with equal sets are one set
    until the end. The sets of a target are dealt to chunks, and a pair of chunks is a key of the
    join, so no task holds a common target; sets of more than ``long`` members are counted
    against those large enough to be similar, without being sent. Pairs of sources are written
    from pairs of sets, both ways in the task that makes them; with ``digits`` weights are
    rounded before that, once for a pair of sets.

    Where candidates are so many that most pairs of sets are, blocks of sets and sources are
    counted instead (``blocks``), of built-in similarities.

    With ``k``, only the ``k`` heaviest edges at each target, ties by the smaller source. They
    are chosen among sets, each with its ``k + 1`` smallest sources, so that equal sets are
    never expanded into all pairs.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 would also join pairs that share nothing")
    if isinstance(kind, str) and kind not in SET_SIMILARITIES:
        raise ValueError(f"kind must be one of {tuple(SET_SIMILARITIES)}")
    weigh = SET_SIMILARITIES[kind] if isinstance(kind, str) else kind
    share, partner = _LEAST[kind](threshold) if isinstance(kind, str) and of_sets is None else (0.0, 0.0)
    edges = annotation.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s IS NOT NULL AND t IS NOT NULL").distinct()
    ranked = in_order(edges.groupBy("t").agg(F.count("*").alias("_f")), ["_f", "t"], "r").select("t", "r")
    owned = cut(edges.join(ranked, "t").groupBy("s").agg(F.sort_array(F.collect_list("r")).alias("set")))
    sets = cut(owned.groupBy("set").agg(F.count("*").alias("members")).withColumns({"i": F.monotonically_increasing_id(), "n": F.size("set")}))
    double = lambda c: F.col(c).cast("double")

    # short sets meet at their first targets
    first = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1)
    spread = F.col("set") if kind == "overlap" else F.slice("set", F.lit(1), first.cast("int"))
    met = sets.filter(F.col("n") <= long).select("i", "n", "set", first.alias("p"), F.posexplode(spread).alias("at", "r"))
    if of_sets is None and isinstance(kind, str) and (k is None or digits is None):
        candidates = met.groupBy("r").agg(F.count("*").alias("_m")).agg(F.sum(F.col("_m") * (F.col("_m") - 1) / 2)).first()[0] or 0
        if blocks.worth(candidates, sets.count(), owned.count()):
            return _in_blocks(owned, sets, kind, threshold, both_ways, k, digits)
    chunks = met.groupBy("r").agg(F.ceil(F.count("*") / _CHUNK).alias("chunks"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    dealt = met.join(chunks, "r").withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks")))
    keyed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("r", "i", "n", "set", "at", "p", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk")
    left = keyed.filter("chunk = x").select("r", "x", "y", *(F.col(c).alias(f"{c}_a") for c in ("i", "n", "set", "at", "p")))
    right = keyed.filter("chunk = y").select("r", "x", "y", *(F.col(c).alias(f"{c}_b") for c in ("i", "n", "set", "at", "p")))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # chunks of one number hold both sides of a pair, others only one
    pairs = left.join(right, ["r", "x", "y"]).filter(F.when(F.col("x") == F.col("y"), F.col("i_a") < F.col("i_b")).otherwise(F.lit(True))).filter(small >= large * F.lit(partner) - 1e-9)
    if kind == "overlap":
        pairs = pairs.filter(((F.col("n_a") == small) & (F.col("at_a") < F.col("p_a"))) | ((F.col("n_b") == small) & (F.col("at_b") < F.col("p_b"))))
    if isinstance(kind, str) and of_sets is None:  # all targets from here on are common at most
        pairs = pairs.filter(weigh(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")).cast("double"), double("n_a"), double("n_b")) > threshold - 1e-9)
    common = F.filter(F.array(F.array_intersect("set_a", "set_b")), lambda c: F.element_at(c, 1) == F.col("r"))
    found = pairs.select("i_a", "i_b", "n_a", "n_b", F.explode(common).alias("_c")).select("i_a", "i_b", "n_a", "n_b", F.size("_c").alias("c"))

    # long sets are counted
    whole = sets.filter(F.col("n") > long).select("i", "n", F.explode("set").alias("r"))
    near = sets.filter(F.col("n") >= long * partner).select("i", "n", F.explode("set").alias("r"))
    counted = whole.toDF("i_a", "n_a", "r").join(near.toDF("i_b", "n_b", "r"), "r").filter((F.col("n_b") <= long) | (F.col("i_a") < F.col("i_b")))
    found = found.unionByName(counted.groupBy("i_a", "i_b", "n_a", "n_b").agg(F.count("*").cast("int").alias("c")))

    alone = sets.filter("members > 1").select(F.col("i").alias("i_a"), F.col("i").alias("i_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("c"))
    found = found.unionByName(alone)
    if of_sets is not None:
        names = owned.select("s", "set").join(sets.select("set", "i"), "set").groupBy("i").agg(F.min("s").alias("s")).join(edges, "s").groupBy("i").agg(F.collect_list("t").alias("ts"))

        def judged(left: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series([float(of_sets(set(a), set(b))) for a, b in zip(left, right, strict=True)], dtype=float)

        both = found.join(names.toDF("i_a", "ts_a"), "i_a").join(names.toDF("i_b", "ts_b"), "i_b")
        weighed = both.select("i_a", "i_b", F.pandas_udf(judged, "double")("ts_a", "ts_b").alias("weight"))
    else:
        weighed = found.select("i_a", "i_b", weigh(double("c"), double("n_a"), double("n_b")).alias("weight"))
    members = cut(owned.join(sets.select("set", "i"), "set").select("i", "s"))
    heavy = weighed.filter(F.col("weight") > threshold)
    if digits is not None:
        heavy = heavy.withColumn("weight", F.round("weight", digits) + F.lit(0.0))
    if k is not None:
        return _heaviest(heavy, members, k)
    return _written(heavy, members, both_ways)


def _in_blocks(owned: DataFrame, sets: DataFrame, kind: str, threshold: float, both_ways: bool, k: int | None, digits: int | None) -> DataFrame:
    """The projection of ``owned (s, set)`` with its ``sets``, from blocks of sets that meet all sources."""
    if k is not None:
        weight = SET_SIMILARITIES[kind](*(F.col(c).cast("double") for c in ("c", "n_a", "n_b"))).alias("weight")
        found = blocks.nearest(sets.select("i", "set"), owned, kind, threshold, k + 1)  # one more, as a source meets itself
        candidates = found.select(F.col("i").alias("a"), weight, "source").filter(F.col("weight") > threshold)
        return _best(candidates, owned.join(sets.select("set", "i"), "set").select("i", "s"), k)
    placed = owned.join(sets.select("set", "i", F.ceil(F.col("members") / _CHUNK).alias("_c")), "set")
    left = placed.groupBy("i", F.pmod(F.xxhash64("s"), "_c").alias("_k")).agg(F.first("set").alias("set"), F.collect_list("s").alias("sources"), F.min("s").alias("at")).select("at", "set", "sources")
    return blocks.alike(left, owned, kind, threshold, digits).filter("source <> target" if both_ways else "source < target")


def _heaviest(pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges at each source of ``members (i, s)`` as target, from pairs of sets ``i_a, i_b, weight``."""
    place = Window.partitionBy("i").orderBy("s")
    smallest = cut(members.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k + 1).groupBy(F.col("i").alias("b")).agg(F.collect_list("s").alias("_s")))
    both = pairs.select(F.explode(F.when(F.col("i_a") == F.col("i_b"), F.array(F.struct(F.col("i_a").alias("a"), F.col("i_b").alias("b")))).otherwise(F.array(F.struct(F.col("i_a").alias("a"), F.col("i_b").alias("b")), F.struct(F.col("i_b").alias("a"), F.col("i_a").alias("b"))))).alias("_p"), "weight").select("_p.a", "_p.b", "weight")
    return _best(both.join(smallest, "b").select("a", "weight", F.explode("_s").alias("source")), members, k)


def _best(candidates: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest of the edges to each set, ``a, weight, source``, for each of its sources as target."""
    # one more than asked, as a source is no neighbour of its own
    best = Window.partitionBy("a").orderBy(F.desc("weight"), "source")
    kept = candidates.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    lists = kept.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("_r", "source", "weight"))).alias("_l"))
    first = F.slice(F.filter("_l", lambda x: x["source"] != F.col("target")), 1, k)
    out = members.select(F.col("i").alias("a"), F.col("s").alias("target")).join(lists, "a").select("target", F.explode(first).alias("_x"))
    return out.select("_x.source", "target", "_x.weight")


def _written(pairs: DataFrame, members: DataFrame, both_ways: bool) -> DataFrame:
    """Pairs of sets ``i_a, i_b, weight`` as pairs of their sources, from lists of at most about ``_CHUNK`` sources a side."""
    sizes = members.groupBy("i").agg(F.ceil(F.count("*") / _CHUNK).alias("_c"))
    lists = cut(members.join(sizes, "i").groupBy("i", F.pmod(F.xxhash64("s"), "_c").alias("_k")).agg(F.collect_list("s").alias("_s")))
    spread = pairs.join(lists.select(F.col("i").alias("i_a"), F.col("_k").alias("_ka"), F.col("_s").alias("_x")), "i_a").join(lists.select(F.col("i").alias("i_b"), F.col("_k").alias("_kb"), F.col("_s").alias("_y")), "i_b")
    tasks = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = spread.repartition(tasks, "i_a", "_ka", "i_b", "_kb").select((F.col("i_a") == F.col("i_b")).alias("_same"), "_x", "_y", "weight")
    if both_ways:  # lists change places, not their pairs; lists of equal sets meet in either order already
        forth, back = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")), F.struct(F.col("_y").alias("x"), F.col("_x").alias("y"))
        turned = dealt.select("_same", F.explode(F.when(F.col("_same"), F.array(forth)).otherwise(F.array(forth, back))).alias("_e"), "weight").select("_same", F.col("_e.x").alias("_x"), F.col("_e.y").alias("_y"), "weight")
        found = turned.select("_same", F.explode("_x").alias("source"), "_y", "weight").select("_same", "source", F.explode("_y").alias("target"), "weight")
        return found.filter(~F.col("_same") | (F.col("source") != F.col("target"))).select("source", "target", "weight")
    found = dealt.select("_same", F.explode("_x").alias("x"), "_y", "weight").select("_same", "x", F.explode("_y").alias("y"), "weight").filter(~F.col("_same") | (F.col("x") < F.col("y")))
    return found.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "weight")


def strongest(edges: DataFrame, k: int, by: str = "target") -> DataFrame:
    """The ``k`` heaviest edges at each ``by`` node; ties go to the smaller other node."""
    other = "source" if by == "target" else "target"
    order = Window.partitionBy(by).orderBy(F.desc("weight"), other)
    return edges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def correlation(X: DataFrame, cells: DataFrame, tile: int = 1024) -> DataFrame:
    """Pearson correlation of every two genes over ``cells``: ``gene_a, gene_b, r``.

    Genes are cut into tiles of ``tile`` and cells into blocks of about as many. Sums of products are taken for a pair of
    tiles at a time, block by block, and added up as arrays; a task holds one pair of tiles,
    however many genes there are.
    """
    inside = X.join(cells.select("cell"), "cell", "left_semi").select("cell", "gene", F.col("value").cast("double").alias("value"))
    n = cells.agg(F.count("*").cast("double").alias("n"))
    sums = inside.groupBy("gene").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    genes = in_order(sums, ["gene"], "i")
    products = _products(inside.join(genes.select("gene", "i"), "gene"), max(1, cells.count() // tile), tile)
    side = lambda k: genes.select(F.col("i").alias(f"i_{k}"), F.col("gene").alias(f"gene_{k}"), F.col("s1").alias(f"s1{k}"), F.col("s2").alias(f"s2{k}"))
    joined = products.join(side("a"), "i_a").join(side("b"), "i_b").crossJoin(F.broadcast(n))
    centered = lambda k: F.greatest(F.lit(0.0), F.col(f"s2{k}") - F.col(f"s1{k}") ** 2 / F.col("n"))
    norm = F.sqrt(centered("a") * centered("b"))
    r = (F.col("xy") - F.col("s1a") * F.col("s1b") / F.col("n")) / F.when(norm == 0, 1e-10).otherwise(norm)
    return joined.select("gene_a", "gene_b", r.alias("r"))


def _products(entries: DataFrame, blocks: int, tile: int) -> DataFrame:
    """Sums of products of genes that meet in a cell: ``i_a, i_b, xy`` of ``entries (cell, i, value)``, both ways."""
    placed = entries.select(F.pmod(F.xxhash64("cell"), F.lit(blocks)).alias("block"), (F.col("i") / tile).cast("int").alias("tile"), F.xxhash64("cell").alias("c"), (F.col("i") % tile).cast("int").alias("g"), F.col("value").alias("v"))
    packed = placed.groupBy("block", "tile").agg(F.collect_list(F.struct("c", "g", "v")).alias("e"))
    pairs = packed.select("block", F.col("tile").alias("p"), F.col("e").alias("left")).join(packed.select("block", F.col("tile").alias("q"), F.col("e").alias("right")), "block").filter("p <= q")

    def matrix(entries: pa.Array, order: np.ndarray) -> np.ndarray:
        out = np.zeros((len(order), tile))
        out[np.searchsorted(order, entries.field("c").to_numpy()), entries.field("g").to_numpy()] = entries.field("v").to_numpy()
        return out

    def sums(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        held, total = None, None
        for p, q, product in rows:
            if held == (p, q):
                total += product
            else:
                if held is not None:
                    yield *held, total
                held, total = (p, q), product
        if held is not None:
            yield *held, total

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(2)[k].values, batch.column(3)[k].values
                order = np.unique(np.concatenate([left.field("c").to_numpy(), right.field("c").to_numpy()]))
                yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), matrix(left, order).T @ matrix(right, order)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q, total in sums(multiplied(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["p", "q", "m"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), np.frombuffer(batch.column(2)[k].as_buffer()).reshape(tile, tile).copy()

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q, total in sums(read(batches)):
            a, b = np.nonzero(total)
            xy, a, b = total[a, b], a + p * tile, b + q * tile
            for x, y in ((a, b), (b, a)) if p < q else ((a, b),):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(xy)], ["i_a", "i_b", "xy"])

    ready = pairs.select("p", "q", "left", "right").repartition("p", "q", F.pmod(F.xxhash64("block"), F.lit(64))).sortWithinPartitions("p", "q")
    return ready.mapInArrow(partly, "p int, q int, m binary").repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(wholly, "i_a long, i_b long, xy double")


def coexpression(X: DataFrame, cells: DataFrame, threshold: float = 0.4, k: int | None = 20) -> DataFrame:
    """Directed graph of strongest absolute correlations: ``source, target, weight``.

    A gene's ``k`` best include itself, as its own place is taken before it is left out;
    what is not above ``threshold`` goes.
    """
    r = correlation(X, cells).select(F.col("gene_a").alias("source"), F.col("gene_b").alias("target"), F.abs("r").alias("weight"))
    r = r.filter((F.col("weight") > threshold) | (F.col("source") == F.col("target")))  # those below come after all others
    if k:
        first = Window.partitionBy("source").orderBy((F.col("source") == F.col("target")).desc(), F.desc("weight"), "target")
        r = r.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r")
    return r.filter((F.col("source") != F.col("target")) & (F.col("weight") > threshold))


def annotation_graph(annotation: DataFrame, kind: str = "jaccard", threshold: float = 0.1, k: int | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Similarity graph of genes from ``annotation (gene, term)``, of the genes in ``genes`` if given."""
    chosen = annotation.join(genes.select("gene"), "gene", "left_semi") if genes is not None else annotation
    return project(chosen, kind, threshold, "gene", "term", k=k or None)
