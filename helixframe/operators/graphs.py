"""Weighted graphs, bipartite maps, hierarchies and hypergraphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import blocks
from helixframe.operators.lineage import cut
from helixframe.operators.numbering import in_order


def numbered(names: DataFrame, column: str) -> DataFrame:
    """``token, idx`` from 0 in sorted order, counted range by range."""
    distinct = names.select(F.col(column).cast("string").alias("token")).filter("token IS NOT NULL").distinct()
    return in_order(distinct, ["token"], "idx")


def graph_from_table(df: DataFrame, source: str = "source", target: str = "target", weight: str | None = "weight", default_weight: float = 1.0, undirected: bool = True) -> DataFrame:
    """``source, target, weight``; missing weights get the default, missing reverse edges are added."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(default_weight)) if weight and weight in df.columns else F.lit(default_weight)
    edges = df.select(F.col(source).alias("source"), F.col(target).alias("target"), w.alias("weight"))
    if not undirected:
        return edges
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight").filter("source <> target")
    return edges.unionByName(back.join(edges.select("source", "target"), ["source", "target"], "left_anti"))


def with_numbers(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Names at both ends replaced by numbers; edges with an unknown end go."""
    a, b = vocab.select(F.col("token").alias("source"), F.col("idx").alias("_a")), vocab.select(F.col("token").alias("target"), F.col("idx").alias("_b"))
    return edges.join(a, "source").join(b, "target").select(F.col("_a").alias("source"), F.col("_b").alias("target"), "weight")


def with_names(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    a, b = vocab.select(F.col("idx").alias("source"), F.col("token").alias("_a")), vocab.select(F.col("idx").alias("target"), F.col("token").alias("_b"))
    return edges.join(a, "source", "left").join(b, "target", "left").select(F.col("_a").alias("source"), F.col("_b").alias("target"), "weight")


def subgraph(edges: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """Edges with both ends in ``nodes``."""
    keep = nodes.select(F.col(column).alias("_n")).distinct()
    return edges.join(keep, F.col("source") == F.col("_n"), "left_semi").join(keep, F.col("target") == F.col("_n"), "left_semi")


def shared(edges: DataFrame, vocab: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A numbered graph cut to the tokens that ``other`` has too, numbered anew: edges and vocabulary."""
    both = vocab.join(other.select("token"), "token", "left_semi")
    new = in_order(both.select("idx", "token"), ["idx"], "_new").select(F.col("_new").alias("idx"), "token")
    return with_numbers(with_names(edges, vocab), new), new


def neighbors(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Sorted targets of each ``node`` asked for; an empty list where there are none."""
    found = edges.groupBy(F.col("source").alias("node")).agg(F.sort_array(F.collect_list("target")).alias("neighbors"))
    empty = F.array().cast(found.schema["neighbors"].dataType)
    return queries.select("node").join(found, "node", "left").select("node", F.coalesce("neighbors", empty).alias("neighbors"))


def neighbor_weights(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Weights of each ``node``'s edges, in the order of ``neighbors``; an empty list where there are none."""
    found = edges.groupBy(F.col("source").alias("node")).agg(F.sort_array(F.collect_list(F.struct("target", F.col("weight").cast("double").alias("weight")))).alias("e"))
    return queries.select("node").join(found, "node", "left").select("node", F.coalesce(F.col("e.weight"), F.array().cast("array<double>")).alias("weights"))


def edge_weight(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Weight of each ``source, target`` asked for, 0 where there is no edge."""
    first = edges.groupBy("source", "target").agg(F.first("weight").alias("weight"))
    return queries.select("source", "target").join(first, ["source", "target"], "left").fillna(0.0, ["weight"])


def degree(edges: DataFrame, nodes: DataFrame, end: str = "source", weighted: bool = False) -> DataFrame:
    """Edges, or their weights, at each node of ``nodes (node)``; 0 where there are none."""
    amount = F.sum("weight") if weighted else F.count("*").cast("double")
    counts = edges.groupBy(F.col(end).alias("node")).agg(amount.alias("degree"))
    return nodes.select("node").join(counts, "node", "left").fillna(0.0, ["degree"])


def adjacency(edges: DataFrame) -> DataFrame:
    """Repeated edges summed into one entry."""
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def unique_edges(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Bipartite edges without repeats; weights of repeats add up."""
    return adjacency(edges) if weighted else edges.select("source", "target").distinct()


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *(c for c in edges.columns if c not in ("source", "target")))


def from_adjacency(lists: DataFrame) -> DataFrame:
    """Edges of ``(source, neighbors)``."""
    return lists.select("source", F.explode("neighbors").alias("target"))


def map_properties(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row saying what kind of map the edges are between ``sources (node)`` and ``targets (node)``."""
    pairs = unique_edges(edges).withColumn("weight", F.lit(1.0))
    s = degree(pairs, sources).agg(F.coalesce(F.bool_and(F.col("degree") == 1), F.lit(True)).alias("is_total_function"), F.coalesce(F.bool_and(F.col("degree") <= 1), F.lit(True)).alias("is_partial_function"), F.count("*").alias("_s"))
    t = degree(pairs, targets, "target").agg(F.coalesce(F.bool_and(F.col("degree") <= 1), F.lit(True)).alias("_one"), F.coalesce(F.bool_and(F.col("degree") >= 1), F.lit(True)).alias("_onto"), F.count("*").alias("_t"))
    f = F.col("is_total_function")
    return s.crossJoin(t).select(f.alias("is_function"), f, "is_partial_function", (f & F.col("_one")).alias("is_injective"), (f & F.col("_onto")).alias("is_surjective"), (f & F.col("_one") & F.col("_onto") & (F.col("_s") == F.col("_t"))).alias("is_bijective"))


def function_mapping(edges: DataFrame) -> DataFrame:
    """``source, target`` where every source has one target; raises otherwise."""
    pairs = unique_edges(edges)
    if not pairs.groupBy("source").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a source has two targets")
    return pairs


def inverse_mapping(edges: DataFrame) -> DataFrame:
    """``target, sources`` for targets that have any."""
    return edges.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges from the sources of one map to the targets of the next."""
    return first.select("source", F.col("target").alias("_m")).join(second.select(F.col("source").alias("_m"), "target"), "_m").select("source", "target").distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return _nodes(edges).join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return _nodes(edges).join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


class _Chains:
    """A hierarchy with its chains taken together.

    An inner node has one parent and one child. Each finds the first inner node of its chain by
    pointer jumping, so a chain of n nodes takes about log2(n) rounds and becomes one edge.
    ``inner (node, head, pos)`` numbers a chain's nodes from 1; ``edges (parent, child, weight,
    head)`` join the other nodes, over a chain where ``head`` is not null. ``closed`` is true
    where a chain has no first node, which is a cycle.
    """

    def __init__(self, edges: DataFrame, upward: bool = False):
        a, b = ("child", "parent") if upward else ("parent", "child")
        self.steps = cut(edges.select(F.col(a).alias("parent"), F.col(b).alias("child")).distinct())
        below = self.steps.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_d"), F.min("child").alias("down"))
        above = self.steps.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("_u"), F.min("parent").alias("up"))
        single = cut(above.filter("_u = 1").join(below.filter("_d = 1"), "node").select("node", "up", "down"))
        names = single.select(F.col("node").alias("_n"))
        found = cut(single.join(names, F.col("up") == F.col("_n"), "left").select("node", "up", "down", F.coalesce("_n", "node").alias("head"), F.when(F.col("_n").isNull(), 0).otherwise(1).cast("long").alias("pos")))
        size, rounds, self.closed = found.count(), 0, False
        while size and not self.closed:
            rounds += 1
            before = found.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("pos").alias("_p"))
            found = cut(found.join(before, "head").select("node", "up", "down", F.col("_h").alias("head"), (F.col("pos") + F.col("_p")).alias("pos"), (F.col("_h") != F.col("head")).alias("_on")))
            if found.filter("_on").isEmpty():
                break
            self.closed = 1 << rounds > 4 * size
        self.inner = found.select("node", "head", (F.col("pos") + 1).alias("pos"))
        first = found.filter("node = head").select("head", F.col("up").alias("parent"))
        last = found.join(names, F.col("down") == F.col("_n"), "left_anti").select("head", F.col("down").alias("child"), (F.col("pos") + 2).alias("weight"))
        plain = self.steps.join(names, F.col("parent") == F.col("_n"), "left_anti").join(names, F.col("child") == F.col("_n"), "left_anti").withColumn("weight", F.lit(1).cast("long"))
        over = first.join(last, "head").select("parent", "child", "weight", "head")
        self.edges = cut(plain.withColumn("head", F.lit(None).cast(over.schema["head"].dataType)).unionByName(over))
        self.heads = over.select("head", F.col("parent").alias("anchor"), F.col("child").alias("end"))


def levels(edges: DataFrame) -> DataFrame:
    """Shortest and longest distance of every node from a root: ``node, level, depth``.

    Chains are edges of their length (see ``_Chains``); then one join for each level that is
    left, of the nodes whose distances changed. A longer path than there are nodes is a cycle.
    """
    chains = _Chains(edges)
    cycle = ValueError("the hierarchy has a cycle")
    if chains.closed:
        raise cycle
    hops = chains.edges.groupBy("parent", "child").agg(F.min("weight").alias("short"), F.max("weight").alias("long"))
    hops, size = cut(hops), _nodes(chains.edges).count()
    state = cut(roots(chains.edges).select("node", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("depth")))
    frontier, rounds = state, 0
    while not frontier.isEmpty():
        rounds += 1
        if rounds > size:
            raise cycle
        met = frontier.join(hops, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.min(F.col("level") + F.col("short")).alias("_l"), F.max(F.col("depth") + F.col("long")).alias("_d"))
        merged = state.join(met, "node", "full")
        better = F.col("level").isNull() | (F.col("_l") < F.col("level")) | (F.col("_d") > F.col("depth"))
        state = cut(merged.select("node", F.least("level", "_l").alias("level"), F.greatest("depth", "_d").alias("depth"), (F.col("_l").isNotNull() & better).alias("_new")))
        frontier, state = state.filter("_new").drop("_new"), state.drop("_new")
    if state.count() < size:
        raise ValueError("the hierarchy has a cycle: some nodes are not under a root")
    at = state.select(F.col("node").alias("anchor"), "level", "depth")
    inside = chains.inner.join(chains.heads, "head").join(at, "anchor").select("node", (F.col("level") + F.col("pos")).alias("level"), (F.col("depth") + F.col("pos")).alias("depth"))
    return state.unionByName(inside).select("node", F.col("level").cast("int").alias("level"), F.col("depth").cast("int").alias("depth"))


def is_acyclic(edges: DataFrame) -> bool:
    """Whether taking chains together, then nodes without parents again and again, leaves nothing."""
    chains = _Chains(edges)
    if chains.closed:
        return False
    left, before = chains.edges.select("parent", "child").distinct(), -1
    while (count := left.count()) != before:
        before = count
        left = cut(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"))
    return count == 0


def reachable(edges: DataFrame, start: DataFrame, upward: bool = False) -> DataFrame:
    """All nodes below (or above) each ``node`` of ``start``, without itself: ``node, other``.

    The search goes over chains as single edges (see ``_Chains``) and adds what lies inside of
    those it met; a start inside a chain goes on from the chain's end.
    """
    chains = _Chains(edges, upward)
    asked = start.select("node").distinct()
    steps = (chains.steps if chains.closed else chains.edges).select(F.col("parent").alias("_a"), F.col("child").alias("_b")).distinct()
    if chains.closed:
        placed = asked.select("node", F.lit(None).cast("long").alias("pos"), F.col("node").alias("end"))
        frontier = asked.select("node", F.col("node").alias("other"))
    else:
        placed = cut(asked.join(chains.inner, "node", "left").join(chains.heads.select("head", "end"), "head", "left"))
        frontier = placed.select("node", F.coalesce("end", "node").alias("other"))
    found = frontier = cut(frontier)
    while True:
        new = frontier.join(steps, F.col("other") == F.col("_a")).select("node", F.col("_b").alias("other")).distinct()
        frontier = cut(new.join(found, ["node", "other"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    if not chains.closed:
        members = chains.inner.select("head", F.col("node").alias("other"), F.col("pos").alias("_p"))
        through = found.join(chains.heads.select(F.col("anchor").alias("other"), "head"), "other").select("node", "head").join(members, "head").select("node", "other")
        behind = placed.filter("pos IS NOT NULL").join(members, "head").filter("_p > pos").select("node", "other")
        found = found.unionByName(through).unionByName(behind).distinct()
    return found.filter("node <> other")


def has_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, target, connected`` for the pairs asked for; a node does not reach itself."""
    below = reachable(edges, pairs.select(F.col("source").alias("node")).distinct())
    found = below.select(F.col("node").alias("source"), F.col("other").alias("target"), F.lit(True).alias("connected"))
    return pairs.select("source", "target").join(found, ["source", "target"], "left").fillna(False, ["connected"])


def nodes_at_level(edges: DataFrame, level: int) -> DataFrame:
    return levels(edges).filter(F.col("level") == level).select("node")


def topological_order(edges: DataFrame) -> DataFrame:
    """Nodes with their depth, parents before children."""
    return levels(edges).select("node", "depth").orderBy("depth", "node")


def dag_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, roots, leaves, highest level and depth, mean children."""
    table = levels(edges).agg(F.count("*").alias("n_nodes"), F.max("level").alias("max_level"), F.max("depth").alias("max_depth"))
    n = edges.agg(F.count("*").alias("n_edges"))
    r, l_ = roots(edges).agg(F.count("*").alias("n_roots")), leaves(edges).agg(F.count("*").alias("n_leaves"))
    out = table.crossJoin(n).crossJoin(r).crossJoin(l_)  # a row each
    return out.withColumn("avg_children", F.col("n_edges") / F.col("n_nodes"))


def incidence(hyperedges: DataFrame) -> DataFrame:
    """``edge_id, node`` of ``hyperedges (edge_id, participants)``."""
    return hyperedges.select("edge_id", F.explode("participants").alias("node")).distinct()


def undirected_edges(hyperedges: DataFrame) -> DataFrame:
    """Edges whose identity is their sorted participants; repeats go."""
    return hyperedges.withColumn("participants", F.array_sort("participants")).dropDuplicates(["participants"])


#: Kinds of an edge that meet in one task, and nodes of a kind that are written out in one.
_CHUNK = 1024


def _kinds(hyperedges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes in the same edges are of one kind: ``node, kind``, ``kind, m, edges`` with its nodes counted and its edges numbered, and ``edge_id, e``."""
    a = cut(incidence(hyperedges))
    edges = cut(a.select("edge_id").distinct().withColumn("e", F.monotonically_increasing_id()))
    of = cut(a.join(edges, "edge_id", "left").groupBy("node").agg(F.sort_array(F.collect_list("e")).alias("edges")))
    kinds = cut(of.groupBy("edges").agg(F.count("*").alias("m")).withColumn("kind", F.monotonically_increasing_id()))
    return cut(of.join(kinds.select("edges", "kind"), "edges").select("node", "kind")), kinds, edges


def _meetings(own: DataFrame, kinds: DataFrame, every: bool = False) -> DataFrame:
    """Each kind of ``own`` with each of ``kinds`` that shares an edge, itself too: ``a, b, m, e``, at their first common edge or at every.

    Both sides carry their edges, so nothing has to be made distinct. The kinds of an edge are
    dealt to chunks and a pair of chunks is a key, so an edge of very many kinds is many tasks.
    """
    opened = kinds.select("kind", "m", "edges", F.explode("edges").alias("e"))
    chunks = opened.groupBy("e").agg(F.ceil(F.count("*") / _CHUNK).alias("n"))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    left = own.select(F.col("kind").alias("a"), F.col("edges").alias("_a"), F.explode("edges").alias("e")).join(chunks, "e").select("e", "a", "_a", F.pmod(F.xxhash64("a"), "n").alias("x"), F.explode(numbers).alias("y"))
    right = opened.select(F.col("kind").alias("b"), "m", F.col("edges").alias("_b"), "e").join(chunks, "e").select("e", "b", "m", "_b", F.pmod(F.xxhash64("b"), "n").alias("y"), F.explode(numbers).alias("x"))
    met = left.join(right, ["e", "x", "y"])
    first = met if every else met.filter(F.get(F.array_intersect("_a", "_b"), F.lit(0)) == F.col("e"))
    return first.select("a", "b", "m", "e")


def _written(pairs: DataFrame, left: DataFrame, right: DataFrame, more: list[str]) -> DataFrame:
    """Pairs of kinds (``a, b`` and ``more``) as pairs of their nodes: ``source, target``, none with itself.

    Nodes of a kind are dealt to chunks on both sides, so two large kinds are many tasks; pairs
    of nodes leave the task that makes them only as a result. Sources meet a chunk of targets
    in a hash join, as it writes a row in a tenth of the time that opening a list takes.
    """
    sizes = right.groupBy("kind").agg(F.ceil(F.count("*") / _CHUNK).alias("_c"))
    targets = right.join(sizes, "kind").select(F.col("kind").alias("b"), F.pmod(F.xxhash64("node"), "_c").alias("y"), F.col("node").alias("target"))
    chunks = left.groupBy("kind").agg(F.ceil(F.count("*") / _CHUNK).alias("_c"))
    lists = left.join(chunks, "kind").groupBy(F.col("kind").alias("a"), F.pmod(F.xxhash64("node"), "_c").alias("x")).agg(F.collect_list("node").alias("_s"))
    both = pairs.join(lists, "a").join(sizes.select(F.col("kind").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("y")), "b")
    tasks = _tasks(pairs)
    spread = both.repartition(tasks, "b", "y").select("b", "y", F.explode("_s").alias("source"), *more)
    met = spread.join(targets.repartition(tasks, "b", "y").hint("shuffle_hash"), ["b", "y"])
    return met.select("source", "target", *more).filter("source <> target")


def _tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def co_participants(hyperedges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Nodes that share an edge: ``node, neighbor``; of the nodes ``asked (node)`` only, if given.

    Nodes in the same edges are one kind; kinds meet first, and pairs of nodes are written from
    pairs of kinds without being made distinct. Only edges of nodes that are asked for are
    opened, and the pairs of others are never written.
    """
    of, kinds, _ = _kinds(hyperedges)
    own = of if asked is None else of.join(asked.select("node").distinct(), "node", "left_semi")
    opened = kinds if asked is None else kinds.join(own.select("kind"), "kind", "left_semi")
    return _written(_meetings(opened, kinds).select("a", "b"), own, of, []).select(F.col("source").alias("node"), F.col("target").alias("neighbor"))


def co_degrees(hyperedges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``node, degree``: how many nodes share an edge with each node (of those asked for), 0 where none does.

    Nodes in the same edges have the same neighbours, so they are counted as one kind, and a
    kind's edges are opened once; an edge of a million nodes is not opened for each of them.
    Kinds that meet are added up where they meet and not written. Where edges hold so many kinds
    that most pairs of them meet, blocks of kinds and nodes are counted instead
    (``blocks.touching``).
    """
    of, kinds, _ = _kinds(hyperedges)
    wanted = of if asked is None else asked.select("node").distinct().join(of, "node", "left")
    opened = kinds if asked is None else kinds.join(wanted.select("kind"), "kind", "left_semi")
    meeting = [k.select(F.explode("edges").alias("e")).groupBy("e").agg(F.count("*").alias(n)) for k, n in ((opened, "_a"), (kinds, "_b"))]
    pairs = meeting[0].join(meeting[1], "e").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    if blocks.worth(pairs, opened.count(), of.count()):
        sets = of.join(kinds.select("kind", F.col("edges").alias("set")), "kind").select("node", "set")
        met = blocks.touching(opened.select("kind", F.col("edges").alias("set")), sets, "kind", "node")
        found = met.groupBy("kind").agg((F.sum("n") - 1).alias("degree"))  # without itself
    else:
        found = _meetings(opened, kinds).groupBy(F.col("a").alias("kind")).agg((F.sum("m") - 1).alias("degree"))
    return wanted.join(found, "kind", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def clique_expansion(hyperedges: DataFrame, weight: str | None = None, default: float = 1.0) -> DataFrame:
    """Symmetric weighted edges between participants, weights of shared edges added up.

    They are added up for kinds of nodes in the same edges and written for their nodes.
    """
    w = hyperedges.select("edge_id", (F.coalesce(F.col(weight).cast("double"), F.lit(default)) if weight else F.lit(default)).alias("w"))
    of, kinds, edges = _kinds(hyperedges)
    weights = edges.join(w, "edge_id").groupBy("e").agg(F.sum("w").alias("w"))
    pairs = _meetings(kinds, kinds, True).join(weights, "e").groupBy("a", "b").agg(F.sum("w").alias("weight"))
    return _written(pairs, of, of, ["weight"])
