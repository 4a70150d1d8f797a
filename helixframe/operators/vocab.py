"""Vocabularies ``(idx, token)``, gene maps, and lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.numbering import in_order

UNKNOWN, MISSING = "<unk>", -1
POLICIES = ("error", "first", "last", "remove")


def deduplicated(tokens: DataFrame, policy: str = "error", key: str = "token", order: str = "idx") -> DataFrame:
    """Rows with repeated keys handled by ``policy``: raise, keep the first or last, or drop all."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    same = Window.partitionBy(key)
    counted = tokens.withColumn("_n", F.count("*").over(same))
    if policy == "error":
        if not counted.filter("_n > 1").isEmpty():
            raise ValueError("repeated tokens")
        return tokens
    if policy == "remove":
        return counted.filter("_n = 1").drop("_n")
    direction = F.asc(order) if policy == "first" else F.desc(order)
    return counted.withColumn("_r", F.row_number().over(same.orderBy(direction))).filter("_r = 1").drop("_n", "_r")


def renumbered(vocab: DataFrame) -> DataFrame:
    """The same order with numbers from 0, counted range by range."""
    return in_order(vocab.select("idx", "token"), ["idx", "token"], "_new").select(F.col("_new").alias("idx"), "token")


def vocabulary(tokens: DataFrame, policy: str = "error", drop_empty: bool = False) -> DataFrame:
    """A vocabulary of ``tokens (idx, token)``; empty and null tokens raise or go."""
    empty = F.col("token").isNull() | (F.trim("token") == "")
    if not drop_empty and not tokens.filter(empty).isEmpty():
        raise ValueError("empty tokens")
    return renumbered(deduplicated(tokens.filter(~empty), policy))


def lookup_indices(queries: DataFrame, vocab: DataFrame, fallback: int = MISSING) -> DataFrame:
    """``queries`` with ``idx`` of their ``token``; unknown tokens get the fallback."""
    return queries.join(vocab.select("token", "idx"), "token", "left").withColumn("idx", F.coalesce("idx", F.lit(fallback)))


def lookup_tokens(queries: DataFrame, vocab: DataFrame, fallback: str = UNKNOWN) -> DataFrame:
    return queries.join(vocab.select("token", "idx"), "idx", "left").withColumn("token", F.coalesce("token", F.lit(fallback)))


def intersection(vocab: DataFrame, other: DataFrame) -> DataFrame:
    """Tokens also in ``other``, in their own order."""
    return renumbered(vocab.join(other.select("token"), "token", "left_semi"))


def union(vocab: DataFrame, other: DataFrame) -> DataFrame:
    """Own tokens, then those only in ``other``."""
    new = other.join(vocab.select("token"), "token", "left_anti").select(F.lit(1).alias("_o"), "idx", "token")
    both = vocab.select(F.lit(0).alias("_o"), "idx", "token").unionByName(new)
    return in_order(both, ["_o", "idx", "token"], "_new").select(F.col("_new").alias("idx"), "token")


def selected(vocab: DataFrame, keep: DataFrame, keep_order: bool = True, minimum: int = 1) -> DataFrame:
    """Tokens listed in ``keep (idx, token)``, in own or given order; too few raise."""
    found = vocab.select("idx", "token").join(keep.select("token"), "token", "left_semi") if keep_order else keep.select("idx", "token").join(vocab.select("token"), "token", "left_semi")
    if found.limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} tokens are left")
    return renumbered(found)


def filtered(vocab: DataFrame, condition: Column | str) -> DataFrame:
    return renumbered(vocab.filter(condition))


def standardized_tokens(vocab: DataFrame, mapping: DataFrame, policy: str = "first") -> DataFrame:
    """Tokens replaced by ``mapping (token, standard)`` where listed, repeats handled after."""
    mapped = vocab.join(mapping, "token", "left").select("idx", F.coalesce("standard", "token").alias("token"))
    return renumbered(deduplicated(mapped, policy))


def align_genes(X: DataFrame, var: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A matrix over the genes of ``targets (idx, token)``: entries renumbered, and the gene table.

    ``var (gene, gene_name)``. Genes that the matrix lacks stay empty, which is the fill value
    0; ``filled`` writes any other. The gene table says which genes are virtual.
    """
    known = targets.join(var.select(F.col("gene_name").alias("token"), "gene"), "token", "left")
    entries = X.join(known.filter("gene IS NOT NULL").select("gene", "idx"), "gene").select("cell", F.col("idx").alias("gene"), "value")
    return entries, known.select(F.col("idx").alias("gene"), F.col("token").alias("gene_name"), F.col("gene").isNull().alias("is_virtual"))


def filled(entries: DataFrame, genes: DataFrame, obs: DataFrame, fill: float) -> DataFrame:
    """The entries and, for virtual genes, ``fill`` in every cell."""
    virtual = obs.select("cell").crossJoin(genes.filter("is_virtual").select("gene"))
    return entries.unionByName(virtual.select("cell", "gene", F.lit(fill).alias("value")))


def checked_gene_map(aliases: DataFrame, ids: DataFrame) -> None:
    """Raise unless ``aliases (alias, symbol)`` is a function onto all symbols, and
    ``ids (symbol, id)`` gives each of them one id of its own."""
    bad = {
        "an alias has two symbols": aliases.groupBy("alias").agg(F.countDistinct("symbol").alias("n")).filter("n <> 1"),
        "a symbol has two ids": ids.groupBy("symbol").agg(F.countDistinct("id").alias("n")).filter("n <> 1"),
        "an id has two symbols": ids.groupBy("id").agg(F.countDistinct("symbol").alias("n")).filter("n <> 1"),
        "a symbol has no alias": ids.join(aliases, "symbol", "left_anti"),
        "a symbol has no id": aliases.join(ids, "symbol", "left_anti"),
    }
    for what, rows in bad.items():
        if not rows.isEmpty():
            raise ValueError(what)


def gene_records(queries: DataFrame, aliases: DataFrame, ids: DataFrame, by: str = "alias") -> DataFrame:
    """Record of each ``query`` by alias, symbol or id: ``query, symbol, id, aliases``, nulls where unknown."""
    lists = aliases.groupBy("symbol").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    genes = ids.join(lists, "symbol", "left")
    key = aliases.select(F.col("alias").alias("query"), "symbol").distinct() if by == "alias" else ids.select(F.col("symbol" if by == "symbol" else "id").alias("query"), "symbol")
    return queries.select("query").join(key, "query", "left").join(genes, "symbol", "left").select("query", "symbol", "id", "aliases")


def coverage(aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of counts of a gene map."""
    a = aliases.agg(F.countDistinct("alias").alias("n_aliases"), F.count("*").alias("n_alias_edges"), F.countDistinct("symbol").alias("n_symbols"))
    i = ids.agg(F.countDistinct("id").alias("n_ids"), F.count("*").alias("n_id_edges"))
    return a.crossJoin(i).withColumn("aliases_per_symbol", F.col("n_aliases") / F.col("n_symbols"))  # a row each
