"""Splits, samples and pairings: deterministic by a hash of seed and key.

Rows are ordered by ``md5(seed || ':' || key)``, so the same seed gives the same choice on
any engine and at any partitioning. Positions within large groups come from counts of hash
prefixes, not from one window over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.numbering import in_order


def hash_order(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def uniform(key: Column | str, seed: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the hash."""
    return (F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def positions(df: DataFrame, key: str, seed: int, groups: Sequence[str] = (), out: str = "position") -> DataFrame:
    """Number rows from 1 in hash order, within ``groups``.

    The hash's first two digits cut each group into 256 parts that are numbered apart and
    shifted by the sizes of the parts before, so no task holds a whole group.
    """
    marked = df.withColumn("_h", hash_order(key, seed)).withColumn("_part", F.substring("_h", 1, 2))
    cols = [F.col(g) for g in groups]
    sizes = marked.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*cols) if groups else Window.partitionBy(F.lit(1))
    starts = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(every).alias("_size"))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(*cols, "_part").orderBy("_h", key)
    numbered = marked.withColumn("_row", F.row_number().over(inner)).join(starts, on)
    return numbered.withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).withColumn(f"{out}_of", F.col("_size").cast("long")).select(*df.columns, out, f"{out}_of")


def places(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_place``: its number from 0 in the order of ``order``, of any sortable type.

    A null comes first, ties go by all other columns that can be sorted. See ``numbering.in_order``.
    """
    others = [c for c, kind in df.dtypes if c != order and "map<" not in kind and kind != "variant"]
    return in_order(df, [order, *others], "_place")


def split_cells(obs: DataFrame, test_size: float = 0.2, stratify: str | None = None, seed: int = 42, key: str = "cell", out: str = "split") -> DataFrame:
    """``train`` or ``test`` for every cell; test takes the size rounded up, in every stratum if asked."""
    placed = positions(obs, key, seed, [stratify] if stratify else [], "_pos")
    test = F.col("_pos") <= F.ceil(F.col("_pos_of") * F.lit(test_size))
    return placed.withColumn(out, F.when(test, "test").otherwise("train")).drop("_pos", "_pos_of")


def split_by_group(obs: DataFrame, group: str, test_size: float = 0.2, seed: int = 42, key: str = "cell", out: str = "split") -> DataFrame:
    """The same with test sizes rounded down in every group."""
    placed = positions(obs, key, seed, [group], "_pos")
    test = F.col("_pos") <= F.floor(F.col("_pos_of") * F.lit(test_size))
    return placed.withColumn(out, F.when(test, "test").otherwise("train")).drop("_pos", "_pos_of")


def _quota(n: int | None, frac: float | None, size: Column) -> Column:
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    return F.lit(n) if n is not None else F.floor(size * F.lit(frac))


def sample_cells(obs: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 42, key: str = "cell", replace: bool = False) -> DataFrame:
    """``n`` cells, or a share rounded down; with replacement a cell may come again (``draw`` tells)."""
    placed = positions(obs, key, seed, [], "_pos")
    if not replace:
        return placed.filter(F.col("_pos") <= _quota(n, frac, F.col("_pos_of"))).select(*obs.columns)
    total = obs.count()
    draws = obs.sparkSession.range(n if n is not None else int(total * frac)).select(F.col("id").alias("draw"))
    wanted = draws.withColumn("_w", F.floor(uniform("draw", seed) * total).cast("long") + 1)
    return wanted.join(placed, F.col("_w") == F.col("_pos")).select("draw", *obs.columns)


def sample_weighted(obs: DataFrame, weight: Column | str, n: int | None = None, frac: float | None = None, seed: int = 42, key: str = "cell", replace: bool = False) -> DataFrame:
    """Chances in proportion to weight. Without replacement, the highest ``ln(u) / weight``.

    With it, each ``draw`` falls on the cell whose stretch of the cumulated weights holds it;
    stretches are laid out in hash order, in parts that are cumulated apart.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    take = n if n is not None else int(obs.count() * frac)
    scored = obs.withColumn("_w", w.cast("double")).filter("_w > 0")
    if not replace:
        return scored.withColumn("_k", F.log(uniform(key, seed)) / F.col("_w")).orderBy(F.desc("_k"), key).limit(take).select(*obs.columns)
    marked = scored.withColumn("_h", hash_order(key, seed)).withColumn("_part", F.substring("_h", 1, 3))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 parts at most
    parts = marked.groupBy("_part").agg(F.sum("_w").alias("_size")).select("_part", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0.0)).alias("_from"))
    total = F.broadcast(parts.agg(F.sum("_size").alias("_total")))  # one row
    draws = obs.sparkSession.range(take).select(F.col("id").alias("draw")).crossJoin(total).withColumn("_at", uniform("draw", seed + 1) * F.col("_total"))
    known = F.broadcast(parts)  # bounded by the number of parts
    inside = draws.join(known, (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_size"))).select("_part", (F.col("_at") - F.col("_from")).alias("_edge"), "draw")
    order = Window.partitionBy("_part").orderBy("_h", key)
    starts = marked.withColumn("_edge", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w"))
    both = starts.select("_part", "_edge", F.lit(None).cast("long").alias("draw"), F.struct(*obs.columns).alias("_row")).unionByName(inside.withColumn("_row", F.lit(None).cast(obs.schema)))
    ahead = Window.partitionBy("_part").orderBy("_edge", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_row", F.last("_row", ignorenulls=True).over(ahead)).filter("draw IS NOT NULL").select("draw", "_row.*")


def sample_by_group(obs: DataFrame, group: str, n: int | None = None, frac: float | None = None, balance: bool = False, seed: int = 42, key: str = "cell", replace: bool = False) -> DataFrame:
    """From every group ``n`` cells (balance), a share of it, or its share of ``n``; rounded down.

    With replacement a group gives its whole quota, by drawn positions (``draw`` tells which).
    """
    placed = positions(obs, key, seed, [group], "_pos")
    if frac is not None or balance:
        quota = _quota(n, frac, F.col("_pos_of"))
    else:
        quota = F.floor(F.lit(float(n)) * F.col("_pos_of") / F.lit(float(obs.count())))
    if not replace:
        return placed.filter(F.col("_pos") <= quota).select(*obs.columns)
    # a row of a group stands for the draws of its own number, and of that plus the group's size, and so on
    rounds = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((quota - 1) / F.col("_pos_of"))).cast("long"))
    draws = placed.withColumn("_quota", quota).select(F.col(group).alias("_g"), "_quota", "_pos", "_pos_of", F.explode(rounds).alias("_k")).withColumn("draw", F.col("_pos") + F.col("_k") * F.col("_pos_of")).filter("draw <= _quota")
    wanted = draws.select("_g", (F.col("draw") - 1).alias("draw"), (F.floor(uniform(F.concat_ws(":", F.col("_g").cast("string"), F.col("draw").cast("string")), seed + 1) * F.col("_pos_of")) + 1).cast("long").alias("_want"))
    return wanted.join(placed, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_want") == F.col("_pos"))).select("draw", *obs.columns)


def parts_of(label: Column, controls: Sequence[str]) -> Column:
    """Genes of a label ``A+B`` without control names."""
    trimmed = F.filter(F.transform(F.split(label, r"\+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.array_except(trimmed, F.array(*(F.lit(c) for c in controls))) if controls else F.array_distinct(trimmed)))


def split_perturbations(perturbations: DataFrame, controls: Sequence[str] = (), kind: str = "simple", test_size: float = 0.2, val_size: float | None = None, train_gene_fraction: float = 0.7, seen: int = 0, seed: int = 42) -> DataFrame:
    """``perturbation, split`` for distinct ``perturbations (perturbation)``.

    ``simple``: sizes rounded down, rest train. ``no_test``: validation alone. ``simulation``:
    genes of single perturbations are split; singles follow their gene, combinations of two
    or more trained genes are split again, others and the rest are held out.
    ``simulation_single``: singles only. ``combo_seen``: combinations with exactly ``seen``
    trained genes are held out.
    """
    labels = perturbations.select("perturbation").distinct()
    if kind in ("simple", "no_test"):
        placed = positions(labels, "perturbation", seed, [], "_pos")
        n_test = F.floor(F.col("_pos_of") * F.lit(test_size if kind == "simple" else 0.0))
        n_val = F.floor(F.col("_pos_of") * F.lit(val_size or 0.0))
        return placed.select("perturbation", F.when(F.col("_pos") <= n_test, "test").when(F.col("_pos") <= n_test + n_val, "val").otherwise("train").alias("split"))
    marked = labels.withColumn("genes", parts_of(F.col("perturbation"), controls)).withColumn("combo", F.contains("perturbation", F.lit("+")))
    genes = positions(marked.filter("NOT combo").select(F.explode("genes").alias("gene")).distinct(), "gene", seed, [], "_pos")
    trained = genes.filter(F.col("_pos") <= F.floor(F.col("_pos_of") * F.lit(train_gene_fraction))).select("gene", F.lit(1).alias("_t"))
    counts = marked.select("perturbation", F.explode("genes").alias("gene")).join(trained, "gene", "left").groupBy("perturbation").agg(F.count("_t").alias("n_trained"), F.count("*").alias("n_genes"))
    told = marked.join(counts, "perturbation", "left").fillna(0, ["n_trained", "n_genes"])
    if kind == "combo_seen":
        state = F.when(F.col("combo") & (F.col("n_trained") == seen), "held").when(F.col("combo") | (F.col("n_trained") == F.col("n_genes")), "train").otherwise("out")
        told = told.withColumn("_state", state).filter("_state <> 'out'")
    elif kind in ("simulation", "simulation_single"):
        if kind == "simulation_single":
            told = told.filter("NOT combo")
        told = told.withColumn("_both", F.col("combo") & (F.col("n_trained") >= 2))
        told = positions(told, "perturbation", seed + 1, ["_both"], "_c")
        train = F.when(F.col("_both"), F.col("_c") <= F.floor(F.col("_c_of") * F.lit(train_gene_fraction))).otherwise(~F.col("combo") & (F.col("n_trained") == F.col("n_genes")))
        told = told.withColumn("_state", F.when(train, "train").otherwise("held"))
    else:
        raise ValueError("unknown kind of split")
    share = (val_size / (test_size + val_size)) if val_size else 0.0
    placed = positions(told.select("perturbation", "_state"), "perturbation", seed + 2, ["_state"], "_pos")
    return placed.select("perturbation", F.when(F.col("_state") == "train", "train").when(F.col("_pos") <= F.floor(F.col("_pos_of") * F.lit(share)), "val").otherwise("test").alias("split"))


def split_obs(obs: DataFrame, perturbation: str, controls: Sequence[str], ignored: Sequence[str] = (), **options) -> DataFrame:
    """``obs`` with a ``split`` by perturbation; controls and ignored labels are ``train``."""
    labels = obs.filter(~F.col(perturbation).isin([*controls, *ignored])).select(F.col(perturbation).alias("perturbation"))
    table = split_perturbations(labels, controls, **options).withColumnRenamed("perturbation", "_label")
    return obs.join(table, F.col(perturbation) == F.col("_label"), "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("_label")


def pair_controls(obs: DataFrame, perturbation: str, controls: Sequence[str], n: int = 1, stratify: str | None = None, ignored: Sequence[str] = (), seed: int = 42, key: str = "cell") -> DataFrame:
    """Control cells for every cell: ``cell, draw, control_cell``.

    A perturbed cell draws ``n`` controls with replacement, of its stratum if that has any,
    else of all; a control is its own; ignored and unlabelled cells have none (null).
    """
    is_control = F.col(perturbation).isin(list(controls))
    s = F.col(stratify).cast("string") if stratify else F.lit("")
    cells = obs.select(F.col(key).alias("cell"), F.coalesce(s, F.lit("")).alias("stratum"), is_control.alias("_c"), (~is_control & ~F.col(perturbation).isin(list(ignored) or ["\0"])).alias("_p"))
    pool = cells.filter("_c").select("cell", "stratum")
    everywhere = pool.select("cell", F.lit(None).cast("string").alias("stratum"))
    numbered = positions(pool.unionByName(everywhere), "cell", seed, ["stratum"], "_pos").select("stratum", F.col("cell").alias("control_cell"), "_pos")
    sizes = pool.groupBy("stratum").agg(F.count("*").alias("_size"))
    total = pool.agg(F.count("*").alias("_total"))
    draws = cells.select("cell", "stratum", "_c", F.coalesce("_p", F.lit(False)).alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    sized = draws.join(sizes, "stratum", "left").crossJoin(F.broadcast(total))
    u = uniform(F.concat_ws(":", "cell", "draw"), seed + 1)
    wanted = sized.withColumn("_pool", F.when(F.col("_size").isNotNull(), F.col("stratum"))).withColumn("_want", F.when(F.col("_p"), F.floor(u * F.coalesce("_size", "_total")).cast("long") + 1))
    found = wanted.join(numbered.withColumnRenamed("stratum", "_s"), F.col("_pool").eqNullSafe(F.col("_s")) & (F.col("_want") == F.col("_pos")), "left")
    return found.select("cell", F.col("draw").cast("long").alias("draw"), F.when(F.col("_c"), F.col("cell")).otherwise(F.col("control_cell")).alias("control_cell"))
