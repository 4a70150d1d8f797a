"""Very many sets held against each other: blocks of them meet in a task, which goes through them with arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.lineage import cut

#: Sets of a block on the left and on the right, and members of either. The names of a right block fit a dictionary of a Parquet page if they are numbers.
_ROWS, _COLUMNS, _MEMBERS = 32_768, 120_000, 4_000_000
#: Candidate pairs from which blocks are gone through, and how many pairs of a block take as long as a candidate of a join.
_PAIRS, _RATIO = 1_000_000, 1000


def worth(candidates: int, left: int, right: int) -> bool:
    """Whether holding all sets against each other is quicker than joining so many candidate pairs."""
    return candidates > _PAIRS and candidates * _RATIO > left * right


def _parts(sets: DataFrame, size: int) -> int:
    found = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("set").cast("long")), F.lit(0)).alias("members")).first()
    return max(1, -(-found["n"] // size), -(-found["members"] // _MEMBERS))


def _packed(sets: DataFrame, parts: int, by: str, *order: str | Column) -> DataFrame:
    """``sets (set, ...)`` dealt to parts by a column, and sorted by ``order``: a row a part, in a partition of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(pa.Table.from_batches(held).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["part"])

    return cut(sets.repartition(parts, by).sortWithinPartitions(*order).mapInArrow(pack, "part binary"))


def meet(left: DataFrame, right: DataFrame, left_by: str, right_by: str, step: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``step`` makes of each block of ``left`` with each of ``right``, a pair of blocks a task.

    Blocks are bounded by their rows and by the members of their sets. Those of ``left`` come
    sorted by the sizes of sets and ``left_by``, those of ``right`` by ``right_by``.
    """

    def opened(part: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(part.as_buffer()).read_all().combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from step(opened(batch.column(0)[k]), opened(batch.column(1)[k]))

    parts, tasks = _parts(right, _COLUMNS), max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a, b = _packed(left, max(_parts(left, _ROWS), -(-2 * tasks // parts)), left_by, F.size("set"), left_by).toDF("a"), _packed(right, parts, right_by, right_by).toDF("b")
    # neither side may be broadcast, as both grow with the input
    return a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(run, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _lists(sets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and members of a column of sets."""
    lists = _whole(sets)
    return lists.value_lengths().to_numpy(), lists.flatten().to_numpy()


class _Turned:
    """A block's sets turned: of each member the places of the sets that hold it, as a whole row of ``dense`` where they are many.

    A row takes no more than 64 bytes a place, so all take memory as the block's members do.
    """

    def __init__(self, sets: pa.ChunkedArray, kind: type, bits: bool = False):
        self.sizes, members = _lists(sets)
        self.width = -(-len(self.sizes) // 64) * 64
        order = np.argsort(members, kind="stable")
        places = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.ids, starts = np.unique(members[order], return_index=True)
        ends = np.r_[starts[1:], len(members)].astype(int)
        many = np.flatnonzero((ends - starts) * 64 >= (self.width // 8 if bits else self.width * np.dtype(kind).itemsize))
        self.rows: list[np.ndarray] = [places[a:b] for a, b in zip(starts, ends, strict=True)]
        self.dense = np.zeros(len(self.ids), bool)
        self.dense[many] = True
        self.dense = self.dense.tolist()
        for k in many:
            row = np.zeros(self.width, np.uint8 if bits else kind)
            row[self.rows[k]] = 1
            self.rows[k] = np.packbits(row, bitorder="little").view(np.uint64) if bits else row

    def places(self, sets: pa.ChunkedArray) -> tuple[np.ndarray, Iterator[tuple[list[np.ndarray], list[np.ndarray]]]]:
        """Sizes of other sets, and of each the dense rows and the places of its members."""
        sizes, members = _lists(sets)
        at = np.minimum(np.searchsorted(self.ids, members), max(0, len(self.ids) - 1))
        known = self.ids[at] == members if len(self.ids) else np.zeros(len(members), bool)
        ends = np.cumsum(sizes)

        def each() -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
            for a, b in zip(ends - sizes, ends, strict=True):
                found = at[a:b][known[a:b]].tolist()
                yield [self.rows[i] for i in found if self.dense[i]], [self.rows[i] for i in found if not self.dense[i]]

        return sizes, each()


def _summed(ufunc: np.ufunc, rows: list[np.ndarray], out: np.ndarray) -> None:
    if len(rows) < 2:
        out[:] = rows[0] if rows else 0
        return
    ufunc(rows[0], rows[1], out=out)
    for row in rows[2:]:
        ufunc(out, row, out=out)


def touching(left: DataFrame, right: DataFrame, left_by: str, right_by: str) -> DataFrame:
    """``left_by, n``: how many sets of ``right (right_by, set)`` share a member with each of ``left (left_by, set)``, a row a block of ``right``."""

    def step(rows: pa.Table, columns: pa.Table) -> Iterator[pa.RecordBatch]:
        turned = _Turned(columns["set"], np.uint8, bits=True)
        out, met = np.empty(turned.width // 64, np.uint64), []
        for dense, others in turned.places(rows["set"])[1]:
            _summed(np.bitwise_or, dense, out)
            n = int(np.bitwise_count(out).sum())
            if others:
                p = np.unique(np.concatenate(others))
                n += int(np.count_nonzero((out[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 0))
            met.append(n)
        yield pa.RecordBatch.from_arrays([_whole(rows[left_by]), pa.array(met, pa.int64())], [left_by, "n"])

    kind = left.schema[left_by].dataType.simpleString()
    return meet(left, right, left_by, right_by, step, f"{left_by} {kind}, n long")


#: Of each built-in similarity: itself, and the common members at it, of common members or a similarity and both sizes.
_KNOWN: dict[str, tuple[Callable, Callable]] = {
    "jaccard": (lambda c, a, b: c / (a + b - c), lambda t, a, b: t * (a + b) / (1 + t)),
    "overlap": (lambda c, a, b: c / np.minimum(a, b), lambda t, a, b: t * np.minimum(a, b)),
    "cosine": (lambda c, a, b: c / np.sqrt(a * b), lambda t, a, b: t * np.sqrt(a * b)),
}


class _Counted:
    """Common members of sets with all sets of a block, one set after another."""

    def __init__(self, kind: str, rows: pa.Table, columns: pa.Table):
        smaller = min(_lists(t["set"])[0].max(initial=0) for t in (rows, columns))
        self.dtype = np.uint8 if smaller < 1 << 8 else np.uint16 if smaller < 1 << 16 else np.uint32
        self.turned = _Turned(columns["set"], self.dtype)
        self.found = np.empty(self.turned.width, self.dtype)
        self._hit = np.empty(self.turned.width, bool)
        self.sizes, self.code = np.unique(self.turned.sizes, return_inverse=True)
        self._at = _KNOWN[kind][1]
        self._rows, self._n, self._needs = rows, -1, {}

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Number and size of each set, while ``found`` holds its common members with the block's."""
        sizes, places = self.turned.places(self._rows["set"])
        for k, (n, (dense, others)) in enumerate(zip(sizes.tolist(), places, strict=True)):
            _summed(np.add, dense, self.found)
            for p in others:
                self.found[p] += 1
            if n != self._n:
                self._n, self._needs = n, {}
            yield k, n

    def above(self, threshold: float) -> np.ndarray:
        """Places of the sets that are as similar to the present one as ``threshold``, by a hair less too."""
        need = self._needs.get(threshold)
        if need is None:
            most = np.iinfo(self.dtype).max
            least = np.floor(self._at(threshold, float(self._n), self.sizes.astype(float)) - 1e-9) + 1
            need = self._needs[threshold] = np.full(self.turned.width, most, self.dtype)
            need[: len(self.code)] = np.clip(least, 1, most).astype(self.dtype)[self.code]
        np.greater_equal(self.found, need, out=self._hit)
        held = self._hit.view(np.uint64)
        words = np.flatnonzero(held != 0)  # most hold none
        inside = np.flatnonzero(held.take(words).view(bool))
        return words[inside >> 3] * 8 + (inside & 7)


def _round(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark does: half up, of the shortest decimals that tell a number."""
    unit = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) for x in values.tolist()], dtype=float)


def alike(left: DataFrame, right: DataFrame, kind: str, threshold: float, digits: int | None = None) -> DataFrame:
    """``source, target, weight``: sources of ``left (at, set, sources)`` and ``s`` of ``right (s, set)`` whose sets are similar above ``threshold``, a source with itself too."""
    form = _KNOWN[kind][0]

    def step(rows: pa.Table, columns: pa.Table) -> Iterator[pa.RecordBatch]:
        counted, names, sources = _Counted(kind, rows, columns), _whole(columns["s"]), _whole(rows["sources"])
        ends, members = np.cumsum(sources.value_lengths().to_numpy()).tolist(), sources.flatten()
        held, size, last, weights = [], 0, -1, np.empty(0)

        def written() -> pa.RecordBatch:
            who, at, weight = ([x[k] for x in held] for k in range(3))
            source = np.repeat(np.array(who), [len(x) for x in at])
            return pa.RecordBatch.from_arrays([members.take(pa.array(source)), names.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(weight))], ["source", "target", "weight"])

        for k, n in counted:
            at = counted.above(threshold)
            if n != last:  # weights by size and common members, as they are needed
                last, weights = n, np.full((len(counted.sizes), n + 1), np.nan)
            code, c = counted.code[at], counted.found[at]
            weight = weights[code, c]
            if np.isnan(weight).any():
                x, y = (v.astype(int) for v in np.divmod(np.unique((code * (n + 1) + c)[np.isnan(weight)]), n + 1))
                exact = form(y.astype(float), float(n), counted.sizes[x].astype(float))
                weights[x, y] = np.where(exact > threshold, exact if digits is None else _round(exact, digits), -1.0)
                weight = weights[code, c]
            if (weight < 0).any():
                at, weight = at[weight >= 0], weight[weight >= 0]
            for who in range(ends[k - 1] if k else 0, ends[k]) if len(at) else ():
                held.append((who, at, weight))
                size += len(at)
                if size > 500_000:
                    yield written()
                    held, size = [], 0
        if held:
            yield written()

    one, two = (t.schema[c].dataType for t, c in ((left, "sources"), (right, "s")))
    return meet(left, right, "at", "s", step, f"source {one.elementType.simpleString()}, target {two.simpleString()}, weight double")


def nearest(left: DataFrame, right: DataFrame, kind: str, threshold: float, k: int) -> DataFrame:
    """``i, source, c, n_a, n_b``: of each set of ``left (i, set)`` the ``k`` most similar of each block of ``right (s, set)``, ties by the smaller ``s``.

    Few sets are very similar, so a set is first asked for those above a high similarity, and
    for less similar ones only while it has not found ``k``.
    """
    form, steps = _KNOWN[kind][0], [*(t for t in (0.8**e for e in range(1, 40)) if t > threshold), threshold]

    def step(rows: pa.Table, columns: pa.Table) -> Iterator[pa.RecordBatch]:
        counted, sizes, held, begin = _Counted(kind, rows, columns), _lists(columns["set"])[0], [], {}
        for number, n in counted:
            level = begin.get(n, 0)
            while True:
                at = counted.above(steps[level])
                if level == len(steps) - 1 or len(at) >= k:
                    weight = form(counted.found[at].astype(float), float(n), sizes[at].astype(float))
                    if level == len(steps) - 1 or np.count_nonzero(weight >= steps[level]) >= k:
                        break
                level += 1
            begin[n] = max(0, level - (len(at) > 50 * k))
            if len(at) > k:
                best = np.flatnonzero(weight >= np.partition(weight, len(at) - k)[len(at) - k])
                at = at[best[np.lexsort((at[best], -weight[best]))[:k]]]  # places are in the order of s
            one = np.ones(len(at), np.int64)
            held.append((one * number, at, counted.found[at].astype(np.int64), one * n, sizes[at]))
        if held:
            number, at, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([_whole(rows["i"]).take(pa.array(number)), _whole(columns["s"]).take(pa.array(at)), *(pa.array(x, pa.int32()) for x in rest)], ["i", "source", "c", "n_a", "n_b"])

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((left, "i"), (right, "s"))]
    return meet(left, right, "i", "s", step, f"i {kinds[0]}, source {kinds[1]}, c int, n_a int, n_b int")
