"""Pairs of samples as whole blocks.

A table of pairs made by ``distances`` remembers the job behind it. Operators that know such a table take its blocks as arrays inside the
comparing tasks, and send on what they make of them; every other use sees rows. Any change of the table drops the memory, so that
filtered or recomputed pairs are rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sigloom.session import stored

#: statistics of the values of a row of a matrix, in the order of ``row_statistics``
STATISTICS = ("total", "top", "low", "squares")
#: pairs that are sent on at a time, and cells of two samples' features that are compared at a time
ROWS_AT_ONCE = 1 << 18
TILE = 1 << 16


class Side:
    """A block of samples: its ids, and row, feature number and value of every cell."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, features: np.ndarray, values: np.ndarray, width: int):
        self.ids, self.rows, self.features, self.values, self.width = ids, rows, features, values, width
        self.kept: dict = {}

    def once(self, name, make: Callable):
        """What ``make`` gives, kept for the other blocks of the task."""
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    @property
    def met(self) -> np.ndarray:
        return self.once("met", lambda: np.bincount(self.features, minlength=self.width).astype(float))

    @property
    def present(self) -> np.ndarray:
        return self.once("present", lambda: np.bincount(self.rows, self.values != 0, minlength=len(self.ids)))

    @property
    def reach(self) -> float:
        """The largest sum of absolute values of a row, infinite unless all are whole numbers."""

        def find():
            if not np.array_equal(self.values, np.rint(self.values)):
                return np.inf
            return float(np.bincount(self.rows, np.abs(self.values), minlength=len(self.ids)).max(initial=0))

        return self.once("reach", find)

    @property
    def unsigned(self) -> bool:
        return self.once("unsigned", lambda: bool((self.values >= 0).all()))

    def columns(self, kind) -> np.ndarray:
        """Features by samples."""

        def make():
            cells = np.zeros((self.width, len(self.ids)), kind)
            cells[self.features, self.rows] = self.values
            return cells

        return self.once(("columns", np.dtype(kind).str), make)


def apart_dense(x: Side, y: Side) -> np.ndarray:
    """Sum of |a - b| of all pairs, feature by feature; in 16 or 32 bits where whole numbers cannot exceed them."""
    reach, n, m = x.reach + y.reach, len(x.ids), len(y.ids)
    # a difference of values of one sign is no larger than either of them
    short = max(x.reach, y.reach) < 1 << 15 and reach < (1 << 16 if x.unsigned and y.unsigned else 1 << 15)
    kind, total = (np.int16, np.uint16) if short else (np.int32, np.int32) if reach < 1 << 31 else (float, float)
    a, b = x.columns(kind), y.columns(kind)
    found, high = np.empty((n, m)), max(1, min(n, TILE // m))
    step = np.empty((high, m), kind)
    sums = np.empty((high, m), total)
    for at in range(0, n, high):
        rows = min(high, n - at)
        diff, own = step[:rows], sums[:rows]
        own[:] = 0
        for p, q in zip(a, b):
            np.subtract(p[at : at + rows, None], q, out=diff)
            np.abs(diff, out=diff)
            np.add(own, diff.view(total), out=own)
        found[at : at + rows] = own
    return found


def common_dense(x: Side, y: Side) -> np.ndarray:
    """Number of features that both samples of a pair have."""
    marks = [side.once("marks", lambda side=side: (side.columns(float) != 0).astype(np.float32)) for side in (x, y)]
    return (marks[0].T @ marks[1]).astype(float)


@dataclass(frozen=True)
class Block:
    """Values of all pairs of two sides; of one block with itself, every pair is there both ways."""

    left: Side
    right: Side
    same: bool
    values: dict[str, np.ndarray]

    def order(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of both sides, and their places in the order of ids."""
        ids = pa.concat_arrays([self.left.ids, self.right.ids])
        ranks = np.empty(len(ids), np.int64)
        ranks[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        n = len(self.left.ids)
        return ids, ranks[:n], ranks[:n] if self.same else ranks[n:]


#: packed bytes of all samples' features that may be sent to every task
GATHERED_BYTES = 96 << 20


@dataclass(frozen=True)
class Gathered:
    """Cells of all samples, in the order of ``ids``."""

    ids: pa.Array
    starts: np.ndarray
    features: np.ndarray
    values: np.ndarray
    width: int

    def side(self, lo: int, hi: int) -> Side:
        at, end = self.starts[lo], self.starts[hi]
        rows = np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1]))
        return Side(self.ids.slice(lo, hi - lo), rows, self.features[at:end].astype(np.int64), self.values[at:end].astype(float), self.width)

    def taken(self, ids: pa.Array) -> Gathered:
        """The samples of these ids, in their order."""
        at = pc.index_in(ids, value_set=self.ids).to_numpy()
        sizes = np.diff(self.starts)[at]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        cells = np.repeat(self.starts[at] - starts[:-1], sizes) + np.arange(starts[-1])
        return Gathered(ids, starts, self.features[cells], self.values[cells], self.width)


def in_order(ids: pa.Array) -> pa.Array:
    return ids.take(pc.array_sort_indices(ids))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    if values.dtype.kind == "f" and not np.array_equal(values, np.rint(values)):
        return values
    reach = np.abs(values).max(initial=0)
    return next((values.astype(kind) for kind in (np.int8, np.int16, np.int32) if reach <= np.iinfo(kind).max), values)


#: makes the values of a block from ``apart``, ``common`` and ``present``
Formula = Callable[[dict[str, np.ndarray], Side, Side], np.ndarray]


@dataclass(frozen=True)
class PairBlocks:
    """How the pairs of a table are made: groups of two sides, the comparison, and a formula per value.

    ``named`` says that values are rows with a ``metric`` instead of columns. ``diagonal`` makes it the full matrix: both ways of every
    pair, and these rows ``(metric?, a, b, values...)``. ``only`` are the ids of the columns kept, in order.
    """

    sides: DataFrame
    jobs: GroupedData
    compare: Callable[[frozenset[str]], Callable]
    id_type: DataType
    needs: frozenset[str]
    formulas: dict[str, Formula]
    ids: DataFrame
    several: bool
    parts: Callable[[Side, Side, frozenset[str]], dict[str, np.ndarray]]
    named: bool = False
    diagonal: DataFrame | None = None
    only: Broadcast | None = field(default=None, compare=False)

    def emit(self, make: Callable[[Block], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
        """What ``make`` gives for every block."""
        compare, formulas = self.compare(self.needs), self.formulas

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for left, right, same, parts in compare(key, batches):
                yield from make(Block(left, right, same, {name: f(parts, left, right) for name, f in formulas.items()}))

        return self.jobs.applyInArrow(run, schema)

    def with_formulas(self, needs: Iterable[str], formulas: dict[str, Formula], **changes) -> PairBlocks:
        return replace(self, needs=frozenset(needs), formulas=formulas, **changes)

    def column(self, metric: str, name: str) -> PairBlocks:
        """The values of one metric as a column."""
        return replace(self, formulas={name: self.formulas[metric]}, named=False)

    def square(self, ids: pa.Array) -> bool:
        """Whether this is the full matrix of one value, with just these rows and columns (ids in order)."""
        if self.diagonal is None or self.only is not None or len(self.formulas) != 1 or not self.several:
            return False
        return all(in_order(one_array(t.toArrow()["_id"])).equals(ids) for t in (self.ids.select(F.col("sample_id").alias("_id")), self.diagonal.select(F.col("a").alias("_id"))))

    def gathered(self) -> Gathered | None:
        """Cells of all samples in the order of ids, if they are few enough to be sent to every task."""
        sides = stored(self.sides, "pair-sides")
        size = sides.agg(F.sum(sum(F.octet_length(c) for c in ("rows", "numbers", "vals")))).first()[0] or 0
        if size > GATHERED_BYTES:
            return None
        found = sides.toArrow()
        names = found["names"].combine_chunks()
        names = names if isinstance(names, pa.ListArray) else pa.concat_arrays(names.chunks)
        encoded = names.flatten().dictionary_encode()
        numbers, at, ids, cells = encoded.indices.to_numpy(), 0, [], []
        for i in range(found.num_rows):
            kinds = found["kinds"][i].as_py().split()
            rows, own, values = (np.frombuffer(found[c][i].as_buffer(), k) for c, k in zip(("rows", "numbers", "vals"), kinds))
            roster = found["roster"][i].values
            size = len(found["names"][i].values)
            order = np.argsort(rows, kind="stable")
            cells.append((np.bincount(rows, minlength=len(roster)), narrow(numbers[at : at + size])[own[order]] if size else own, values[order]))
            ids.append(roster)
            at += size
        sizes, features, values = (np.concatenate(c) for c in zip(*cells))
        whole = Gathered(pa.concat_arrays(ids), np.concatenate(([0], np.cumsum(sizes))), features, values, len(encoded.dictionary))
        return whole.taken(in_order(whole.ids))

    def values_of(self):
        """Makes the values of two sides, for tasks."""
        parts, needs, formula = self.parts, self.needs, next(iter(self.formulas.values()))
        return lambda left, right: formula(parts(left, right, needs), left, right)

    def rows(self) -> DataFrame:
        """A row per unordered pair, ``a < b``."""
        named, names = self.named, list(self.formulas)

        def make(block: Block) -> Iterator[pa.RecordBatch]:
            ids, p, q = block.order()
            n, m = len(p), len(q)
            high = max(1, ROWS_AT_ONCE // max(m, 1))
            for at in range(0, n, high):
                rows = np.arange(at, min(at + high, n))
                if block.same:
                    x, y = np.triu_indices(len(rows), at + 1, m) if not at else np.nonzero(rows[:, None] < np.arange(m))
                    x = x + at
                else:
                    x, y = np.repeat(rows, m), np.tile(np.arange(m), len(rows))
                shift = 0 if block.same else n
                turned = p[x] > q[y]
                a = ids.take(pa.array(np.where(turned, y + shift, x)))
                b = ids.take(pa.array(np.where(turned, x, y + shift)))
                found = {name: pa.array(v[x, y]) for name, v in block.values.items()}
                if named:
                    for name, d in found.items():
                        yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(a), np.int8))), a, b, d], ["metric", "a", "b", "d"])
                else:
                    yield pa.RecordBatch.from_arrays([a, b, *found.values()], ["a", "b", *found])

        ends = [StructField("a", self.id_type), StructField("b", self.id_type)]
        if named:
            return self.emit(make, StructType([StructField("metric", StringType()), *ends, StructField("d", DoubleType())]))
        return self.emit(make, StructType([*ends, *[StructField(c, DoubleType()) for c in names]]))

    def statistics(self, stats: tuple[str, ...]) -> DataFrame:
        """Statistics of every row within every block: ``(metric?, a, n, <value>_<statistic>...)``."""
        named, names, full, only = self.named, list(self.formulas), self.diagonal is not None, self.only

        def wanted(side: Side) -> np.ndarray:
            if only is None:
                return np.ones(len(side.ids), bool)
            return side.once("wanted", lambda: pc.is_in(side.ids, value_set=only.value).to_numpy(zero_copy_only=False))

        def make(block: Block) -> Iterator[pa.RecordBatch]:
            _, p, q = block.order()
            if full:
                inside = np.broadcast_to(wanted(block.right), (len(p), len(q)))
                inside = inside & ~np.eye(len(p), dtype=bool) if block.same else inside
                back = np.broadcast_to(wanted(block.left)[:, None], (len(p), len(q)))
            else:
                inside = p[:, None] < q
                back = ~inside
            turns = [(block.left.ids, inside, 1)] + ([] if block.same else [(block.right.ids, back, 0)])
            for ids, mask, axis in turns:
                n = mask.sum(axis=axis)
                some = np.flatnonzero(n)
                every = bool(mask.all())
                cells = {name: _statistics(v, mask, every, axis, stats) for name, v in block.values.items()}
                head = [ids.take(pa.array(some)), pa.array(n[some])]
                for group in [[x] for x in names] if named else [names]:
                    tag = [pa.array([group[0]] * len(some), pa.string())] if named else []
                    made = [pa.array(c[some]) for x in group for c in cells[x]]
                    labels = [f"{'d' if named else x}_{s}" for x in group for s in stats]
                    yield pa.RecordBatch.from_arrays([*tag, *head, *made], [*(["metric"] if named else []), "a", "n", *labels])

        values = ["d"] if named else names
        tag = [StructField("metric", StringType())] if named else []
        cells = [StructField(f"{v}_{s}", DoubleType()) for v in values for s in stats]
        found = self.emit(make, StructType([*tag, StructField("a", self.id_type), StructField("n", LongType()), *cells]))
        if not full:
            return found
        ends = {"total": lambda c: F.col(c), "top": lambda c: F.col(c), "low": lambda c: F.col(c), "squares": lambda c: F.col(c) * F.col(c)}
        rows = self.diagonal.select(
            *(["metric"] if named else []), "a", F.lit(1).cast("bigint").alias("n"), *[ends[s](v).alias(f"{v}_{s}") for v in values for s in stats]
        )
        return found.unionByName(rows)


def _statistics(v: np.ndarray, mask: np.ndarray, every: bool, axis: int, stats: tuple[str, ...]) -> Iterator[np.ndarray]:
    """Statistics along an axis over the cells of the mask; the least value is as in SQL, where NaN is the largest."""
    zeroed = v if every else np.where(mask, v, 0.0)
    for s in stats:
        if s == "total":
            yield zeroed.sum(axis=axis)
        elif s == "squares":
            yield np.einsum("ij,ij->i" if axis else "ij,ij->j", zeroed, zeroed)
        elif s == "top":
            yield (v if every else np.where(mask, v, -np.inf)).max(axis=axis, initial=-np.inf)
        else:
            yield _least(v if every else np.where(mask, v, np.inf), axis, mask)


def _least(v: np.ndarray, axis: int, mask: np.ndarray) -> np.ndarray:
    low = v.min(axis=axis, initial=np.inf)
    if np.isnan(low).any():
        low = np.fmin.reduce(v, axis=axis, initial=np.inf)
        low[(np.isnan(v) | ~mask).all(axis=axis)] = np.nan
    return low


def tagged(df: DataFrame, blocks: PairBlocks | None) -> DataFrame:
    df.__dict__["_pair_blocks"] = blocks
    return df


def blocks_of(df: DataFrame) -> PairBlocks | None:
    """The blocks of a table of pairs, if it is as the operators of ``distances`` made it."""
    return df.__dict__.get("_pair_blocks")
