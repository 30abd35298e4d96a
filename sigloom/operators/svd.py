"""Truncated singular value decomposition of rows of any width, by a randomised range finder.

A matrix is a table of chunks: the entries of at most ``SIDE`` rows (a block) and ``SIDE`` features (a shard). Tall matrices with few
columns, such as the axes, are tables of one dense piece per block or shard. A product joins chunks with pieces and adds up partial
pieces as a stream, so a task holds a chunk and two pieces however many rows or features there are. Only square matrices as
wide as the wanted dimensions reach the driver: the triangular factors of a tree of QR decompositions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.vectors import sparse_cells
from sigloom.session import stored

SIDE = 1024
OVERSAMPLE = 10
POWERS = 2
_HELD = 1 << 18
_SUMS = 1 << 21
_PIECE = "key bigint, cells binary"
_CHUNK = "block bigint, shard bigint, slots array<int>, places array<int>, cells array<double>"


def keyed_rows(dataset: DataFrame, column: str) -> DataFrame:
    """Distinct vectors of a column: ``(id, k1, k2, weight, v)``, with the root of how often each occurs, in blocks of ids.

    Repeated vectors share a row, so a vector that owns a third of all rows is no task's load.
    """
    v = F.unwrap_udt(column)
    rows = dataset.select(*vector_keys(column), v.alias("v"))
    once = rows.groupBy("k1", "k2").agg(F.any_value("v").alias("v"), F.sqrt(F.count(F.lit(1))).alias("weight"))
    return stored(once.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "weight", "v"), "svd-rows")


def vector_keys(column: str) -> list:
    """Two hashes that tell vectors apart."""
    v = F.unwrap_udt(column)
    return [F.xxhash64(v["indices"], v["values"]).alias("k1"), F.xxhash64(F.lit(1), v["values"], v["indices"]).alias("k2")]


def chunked(rows: DataFrame, weighted: bool) -> DataFrame:
    """Chunks of the rows of ``keyed_rows``; a block and shard may have several, whose entries add up."""

    def cut(blocks, slots, features, cells) -> Iterator[pa.RecordBatch]:
        shards = features // SIDE
        order = np.lexsort((shards, blocks))
        blocks, shards = blocks[order], shards[order]
        change = (blocks[1:] != blocks[:-1]) | (shards[1:] != shards[:-1])
        at = np.concatenate(([0], np.flatnonzero(change) + 1, [len(order)]))
        offsets = pa.array(at, pa.int32())
        arrays = [pa.array(blocks[at[:-1]]), pa.array(shards[at[:-1]])]
        parts = (slots[order].astype(np.int32), (features[order] % SIDE).astype(np.int32), cells[order])
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(p)) for p in parts]
        yield pa.RecordBatch.from_arrays(arrays, ["block", "shard", "slots", "places", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight"))
            row, feature, value = sparse_cells(batch.column("v"))
            value = value * weights[row] if weighted else value
            for at in range(0, len(row), _HELD):
                part = slice(at, at + _HELD)
                own = ids[row[part]]
                yield from cut(own // SIDE, own % SIDE, feature[part].astype(np.int64), value[part])

    return stored(rows.select("id", "weight", "v").mapInArrow(run, _CHUNK), "svd-chunks")


def signs(features: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Test matrix of random signs, generated from the features' numbers: no task needs to be sent any of it."""
    words = -(-width // 64)
    at = features.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    x = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**32 * 0x632BE59BD9B4E019 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(features), -1), axis=1)[:, :width]
    return bits * 2.0 - 1.0


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a batch: their other columns, and slots, places and cells of their entries."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        yield row, *[row[c].values.to_numpy(zero_copy_only=False) for c in ("slots", "places", "cells")]


def _multiplied(chunks: DataFrame, out: str, inner: Callable, width: int) -> DataFrame:
    """Pieces by ``out`` (block or shard): per entry, the cell times a row that ``inner`` gives for the other side.

    A task holds ``_SUMS`` numbers of pieces at most, whatever the number of chunks in a batch, and sends them one by one.
    """
    most = max(1, _SUMS // (SIDE * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a task adds up what it can hold
        for batch in batches:
            for row, slots, places, cells in _entries(batch):
                target, other = (slots, places) if out == "block" else (places, slots)
                key, step = row[out].as_py(), max(1, _HELD // width)
                if key not in sums and len(sums) >= most:
                    yield from flushed(sums)
                piece = sums.setdefault(key, np.zeros((SIDE, width)))
                for at in range(0, len(cells), step):
                    part = slice(at, at + step)
                    order = np.argsort(target[part], kind="stable")
                    found = (cells[part, None] * inner(row, other[part]))[order]
                    to = target[part][order]
                    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                    piece[to[first]] += np.add.reduceat(found, first, axis=0)
        yield from flushed(sums)

    def flushed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while sums:
            key, piece = sums.popitem()
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["key", "cells"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE * width)
        for batch in batches:
            for cell in batch.column("cells"):
                total += np.frombuffer(cell.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["key", "cells"])

    parts = chunks.mapInArrow(run, _PIECE)
    for salt in (16, 1):  # first in sixteen parts, so that a piece with very many parts is no single task's
        keys = [F.col("key"), F.pmod(F.xxhash64("cells"), F.lit(salt)).alias("salt")] if salt > 1 else [F.col("key")]
        parts = parts.groupBy(*keys).applyInArrow(added, _PIECE)
    return stored(parts, "svd-pieces")


def times_signs(chunks: DataFrame, width: int, seed: int) -> DataFrame:
    return _multiplied(chunks, "block", lambda row, places: signs(row["shard"].as_py() * SIDE + places, width, seed), width)


def times(chunks: DataFrame, pieces: DataFrame, width: int, out: str = "block") -> DataFrame:
    """Product of the chunked matrix (``out`` is ``block``) or of its transpose (``shard``) with a matrix of pieces."""
    other = "shard" if out == "block" else "block"
    joined = chunks.join(pieces.withColumnsRenamed({"key": other, "cells": "piece"}), other)
    return _multiplied(joined, out, lambda row, at: np.frombuffer(row["piece"].as_buffer()).reshape(SIDE, width)[at], width)


def triangle(pieces: DataFrame, width: int) -> np.ndarray:
    """Triangular factor of a matrix of pieces, by a tree of QR decompositions: per task, per group of tasks, of all groups."""

    def stacked(cells: Iterator) -> bytes:
        r = np.zeros((0, width))
        for cell in cells:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(cell.as_buffer()).reshape(-1, width)]), mode="r")
        return r.tobytes()

    def named(raw: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["cells"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield named(stacked(c for b in batches for c in b.column("cells")))

    leaves = pieces.select("cells").mapInArrow(leaf, "cells binary")
    grouped = leaves.groupBy(F.pmod(F.xxhash64("cells"), F.lit(16)).alias("g")).applyInArrow(leaf, "cells binary")
    rows = [np.frombuffer(r["cells"]).reshape(-1, width) for r in grouped.collect()]  # at most 16 triangles
    r = np.linalg.qr(np.vstack([*rows, np.zeros((width, width))]), mode="r")
    return r[:width]


def turned(pieces: DataFrame, right: np.ndarray) -> DataFrame:
    """Pieces times a small matrix."""
    rows = right.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [(np.frombuffer(c.as_buffer()).reshape(-1, rows) @ right).tobytes() for c in batch.column("cells")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cells, pa.binary())], ["key", "cells"])

    return pieces.mapInArrow(run, _PIECE)


def _orthonormal(pieces: DataFrame, width: int) -> DataFrame:
    """The same column space with orthonormal columns; columns beyond the rank become zero."""
    left, size, _ = np.linalg.svd(triangle(pieces, width).T)
    return turned(pieces, left * _inverse(size))


def _inverse(size: np.ndarray) -> np.ndarray:
    known = size > 1e-12 * max(float(size.max(initial=0.0)), 1e-300)
    return np.where(known, 1.0 / np.where(known, size, 1.0), 0.0)


def singular_axes(dataset: DataFrame, column: str, components: int, seed: int = 0, powers: int = POWERS) -> tuple[DataFrame, np.ndarray]:
    """Leading right singular vectors as a table of pieces by shard, and the singular values.

    The rows' range is sought with ``components + OVERSAMPLE`` random combinations of the features and ``powers`` power
    iterations. Input of at most that rank is decomposed exactly; otherwise the error falls with the gap in the spectrum, to the power
    ``2 * powers + 1``. Directions beyond the rank are zero.
    """
    wide = components + OVERSAMPLE
    chunks = chunked(keyed_rows(dataset, column), weighted=True)
    found = times_signs(chunks, wide, seed)
    for _ in range(powers):
        across = times(chunks, _orthonormal(found, wide), wide, "shard")
        found = times(chunks, _orthonormal(across, wide), wide)
    across = times(chunks, _orthonormal(found, wide), wide, "shard")
    left, size, _ = np.linalg.svd(triangle(across, wide).T)
    return stored(turned(across, (left * _inverse(size))[:, :components]), "svd-axes"), size[:components]


def projected(dataset: DataFrame, column: str, axes: DataFrame, components: int) -> DataFrame:
    """``(k1, k2, cells)``: per distinct vector its coordinates along the axes, by a join with the table of axes and a sum."""
    rows = keyed_rows(dataset, column)
    product = times(chunked(rows, weighted=False), axes, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cell in zip(batch.column("key").to_pylist(), batch.column("cells")):
                offsets = pa.array(np.arange(0, (SIDE + 1) * components, components), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(cell.as_buffer())))
                yield pa.RecordBatch.from_arrays([pa.array(key * SIDE + np.arange(SIDE)), lists], ["id", "cells"])

    found = product.mapInArrow(run, "id bigint, cells array<double>")
    zero = F.array_repeat(F.lit(0.0), components)
    return rows.select("id", "k1", "k2").join(found, "id", "left").select("k1", "k2", F.coalesce("cells", zero).alias("cells"))
