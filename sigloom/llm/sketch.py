"""Count-min sketches merged from one part per partition, kept as bits: estimated to reach a count or not."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame

from sigloom.llm.common import scratch
from sigloom.llm.textops import mix, small
from sigloom.session import workers_open


@dataclass(frozen=True)
class Sketch:
    """Shape of a sketch: ``rows`` hash rows of 2^``bits`` cells, handled in blocks of 2^16.

    Its size is fixed, so every worker may read the merged bit table (2^bits * rows / 8 bytes). More keys than it can tell
    apart only mean more keys estimated too high, never one estimated too low.
    """

    rows: int = 3
    bits: int = 26

    def grown(self, cells: int) -> Sketch:
        """This sketch with at least so many cells in a row, as far as ``MOST_BITS`` allows."""
        return replace(self, bits=max(self.bits, min(MOST_BITS, max(0, int(cells) - 1).bit_length())))

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (2 * row + 1)) % 2**64)
        return mix(keys ^ salt) >> np.uint64(64 - self.bits)

    def marked(self, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Mask of the keys whose cells are set in every row."""
        found = np.ones(len(keys), bool)
        for row in range(self.rows):
            cells = self.cells(keys, row)
            place = np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8)
            found &= (bits[row][(cells >> np.uint64(3)).astype(np.int64)] >> place) & 1 == 1
        return found


BLOCK_BITS = 16
#: a row of a grown sketch takes 128 MB for each level in a worker at most
MOST_BITS = 30
_HELD = 4_000_000


def _capped(cells: np.ndarray, cap: int) -> np.ndarray:
    """Cells in order, each at most ``cap`` times."""
    cells = np.sort(cells)
    over = np.zeros(len(cells), bool)
    over[cap:] = cells[cap:] == cells[:-cap]
    return cells[~over]


def partition_sketch(keys_of: Callable[[pa.RecordBatch], np.ndarray], sketch: Sketch, cap: int, column: str):
    """Arrow batches -> this partition's sketch: per block its cells in order, each as often as counted, up to ``cap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(sketch.rows)]
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for row in range(sketch.rows):
                cells = _capped(np.concatenate(parts[row]), cap)
                parts[row].clear()
                blocks = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
                cut = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1))
                low = cells.astype(np.uint16).tobytes()
                ends = np.append(cut[1:], len(cells))
                packed = pa.array([low[2 * a : 2 * b] for a, b in zip(cut.tolist(), ends.tolist())], pa.binary())
                named = blocks[cut] + (row << (sketch.bits - BLOCK_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(named), packed], ["block", "cells"])

        for batch in small(batches, column=column):
            keys = keys_of(batch)
            for row in range(sketch.rows):
                parts[row].append(sketch.cells(keys, row))
            held += len(keys)
            if held > _HELD:  # keeps a task's memory bounded however many rows it reads
                yield from emit()
                held = 0
        if held:
            yield from emit()

    return run


def _merged_block(parts: pd.DataFrame, levels: tuple[int, ...], cap: int) -> pd.DataFrame:
    """Bits of one block, one table for every level: set where the summed counts reach it."""
    counts = np.zeros(1 << BLOCK_BITS, np.int64)
    for raw in parts["cells"]:
        counts += np.bincount(np.frombuffer(raw, np.uint16), minlength=1 << BLOCK_BITS)
    if not (counts >= min(levels)).any():
        return pd.DataFrame({"block": [], "bits": []})
    packed = b"".join(np.packbits(counts >= level).tobytes() for level in levels)
    return pd.DataFrame({"block": [parts["block"].iloc[0]], "bits": [packed]})


@dataclass(frozen=True)
class BitTable:
    """Merged sketch in the shared folder: blocks of bits that tasks wrote, which a worker reads when it first needs them.

    Neither the driver nor a broadcast holds the bits; a lost executor's tasks read them again elsewhere. Only
    the bits in a store that workers cannot open are ``sent`` to them.
    """

    path: str
    sketch: Sketch
    levels: int
    chosen: int = 0
    sent: Broadcast | None = None

    def level(self, number: int) -> BitTable:
        return replace(self, chosen=number)

    @property
    def value(self) -> np.ndarray:
        """Bits of the chosen level, rows x bytes."""
        return self.all()[self.chosen]

    def all(self) -> np.ndarray:
        if self.sent is not None:
            return self.sent.value
        if self.path not in _TABLES:
            while len(_TABLES) >= _HELD_TABLES:
                del _TABLES[next(iter(_TABLES))]
            _TABLES[self.path] = self.filled(self._blocks())
        return _TABLES[self.path]

    def filled(self, blocks: Iterator[tuple[int, bytes]]) -> np.ndarray:
        """Bits of all levels, levels x rows x bytes."""
        size = (1 << BLOCK_BITS) // 8
        out = np.zeros((self.levels, self.sketch.rows << (self.sketch.bits - BLOCK_BITS), size), np.uint8)
        for block, bits in blocks:
            out[:, block] = np.frombuffer(bits, np.uint8).reshape(self.levels, size)
        return out.reshape(self.levels, self.sketch.rows, -1)

    def _blocks(self) -> Iterator[tuple[int, bytes]]:
        if self.path.startswith("file:") or "://" not in self.path:
            store, folder = fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        else:
            store, folder = fs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1))
        for file in store.get_file_info(fs.FileSelector(folder)):
            if file.base_name.endswith(".parquet"):
                with store.open_input_file(file.path) as raw:
                    for batch in pq.ParquetFile(raw).iter_batches(256):
                        yield from zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist())


#: tables a worker has read, the latest few
_TABLES: dict[str, np.ndarray] = {}
_HELD_TABLES = 3


def bit_table(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], sketch: Sketch, *levels: int, column: str = "text"
) -> BitTable:
    """Merged sketch of all keys as bits, per level: estimated count of at least that level.

    Parts meet by block, whose size is fixed; tasks write the blocks to the shared folder.
    """
    cap = max(levels)
    parts = rows.mapInArrow(partition_sketch(keys_of, sketch, cap, column), "block bigint, cells binary")
    merged = parts.groupBy("block").applyInPandas(lambda pdf: _merged_block(pdf, levels, cap), "block bigint, bits binary")
    path = scratch(rows.sparkSession, "sketch")
    merged.write.parquet(path)
    table, found = BitTable(path, sketch, len(levels)), rows.sparkSession.read.schema(merged.schema).parquet(path)
    if workers_open(found, path):
        return table
    bits = table.filled((r["block"], bytes(r["bits"])) for r in found.toLocalIterator())
    return replace(table, sent=rows.sparkSession.sparkContext.broadcast(bits))


def count_bits(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], sketch: Sketch, *levels: int, column: str = "text"
) -> np.ndarray:
    """The bits of a ``bit_table`` here, (levels x) rows x bytes."""
    out = bit_table(rows, keys_of, sketch, *levels, column=column).all()
    return out[0] if len(levels) == 1 else out
