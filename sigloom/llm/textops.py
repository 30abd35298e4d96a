"""Array kernels shared by the operators: word hashes and rolling hashes over Arrow string columns.

Every function sees one Arrow batch inside a task. A word's hash mixes its bytes eight at a time, each eight with
their place, and its length. A window's hash is a polynomial sum of word hashes modulo 2^64, finished by a 64-bit mixer. Both
depend on the bytes alone, so every task and every run computes the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_PLACE = np.uint64(0x9E3779B97F4A7C15)
#: masks of the first 0 to 8 bytes of a little-endian number
_FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_STEP = 0xD6E8FEB86659FD93


def _inverse(base: int) -> int:
    x = base
    for _ in range(6):
        x = x * (2 - base * x) % 2**64
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_CACHE: dict[tuple[int, bool], np.ndarray] = {}


def cached_powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers of an odd base modulo 2^64; tables up to a chunk's length are kept."""
    of = _inverse(base) if inverse else base
    if n > CHUNK + 1:
        return powers(of, n)
    if (base, inverse) not in _CACHE:
        _CACHE[base, inverse] = powers(of, CHUNK + 1)
    return _CACHE[base, inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def small(batches, limit: int = 4 << 20, column: str = "text"):
    """Slices of Arrow batches with about ``limit`` bytes of text each (at least one row), so that a task's arrays stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made lower case."""
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


class Words:
    """Words of a batch: byte ranges in ``data``, their 64-bit ``hashes`` and the rows' word ``offsets``."""

    def __init__(self, column, lower: bool = False, hashes: bool = True):
        self.data, self.row_bytes = buffers(column)
        self.starts, self.ends, found = _scan(self.data, self.row_bytes, lower, hashes)
        self.hashes = found
        self.offsets = np.searchsorted(self.starts, self.row_bytes)
        self.offsets[-1] = len(self.starts)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self)), self.counts())


def _scan(data, row_bytes, lower, hashes):
    """Cut at white space and row borders, a chunk at a time; a chunk ends behind a space or a row."""
    starts, ends, found = [], [], []
    borders = row_bytes
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            border = borders[np.searchsorted(borders, to, "right") - 1]
            if border > at:
                to = int(border)
            else:
                spaces = np.flatnonzero(is_space(data[at:to]))
                while len(spaces) == 0 and to < n and to not in borders[max(0, np.searchsorted(borders, to) - 1) :][:2]:
                    nxt = int(borders[np.searchsorted(borders, to, "right")]) if to < borders[-1] else n
                    more = min(nxt, to + CHUNK)
                    spaces = np.flatnonzero(is_space(data[to:more])) + (to - at)
                    to = more
                if len(spaces):
                    to = at + int(spaces[-1]) + 1
        part = data[at:to]
        inside = ~is_space(part)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cuts = borders[np.searchsorted(borders, at, "left") : np.searchsorted(borders, to, "left")] - at
        cuts = cuts[cuts < len(part)]
        begin[cuts] = inside[cuts]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        last = cuts[cuts > 0] - 1
        end[last] = inside[last]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if hashes:
            found.append(range_hashes(lowered(part) if lower else part, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    empty = np.zeros(0, np.int64)
    return (
        np.concatenate(starts) if starts else empty,
        np.concatenate(ends) if ends else empty,
        np.concatenate(found) if found else np.zeros(0, np.uint64),
    )


def range_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every range of one chunk.

    A polynomial over the bytes would not do: modulo 2^64, alternating words of a thousand letters can agree under every base.
    """
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = part
    eight = np.ndarray(len(part) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every position on
    sizes = ends - starts
    found = mix((eight[starts] & _FIRST[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * _PLACE))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(more.sum()) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        left = np.repeat(ends[long], more) - at
        terms = mix((eight[at] & _FIRST[np.minimum(left, 8)]) ^ mix(place.astype(np.uint64) * _PLACE))
        found[long] = mix(found[long] + np.add.reduceat(terms, first))
    return found


def rolling(values: np.ndarray, width: int, base: int = _STEP) -> np.ndarray:
    """Mixed hash of every run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    block = CHUNK - width if width < CHUNK // 2 else n
    for at in range(0, n, block):
        part = values[at : min(at + block, n) + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * cached_powers(base, len(part)), out=sums[1:])
        m = len(part) - width + 1
        out[at : at + m] = (sums[width:] - sums[:m]) * cached_powers(base, len(part) + 1, True)[:m]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` positions that lie in ``[start, start + width)`` of any start."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def ids_of(column) -> np.ndarray:
    """Integer ids; a null id ranks behind every other one."""
    return column.cast(pa.int64()).fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
