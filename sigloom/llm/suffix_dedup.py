"""Repeated byte strings by common-prefix interval trees over enhanced suffix arrays.

A string of ``width`` bytes that starts in two places holds the same minimizer at the same offset: the least hash of
the ``gram``-byte strings inside it. So only suffixes that start at minimizers are sorted, and the suffix array
falls into one part per minimizer value. Within a part, the suffixes are sorted with the lengths of their common
prefixes; a scan with a stack walks the tree of intervals of suffixes that share a prefix. An interval repeats
a string on the right; the bytes to the left tell whether and how far its suffixes extend that way, and only where they
differ is the group a maximal repeat.

Two kinds of strings go another, equally exact way, by digests of whole strings whose counts combine inside tasks: those whose
minimizer occurs in them twice (periodic text), and those of minimizers with more than ``part`` different surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, narrow, stored
from sigloom.llm.sketch import Sketch, bit_table
from sigloom.llm.textops import buffers, cached_powers, covered, ids_of, mix, signed, sliding_min, small

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_CODES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) for s in (31, 37)]
_PLACE_BITS = 22
#: bytes handled at once: the arrays over them stay in a core's cache
CHUNK = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Length of the strings, of the grams, most surroundings in a part of the suffix array, and the prefilter's shape."""

    width: int = 400
    gram: int = 64
    part: int = 4096
    sketch: Sketch = Sketch(rows=3, bits=25)


class Piece:
    """Bytes of several rows, or a stretch of one long row with the bytes around it that its strings need.

    Strings count if they start in [``lo``, ``hi``), minimizers if they lie there; ``before`` is the place of the first byte in its row.
    """

    def __init__(self, data, at, rows, before=0, lo=0, hi=None):
        self.data, self.at, self.rows, self.before = data, at, rows, before
        self.lo, self.hi = lo, len(data) if hi is None else hi
        self.sums: dict[int, np.ndarray] = {}

    def rolling(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from every place."""
        sums, n = self._sums(0), len(self.data) - width + 1
        return mix((sums[width:] - sums[:n]) * cached_powers(_BASES[0], len(self.data) + 1, True)[:n])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """64-bit hash of every byte range."""
        sums = self._sums(which)
        return mix((sums[ends] - sums[starts]) * cached_powers(_BASES[which], len(self.data) + 1, True)[starts])

    def _sums(self, which: int) -> np.ndarray:
        n = len(self.data)
        if which not in self.sums:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_CODES[which][self.data] * cached_powers(_BASES[which], n), out=sums[1:])
            self.sums[which] = sums
        return self.sums[which]


def pieces(column: pa.Array, s: Settings) -> Iterator[Piece]:
    data, at = buffers(column)
    n, row = len(at) - 1, 0
    while row < n:
        if at[row + 1] - at[row] <= CHUNK:
            stop = row + 1
            while stop < n and at[stop + 1] - at[row] <= CHUNK:
                stop += 1
            yield Piece(data[at[row] : at[stop]], at[row : stop + 1] - at[row], np.arange(row, stop))
            row = stop
            continue
        own = data[at[row] : at[row + 1]]
        for a in range(0, len(own), CHUNK // 2):
            b = min(len(own), a + CHUNK // 2)
            first, last = max(0, a - 2 * s.width), min(len(own), b + 2 * s.width)
            yield Piece(own[first:last], np.array([0, last - first]), np.array([row]), first, a - first, b - first)
        row += 1


def minimizers(piece: Piece, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the only least one of some string; starts and piece rows of the tied strings."""
    none = np.zeros(0, np.int64)
    n = len(piece.data)
    if n < s.width:
        return none, none.view(np.uint64), none, none
    every = np.arange(n - s.gram + 1)
    grams = piece.rolling(s.gram)
    owner = np.repeat(np.arange(len(piece.rows)), np.diff(piece.at))
    starts = np.flatnonzero(owner[s.width - 1 :] == owner[: n - s.width + 1])
    # the order of grams is that of their hashes' upper bits; the place below them tells the first or the last of equal ones
    upper = (grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)
    mask, wide = np.uint64((1 << _PLACE_BITS) - 1), s.width - s.gram + 1
    place = every.astype(np.uint64)
    first = (sliding_min(upper | place, wide)[starts] & mask).astype(np.int64)
    last = (mask - (sliding_min(upper | (mask - place), wide)[starts] & mask)).astype(np.int64)
    single = first == last
    # a stretch answers for the minimizers in it, whatever strings (also those that start before it) choose them
    chosen = np.unique(first[single])
    chosen = chosen[(chosen >= piece.lo) & (chosen < piece.hi)]
    tied = starts[~single]
    tied = tied[(tied >= piece.lo) & (tied < piece.hi)]
    return chosen, grams[chosen], tied, owner[tied]


def _surroundings(piece: Piece, places: np.ndarray, s: Settings):
    """Byte ranges around minimizers that their strings can reach, inside the row."""
    row = np.searchsorted(piece.at, places, "right") - 1
    start = np.maximum(places - (s.width - s.gram), piece.at[row])
    end = np.minimum(places + s.width, piece.at[row + 1])
    return row, start, end


def _gram_keys(batch: pa.RecordBatch, s: Settings) -> np.ndarray:
    found = [minimizers(piece, s)[1] for piece in pieces(batch.column("text"), s)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _marked(piece: Piece, s: Settings, bits):
    """Minimizers estimated to occur twice, with their surroundings and the 128-bit digests of those."""
    places, grams, _, _ = minimizers(piece, s)
    seen = s.sketch.marked(grams, bits)
    places, grams = places[seen], grams[seen]
    row, start, end = _surroundings(piece, places, s)
    shift = (places - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return places, grams, row, start, end, [mix(piece.hashes(start, end, k) ^ shift) for k in (0, 1)]


def occurrences(texts: DataFrame, s: Settings, bits) -> DataFrame:
    """Every minimizer estimated repeated: gram, s1, s2 (digest of its surroundings), id, row, place, before, after (bytes reached)."""

    def run(batches):
        for batch in small(batches):
            ids, keys = ids_of(batch.column("doc_id")), batch.column("row").to_numpy()
            for piece in pieces(batch.column("text"), s):
                places, grams, row, start, end, digests = _marked(piece, s, bits.value)
                own = piece.rows[row]
                cells = (signed(grams), *(signed(d) for d in digests), ids[own], keys[own], places - piece.at[row] + piece.before, places - start, end - places)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["gram", "s1", "s2", "id", "row", "place", "before", "after"])

    schema = "gram bigint, s1 bigint, s2 bigint, id bigint, row bigint, place bigint, before bigint, after bigint"
    return texts.mapInArrow(run, schema)


def surroundings(texts: DataFrame, s: Settings, bits, wanted) -> DataFrame:
    """Bytes around the minimizers in ``wanted`` (a bit table): gram, s1, s2, left (backwards), right."""

    def run(batches):
        for batch in small(batches):
            for piece in pieces(batch.column("text"), s):
                places, grams, _, start, end, digests = _marked(piece, s, bits.value)
                use = np.flatnonzero(s.sketch.marked(grams, wanted.value))
                _, once = np.unique(digests[0][use] ^ mix(grams[use]), return_index=True)
                use = use[once]
                raw, back = piece.data.tobytes(), piece.data[::-1].tobytes()
                n = len(raw)
                spans = list(zip(places[use].tolist(), start[use].tolist(), end[use].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(x[use])) for x in (grams, *digests)]
                    + [pa.array([back[n - p : n - a] for p, a, _ in spans], pa.binary()), pa.array([raw[p:b] for p, _, b in spans], pa.binary())],
                    ["gram", "s1", "s2", "left", "right"],
                )

    found = texts.select("text").mapInArrow(run, "gram bigint, s1 bigint, s2 bigint, left binary, right binary")
    return found.groupBy("gram", "s1", "s2").agg(F.first("left").alias("left"), F.first("right").alias("right"))


def common_prefixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the length of the common prefix of every neighbouring two in it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lengths = np.array([len(strings[i]) for i in order])
    wide = max(1, int(lengths.max()))
    table = np.frombuffer(b"".join(strings[i].ljust(wide, b"\0") for i in order), np.uint8).reshape(len(order), wide)
    differ = table[1:] != table[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return np.array(order), np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


def prefix_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Intervals (depth, first, last) of the tree of common prefixes, children before parents, by a scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), 0]):
        begin = i
        while stack and stack[-1][0] > depth:
            deep, begin = stack.pop()
            yield deep, begin, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def _between(lcp: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Least of ``lcp`` between every two neighbours of strictly increasing ranks."""
    return np.minimum.reduceat(lcp[: ranks[-1]], ranks[:-1])


def maximal_repeats(left: list[bytes], right: list[bytes], width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of at least ``width`` bytes: (bytes to the left, bytes to the right, all suffixes that have it).

    The members of an interval that shares ``depth`` bytes to the right are put in the order of their backward left sides; the
    intervals there share a left extension and differ before it. Such a group counts unless all its members go on alike to the
    right too, when a deeper interval gives it.
    """
    order, lcp = common_prefixes(right)
    left_order, left_lcp = common_prefixes(left)
    rank, right_rank = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    rank[left_order], right_rank[order] = np.arange(len(left)), np.arange(len(left))
    farthest = int(left_lcp.max())
    for depth, first, last in prefix_intervals(lcp):
        if depth + farthest < width:
            continue
        members = left_order[np.sort(rank[order[first : last + 1]])]
        shared = _between(left_lcp, rank[members])
        # one more than the shared length, so that a group without left extension counts as well
        for extent, a, b in prefix_intervals(np.where(shared + depth >= width, shared + 1, 0)):
            group = members[a : b + 1]
            spots = right_rank[group]
            if int(lcp[spots.min() : spots.max()].min()) == depth:
                yield extent - 1, depth, group


def reach(left: list[bytes], right: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after every suffix's start that strings repeated in another suffix cover (0, 0: none).

    All these strings contain the start, so what they cover is one range.
    """
    before, after = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for extent, depth, group in maximal_repeats(left, right, width):
        before[group] = np.maximum(before[group], extent)
        after[group] = np.maximum(after[group], depth)
    return before, after


def part_reach(parts: DataFrame, s: Settings) -> DataFrame:
    """``reach`` for every surrounding, part by part of the suffix array: gram, s1, s2, before, after."""

    def run(batches):
        held: list[tuple] = []

        def flush(groups: list[list[tuple]]) -> pa.RecordBatch:
            out = []
            for group in groups:
                if len(group) > 1:
                    before, after = reach([g[3] for g in group], [g[4] for g in group], s.width)
                    out += [(*g[:3], b, a) for g, b, a in zip(group, before.tolist(), after.tolist()) if a]
            columns = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "s1", "s2", "before", "after"])

        for batch in batches:
            done: list[list[tuple]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if held and held[0][0] != row[0]:
                    done.append(held)
                    held = []
                held.append(row)
            yield flush(done)
        if held:
            yield flush([held])

    ordered = parts.select("gram", "s1", "s2", "left", "right").repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "gram bigint, s1 bigint, s2 bigint, before bigint, after bigint")


def crowded_reach(parts: DataFrame, s: Settings) -> DataFrame:
    """As ``part_reach``, for minimizers with too many surroundings: digests of their strings, counted by offset."""

    def run(batches):
        for batch in batches:
            for gram, s1, s2, left, right in zip(*(batch.column(c).to_pylist() for c in range(5))):
                data = left[::-1] + right
                n = len(data) - s.width + 1
                if n <= 0:
                    continue
                piece = Piece(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([0]))
                starts = np.arange(n)
                cells = [np.full(n, x, np.int64) for x in (gram, s1, s2)] + [signed(piece.hashes(starts, starts + s.width, k)) for k in (0, 1)]
                cells.append(len(left) - starts)
                use = (cells[5] >= 0) & (cells[5] <= s.width - s.gram)
                yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in cells], ["gram", "s1", "s2", "h1", "h2", "offset"])

    schema = "gram bigint, s1 bigint, s2 bigint, h1 bigint, h2 bigint, offset bigint"
    strings = parts.select("gram", "s1", "s2", "left", "right").mapInArrow(run, schema)
    twice = strings.groupBy("gram", "offset", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = strings.join(twice, ["gram", "offset", "h1", "h2"])
    return found.groupBy("gram", "s1", "s2").agg(F.max("offset").alias("before"), (F.lit(s.width) - F.min("offset")).alias("after"))


def tied_strings(texts: DataFrame, s: Settings) -> DataFrame:
    """Strings with a tied minimizer, once per row and content: h1, h2, id, row, start, n; covered runs within a row have n = 0, ``after`` their length."""

    def run(batches):
        for batch in small(batches):
            ids, keys = ids_of(batch.column("doc_id")), batch.column("row").to_numpy()
            for piece in pieces(batch.column("text"), s):
                _, _, tied, owner = minimizers(piece, s)
                if not len(tied):
                    continue
                h1, h2 = (piece.hashes(tied, tied + s.width, k) for k in (0, 1))
                mixed = mix(h1 ^ mix(h2 + owner.astype(np.uint64)))
                _, first, back, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
                mask = covered(tied[n[back] > 1], s.width, len(piece.data))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                # covered runs never cross rows: strings do not
                cut = np.unique(np.concatenate((edges, piece.at[(piece.at > 0) & (piece.at < len(mask))])))
                a, b = cut[:-1], cut[1:]
                a, b = a[mask[a]], b[mask[a]]
                run_row = np.searchsorted(piece.at, a, "right") - 1
                zero = np.zeros(len(a), np.int64)
                row = owner[first]
                cells = [
                    np.concatenate(x) for x in (
                        (signed(h1[first]), zero), (signed(h2[first]), zero), (ids[piece.rows[row]], ids[piece.rows[run_row]]),
                        (keys[piece.rows[row]], keys[piece.rows[run_row]]),
                        (tied[first] - piece.at[row] + piece.before, a - piece.at[run_row] + piece.before), (n, zero),
                        (np.full(len(first), s.width), b - a),
                    )
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["h1", "h2", "id", "row", "start", "n", "after"])

    return texts.mapInArrow(run, "h1 bigint, h2 bigint, id bigint, row bigint, start bigint, n bigint, after bigint")


def repeated_ranges(texts: DataFrame, s: Settings) -> DataFrame:
    """Byte ranges of every row covered by repeated strings: id, row, start, length (ranges may overlap)."""
    bits = bit_table(texts.select("text"), lambda batch: _gram_keys(batch, s), s.sketch, 2)
    seen = stored(occurrences(texts, s, bits), "minimizers")
    kinds = stored(
        seen.groupBy("gram", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("after").alias("after")), "surroundings"
    )
    grams = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "parts")
    wanted = bit_table(grams.select(F.col("gram").cast("string").alias("text"), "gram"), lambda batch: batch.column("gram").to_numpy().view(np.uint64), s.sketch, 1)
    parts = stored(surroundings(texts, s, bits, wanted), "suffixes")
    crowded = stored(grams.where(F.col("kinds") > s.part).select("gram"), "crowded")
    sorted_ = part_reach(parts.join(crowded, "gram", "left_anti"), s)
    dense = crowded_reach(parts.join(crowded, "gram", "left_semi"), s)
    # the same surroundings twice: every string in them is repeated
    same = kinds.where((F.col("n") > 1) & (F.col("before") + F.col("after") >= s.width)).select("gram", "s1", "s2", "before", "after")
    reached = same.unionByName(sorted_).unionByName(dense).groupBy("gram", "s1", "s2").agg(
        F.max("before").alias("reach_before"), F.max("after").alias("reach_after")
    )
    # tables meet in plain shuffles, of which Spark splits the part of a hot key
    reached = stored(reached, "reached")
    ranges = seen.join(reached, ["gram", "s1", "s2"]).select(
        "id", "row", (F.col("place") - F.col("reach_before")).alias("start"), (F.col("reach_before") + F.col("reach_after")).alias("length")
    )
    tied = stored(tied_strings(texts, s), "tied-strings")
    twice = tied.where("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2")
    elsewhere = tied.where("n = 1").join(stored(twice, "tied-twice"), ["h1", "h2"])
    return ranges.unionByName(
        tied.where("n = 0").unionByName(elsewhere.select(*tied.columns)).select("id", "row", "start", F.col("after").alias("length"))
    )


def suffix_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What is left of every document without repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256, row.

    One row per input row. Null texts are empty and keep nothing; a null doc_id stays null; a repeated row repeats all strings of the other, so
    both lose them; strings shorter than ``width`` are never removed; an empty table gives no rows.
    """
    texts = narrow(docs)
    gone = repeated_ranges(texts, settings).groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("ranges"))
    gone = stored(gone, "removed-ranges")
    last = F.lit(2**63 - 1)
    marked = texts.withColumn("id", F.coalesce("doc_id", last)).join(gone, ["id", "row"], "left").select(
        "doc_id", "row", "text", F.col("ranges.start").alias("starts"), F.col("ranges.length").alias("lengths")
    )

    def keep(batches):
        for batch in batches:
            data, at = buffers(batch.column("text"))
            raw = data.tobytes()
            removed, spans, digests = [], [], []
            for i, (starts, lengths) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("lengths").to_pylist())):
                own, kept, end, runs = raw[at[i] : at[i + 1]], [], 0, 0
                for start, length in zip(starts or (), lengths or ()):
                    if start > end or not runs:
                        kept.append(own[end:start])
                        runs += 1
                    end = max(end, start + length)
                kept.append(own[end:])
                left = b"".join(kept)
                removed.append(len(own) - len(left))
                spans.append(runs)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), batch.column("row")],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "row"],
            )

    return marked.mapInArrow(keep, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, row bigint")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("row")


QUERIES = [Query("op5_suffix_dedup", op5_suffix_dedup)]
