"""k-mer extraction, counting and frequency tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.sequences import ALPHABET, check_k
from sigloom.operators.skew import salted_join

CHUNK = 65536


def kmers(
    sequences: DataFrame, k: int | Iterable[int], ids: Sequence[str] = ("sample_id",), as_text: bool = True
) -> DataFrame:
    """One row per k-mer position: ``(ids..., k, kmer)``, for one k or several in one scan.

    Letters are cut out of the *binary* form of a sequence (constant-time offsets).
    A sequence is first cut into overlapping chunks, so that a chromosome never
    becomes one array of positions; both explodes and the substring run inside
    one generated stage together with the partial count of ``kmer_counts``.
    """
    ks = sorted({check_k(x) for x in ([k] if isinstance(k, int) else k)})
    keep = [F.col(c) for c in ids]
    size = F.length("_seq")
    chunk_starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")))
    chunks = (
        sequences.select(*keep, F.col("seq").cast("binary").alias("_seq"))
        .select(*keep, "_seq", F.explode(chunk_starts).alias("_c"))
        .select(*keep, F.substring("_seq", F.col("_c") * CHUNK + 1, F.lit(CHUNK + ks[-1] - 1)).alias("_part"))
    )
    if len(ks) > 1:
        chunks = chunks.select(*keep, "_part", F.explode(F.array(*[F.lit(x) for x in ks])).alias("k"))
    else:
        chunks = chunks.withColumn("k", F.lit(ks[0]))
    last = F.least(F.length("_part") - F.col("k") + 1, F.lit(CHUNK))
    positions = F.when(last >= 1, F.sequence(F.lit(1), last))
    word = F.substring(F.col("_part"), F.col("_at"), F.col("k"))
    return chunks.select(*keep, "k", "_part", F.explode(positions).alias("_at")).select(
        *keep, "k", (word.cast("string") if as_text else word).alias("kmer")
    )


def kmer_counts(
    sequences: DataFrame, k: int | Iterable[int], ids: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """k-mer counts per sample: ``(ids..., k, kmer, n)``; all records of a sample add up.

    Counting is a partial plus a final hash aggregation on (sample, k, k-mer): the
    shuffle carries distinct k-mers per task, and a sample that owns a third of the
    bases is spread over its k-mers.
    """
    rows = kmers(sequences, k, ids, as_text=False)
    ks = [k] if isinstance(k, int) else sorted(set(k))
    # a constant is no grouping key
    keys = [*ids, "kmer"] if len(ks) == 1 else [*ids, "k", "kmer"]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one_k = F.lit(ks[0]) if len(ks) == 1 else F.col("k")
    return counted.select(*ids, one_k.alias("k"), F.col("kmer").cast("string").alias("kmer"), "n")


def kmer_totals(sequences: DataFrame, k: int) -> DataFrame:
    """Counts of the k-mers of all samples together: ``(kmer, n)``, for sequences of ACGT.

    K-mers are base-4 numbers, 8 bytes with one bit pattern each up to k = 32, made and partly counted where sequences are
    read, some letters at a time; only distinct ones become text.
    """
    k = check_k(k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in _codes(batch.column("seq").drop_null(), k):
                found, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["code", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.arange(2 * k - 2, -1, -2, dtype=np.uint64)
        for batch in batches:
            codes = batch.column("code").to_numpy().view(np.uint64)
            letters = _LETTERS[((codes[:, None] >> shifts) & np.uint64(3)).astype(np.uint8)].tobytes()
            offsets = np.arange(0, (len(codes) + 1) * k, k, dtype=np.int32)
            words = pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(letters))
            yield pa.RecordBatch.from_arrays([words, batch.column("n")], ["kmer", "n"])

    parts = sequences.select("seq").mapInArrow(count, "code bigint, n bigint")
    return parts.groupBy("code").agg(F.sum("n").alias("n")).mapInArrow(spell, "kmer string, n bigint")


def _codes(column: pa.StringArray, k: int) -> Iterator[np.ndarray]:
    """Numbers of the k-mers at all positions of all rows, ``_LETTERS_AT_ONCE`` at a time."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0]) if len(offsets) else 0
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
    borders = offsets - offsets[0] if size else offsets
    for at in range(0, size - k + 1, _LETTERS_AT_ONCE):
        end = min(size, at + _LETTERS_AT_ONCE + k - 1)
        row = np.zeros(end - at, np.int32)
        own = borders[(borders > at) & (borders < end)] - at
        np.add.at(row, own, 1)
        row = np.cumsum(row)
        piece, width, made, done = _DIGIT[data[at:end]], 1, None, 0
        while width <= k:  # numbers of 1, 2, 4, ... letters are put together
            if k & width:
                made = piece if made is None else (piece[: len(made) - width] << np.uint64(2 * done)) | made[width:]
                done += width
            piece = (piece[:-width] << np.uint64(2 * width)) | piece[width:]
            width *= 2
        yield made[row[: len(made)] == row[k - 1 :]]


_LETTERS_AT_ONCE = 1 << 20
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_DIGIT = np.zeros(256, np.uint64)
_DIGIT[_LETTERS] = np.arange(4)


def kmer_frequencies(counts: DataFrame, ids: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Counts divided by the sample's total: ``(ids..., k, kmer, freq)``.

    The totals come back through a salted join, not a window over the sample, so a
    sample with billions of distinct k-mers is not sorted in one task.
    """
    totals = counts.groupBy(*ids, "k").agg(F.sum("n").alias("_total"))
    joined = salted_join(counts, totals, [*ids, "k"], ["kmer"])
    return joined.select(*ids, "k", "kmer", F.try_divide("n", "_total").alias("freq"))


def avg_nonzero(features: DataFrame, samples: DataFrame, value: str = "n") -> DataFrame:
    """Average number of non-zero entries per sample, truncated; empty samples count."""
    nonzero = features.where(F.col(value) != 0).agg(F.count(F.lit(1)).alias("_nz"))
    size = samples.agg(F.countDistinct("sample_id").alias("_n"))
    return size.select(
        F.floor(F.try_divide(nonzero.scalar(), F.col("_n"))).cast("bigint").alias("avg_nonzero")
    )


def label_features(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Attach the ``group`` of each sample to its feature rows."""
    return salted_join(features, samples.select("sample_id", "group"), ["sample_id"], ["kmer"])
