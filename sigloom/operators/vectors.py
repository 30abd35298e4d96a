"""ML vectors: built from long feature tables, and mapped by numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.sequences import kmer_code
from sigloom.operators.skew import hash_rank, salted_join

CELLS_PER_PANEL = 1_000_000


def _vector_array(kinds, sizes, indices, values) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(kinds, pa.int8()), sizes, indices, values], names=["type", "size", "indices", "values"]
    )


def sparse_vector(indices: Column, values: Column, width: int) -> Column:
    """Vector of ``width`` entries from sorted index and value arrays."""

    @F.arrow_udf(VectorUDT())
    def build(i: pa.Array, v: pa.Array) -> pa.Array:
        n = len(i)
        return _vector_array(np.zeros(n, np.int8), pa.array([width] * n, pa.int32()), i, v)

    return build(indices, values)


def dense_vectors(matrix: np.ndarray) -> pa.StructArray:
    """Rows of a matrix as dense vectors."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, float).ravel()))
    return _vector_array(
        np.ones(n, np.int8), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), lists
    )


def dense_rows(vectors: pa.StructArray, width: int) -> np.ndarray:
    """Unwrapped vectors as a dense matrix."""
    n = len(vectors)
    out = np.zeros((n, width))
    if n == 0:
        return out
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    values, indices = vectors.field("values"), vectors.field("indices")
    v_flat, v_at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    if not sparse.any():
        return v_flat[v_at[0] : v_at[-1]].reshape(n, width)
    i_flat, i_at = indices.values.to_numpy(zero_copy_only=False), indices.offsets.to_numpy()
    sizes = np.diff(v_at)
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stored = i_flat[i_at[0] : i_at[-1]]
    column[sparse[row]] = stored[: int(sizes[sparse].sum())]
    out[row, column] = v_flat[v_at[0] : v_at[-1]]
    return out


def sparse_cells(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the non-zero entries of unwrapped vectors, dense or sparse."""
    values, indices = vectors.field("values"), vectors.field("indices")
    v_flat, v_at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    sizes = np.diff(v_at)
    row = np.repeat(np.arange(len(vectors)), sizes)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    if sparse.any():
        i_flat, i_at = indices.values.to_numpy(zero_copy_only=False), indices.offsets.to_numpy()
        feature[sparse[row]] = i_flat[i_at[0] : i_at[-1]][: int(sizes[sparse].sum())]
    value = v_flat[v_at[0] : v_at[-1]] if len(v_at) else np.zeros(0)
    kept = value != 0
    return row[kept], feature[kept], value[kept]


def map_rows(column: str, width: int, kernel: Callable[[np.ndarray], np.ndarray], out: int = 1) -> Column:
    """Vector column to vector column through ``kernel(rows x width) -> rows x anything``.

    Rows are densified a panel at a time, so a wide batch never exists whole; ``out`` is the width of the kernel's rows.
    """

    @F.arrow_udf(VectorUDT())
    def run(vectors: pa.Array) -> pa.Array:
        step = max(1, CELLS_PER_PANEL // max(width, out, 1))
        done = [dense_vectors(kernel(dense_rows(vectors.slice(at, step), width))) for at in range(0, max(len(vectors), 1), step)]
        return pa.concat_arrays(done)

    return run(F.unwrap_udt(column))


def kmer_index(features: DataFrame) -> DataFrame:
    """Numbers of the k-mers that occur: ``(kmer, i)``, from 0 in the order of a hash.

    One distributed distinct and a numbering inside hash buckets; it belongs to a model as its coefficients do.
    """
    return hash_rank(features.select("kmer").distinct(), "kmer", "kmers", "i").select("kmer", F.col("i").cast("int").alias("i"))


def to_vectors(features: DataFrame, samples: DataFrame, k: int, value: str = "n", index: DataFrame | None = None) -> DataFrame:
    """``(sample_id, features)`` for every sample: a sparse vector over the k-mers of ``index``.

    K-mers outside the index are left out: no model knows them. Without an index, entries are the base-4 numbers of the
    k-mers (their order is the alphabet's), which fit a vector up to k = 15. A sample without k-mers gets the zero vector.
    """
    if index is None:
        if k > 15:
            raise ValueError("beyond k = 15 vectors need an index of the observed k-mers: see kmer_index")
        cells, width = features.withColumn("i", kmer_code("kmer", k).cast("int")), 4**k
    else:
        cells, width = salted_join(features, index, ["kmer"], ["sample_id"]), max(1, index.count())
    cells = cells.select("sample_id", "i", F.col(value).cast("double").alias("v"))
    rows = cells.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_c"))
    whole = samples.select("sample_id").distinct().join(rows, "sample_id", "left")
    indices = F.coalesce(F.col("_c.i"), F.array().cast("array<int>"))
    values = F.coalesce(F.col("_c.v"), F.array().cast("array<double>"))
    return whole.select("sample_id", sparse_vector(indices, values, width).alias("features"))
