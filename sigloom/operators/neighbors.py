"""Exact nearest-neighbour classification as a block-partitioned job."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sigloom.operators.vectors import dense_rows

BLOCK_CELLS = 4_000_000
SMALL_BLOCK = 2048
#: blocks that are made for the sake of parallel work, each sent once per block of the other side
BUSY_BLOCKS = 16
#: rows of either side that are compared at a time
POINT_ROWS, TRAIN_ROWS = 256, 16384


def _blocks(n: int, width: int) -> int:
    """As few blocks as keep tasks busy and fit a task: a vector is sent once per block of the other side."""
    return max(1, min(BUSY_BLOCKS, math.ceil(n / SMALL_BLOCK)), math.ceil(n / max(64, BLOCK_CELLS // max(width, 1))))


def _block_neighbors(width: int, k: int):
    def nearest(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not len(left) or not len(right):
            empty = left["sample_id"].slice(0, 0)
            return pa.table({"sample_id": empty, "neighbor": empty, "label": pa.array([], pa.int32()), "d": pa.array([], pa.float64())})
        right = right.sort_by("neighbor")
        x = dense_rows(left["vector"].combine_chunks(), width)
        y = dense_rows(right["vector"].combine_chunks(), width)
        parts = [_nearest_over(x[at : at + POINT_ROWS], y, k) for at in range(0, len(x), POINT_ROWS)]
        best, d = (np.concatenate(p) for p in zip(*parts))
        flat = pa.array(best.ravel())
        return pa.table(
            {
                "sample_id": left["sample_id"].take(pa.array(np.repeat(np.arange(len(x)), best.shape[1]))),
                "neighbor": right["neighbor"].take(flat),
                "label": right["label"].take(flat),
                "d": d.ravel(),
            }
        )

    return nearest


def _nearest_over(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``y`` nearest to every row of ``x``, of which a part is compared at a time."""
    best, d = _nearest_rows(x, y[:TRAIN_ROWS], k)
    for at in range(TRAIN_ROWS, len(y), TRAIN_ROWS):
        more, further = _nearest_rows(x, y[at : at + TRAIN_ROWS], k)
        best, d = np.hstack([best, more + at]), np.hstack([d, further])
        # a stable order keeps earlier rows first
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        best, d = np.take_along_axis(best, order, axis=1), np.take_along_axis(d, order, axis=1)
    return best, d


def _nearest_rows(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``y`` nearest to every row of ``x`` and their distances; ties go to the earlier row.

    The product of the matrices only sorts out rows that rounding cannot bring among the nearest. The
    distances themselves are sums of squared differences, which do not depend on the other rows of a block.
    """
    k = min(k, len(y))
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    squared = x2[:, None] - 2 * (x @ y.T) + y2
    error = 8 * (x.shape[1] + 2) * np.finfo(float).eps * (x2 + y2.max())
    limit = np.partition(squared, k - 1, axis=1)[:, k - 1] + 2 * error + 1e-300
    # rounded distances may tie beyond the k-th: half a unit of the rounding is let in as well
    limit = np.square(np.sqrt(np.maximum(limit, 0)) + 1e-9)
    best, d = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for i in range(len(x)):
        near = np.flatnonzero(squared[i] <= limit[i])
        own = np.round(np.sqrt(np.square(y[near] - x[i]).sum(axis=1)), 9)
        order = np.argsort(own, kind="stable")[:k]
        best[i], d[i] = near[order], own[order]
    return best, d


def nearest_neighbors(points: DataFrame, train: DataFrame, column: str, width: int, k: int) -> DataFrame:
    """The ``k`` nearest training rows of every point: ``(sample_id, neighbor, label, d, rank)``.

    Points and training rows are dealt into blocks; a task compares one block with
    one block and keeps k per point, and the block winners are ranked again. The
    result is exact, ties go to the smaller id.
    """
    vector = F.unwrap_udt(column).alias("vector")
    n_points, n_train = points.count(), train.count()
    if n_train < k:
        raise ValueError(f"{k} neighbours asked of {n_train} training rows")
    p_blocks, t_blocks = _blocks(n_points, width), _blocks(n_train, width)

    def dealt(df, name, own, blocks, other, other_blocks, *extra):
        number = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other)
        return df.select(F.col("sample_id").alias(name), vector, *extra, number).select("*", copies)

    slots = points.sparkSession.sparkContext.defaultParallelism
    parts = min(p_blocks * t_blocks, 4 * slots)
    left = dealt(points, "sample_id", "p", p_blocks, "t", t_blocks).repartition(parts, "p", "t").groupBy("p", "t")
    right = dealt(train, "neighbor", "t", t_blocks, "p", p_blocks, F.col("label").cast("int").alias("label"))
    right = right.repartition(parts, "p", "t").groupBy("p", "t")
    id_type = points.schema["sample_id"].dataType
    schema = StructType(
        [
            StructField("sample_id", id_type),
            StructField("neighbor", id_type),
            StructField("label", IntegerType()),
            StructField("d", DoubleType()),
        ]
    )
    # column names differ on both sides: they may stem from one cached table
    found = left.cogroup(right).applyInArrow(_block_neighbors(width, k), schema)
    # at most k rows per training block and point
    order = Window.partitionBy("sample_id").orderBy("d", "neighbor")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.train.write.parquet(f"{path}/train")


class _Reader(MLReader):
    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        model = KNNModel()
        model.train = spark.read.parquet(f"{path}/train")
        DefaultParamsReader.getAndSetParams(model, DefaultParamsReader.loadMetadata(path, spark))
        return model


class _KNNParams(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the vectors", TypeConverters.toInt)
    nClasses = Param(Params._dummy(), "nClasses", "number of classes", TypeConverters.toInt)


class KNNModel(Model, _KNNParams, MLWritable, MLReadable):
    """Vote shares of the nearest training rows; the training rows stay a table."""

    def __init__(self):
        super().__init__()
        self.train: DataFrame | None = None

    def _transform(self, dataset):
        column, k = self.getInputCol(), self.getOrDefault(self.k)
        train = self.train.withColumnRenamed("vector", column)
        found = nearest_neighbors(dataset, train, column, self.getOrDefault(self.width), k)
        votes = found.groupBy("sample_id", "label").agg((F.count(F.lit(1)) / k).alias("share"))
        shares = votes.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("_m"))
        every = F.sequence(F.lit(0), F.lit(self.getOrDefault(self.nClasses) - 1))
        dense = F.transform(every, lambda c: F.coalesce(F.element_at("_m", c), F.lit(0.0)))
        scored = shares.select("sample_id", array_to_vector(dense).alias(self.getOutputCol()))
        return dataset.join(scored, "sample_id")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()


class KNN(Estimator, _KNNParams, HasLabelCol):
    """k nearest neighbours, Euclidean, uniform votes."""

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol="label", outputCol="probability", k=10, nClasses=None):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="probability", k=10)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column = self.getInputCol()
        model = KNNModel()
        model.train = dataset.select("sample_id", F.col(column).alias("vector"), F.col(self.getLabelCol()).cast("int").alias("label"))
        first = model.train.first()
        return model._set(
            inputCol=column, outputCol=self.getOutputCol(), k=self.getOrDefault(self.k),
            nClasses=self.getOrDefault(self.nClasses), width=int(first["vector"].size),
        )
