"""Feature transforms fitted on training rows."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.models import MatrixModel
from sigloom.operators.svd import projected as coordinates
from sigloom.operators.svd import singular_axes, vector_keys


def column_stats(dataset: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population variance of every vector entry."""
    found = dataset.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s"))
    row = found.select("s.count", "s.mean", "s.variance").first()
    n = int(row["count"])
    return n, row["mean"].toArray(), row["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)


class UnitVarianceScaler(Estimator, HasInputCol, HasOutputCol):
    """Divide every entry by its standard deviation, without centering.

    An entry without variance is left as it is. The fitted stage is an
    ``ElementwiseProduct``: it keeps vectors sparse and stays in the JVM.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        _, _, variance = column_stats(dataset, self.getInputCol())
        spread = np.sqrt(np.maximum(variance, 0.0))
        factors = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 1.0)
        return ElementwiseProduct(
            scalingVec=Vectors.dense(factors), inputCol=self.getInputCol(), outputCol=self.getOutputCol()
        )


def row_matrix(dataset: DataFrame, column: str) -> RowMatrix:
    """Vector column as a distributed matrix."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(dataset.select(F.col(column).alias("vector")), "vector"))


#: widest rows whose Gram matrix is decomposed in one piece; the axes (at most its square) are then a model's matrix
GRAM_WIDTH = 4096


class TruncatedSVD(Estimator, HasInputCol, HasOutputCol, HasSeed):
    """Project onto the leading right singular vectors of the uncentered rows.

    ``solver`` is ``gram`` (exact, the axes pass through the driver), ``sketch`` (``operators.svd``: any width, axes stay a table), or
    ``auto``: gram up to ``GRAM_WIDTH`` features.
    """

    components = Param(Params._dummy(), "components", "number of dimensions kept", TypeConverters.toInt)
    solver = Param(Params._dummy(), "solver", "gram, sketch or auto", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, components=None, solver="auto", seed=0):
        super().__init__()
        self._setDefault(solver="auto", seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column, solver = self.getInputCol(), self.getOrDefault(self.solver)
        width = int(dataset.select(column).first()[0].size)
        wanted = min(self.getOrDefault(self.components), width)
        if solver == "sketch" or (solver == "auto" and width > GRAM_WIDTH):
            axes, _ = singular_axes(dataset, column, wanted, self.getSeed())
            return AxesModel(inputCol=column, outputCol=self.getOutputCol(), components=wanted, axes=axes)
        found = row_matrix(dataset, column).computeSVD(wanted, computeU=False).V.toArray()
        # directions beyond the rank project onto zero
        found = np.pad(found, ((0, 0), (0, wanted - found.shape[1])))
        return MatrixModel(inputCol=column, outputCol=self.getOutputCol(), kernel="project", width=width, parts={"axes": found})


class _AxesWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.axes.write.parquet(f"{path}/axes")


class _AxesReader(MLReader):
    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        model = AxesModel(axes=spark.read.parquet(f"{path}/axes"))
        DefaultParamsReader.getAndSetParams(model, DefaultParamsReader.loadMetadata(path, spark))
        return model


class AxesModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Projection onto axes that are a table of their own: a join and a sum, with no bound on their number or length."""

    components = Param(Params._dummy(), "components", "number of dimensions kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, components=None, axes=None):
        super().__init__()
        self.axes = axes
        self._set(**{k: v for k, v in self._input_kwargs.items() if k != "axes" and v is not None})

    def _transform(self, dataset):
        column = self.getInputCol()
        k1, k2 = vector_keys(column)
        found = coordinates(dataset, column, self.axes, self.getOrDefault(self.components))
        found = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), array_to_vector("cells").alias(self.getOutputCol()))
        return dataset.withColumns({"_k1": k1, "_k2": k2}).join(found, ["_k1", "_k2"]).drop("_k1", "_k2")

    def write(self):
        return _AxesWriter(self)

    @classmethod
    def read(cls):
        return _AxesReader()


def total_variance(dataset: DataFrame, column: str) -> float:
    """Sum of the population variances of all vector entries, from the stored ones alone.

    Up to ``GRAM_WIDTH`` features one row of statistics is kept per task. Beyond it, a feature's deviations are those among its stored
    values plus what its zeros add, so nothing cancels and no row as wide as the vectors exists.
    """
    first = dataset.select(column).first()
    if first is None:
        return 0.0
    if first[0].size <= GRAM_WIDTH:
        return float(column_stats(dataset, column)[2].sum())
    n = dataset.count()
    values = F.unwrap_udt(column)
    at = F.coalesce(values["indices"], F.sequence(F.lit(0), F.size(values["values"]) - 1))
    cells = dataset.select(F.explode(F.arrays_zip(at.alias("i"), values["values"].alias("v"))).alias("c")).select("c.i", "c.v")
    per = cells.groupBy("i").agg(F.count("v").alias("have"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    spread = F.col("have") * F.col("var") + F.col("have") * (n - F.col("have")) / F.lit(n) * F.col("mean") * F.col("mean")
    return float(per.agg(F.sum(spread)).first()[0] or 0.0) / max(n, 1)


def explained_variance_ratio(dataset: DataFrame, original: str, projected: str) -> float:
    """Variance kept by a projection, as a share of the variance before it."""
    before, after = total_variance(dataset, original), total_variance(dataset, projected)
    return after / before if before > 0 else 0.0
