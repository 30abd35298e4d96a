"""A model that is a handful of matrices, applied to vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigloom.operators.vectors import map_rows


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def project(x, parts):
    return x @ parts["axes"]


def fourier(x, parts):
    waves = np.cos(x @ parts["axes"] + parts["phase"])
    return waves * np.sqrt(2.0 / waves.shape[1])


def tensor_sketch(x, parts):
    """Features whose inner products approximate ``(gamma x.y) ** degree``: count sketches multiplied as spectra."""
    size, gamma = int(parts["size"][0]), float(parts["gamma"][0])
    spectrum = np.ones((len(x), size // 2 + 1), complex)
    for buckets, signs in zip(parts["buckets"].astype(int), parts["signs"]):
        sketch = np.zeros((size, len(x)))
        np.add.at(sketch, buckets, (x * signs * np.sqrt(gamma)).T)
        spectrum *= np.fft.rfft(sketch.T, axis=1)
    return np.fft.irfft(spectrum, n=size, axis=1)


def tensor_products(x, parts):
    """The same features from all products of a row's entries, for rows with few of them."""
    found = parts["signs"] * float(parts["gamma"][0]) ** (len(parts["entries"]) / 2)
    for entry in parts["entries"].astype(int):
        found = found * x[:, entry]
    return np.add.reduceat(found, parts["starts"].astype(int), axis=1)


def nearest_euclidean(x, parts):
    return -np.round(np.stack([np.sqrt(np.square(x - c).sum(axis=1)) for c in parts["centroids"]], axis=1), 9)


def nearest_manhattan(x, parts):
    return -np.round(np.stack([np.abs(x - c).sum(axis=1) for c in parts["centroids"]], axis=1), 9)


def linear(x, parts):
    return x @ parts["weights"].T + parts["bias"]


def linear_probability(x, parts):
    return softmax(linear(x, parts))


def logistic_probability(x, parts):
    each = 1.0 / (1.0 + np.exp(-np.clip(linear(x, parts), -500, 500)))
    return each / each.sum(axis=1, keepdims=True)


def gaussian_probability(x, parts):
    """Class densities with one whitening matrix per class."""
    scores = []
    for mean, white, offset in zip(parts["means"], parts["whitening"], parts["offsets"]):
        z = (x - mean) @ white.reshape(len(mean), -1)
        scores.append(offset - 0.5 * (z * z).sum(axis=1))
    return softmax(np.stack(scores, axis=1))


def bayes_probability(x, parts):
    """Class densities of independent features."""
    scores = [o - 0.5 * np.square((x - m) * s).sum(axis=1) for m, s, o in zip(parts["means"], parts["scales"], parts["offsets"])]
    return softmax(np.stack(scores, axis=1))


def stump_probability(x, parts):
    """Weighted votes of one-split trees."""
    classes = int(parts["classes"][0])
    votes = np.zeros((len(x), classes))
    rows = np.arange(len(x))
    for feature, threshold, low, high, weight in parts["stumps"]:
        side = np.where(x[:, int(feature)] <= threshold, int(low), int(high))
        votes[rows, side] += weight
    total = max(parts["stumps"][:, 4].sum(), 1e-300)
    return softmax(votes / total * classes / max(classes - 1, 1))


KERNELS = {
    f.__name__: f
    for f in (
        project, fourier, tensor_sketch, tensor_products, nearest_euclidean, nearest_manhattan, linear, linear_probability,
        logistic_probability, gaussian_probability, bayes_probability, stump_probability,
    )
}


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        extra = {"shapes": {name: list(a.shape) for name, a in self.instance.parts.items()}}
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata=extra)
        rows = [
            (name, i, row.ravel().tolist())
            for name, a in self.instance.parts.items()
            for i, row in enumerate(np.atleast_2d(a))
        ]
        frame = pd.DataFrame(rows, columns=["name", "row", "cells"])
        spark.createDataFrame(frame, "name string, row long, cells array<double>").write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        found = spark.read.parquet(f"{path}/data").orderBy("name", "row").toPandas()
        parts = {
            name: np.array([np.asarray(c, float) for c in found.loc[found["name"] == name, "cells"]]).reshape(shape)
            for name, shape in metadata["shapes"].items()
        }
        model = MatrixModel()
        model.parts = parts
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class MatrixModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Applies one kernel with its matrices; the matrices are as small as any linear model's."""

    kernel = Param(Params._dummy(), "kernel", "name of the row function", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "length of the input vectors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, kernel=None, width=None, parts=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if k != "parts" and v is not None}
        self.parts: dict[str, np.ndarray] = {k: np.asarray(v, float) for k, v in (parts or {}).items()}
        self._set(**given)

    def _transform(self, dataset):
        function = KERNELS[self.getOrDefault(self.kernel)]
        shared = dataset.sparkSession.sparkContext.broadcast(self.parts)
        width = self.getOrDefault(self.width)
        out = function(np.zeros((1, width)), self.parts).shape[1]
        column = map_rows(self.getInputCol(), width, lambda x: function(x, shared.value), out)
        return dataset.withColumn(self.getOutputCol(), column)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()
