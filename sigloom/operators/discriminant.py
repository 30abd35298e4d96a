"""Linear and quadratic discriminant analysis from distributed scatter matrices."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.sql import functions as F

from sigloom.operators.models import MatrixModel
from sigloom.operators.moments import grouped_moments, lda_parts, qda_parts


class _Discriminant(Estimator, HasInputCol, HasLabelCol, HasOutputCol):
    @keyword_only
    def __init__(self, *, inputCol=None, labelCol="label", outputCol="probability"):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="probability")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        """One aggregation gives the moments of all classes."""
        column, label = self.getInputCol(), self.getLabelCol()
        width = int(dataset.select(column).first()[0].size)
        rows = dataset.select(column, F.col(label).cast("int").alias("_label"))
        found = grouped_moments(rows, column, ["_label"], width)
        kernel, parts = self._model([found[key] for key in sorted(found)])
        return MatrixModel(inputCol=column, outputCol=self.getOutputCol(), kernel=kernel, width=width, parts=parts)


class LDA(_Discriminant):
    """Common covariance: linear scores."""

    def _model(self, classes):
        return "linear_probability", lda_parts(classes)


class QDA(_Discriminant):
    """One covariance per class."""

    def _model(self, classes):
        return "gaussian_probability", qda_parts(classes)
