"""Boosted one-split trees (SAMME)."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.sql import functions as F

from sigloom.operators.models import MatrixModel


def _stump(tree) -> tuple[int, float, int, int]:
    """Feature, threshold and the class on either side of a fitted one-split tree."""
    root = tree._java_obj.rootNode()
    if tree.depth == 0:
        only = int(root.prediction())
        return 0, float("inf"), only, only
    split = root.split()
    sides = int(root.leftChild().prediction()), int(root.rightChild().prediction())
    return int(split.featureIndex()), float(split.threshold()), *sides


class AdaBoost(Estimator, HasInputCol, HasLabelCol, HasOutputCol):
    """Each round fits a weighted one-split tree to what the earlier ones got wrong.

    The weight of a row is one expression over the cached training table, rebuilt
    from the stumps so far: rounds never stack up as plan or lineage.
    """

    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    nClasses = Param(Params._dummy(), "nClasses", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol="label", outputCol="probability", rounds=50, nClasses=None):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="probability", rounds=50)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column, label, classes = self.getInputCol(), self.getLabelCol(), self.getOrDefault(self.nClasses)
        table = dataset.select(
            F.col(column).alias("features"), F.col(label).alias("label"), vector_to_array(column).alias("_x")
        ).persist()
        width = table.first()["features"].size
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="_w", featuresCol="features", labelCol="label")
        stumps: list[tuple] = []
        exponent = F.lit(0.0)
        for _ in range(self.getOrDefault(self.rounds)):
            weighted = table.withColumn("_w", F.exp(exponent))
            feature, threshold, low, high = _stump(tree.fit(weighted))
            side = F.when(F.col("_x")[feature] <= threshold, low).otherwise(high)
            wrong = F.when(side != F.col("label"), 1.0).otherwise(0.0)
            row = weighted.agg(F.sum(F.col("_w") * wrong).alias("bad"), F.sum("_w").alias("all")).first()
            error = row["bad"] / row["all"]
            if error >= 1 - 1 / classes:
                # no better than chance: boosting ends, as long as there is a tree at all
                if not stumps:
                    raise ValueError("one-split trees do no better than chance on this data")
                break
            alpha = float(np.log(max(1 - error, 1e-300) / max(error, 1e-16)) + np.log(classes - 1)) if classes > 1 else 1.0
            stumps.append((feature, threshold, low, high, alpha))
            if error <= 0:
                break
            exponent = exponent + wrong * alpha
        table.unpersist()
        return MatrixModel(
            inputCol=column, outputCol=self.getOutputCol(), kernel="stump_probability", width=int(width),
            parts={"stumps": np.array(stumps), "classes": np.array([classes])},
        )
