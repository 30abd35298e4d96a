"""Nearest-centroid classifiers and per-class statistics."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sigloom.operators.models import MatrixModel
from sigloom.operators.skew import salted_join
from sigloom.session import stored


def vector_cells(dataset: DataFrame, label: str, column: str) -> DataFrame:
    """Stored entries of a vector column in long form: ``(label, feature, value)``."""
    parts = F.unwrap_udt(column)
    positions = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    zipped = F.arrays_zip(positions.alias("i"), parts["values"].alias("v"))
    return dataset.select(F.col(label).alias("label"), F.explode(zipped).alias("_c")).select(
        "label", F.col("_c.i").alias("feature"), F.col("_c.v").alias("value")
    )


def _with_zeros(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counted values per (label, feature); the entries a sparse table leaves out count as zero."""
    counted = cells.groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("c"))
    present = counted.groupBy("label", "feature").agg(F.sum("c").alias("_have"))
    zeros = present.join(sizes, "label").where(F.col("size") > F.col("_have")).select(
        "label", "feature", F.lit(0.0).alias("value"), (F.col("size") - F.col("_have")).alias("c")
    )
    return counted.unionByName(zeros).groupBy("label", "feature", "value").agg(F.sum("c").alias("c"))


#: distinct values of a class and feature that one task may order
ORDERED = 10_000
BUCKETS = 1024
_KEY = ["label", "feature"]


def _narrowed(kept: DataFrame, offsets: DataFrame, sizes: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of the bucket that holds the lower middle position, and the number of values below it.

    Every class and feature of ``wide`` is cut into equal buckets between its least and greatest value. Only counts per
    bucket meet, at most ``BUCKETS`` per class and feature; the values themselves stay dealt over the tasks by a salt.
    """
    joined = salted_join(kept, wide, _KEY, ["value"], "left")
    bucket = F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS)
    placed = joined.withColumn("bucket", F.when(F.col("lo").isNotNull(), F.least(bucket, F.lit(BUCKETS - 1)))).drop("lo", "hi")
    counts = placed.where("bucket IS NOT NULL").groupBy(*_KEY, "bucket").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*_KEY).orderBy("bucket"))
    ranked = counts.withColumn("_upto", upto).join(offsets, _KEY, "left").join(sizes, "label")
    below = F.coalesce("below", F.lit(0)) + F.col("_upto") - F.col("c")
    position = F.floor((F.col("size") - 1) / 2)
    middle = ranked.withColumn("below", below).where((F.col("below") <= position) & (position < F.col("below") + F.col("c")))
    chosen = stored(middle.select(*_KEY, F.col("bucket").alias("chosen"), "below"), "median-buckets")
    near = salted_join(placed, chosen.drop("below"), _KEY, ["value"], "left")
    inside = F.col("bucket").isNull() | (F.col("bucket") == F.col("chosen"))
    others = offsets.join(chosen, _KEY, "left_anti")
    return stored(near.where(inside).select(*_KEY, "value", "c"), "median-values"), others.unionByName(chosen.select(*_KEY, "below"))


def medians(cells: DataFrame, sizes: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """Exact median per (label, feature), zeros of sparse entries included.

    Equal values are counted first. Where a class and feature has more than ``ordered`` distinct values, histograms narrow them down
    to the bucket around the lower middle, again and again: the least and the greatest value never share a bucket, so every
    round leaves values out. What is left is ordered by a window of bounded size; the upper middle is the same value or the next
    one, found by a minimum. Features without a stored entry in a class are absent (their median is zero).
    """
    counted = stored(_with_zeros(cells, sizes), "counted-values")
    kept, offsets = counted, counted.sparkSession.createDataFrame([], counted.select(*_KEY).schema.add("below", LongType()))
    while True:
        extent = kept.groupBy(*_KEY).agg(F.count("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        wide = extent.where((F.col("m") > ordered) & (F.col("lo") < F.col("hi"))).drop("m")
        if wide.isEmpty():
            break
        kept, offsets = _narrowed(kept, offsets, sizes, wide)
    upto = F.sum("c").over(Window.partitionBy(*_KEY).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = kept.withColumn("_upto", upto).join(offsets, _KEY, "left").join(sizes, "label")
    ranked = ranked.withColumn("_upto", F.col("_upto") + F.coalesce("below", F.lit(0)))
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    lower = ranked.where((F.col("_upto") - F.col("c") <= low) & (low < F.col("_upto"))).select(
        *_KEY, F.col("value").alias("_a"), (high < F.col("_upto")).alias("_same")
    )
    beyond = salted_join(counted, lower.where("NOT _same"), _KEY, ["value"]).where("value > _a")
    upper = beyond.groupBy(*_KEY).agg(F.min("value").alias("_b"))
    both = lower.join(upper, _KEY, "left")
    return both.select(*_KEY, ((F.col("_a") + F.coalesce("_b", "_a")) / 2).alias("median"))


def class_stats(features: DataFrame, samples: DataFrame, feature: str = "kmer", value: str = "n") -> DataFrame:
    """Mean, median and population variance per (class, feature), and the class prior.

    ``features`` is a long sparse table; absent entries are zeros. Only features seen
    in a class are listed for it.
    """
    sizes = samples.groupBy(F.col("group").alias("label")).agg(F.count(F.lit(1)).alias("size"))
    total = samples.agg(F.count(F.lit(1))).scalar()
    labels = samples.select("sample_id", F.col("group").alias("label"))
    cells = salted_join(features, labels, ["sample_id"], [feature]).select(
        "label", F.col(feature).alias("feature"), F.col(value).cast("double").alias("value")
    )
    sums = cells.groupBy("label", "feature").agg(
        F.count("value").alias("_have"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var")
    )
    # the zeros' share of the spread is added to that of the stored values: nothing large cancels
    share = F.col("_have") / F.col("size")
    basic = sums.join(sizes, "label").select(
        "label", "feature", (F.col("_mean") * share).alias("mean"),
        (share * (F.col("_var") + (1 - share) * F.col("_mean") * F.col("_mean"))).alias("variance"), "size",
    )
    joined = basic.join(medians(cells, sizes), ["label", "feature"]).withColumn("_total", total)
    return joined.select(
        F.col("label").alias("group"), "feature", "mean", "median", "variance",
        (F.col("size") / F.col("_total")).alias("prior"),
    )


class NearestCentroid(Estimator, HasInputCol, HasLabelCol, HasOutputCol):
    """Class of the nearest centroid: means with Euclidean, or medians with Manhattan distance."""

    statistic = Param(Params._dummy(), "statistic", "mean or median", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol="label", outputCol="scores", statistic="mean"):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="scores", statistic="mean")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        column, label = self.getInputCol(), self.getLabelCol()
        per_class = dataset.groupBy(label).agg(Summarizer.metrics("count", "mean").summary(F.col(column)).alias("s"))
        # one row per class
        rows = per_class.select(F.col(label).cast("int").alias("l"), "s.count", "s.mean").collect()
        width = rows[0]["mean"].size
        centroids = np.zeros((len(rows), width))
        if self.getOrDefault(self.statistic) == "mean":
            kernel = "nearest_euclidean"
            for row in rows:
                centroids[row["l"]] = row["mean"].toArray()
        else:
            kernel = "nearest_manhattan"
            sizes = dataset.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("size"))
            # at most classes x width numbers, the size of the model
            found = medians(vector_cells(dataset, label, column), sizes).where("median <> 0").toPandas()
            centroids[found["label"].astype(int), found["feature"].astype(int)] = found["median"]
        return MatrixModel(
            inputCol=column, outputCol=self.getOutputCol(), kernel=kernel, width=int(width), parts={"centroids": centroids}
        )
