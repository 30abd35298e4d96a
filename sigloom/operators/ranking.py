"""Ranked predictions and the metrics read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.naming import percent_label


def _rank(scores: DataFrame, *order: Column) -> DataFrame:
    # a window holds one sample's classes
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order)))


def rank_eval(scores: DataFrame) -> DataFrame:
    """Rank classes for evaluation: likeliest first, ties by class name descending."""
    return _rank(scores, F.col("prob").desc(), F.col("cls").desc())


def rank_predict(scores: DataFrame) -> DataFrame:
    """Rank classes for prediction: likeliest first, ties by class name ascending."""
    return _rank(scores, F.col("prob").desc(), F.col("cls").asc())


def top1(predictions: DataFrame) -> DataFrame:
    """Best class per file with its label: ``A1 (97.3%)``, or the bare class without probabilities."""
    best = predictions.where(F.col("rank") == 1)
    label = F.coalesce(F.when(F.col("prob").isNotNull(), percent_label("cls", "prob")), F.col("cls"))
    return best.withColumn("label", label)


def name_predictions(predictions: DataFrame, inputs: DataFrame) -> DataFrame:
    """Attach the input file name to every prediction."""
    return predictions.join(inputs, "sample_id")


def classes(samples: DataFrame) -> DataFrame:
    """Distinct class names, in order."""
    return samples.select("group").distinct().orderBy("group")


def class_sizes(samples: DataFrame) -> DataFrame:
    """Number of samples per class."""
    return samples.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def outcomes(ranked: DataFrame) -> DataFrame:
    """One row per tested sample: its predicted class, the rank of its true class and the depth of its ranking.

    ``ranked`` has ``fold, sample_id, actual, cls, prob, rank``. The true class has no
    rank when the training fold lacked it. ``depth`` is the largest N for which a top-N
    result exists: one less than the ranked classes, or 1 without probabilities.
    """
    depth = F.when(F.max(F.col("prob").isNotNull()), F.max("rank") - 1).otherwise(F.lit(1))
    return ranked.groupBy("fold", "sample_id", "actual").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cls"))).alias("predicted"),
        F.min(F.when(F.col("cls") == F.col("actual"), F.col("rank"))).alias("true_rank"),
        depth.cast("int").alias("depth"),
    )


def _upto(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1), n))


def topn_hits(outcome: DataFrame) -> DataFrame:
    """``(fold, sample_id, n, hit)`` for every N the ranking supports."""
    hit = F.coalesce(F.col("true_rank") <= F.col("n"), F.lit(False))
    rows = outcome.select("fold", "sample_id", "true_rank", F.explode(_upto(F.col("depth"))).alias("n"))
    return rows.select("fold", "sample_id", "n", hit.alias("hit"))


def topn_accuracy(outcome: DataFrame) -> DataFrame:
    """Per fold and N: ``1 - misses / points``.

    Samples are first counted per rank of their true class; N is spread out over
    that small table, not over the samples.
    """
    counted = outcome.groupBy("fold", "depth", "true_rank").agg(F.count(F.lit(1)).alias("_c"))
    spread = counted.select("fold", "true_rank", "_c", F.explode(_upto(F.col("depth"))).alias("n"))
    missed = F.when(F.coalesce(F.col("true_rank") <= F.col("n"), F.lit(False)), 0).otherwise(F.col("_c"))
    return (
        spread.groupBy("fold", "n")
        .agg(F.sum("_c").alias("points"), F.sum(missed).alias("misses"))
        .withColumn("accuracy", 1 - F.col("misses") / F.col("points"))
    )


def cv_accuracy(per_fold: DataFrame, v: int) -> DataFrame:
    """Mean of the fold accuracies over the configured number of folds, per N."""
    return per_fold.groupBy("n").agg((F.sum("accuracy") / F.lit(v)).alias("accuracy"))


def misclassified(outcome: DataFrame) -> DataFrame:
    """``(n, sample_id)`` of the samples whose true class is not among the first N."""
    last = F.least(F.coalesce(F.col("true_rank") - 1, F.col("depth")), F.col("depth"))
    return outcome.select(F.explode(_upto(last)).alias("n"), "sample_id").distinct()


def union_misses(parts: list[DataFrame]) -> DataFrame:
    """Misses of several folds, each sample once per N."""
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.distinct()


def confusion_grid(class_names: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (actual, predicted) pair of classes with its count, zeros included."""
    # the class list; the grid has its square as the confusion matrix does
    names = class_names.agg(F.collect_set("group").alias("_all"))
    grid = names.select(F.explode("_all").alias("actual"), "_all").select("actual", F.explode("_all").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def confusion_matrix(outcome: DataFrame, class_names: DataFrame) -> DataFrame:
    """Confusion counts summed over folds: ``(actual, predicted, n)``."""
    counts = outcome.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return confusion_grid(class_names, counts)


def cv_timing(fold_stats: DataFrame, v: int) -> DataFrame:
    """Mean train and test seconds, iterations and explained-variance ratio over the folds.

    The last two are null when no fold reports them.
    """
    names = {"train_time": "train_time", "test_time": "test_time", "iterations": "average_iterations",
             "reduced_variance_ratio": "average_reduced_variance_ratio"}
    return fold_stats.agg(*[(F.sum(c) / F.lit(v)).alias(name) for c, name in names.items()])
