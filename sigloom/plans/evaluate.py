"""Cross-validated evaluation of classifiers."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import ranking
from sigloom.operators.classifiers import MOMENT_MODELS, FittedClassifier, Options, fit_classifier, fit_moments
from sigloom.operators.distances import distance_features
from sigloom.operators.folds import assign_folds
from sigloom.operators.folds import test_split as held_out
from sigloom.operators.folds import train_split
from sigloom.operators.moments import Moments, grouped_moments, merge_all
from sigloom.operators.transforms import explained_variance_ratio

LOG = logging.getLogger("sigloom.evaluate")


@dataclass
class Evaluation:
    """Result tables of one or more classifiers; every table has a ``classifier`` column."""

    topn: DataFrame
    confusion: DataFrame
    misclassified: DataFrame
    timing: DataFrame
    outcomes: DataFrame
    failed: dict[str, str]

    def union(self, other: Evaluation) -> Evaluation:
        return Evaluation(
            self.topn.unionByName(other.topn),
            self.confusion.unionByName(other.confusion),
            self.misclassified.unionByName(other.misclassified),
            self.timing.unionByName(other.timing),
            self.outcomes.unionByName(other.outcomes),
            {**self.failed, **other.failed},
        )


def nonzero_average(features: DataFrame) -> int:
    """Average number of non-zero vector entries, truncated."""
    values = F.unwrap_udt("features")["values"]
    filled = F.size(F.filter(values, lambda v: v != 0))
    row = features.agg(F.sum(filled).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return int((row["s"] or 0) // row["n"]) if row["n"] else 0


def _iterations(fitted: FittedClassifier) -> float | None:
    """Training iterations, where the fitted stage reports them."""
    last = fitted.model.stages[-1]
    if not getattr(last, "hasSummary", False):
        return None
    summary = last.summary() if callable(last.summary) else last.summary
    return float(summary.totalIterations)


#: cells of all folds' and classes' scatter matrices up to which they are kept together
MOMENT_CELLS = 16_000_000


def _fold_moments(table: DataFrame, names: list[str], width: int) -> dict[tuple[int, str], Moments]:
    """Moments of every fold and class, from one scan."""
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("group")).cast("int") - 1
    rows = table.select("fold", label.alias("label"), "features")
    return {(fold, names[k]): m for (fold, k), m in grouped_moments(rows, "features", ["fold", "label"], width).items()}


def _training_moments(by_fold: dict[tuple[int, str], Moments], fold: int) -> dict[str, Moments]:
    """Moments of each class over all folds but one."""
    kept = [(name, m) for (f, name), m in sorted(by_fold.items(), key=lambda x: x[0]) if f != fold]
    return {name: merge_all(m for other, m in kept if other == name) for name in {n for n, _ in kept}}


FOLD_STATS = "fold int, train_time double, test_time double, iterations double, reduced_variance_ratio double"


def cross_validate(
    features: DataFrame,
    samples: DataFrame,
    classifier: str,
    v: int,
    seed: int = 0,
    split_by: str | None = None,
    options: Options | None = None,
    width: int | None = None,
    distances: DataFrame | None = None,
) -> Evaluation:
    """Cross-validate one classifier.

    ``features`` is ``(sample_id, features VECTOR)`` and ``samples`` has ``sample_id,
    group`` and the ``split_by`` column. With ``distances`` (a full matrix) the
    features of a fold are the distances to its training samples instead. Classifiers made of class moments (centroid
    means, Bayes, both discriminants) and their preparation are fitted for all folds from one scan, whose moments per fold and class
    are merged into those of each training set.
    """
    options = options or Options(seed=seed)
    folded = assign_folds(samples, v, seed, split_by).persist(StorageLevel.MEMORY_AND_DISK)
    tables, stats = [], []
    table = None
    if distances is None:
        table = features.join(folded.select("sample_id", "group", "fold"), "sample_id").persist(
            StorageLevel.MEMORY_AND_DISK
        )
        average = nonzero_average(table)
        width = width or table.first()["features"].size
    by_fold, shared = None, 0.0
    if distances is None and classifier in MOMENT_MODELS:
        start = time.monotonic()
        names = sorted(r["group"] for r in folded.select("group").distinct().collect())
        if v * len(names) * width * width <= MOMENT_CELLS:
            by_fold = _fold_moments(table, names, width)
            shared = (time.monotonic() - start) / v
    for fold in range(v):
        if distances is not None:
            train_ids = train_split(folded, fold).select("sample_id")
            rows = distance_features(distances, train_ids)
            vectors = rows.select("sample_id", array_to_vector("features").alias("features"))
            table = vectors.join(folded.select("sample_id", "group", "fold"), "sample_id").persist(
                StorageLevel.MEMORY_AND_DISK
            )
            average, width = nonzero_average(table), train_ids.count()
        start, ratio = time.monotonic() - shared, None
        if by_fold is not None:
            fitted, ratio = fit_moments(classifier, _training_moments(by_fold, fold), average, options)
        else:
            fitted = fit_classifier(classifier, train_split(table, fold).drop("fold"), width, average, options)
        trained = time.monotonic()
        scored = fitted.scores(held_out(table, fold).select("sample_id", "features"))
        truth = held_out(folded, fold).select("sample_id", "fold", F.col("group").alias("actual"))
        outcome = ranking.outcomes(ranking.rank_eval(scored).join(truth, "sample_id"))
        outcome = outcome.persist(StorageLevel.MEMORY_AND_DISK)
        outcome.count()
        tested = time.monotonic()
        if by_fold is None and not options.skip_normalization:
            projected = fitted.model.stages[1].transform(fitted.model.stages[0].transform(train_split(table, fold)))
            ratio = explained_variance_ratio(projected, "scaled", "reduced")
        stats.append((fold, trained - start, tested - trained, _iterations(fitted), ratio))
        tables.append(outcome)
        if distances is not None:
            table.unpersist()
    everything = tables[0]
    for part in tables[1:]:
        everything = everything.unionByName(part)
    spark = samples.sparkSession
    timing = ranking.cv_timing(spark.createDataFrame(stats, FOLD_STATS), v)
    names = samples.select("group").distinct()
    tag = F.lit(classifier).alias("classifier")
    return Evaluation(
        topn=ranking.cv_accuracy(ranking.topn_accuracy(everything), v).select(tag, "n", "accuracy"),
        confusion=ranking.confusion_matrix(everything, names).select(tag, "actual", "predicted", "n"),
        misclassified=ranking.misclassified(everything).select(tag, "n", "sample_id"),
        timing=timing.select(tag, "*"),
        outcomes=everything.select(tag, "*"),
        failed={},
    )


def evaluate(
    features: DataFrame, samples: DataFrame, classifiers: Iterable[str], v: int, **settings
) -> Evaluation:
    """Cross-validate several classifiers; one that fails is logged and left out of the results."""
    total: Evaluation | None = None
    failed: dict[str, str] = {}
    for name in classifiers:
        try:
            one = cross_validate(features, samples, name, v, **settings)
        except Exception as error:  # noqa: BLE001 - any failure skips just this classifier
            LOG.warning("classifier %s failed, skipping: %s", name, error)
            failed[name] = str(error)
            continue
        total = one if total is None else total.union(one)
    if total is None:
        raise RuntimeError(f"no classifier succeeded: {failed}")
    total.failed.update(failed)
    return total


def fit_final(
    features: DataFrame, samples: DataFrame, classifier: str, options: Options | None = None, width: int | None = None,
    generation: dict | None = None, index: DataFrame | None = None,
) -> FittedClassifier:
    """Fit on all samples; ``generation`` records how the features were made (mode, k), ``index`` numbers their k-mers."""
    table = features.join(samples.select("sample_id", "group"), "sample_id").persist(StorageLevel.MEMORY_AND_DISK)
    width = width or table.first()["features"].size
    fitted = fit_classifier(classifier, table, width, nonzero_average(table), options)
    table.unpersist()
    fitted.generation, fitted.index = dict(generation or {}), index
    return fitted
