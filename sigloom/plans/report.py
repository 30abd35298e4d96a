"""Reports over many evaluated runs.

Result rows are ``(run, dist, classifier, n, accuracy)``; ``with_run`` adds ``base`` and
``k``. There is one row per run, distance, classifier and N, so every group below is
the handful of runs of one experiment, however large the evaluated data was.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.naming import natural_key, parse_run, run_info
from sigloom.operators.classifiers import CLASSIFIER_NAMES
from sigloom.operators.embedding import plot_table
from sigloom.session import stored
from sigloom.sources.results import read_confusion, read_entries, read_misclassified, read_points, read_results

MISSING = "N/A"
MAX_PLOT_CLASSES = 10


def with_run(results: DataFrame) -> DataFrame:
    """Split run names into experiment (``base``) and ``k``."""
    parsed = results.withColumn("_run", parse_run("run"))
    return parsed.withColumn("base", F.col("_run.base")).withColumn("k", F.col("_run.k")).drop("_run")


def metric_present(results: DataFrame, top_n: int) -> DataFrame:
    """Rows of classifiers that have a top-N accuracy, with that accuracy."""
    return results.where((F.col("n") == top_n) & F.col("accuracy").isNotNull())


def gate(table: DataFrame, class_counts: DataFrame, top_n: int) -> DataFrame:
    """Drop experiments with no more than ``top_n`` classes; ``class_counts`` is ``(base, n_classes)``."""
    kept = class_counts.where(F.col("n_classes") > top_n).select("base")
    return table.join(kept, "base", "left_semi")


def best_classifier(results: DataFrame, top_n: int) -> DataFrame:
    """Best row per experiment: highest accuracy, then smallest k, then dist and classifier name."""
    order = Window.partitionBy("base").orderBy(F.col("accuracy").desc(), "k", "dist", "classifier")
    ranked = metric_present(results, top_n).withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") == 1).select("base", "accuracy", "k", "dist", "classifier", "run")


def best_by_k(results: DataFrame, top_n: int) -> DataFrame:
    """Best classifier per experiment, distance and k; ties go to the first name."""
    order = F.struct(-F.col("accuracy"), "classifier")
    return (
        metric_present(results, top_n)
        .groupBy("base", "dist", "k")
        .agg(F.max("accuracy").alias("accuracy"), F.min_by("classifier", order).alias("classifier"))
    )


def classifiers_at_best_k(results: DataFrame, top_n: int) -> DataFrame:
    """Every classifier and distance at the best k of its experiment."""
    best = best_classifier(results, top_n).select("base", "k")
    return metric_present(results, top_n).join(best, ["base", "k"]).select("base", "k", "classifier", "dist", "accuracy")


def pivot_dists(rows: DataFrame, dists: Sequence[str] | None = None) -> DataFrame:
    """One row per classifier, one column per distance: accuracy in percent, or ``N/A``."""
    names = list(dists) if dists is not None else [r[0] for r in rows.select("dist").distinct().orderBy("dist").collect()]
    wide = rows.groupBy("base", "k", "classifier").pivot("dist", names).agg(F.max("accuracy"))
    shown = {d: F.coalesce(F.format_string("%.2f", F.when(F.col(d).isNotNull(), F.col(d) * 100)), F.lit(MISSING)) for d in names}
    blank = {d: F.when(F.col(d).isNull(), F.lit(MISSING)).otherwise(shown[d]) for d in names}
    return wide.withColumns(blank)


def classifier_coverage(results: DataFrame, top_n: int) -> DataFrame:
    """How often each classifier ran, and whether that was every time.

    Every time means once per k and distance of its experiment.
    """
    planned = results.groupBy("base").agg((F.count_distinct("k") * F.count_distinct("dist")).alias("planned"))
    runs = metric_present(results, top_n).groupBy("base", "classifier").agg(F.count(F.lit(1)).alias("runs"))
    status = F.when(F.col("runs") == F.col("planned"), "always").otherwise("sometimes")
    return runs.join(planned, "base").withColumn("status", status)


def classifier_status(known: Iterable[str], coverage: DataFrame) -> DataFrame:
    """Always, sometimes or never, for every known classifier of every experiment."""
    names = F.explode(F.array(*[F.lit(name) for name in known]))
    seen = coverage.select("base", "classifier")
    never = seen.select("base").distinct().select("base", names.alias("classifier")).exceptAll(seen)
    return coverage.select("base", "classifier", "status").unionByName(never.withColumn("status", F.lit("never")))


def experiment_report(
    results: DataFrame, confusion: DataFrame, class_sizes: DataFrame, top_n: int, known: Iterable[str]
) -> dict[str, DataFrame]:
    """Tables of the per-experiment report.

    ``confusion`` is ``(run, dist, classifier, actual, predicted, n)`` and
    ``class_sizes`` is ``(base, group, n)``.
    """
    counts = class_sizes.groupBy("base").agg(F.count(F.lit(1)).alias("n_classes"))
    shown = gate(with_run(results), counts, top_n)
    best = best_classifier(shown, top_n)
    return {
        "classes": class_sizes.join(best.select("base"), "base", "left_semi"),
        "best": best,
        "confusion": confusion.join(best.select("base", "run", "dist", "classifier"), ["run", "dist", "classifier"]),
        "best_by_k": best_by_k(shown, top_n),
        "at_best_k": classifiers_at_best_k(shown, top_n),
        "status": classifier_status(known, classifier_coverage(shown, top_n)),
    }


def summary(results: DataFrame, class_counts: DataFrame, top_n: int) -> DataFrame:
    """Experiment, best accuracy in percent and run info, in natural order of the names."""
    best = best_classifier(gate(with_run(results), class_counts, top_n), top_n)
    return best.orderBy(natural_key("base")).select(
        F.col("base").alias("experiment"),
        (F.col("accuracy") * 100).alias("best_accuracy"),
        run_info("k", "dist", "classifier").alias("run_info"),
    )


def class_sizes(entries: DataFrame) -> DataFrame:
    """Classes of every experiment and their sizes: ``(base, group, n)``.

    Runs of an experiment differ in k only and share their samples, so the first run counts.
    """
    runs = with_run(entries.groupBy("run", "group").agg(F.count(F.lit(1)).alias("n")))
    first = runs.groupBy("base").agg(F.min_by("run", F.struct("k", "run")).alias("run"))
    return runs.join(first, ["base", "run"], "left_semi").select("base", "group", "n")


def summarize(
    spark: SparkSession,
    job_dir: str,
    top_n: int = 1,
    known: Iterable[str] = CLASSIFIER_NAMES,
    nested: bool = False,
    plots: bool = False,
    max_classes: int = MAX_PLOT_CLASSES,
) -> dict[str, DataFrame]:
    """Everything a job folder tells: the tables of ``experiment_report``, the ``summary`` over all experiments and, with ``plots``, ``plot``.

    Sizes come from the runs' ``metadata.json``, results from all their ``classification-*`` files. ``plot`` ties the best run of every
    experiment of at most ``max_classes`` classes to its points, classes and misses: ``(base, sample_id, coords, group, label,
    misclassified)``; an experiment whose best run has no points for its distance has no plot. ``nested`` reads files of one JSON object each.
    """
    results = stored(read_results(spark, job_dir, nested), "results")  # many small files, read once for all tables
    entries = read_entries(spark, job_dir, nested)
    sizes = stored(class_sizes(entries), "class-sizes")
    made = experiment_report(results, read_confusion(spark, job_dir, nested), sizes, top_n, known)
    counts = sizes.groupBy("base").agg(F.count(F.lit(1)).alias("n_classes"))
    made["summary"] = summary(results, counts, top_n)
    if plots:
        few = counts.where(F.col("n_classes") <= max_classes).select("base")
        best = made["best"].join(few, "base", "left_semi").select("base", "run", "dist", "classifier")
        points = read_points(spark, job_dir, nested).join(best.select("base", "run", "dist"), ["run", "dist"])
        missed = read_misclassified(spark, job_dir, nested).where(F.col("n") == top_n).join(best, ["run", "dist", "classifier"])
        made["plot"] = plot_table(points, entries.join(best.select("base", "run"), "run"), missed, by=["base"])
    return made
