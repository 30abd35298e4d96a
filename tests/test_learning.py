import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sigloom.operators.classifiers import CLASSIFIER_NAMES, RECIPES, Options, fit_classifier
from sigloom.plans.evaluate import cross_validate, evaluate
from sigloom.plans.job import Experiment, Job, run_job
from sigloom.plans.predict import predict
from sigloom.plans import report
from sigloom.sources.models import load_model, save_model
from sigloom.sources.results import read_confusion, read_results
from sigloom.streaming.predict import predict_stream


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[6, 0, 0, 1, 0], [0, 6, 0, 0, 1], [0, 0, 6, 1, 1]])
    rows = [(i, [float(v) for v in centers[i % 3] + rng.normal(size=5) * 0.5], "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_id long, v array<double>, group string")
    return df.select("sample_id", array_to_vector("v").alias("features"), "group").persist()


SETTINGS = Options(skip_normalization=True, max_iter=6, rounds=8)


@pytest.mark.parametrize("name", CLASSIFIER_NAMES)
def test_classifier_separates_clear_classes(spark, blobs, tmp_path, name):
    fitted = fit_classifier(name, blobs, 5, 5, SETTINGS)
    scores = fitted.scores(blobs.select("sample_id", "features")).persist()
    truth = blobs.select("sample_id", "group")
    if fitted.has_probabilities:
        sums = scores.groupBy("sample_id").agg(F.sum("prob").alias("t"), F.count("prob").alias("c")).collect()
        assert all(abs(r["t"] - 1) < 1e-9 and r["c"] == 3 for r in sums)
        best = scores.groupBy("sample_id").agg(F.max_by("cls", "prob").alias("cls"))
    else:
        best = scores.select("sample_id", "cls")
    hits = best.join(truth, "sample_id").agg(F.avg((F.col("cls") == F.col("group")).cast("int"))).first()[0]
    assert hits >= 0.95
    save_model(fitted, str(tmp_path / "m"), spark)
    again = load_model(spark, str(tmp_path / "m")).scores(blobs.select("sample_id", "features"))
    a = sorted((r["sample_id"], r["cls"], round(r["prob"] or 0, 9)) for r in scores.collect())
    b = sorted((r["sample_id"], r["cls"], round(r["prob"] or 0, 9)) for r in again.collect())
    assert a == b


def test_normalised_pipeline_and_tables(spark, blobs):
    rows = blobs.select("sample_id", "features")
    out = cross_validate(rows, blobs.select("sample_id", "group"), "lda", 3, seed=1, options=Options(dim_reduce_fraction=0.6))
    acc = {r["n"]: r["accuracy"] for r in out.topn.collect()}
    assert set(acc) == {1, 2} and acc[1] >= 0.95
    assert sum(r["n"] for r in out.confusion.collect()) == 90 and out.confusion.count() == 9
    timing = out.timing.first()
    assert timing["train_time"] > 0 and 0 < timing["average_reduced_variance_ratio"] <= 1


def test_failed_classifiers_are_left_out(spark, blobs):
    rows = blobs.select("sample_id", "features")
    out = evaluate(rows, blobs.select("sample_id", "group"), ["no-such", "nearest-centroid-mean"], 2, options=SETTINGS)
    assert "no-such" in out.failed
    assert {r["classifier"] for r in out.topn.collect()} == {"nearest-centroid-mean"}


def test_single_fold_leaves_nothing_to_train_on(spark, blobs):
    with pytest.raises(RuntimeError):
        evaluate(blobs.select("sample_id", "features"), blobs.select("sample_id", "group"), ["lda"], 1, options=SETTINGS)


def test_version_warning(spark, blobs, tmp_path):
    fitted = fit_classifier("lda", blobs, 5, 5, SETTINGS)
    save_model(fitted, str(tmp_path / "m"), spark)
    about = {"name": "lda", "labels": fitted.labels, "generation": {}, "spark_version": "0.0"}
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(str(tmp_path / "m" / "about"))
    with pytest.warns(UserWarning, match="0.0"):
        load_model(spark, str(tmp_path / "m"))


GENOMES = {"A": "ACGT", "B": "AACC", "C": "GGTA"}


def genome(kind, seed):
    rng = np.random.default_rng(seed)
    weights = {"A": [0.4, 0.1, 0.1, 0.4], "B": [0.1, 0.4, 0.4, 0.1], "C": [0.25, 0.25, 0.25, 0.25]}[kind]
    return "".join(rng.choice(list("ACGT"), 300, p=weights))


def test_job_summary_and_prediction(spark, tmp_path):
    rows = [(f"{kind}{i}", i + 100 * "ABC".index(kind), kind, i == 0) for kind in "ABC" for i in range(12)]
    meta = spark.createDataFrame(rows, "id string, entry_no long, subtype string, recombinant boolean")
    texts = [("zoo", f"whole/{r[0]}.fasta", f">{r[0]}\n{genome(r[2], r[1])}\n") for r in rows]
    archives = spark.createDataFrame(texts, "archive string, member string, content string")
    from sigloom.operators.selection import groups_by_value

    dataset = {"archive": "zoo", "archive_folder": "whole", "metadata": "zoo"}
    job = Job(
        name="zoo",
        experiments={
            "subtype": Experiment(
                groups=lambda options, m: groups_by_value(m, options["selection_key"], options["min_group_pts"]),
                dataset=dataset, options={"selection_key": "subtype", "min_group_pts": 10}, expand={"k": "2..3"},
            )
        },
        steps=[
            {"type": "kmers", "output_file": "cgrs", "mode": "frequencies", "k": "from_options"},
            {"type": "kmers", "output_file": "cgr-counts", "mode": "counts", "k": "from_options"},
            {"type": "distances", "input_file": "cgr-counts", "output_prefix": "dists", "distances": ["manhat"]},
            {"type": "mds", "dists_file": "dists-manhat", "dimensions": 4, "output_file": "mds10-manhat.json"},
            {"type": "classify", "features_file": "cgrs", "output_file": "classification-kmers.json", "validation_count": 3,
             "classifiers": ["linear-svm", "nearest-centroid-mean", "gaussian-naive-bayes"], "max_iter": 3, "dim_reduce_fraction": 0.5},
            {"type": "classify", "features_file": "dists-manhat", "output_file": "classification-manhat.json", "validation_count": 2,
             "classifiers": ["nearest-centroid-mean"]},
        ],
        metadata=meta, archives=archives, pick_group="subtype", seed=5,
    )
    out = str(tmp_path / "out")
    written = run_job(spark, job, out)
    assert set(written) == {"subtype-k=2", "subtype-k=3"}
    points = spark.read.json(f"{out}/zoo/subtype-k=3/mds10-manhat.json")
    assert points.count() == 36
    results = read_results(spark, f"{out}/zoo").persist()
    tops = {(r["run"], r["dist"], r["classifier"]): r["accuracy"] for r in results.where("n = 1").collect()}
    assert len(tops) == 8 and min(tops.values()) > 0.8
    sizes = meta.groupBy(F.lit("subtype").alias("base"), F.col("subtype").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    tables = report.experiment_report(results, read_confusion(spark, f"{out}/zoo"), sizes, 1, CLASSIFIER_NAMES)
    assert tables["best"].count() == 1
    assert sum(r["n"] for r in tables["confusion"].collect()) == 36
    status = {r["classifier"]: r["status"] for r in tables["status"].collect()}
    assert status["nearest-centroid-mean"] == "always" and status["linear-svm"] == "sometimes" and status["qda"] == "never"
    assert report.summary(results, sizes.groupBy("base").agg(F.count("group").alias("n_classes")), 1).count() == 1

    files = tmp_path / "genomes"
    files.mkdir()
    for kind in "ABC":
        (files / f"{kind}.fasta").write_text(f">{kind}\n{genome(kind, 999)}\n")
    model = f"{out}/zoo/subtype-k=3/classification-kmers_linear-svm.model"
    got = {r["file"]: r["cls"] for r in predict(spark, model, str(files)).where("rank = 1").collect()}
    assert got == {"A.fasta": "A", "B.fasta": "B", "C.fasta": "C"}
    ranked = predict(spark, f"{out}/zoo/subtype-k=3/classification-kmers_gaussian-naive-bayes.model", str(files))
    assert ranked.count() == 9

    stream = predict_stream(spark, model, str(files), str(tmp_path / "stream"), str(tmp_path / "state"))
    stream.awaitTermination(120)
    assert {r["file"]: r["cls"] for r in spark.read.parquet(str(tmp_path / "stream")).collect()} == got


def test_nested_result_files(spark, tmp_path):
    run = tmp_path / "job" / "exp-k=4"
    run.mkdir(parents=True)
    body = {
        "linear-svm": {"classes": ["a", "b"], "confusion_matrix": [[3, 1], [0, 2]], "train_time": 0.5, "top1": {"accuracy": 0.75, "misclassified_indexes": [1]}},
        "lda": {"classes": ["a", "b"], "confusion_matrix": [[4, 0], [0, 2]], "top1": {"accuracy": 1.0, "misclassified_indexes": []}, "top2": {"accuracy": 1.0, "misclassified_indexes": []}},
    }
    (run / "classification-kmers.json").write_text(json.dumps(body))
    rows = read_results(spark, str(tmp_path / "job"), nested=True).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("exp-k=4", "kmers", "lda", 1, 1.0), ("exp-k=4", "kmers", "lda", 2, 1.0), ("exp-k=4", "kmers", "linear-svm", 1, 0.75),
    ]
    cells = read_confusion(spark, str(tmp_path / "job"), nested=True).where("classifier = 'linear-svm'").collect()
    assert sorted((r["actual"], r["predicted"], r["n"]) for r in cells) == [("a", "a", 3), ("a", "b", 1), ("b", "a", 0), ("b", "b", 2)]


def test_recipes_cover_the_sixteen_names():
    assert len(RECIPES) == 16


def test_rows_of_many_passes_are_dealt_by_their_number(spark):
    from sigloom.session import dealt

    rows = spark.range(0, 100, 1, 24)
    assert dealt(rows, 1).rdd.getNumPartitions() == 1
    assert dealt(rows, 500).rdd.getNumPartitions() == 24
    slots = spark.sparkContext.defaultParallelism
    assert dealt(spark.range(0, 100, 1, 1), 500).rdd.getNumPartitions() == slots
    assert dealt(spark.range(0, 100, 1, 1), 2).count() == 100
