"""The forest and the threshold of operator 8 come from all labelled rows."""

import numpy as np
from pyspark.sql import functions as F

from sigloom.llm import quality_rules as Q


def labelled_docs(spark, n, junk=0):
    """Clean prose, and after it ``junk`` rows of symbols."""
    text = F.when(F.col("id") < n, F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.substring(F.md5(F.concat("id", F.lit("-"), i)), 1, 6)))).otherwise(
        F.repeat(F.concat(F.lit("#$%& |<> "), F.col("id"), F.lit(" ")), 5))
    docs = spark.range(n + junk).select(F.col("id").alias("doc_id"), text.alias("text"))
    return docs, docs.select("doc_id", F.when(F.col("doc_id") < n, 1).otherwise(0).alias("quality"))


def test_every_labelled_row_grows_a_tree_and_counts_in_the_threshold(spark, monkeypatch):
    docs, marks = labelled_docs(spark, 9000)
    settings = Q.Settings(trees=20, tree_rows=32)
    seen = []
    inner = Q.score_histogram
    monkeypatch.setattr(Q, "score_histogram", lambda rows, forest: seen.append((rows.count(), inner(rows, forest)[1].sum())) or inner(rows, forest))
    model = Q.fit(docs, marks, settings)
    assert seen == [(9000, 9000)]
    assert len(model.forest.trees) == 20 and 450 <= model.forest.size <= 450 + 2 * 32


def test_weighted_rows_are_calibrated_like_single_ones():
    scores, clean, counts = np.array([0.9, 0.8, 0.8, 0.5, 0.4]), np.array([False, False, True, True, False]), np.array([3, 5, 1, 200, 4])
    single = Q.calibrated(np.repeat(scores, counts), np.repeat(clean, counts), 0.01)
    assert Q.calibrated(scores, clean, 0.01, counts) == single
    assert Q.calibrated(scores, clean, 0.01, counts, between=False) == 0.8


def test_few_rows_are_shared_by_all_trees(spark):
    docs, marks = labelled_docs(spark, 100, 6)
    model = Q.fit(docs, marks)
    assert len(model.forest.trees) == 200 and model.forest.size == 106
    assert 0 < model.threshold <= 1


def test_only_statistics_meet_the_labels(spark, monkeypatch):
    docs, marks = labelled_docs(spark, 50, 6)
    plans = []
    inner = Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or inner(df, name))
    Q.fit(docs, marks)
    lines = plans[0].splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("MapInArrow" in line for line in lines[join:])
    assert not any("MapInArrow" in line for line in lines[:join])
