"""Exact medians of many distinct values, narrowed down by histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators.centroids import class_stats, medians


@pytest.mark.parametrize("ordered", [400, 10_000])
def test_medians_of_a_large_class(spark, ordered):
    """One class has three fifths of all rows, all values differ, and one feature's values span many powers of ten."""
    rng = np.random.default_rng(6)
    y = np.where(rng.random(9001) < 0.6, 0, rng.integers(1, 4, 9001))
    x = np.stack([rng.normal(size=len(y)) - 0.3, 10.0 ** rng.uniform(-4, 8, len(y)), np.round(rng.normal(size=len(y)), 1)], axis=1)
    x[rng.random(x.shape) < 0.2] = 0
    cells = [(int(k), j, float(v)) for k, row in zip(y, x) for j, v in enumerate(row) if v]
    table = spark.createDataFrame(cells, "label int, feature int, value double").repartition(6)
    sizes = spark.createDataFrame([(k, int((y == k).sum())) for k in range(4)], "label int, size bigint")
    found = {(r.label, r.feature): r.median for r in medians(table, sizes, ordered).collect()}
    want = {(k, j): float(np.median(x[y == k, j])) for k in range(4) for j in range(3)}
    assert found == want


def test_even_sizes_and_borders(spark):
    """The two middle values lie in different buckets, at the ends, in clusters far apart, or are the same."""
    values = {0: [1.0, 2.0, 1000.0, 1001.0], 1: [5.0] * 6, 2: [-1e308, 1e308], 3: [0.5, 7.0], 4: [1e-9, 2e-9, 3e-9, 1e9, 1e9 + 1, 1e9 + 2]}
    rows = [(k, 0, v) for k, own in values.items() for v in own]
    table = spark.createDataFrame(rows, "label int, feature int, value double")
    sizes = spark.createDataFrame([(0, 4), (1, 6), (2, 2), (3, 5), (4, 6)], "label int, size bigint")
    found = {r.label: r.median for r in medians(table, sizes, 1).collect()}
    assert found == {0: 501.0, 1: 5.0, 2: 0.0, 3: 0.0, 4: (3e-9 + 1e9) / 2}


def test_variance_does_not_cancel(spark):
    x = np.array([1e8 + 1, 1e8 + 2, 1e8 + 3, 1e8 + 4])
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "sample_id int, kmer string, n double")
    samples = spark.createDataFrame([(i, "g") for i in range(4)], "sample_id int, group string")
    row = class_stats(rows, samples).first()
    assert abs(row["variance"] - x.var()) < 1e-9 and row["mean"] == x.mean() and row["median"] == x.mean()
    assert class_stats(rows.where(F.lit(False)), samples).count() == 0
