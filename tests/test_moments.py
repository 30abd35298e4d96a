"""Moments of folds and classes from one scan, and the models made of them."""

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector

from sigloom.operators.classifiers import MOMENT_MODELS, Options, fit_classifier, fit_moments
from sigloom.operators.moments import Moments, grouped_moments, merge_all
from sigloom.plans import evaluate as plan
from sigloom.plans.evaluate import cross_validate


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 6)) * [1, 5, 0.1, 2, 1, 0] + 1e6 * (np.arange(6) == 3)
    y = rng.integers(0, 3, 240)
    x[:, 0] += 2.5 * y
    x[rng.random(x.shape) < 0.3] = 0
    rows = [(int(i), int(i % 4), "abc"[y[i]], DenseVector(v) if i % 2 else SparseVector(6, [j for j in range(6) if v[j]], [t for t in v if t])) for i, v in enumerate(x)]
    return x, y, spark.createDataFrame(rows, ["sample_id", "fold", "group", "features"]).repartition(5).persist()


def test_moments_match_numpy(data):
    x, y, rows = data
    found = grouped_moments(rows, "features", ["fold", "fold"], 6)
    assert set(found) == {(f, f) for f in range(4)}
    for (f, _), m in found.items():
        own = x[np.arange(len(x)) % 4 == f]
        assert m.n == len(own) and np.allclose(m.mean, own.mean(axis=0), rtol=1e-12)
        assert np.allclose(m.scatter, (own - own.mean(axis=0)).T @ (own - own.mean(axis=0)), rtol=1e-9, atol=1e-6)
    whole = merge_all(found.values())
    assert np.allclose(whole.variance(), x.var(axis=0), rtol=1e-9) and np.allclose(whole.gram(), x.T @ x, rtol=1e-9)


def test_large_means_do_not_cancel():
    x = np.random.default_rng(1).normal(size=(1000, 2)) + 1e8
    m = merge_all(Moments.of(part) for part in np.array_split(x, 37))
    assert np.allclose(m.variance(), x.var(axis=0), rtol=1e-6)


@pytest.mark.parametrize("name", MOMENT_MODELS)
@pytest.mark.parametrize("plain", [True, False])
def test_same_answers_as_a_fit_on_rows(data, name, plain):
    _, y, rows = data
    options = Options(skip_normalization=plain, dim_reduce_fraction=0.8)
    by_class = {"abc"[k]: m for (k, _), m in grouped_moments(rows.selectExpr("ascii(group) - 97 AS l", "features"), "features", ["l", "l"], 6).items()}
    made, ratio = fit_moments(name, by_class, 5, options)
    fitted = fit_classifier(name, rows.drop("fold"), 6, 5, options)
    vectors = rows.select("sample_id", "features")
    a, b = ({(r.sample_id, r.cls): r.prob for r in f.scores(vectors).collect()} for f in (made, fitted))
    assert a.keys() == b.keys() and all(p is None or abs(p - b[k]) < 1e-5 for k, p in a.items())
    assert (ratio is None) == plain and (plain or 0 < ratio <= 1 + 1e-9)


@pytest.mark.parametrize("name", ["lda", "nearest-centroid-mean"])
def test_folds_from_one_scan_equal_a_fit_each(data, monkeypatch, name):
    _, _, rows = data
    features, samples = rows.select("sample_id", "features"), rows.select("sample_id", "group")
    one = cross_validate(features, samples, name, 3, seed=2, options=Options(dim_reduce_fraction=0.8))
    monkeypatch.setattr(plan, "MOMENT_CELLS", 0)
    each = cross_validate(features, samples, name, 3, seed=2, options=Options(dim_reduce_fraction=0.8))
    for table in ("topn", "confusion", "misclassified"):
        a, b = (sorted(map(tuple, getattr(r, table).collect())) for r in (one, each))
        assert a == b
    ratios = [r.timing.first()["average_reduced_variance_ratio"] for r in (one, each)]
    assert abs(ratios[0] - ratios[1]) < 1e-9
