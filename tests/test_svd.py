"""Truncated decomposition by random combinations, against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from sigloom.operators import svd
from sigloom.operators.transforms import AxesModel, TruncatedSVD, explained_variance_ratio, total_variance


def table(spark, matrix, sparse=True):
    rows = []
    for i, x in enumerate(matrix):
        at = np.flatnonzero(x)
        rows.append((i, SparseVector(len(x), at.tolist(), x[at].tolist()) if sparse and i % 3 else DenseVector(x)))
    return spark.createDataFrame(rows, ["sample_id", "features"]).repartition(3)


@pytest.fixture(scope="module")
def low_rank():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)) @ (rng.normal(size=(6, 2600)) * (rng.random((6, 2600)) < 0.2))
    x[7] = x[8] = x[9]  # repeated rows count each
    x[11] = 0
    return x


def test_rank_limited_rows_keep_their_products(spark, low_rank):
    rows = table(spark, low_rank)
    model = TruncatedSVD(inputCol="features", outputCol="reduced", components=8, solver="sketch").fit(rows)
    out = model.transform(rows)
    got = {r.sample_id: np.array(r.v) for r in out.select("sample_id", vector_to_array("reduced").alias("v")).collect()}
    y = np.array([got[i] for i in range(len(low_rank))])
    assert len(got) == 90 and np.allclose(y @ y.T, low_rank @ low_rank.T, atol=1e-8)
    assert np.allclose(np.sort(np.linalg.norm(y, axis=0))[::-1][:6], np.linalg.svd(low_rank, compute_uv=False)[:6])
    assert np.allclose(y[:, 6:], 0, atol=1e-8)
    assert abs(explained_variance_ratio(out, "features", "reduced") - 1) < 1e-9
    assert abs(total_variance(rows, "features") - low_rank.var(axis=0).sum()) < 1e-9


def test_full_rank_rows_lose_little(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 1500)) * 0.85 ** np.arange(1500)
    axes, size = svd.singular_axes(table(spark, x), "features", 10, seed=3)
    best = np.linalg.svd(x, compute_uv=False)[:10]
    assert np.allclose(size, best, rtol=1e-3)
    pieces = {r.key: np.frombuffer(r.cells).reshape(svd.SIDE, 10) for r in axes.collect()}
    v = np.vstack([pieces[k] for k in sorted(pieces)])[:1500]
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-9)
    assert ((x @ v) ** 2).sum() > 0.9999 * (best**2).sum()


def test_axes_are_a_table_and_never_broadcast_whole(spark, low_rank, tmp_path):
    rows = table(spark, low_rank)
    model = TruncatedSVD(inputCol="features", outputCol="reduced", components=4, solver="sketch").fit(rows)
    assert isinstance(model, AxesModel) and model.axes.count() == 3  # one piece per 1,024 features
    model.write().save(str(tmp_path / "m"))
    again = AxesModel.load(str(tmp_path / "m")).transform(rows)
    a, b = ({r.sample_id: r.reduced for r in m.collect()} for m in (model.transform(rows), again))
    assert a == b and set(again.columns) == {"sample_id", "features", "reduced"}


def test_signs_depend_on_feature_and_seed_alone():
    a, b = svd.signs(np.arange(50), 70, 1), svd.signs(np.arange(25, 50), 70, 1)
    assert (a[25:] == b).all() and set(np.unique(a)) == {-1.0, 1.0} and abs(a.mean()) < 0.05
    assert (svd.signs(np.arange(50), 70, 2) != a).mean() > 0.4
