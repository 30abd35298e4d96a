import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sigloom.operators import centroids, embedding
from sigloom.operators import distances as D
from sigloom.operators.neighbors import nearest_neighbors
from sigloom.operators.transforms import TruncatedSVD, UnitVarianceScaler, explained_variance_ratio


def long_table(spark, matrix):
    rows = [(i, f"f{j}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "sample_id long, feature string, value double")


def ids(spark, n):
    return spark.range(n).select(F.col("id").alias("sample_id"))


def brute(matrix):
    out = {}
    for a, b in itertools.combinations(range(len(matrix)), 2):
        x, y = matrix[a], matrix[b]
        either = ((x != 0) | (y != 0)).sum()
        both = ((x != 0) & (y != 0)).sum()
        out[("manhat", a, b)] = float(np.abs(x - y).sum())
        out[("info", a, b)] = 0.0 if either == 0 else float((either - both) / either)
    return out


@pytest.mark.parametrize("density, slices", [(0.7, None), (0.02, None), (0.3, 5)])
def test_distances_against_brute_force(spark, monkeypatch, density, slices):
    monkeypatch.setattr(D, "BLOCK", 7)
    monkeypatch.setattr(D, "DENSE_CELLS", 64)
    rng = np.random.default_rng(1)
    matrix = rng.integers(1, 9, (23, 60)) * (rng.random((23, 60)) < density)
    matrix[4] = matrix[9] = 0
    table = long_table(spark, matrix)
    found = D.distances(table, ["manhat", "info"], ids(spark, 23), feature="feature", value="value", slices=slices).collect()
    got = {(r["metric"], r["a"], r["b"]): r["d"] for r in found}
    expected = brute(matrix)
    assert got.keys() == expected.keys()
    assert all(got[key] == pytest.approx(expected[key], abs=1e-12) for key in expected)


def test_symmetrize_has_every_cell(spark):
    matrix = np.eye(4)
    pairs = D.distances(long_table(spark, matrix), ["manhat"], ids(spark, 4), feature="feature", value="value")
    full = D.symmetrize(pairs, ids(spark, 4)).collect()
    assert len(full) == 16
    assert all(r["d"] == (0.0 if r["a"] == r["b"] else 2.0) for r in full)


def test_distance_features_keep_training_order(spark):
    matrix = D.symmetrize(spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)], "a long, b long, d double"), ids(spark, 3))
    got = D.distance_features(matrix, spark.createDataFrame([(2,), (0,)], "sample_id long")).orderBy("sample_id").collect()
    assert [r["features"] for r in got] == [[0.0, 2.0], [1.0, 3.0], [2.0, 0.0]]


def full_matrix(spark, points):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    rows = [(int(a), int(b), float(d[a, b])) for a in range(len(points)) for b in range(len(points))]
    return spark.createDataFrame(rows, "a long, b long, d double"), d


def test_mds_reproduces_euclidean_distances(spark):
    points = np.random.default_rng(3).normal(size=(20, 3))
    matrix, d = full_matrix(spark, points)
    found = embedding.mds(matrix, ids(spark, 20), 5).orderBy("sample_id").collect()
    coords = np.array([r["coords"] for r in found])
    assert coords.shape == (20, 3)
    assert np.allclose(np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(-1)), d, atol=1e-6)
    spread = (coords**2).sum(0)
    assert (np.diff(spread) < 0).all()


def test_negative_axes_are_dropped(spark):
    rng = np.random.default_rng(8)
    d = rng.random((12, 12)) * 5
    d = (d + d.T) * (1 - np.eye(12))
    rows = [(a, b, float(d[a, b])) for a in range(12) for b in range(12)]
    matrix = spark.createDataFrame(rows, "a long, b long, d double")
    centering = np.eye(12) - 1 / 12
    values = np.linalg.eigvalsh(-0.5 * centering @ d**2 @ centering)
    top = values[np.argsort(-np.abs(values))][:6]
    assert (top < 0).any()
    signed, _ = embedding.eigen(embedding.double_center(matrix), ids(spark, 12), 6)
    assert np.allclose(sorted(signed), sorted(top), atol=1e-6)
    with pytest.warns(UserWarning, match="negative"):
        found = embedding.mds(matrix, ids(spark, 12), 6)
    assert len(found.first()["coords"]) == (top > 0).sum()


def test_opposite_eigenvalues_are_told_apart(spark):
    """Singular vectors of 3 and -3 may be mixtures; the pairs returned still solve the problem."""
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(9, 9)))[0]
    matrix = turn @ np.diag([3.0, -3, 1, 0.5, -0.5, 0.2, 0, 0, 0]) @ turn.T
    rows = [(a, b, float(matrix[a, b])) for a in range(9) for b in range(9)]
    values, vectors = embedding.eigen(spark.createDataFrame(rows, "a long, b long, v double"), ids(spark, 9), 3)
    u = np.array([r["u"] for r in vectors.orderBy("sample_id").collect()])
    assert np.allclose(sorted(values), [-3, 1, 3], atol=1e-8)
    assert np.allclose(matrix @ u, u * values, atol=1e-7)


def test_mds_over_several_blocks(spark, monkeypatch):
    """Pieces of 16 rows, the last block part filled; a product with chunks meets its pieces without a broadcast."""
    from sigloom.operators import eigen

    monkeypatch.setattr(eigen, "SIDE", 16)
    monkeypatch.setattr(eigen, "BROADCAST_BYTES", 0)
    points = np.random.default_rng(5).normal(size=(75, 6)) * [9, 7, 5, 3, 2, 1]
    matrix, d = full_matrix(spark, points)
    found = embedding.mds(matrix, ids(spark, 75), 8).orderBy("sample_id").collect()
    coords = np.array([r["coords"] for r in found])
    assert coords.shape == (75, 6)
    assert np.allclose(np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(-1)), d, atol=1e-6)


def test_flat_spectrum_needs_several_cycles(spark, monkeypatch):
    from sigloom.operators import eigen

    monkeypatch.setattr(eigen, "SPARE", 8)
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(60, 60))
    matrix = matrix + matrix.T
    pairs = spark.createDataFrame([(a, b, float(matrix[a, b])) for a in range(60) for b in range(60)], "a long, b long, d double")
    values = np.linalg.eigvalsh(matrix)
    top = values[np.argsort(-np.abs(values))][:4]
    found, vectors = eigen.leading_pairs(eigen.PairMatrix(pairs, pairs["d"], ids(spark, 60), centered=False), 4, tolerance=1e-5)
    u = np.array([r["u"] for r in vectors.orderBy("sample_id").collect()])
    assert np.allclose(sorted(found), sorted(top), atol=1e-8 * abs(top[0]))
    assert np.allclose(matrix @ u, u * found, atol=1e-5 * abs(top[0]))
    with pytest.warns(UserWarning, match="residual"):
        eigen.leading_pairs(eigen.PairMatrix(pairs, pairs["d"], ids(spark, 60), centered=False), 4, cycles=1)


def test_mds_of_none_one_and_equal_samples(spark):
    empty = spark.createDataFrame([], "a long, b long, d double")
    assert embedding.mds(empty, ids(spark, 0), 3).collect() == []
    assert embedding.mds(spark.createDataFrame([(0, 0, 0.0)], "a long, b long, d double"), ids(spark, 1), 3).collect()[0]["coords"] == []
    same = spark.createDataFrame([(a, b, 0.0) for a in range(3) for b in range(3)], "a long, b long, d double")
    assert [r["coords"] for r in embedding.mds(same, ids(spark, 3), 2).collect()] == [[], [], []]


def test_constant_axis_scales_to_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "sample_id long, coords array<double>")
    got = [r["coords"] for r in embedding.scale_points(df).orderBy("sample_id").collect()]
    assert got == [[-1.0, 0.0], [1.0, 0.0]]


def vectors(spark, matrix):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "sample_id long, v array<double>").select("sample_id", array_to_vector("v").alias("features"))


def as_matrix(df, column):
    return np.array([r["v"] for r in df.orderBy("sample_id").select(vector_to_array(column).alias("v")).collect()])


def test_unit_variance_leaves_constant_features(spark):
    matrix = np.array([[1.0, 7, 0], [2.0, 7, 0], [6.0, 7, 3]])
    df = vectors(spark, matrix)
    got = as_matrix(UnitVarianceScaler(inputCol="features", outputCol="s").fit(df).transform(df), "s")
    spread = matrix.std(axis=0)
    spread[1] = 1
    assert np.allclose(got, matrix / spread)


def test_truncated_svd_against_numpy(spark):
    matrix = np.random.default_rng(2).normal(size=(40, 6)) @ np.diag([9, 6, 4, 2, 1, 0.5])
    df = vectors(spark, matrix)
    model = TruncatedSVD(inputCol="features", outputCol="r", components=3).fit(df)
    axes = model.parts["axes"]
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-8)
    out = model.transform(df)
    assert np.allclose(np.linalg.norm(as_matrix(out, "r"), axis=0), np.linalg.svd(matrix)[1][:3], atol=1e-6)
    _, _, vt = np.linalg.svd(matrix, full_matrices=False)
    kept = (matrix @ vt[:3].T).var(axis=0).sum() / matrix.var(axis=0).sum()
    assert explained_variance_ratio(out, "features", "r") == pytest.approx(kept, abs=1e-8)


def test_medians_count_missing_entries_as_zero(spark):
    rng = np.random.default_rng(6)
    matrix = rng.integers(0, 5, (31, 4)) * (rng.random((31, 4)) < 0.6)
    labels = rng.integers(0, 3, 31)
    table = pd.DataFrame([(int(labels[i]), j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v], columns=["label", "feature", "value"])
    cells = spark.createDataFrame(table)
    size = spark.createDataFrame([(int(c), int((labels == c).sum())) for c in range(3)], "label long, size long")
    got = {(r["label"], r["feature"]): r["median"] for r in centroids.medians(cells, size).collect()}
    for c in range(3):
        for j in range(4):
            assert got.get((c, j), 0.0) == np.median(matrix[labels == c, j])


def test_neighbors_over_many_blocks(spark, monkeypatch):
    from sigloom.operators import neighbors

    monkeypatch.setattr(neighbors, "_blocks", lambda n, width: 4)
    rng = np.random.default_rng(9)
    train, test = rng.integers(0, 4, (50, 3)), rng.integers(0, 4, (12, 3))
    labelled = vectors(spark, train).withColumn("label", F.col("sample_id") % 3)
    found = nearest_neighbors(vectors(spark, test), labelled, "features", 3, 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["sample_id"], []).append(r["neighbor"])
    for i, x in enumerate(test):
        d = np.round(np.sqrt(((train - x) ** 2).sum(1)), 9)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(50), d))[:5]]


def test_distances_do_not_depend_on_blocks(spark, monkeypatch):
    """Twins of large norm are at distance 0, however the points are dealt."""
    from sigloom.operators import neighbors

    rng = np.random.default_rng(10)
    train = rng.normal(size=(60, 64)) * 110
    test = np.vstack([train[:10], train[10:20] + 1e-7])
    labelled = vectors(spark, train).withColumn("label", F.col("sample_id") % 3)
    found = []
    for blocks in (1, 7):
        monkeypatch.setattr(neighbors, "_blocks", lambda n, width, blocks=blocks: blocks)
        rows = nearest_neighbors(vectors(spark, test), labelled, "features", 64, 4).orderBy("sample_id", "rank").collect()
        found.append([(r["sample_id"], r["neighbor"], r["d"]) for r in rows])
    assert found[0] == found[1]
    assert [(i, n, d) for i, n, d in found[0] if i < 10][::4] == [(i, i, 0.0) for i in range(10)]


def test_polynomial_sketch_approximates_the_kernel(spark):
    from sigloom.operators.margins import PolynomialSketch

    matrix = np.random.default_rng(12).normal(size=(15, 30))
    df = vectors(spark, matrix)
    for degree in (2, 3):
        made = PolynomialSketch(inputCol="features", outputCol="p", size=16384, degree=degree, seed=1).fit(df)
        got = as_matrix(made.transform(df), "p")
        want = (matrix @ matrix.T / 30) ** degree
        assert np.abs(got @ got.T - want).max() < 0.1 * want.max()


def test_vectors_of_observed_long_kmers(spark):
    from sigloom.operators.vectors import kmer_index, to_vectors

    rows = [(0, "A" * 31, 2), (0, "C" * 31, 1), (1, "G" * 31, 5)]
    features = spark.createDataFrame(rows, "sample_id long, kmer string, n long")
    index = kmer_index(features)
    got = as_matrix(to_vectors(features, ids(spark, 3), 31, "n", index).withColumnRenamed("features", "f"), "f")
    place = {r["kmer"][0]: r["i"] for r in index.collect()}
    want = np.zeros((3, 3))
    want[0, place["A"]], want[0, place["C"]], want[1, place["G"]] = 2, 1, 5
    assert np.array_equal(got, want)


def test_sparse_and_dense_vectors_mix(spark):
    from sigloom.operators.vectors import map_rows

    rows = [(0, Vectors.sparse(4, [1, 3], [2.0, 5.0])), (1, Vectors.dense([1.0, 0, 0, 4])), (2, Vectors.sparse(4, [], []))]
    df = spark.createDataFrame(rows, ["sample_id", "v"])
    got = df.select("sample_id", map_rows("v", 4, lambda x: x * 2).alias("w"))
    assert as_matrix(got, "w").tolist() == [[0, 4, 0, 10], [2, 0, 0, 8], [0, 0, 0, 0]]


def test_narrow_polynomial_features_are_the_sketch_without_its_empty_columns(spark):
    from sigloom.operators.margins import PolynomialSketch
    from sigloom.operators.models import tensor_sketch

    matrix = np.random.default_rng(3).normal(size=(20, 5))
    df = vectors(spark, matrix)
    for degree in (2, 3):
        made = PolynomialSketch(inputCol="features", outputCol="p", size=256, degree=degree, seed=4).fit(df)
        got = as_matrix(made.transform(df), "p")
        random = np.random.default_rng(4)
        parts = {"buckets": random.integers(0, 256, (degree, 5)), "signs": random.choice([-1.0, 1.0], (degree, 5)), "size": [256], "gamma": [0.2]}
        want = tensor_sketch(matrix, parts)
        used = np.abs(want).max(axis=0) > 1e-9
        assert got.shape[1] <= 5**degree < 256
        assert np.allclose(got, want[:, used])


def test_feature_maps_are_applied_in_the_passes_of_a_linear_model(spark):
    from pyspark.ml import PipelineModel
    from sigloom.operators.margins import FourierFeatures, OneVsRestLinear

    matrix = np.random.default_rng(5).normal(size=(80, 4))
    df = vectors(spark, matrix).withColumn("label", (F.col("sample_id") % 2).cast("double"))
    waves = FourierFeatures(inputCol="features", outputCol="waves", size=32, seed=2)
    both = OneVsRestLinear(inputCol="features", regParam=0.01, maxIter=8, through=waves).fit(df)
    first = waves.fit(df)
    plain = OneVsRestLinear(inputCol="waves", regParam=0.01, maxIter=8).fit(first.transform(df))
    assert isinstance(both, PipelineModel) and [m.getOutputCol() for m in both.stages] == ["waves", "scores"]
    assert np.allclose(both.stages[1].parts["weights"], plain.parts["weights"])
    assert np.allclose(as_matrix(both.transform(df), "scores"), as_matrix(plain.transform(first.transform(df)), "scores"))


def test_a_batch_of_chunks_gives_pieces_one_by_one(spark, monkeypatch):
    from sigloom.operators import svd

    monkeypatch.setattr(svd, "_SUMS", svd.SIDE * 3)  # one piece is held
    chunks = spark.createDataFrame(
        [(b, s, [0, 1], [2, 3], [1.0, 2.0]) for b in range(3) for s in range(2)], svd._CHUNK
    ).coalesce(1)
    got = svd.times(chunks, spark.createDataFrame([(s, bytearray(np.ones((svd.SIDE, 3)).tobytes())) for s in range(2)], svd._PIECE), 3).collect()
    found = {r.key: np.frombuffer(r.cells).reshape(svd.SIDE, 3) for r in got}
    assert sorted(found) == [0, 1, 2]
    assert all(piece[0].tolist() == [2.0] * 3 and piece[1].tolist() == [4.0] * 3 and not piece[2:].any() for piece in found.values())
