"""Operators on pairs that take whole blocks give what they give on rows, without a row per pair in Spark."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.operators import distances as D
from sigloom.operators import eigen, embedding, pairblocks
from sigloom.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark, monkeypatch, names=str, scale=1.0, n=13):
    monkeypatch.setattr(D, "BLOCK", 4)
    rng = np.random.default_rng(8)
    matrix = rng.integers(-3, 9, (n, 6)) * (rng.random((n, 6)) < 0.6) * scale
    rows = [(names(i), j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    kind = "string" if names is str else "long"
    cells = spark.createDataFrame(rows, f"sample_id {kind}, feature int, value double")
    return cells, spark.createDataFrame([(names(i),) for i in range(n)], f"sample_id {kind}"), matrix


def numbers(df):
    return sorted((tuple(float(f"{x:.11g}") if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("names", [str, int])
@pytest.mark.parametrize("scale", [3000.0, 0.37])
def test_statistics_of_blocks_are_those_of_rows(spark, monkeypatch, names, scale):
    cells, ids, matrix = made(spark, monkeypatch, names, scale)
    pairs = D.distances(cells, ["manhat", "info"], ids, "feature", "value", width=6)
    for r in pairs.where("metric = 'manhat'").collect():
        assert r["a"] < r["b"] and r["d"] == pytest.approx(np.abs(matrix[int(r["a"])] - matrix[int(r["b"])]).sum(), rel=1e-12)
    full = D.symmetrize(pairs, ids)
    kept = D.project_reference(full, ids.where("sample_id % 3 = 1"))
    for table, by in ((pairs, ["metric", "a"]), (full, ["metric", "a"]), (kept, ["a"])):
        found = D.row_statistics(table, by)
        assert "_p#" not in plan(found) and "Expand" not in plan(found)
        assert numbers(found) == numbers(D.row_statistics(table.select("*"), by))


@pytest.mark.parametrize("reach", [100, 20_000, 33_000, 1_500_000_000, 0.3])
def test_short_numbers_do_not_overflow(reach):
    rng = np.random.default_rng(3)
    for low in (0, -reach):
        x, y = ((rng.random((5, 2)) * (reach - low) + low).astype(type(reach)).astype(float) for _ in range(2))
        x[0], y[0] = reach, low
        sides = [pairblocks.Side(pa.array(range(5)), np.repeat(np.arange(5), 2), np.tile(np.arange(2), 5), v.ravel(), 2) for v in (x, y)]
        assert np.allclose(pairblocks.apart_dense(*sides), np.abs(x[:, None] - y[None]).sum(axis=2), rtol=1e-14)


def test_sizes_are_added_up_by_blocks(spark, monkeypatch):
    cells, ids, _ = made(spark, monkeypatch)
    sizes = D.set_sizes(cells, ids, feature="feature", value="value", width=6)
    sums = [D.row_statistics(t, ["a"], ["n_common", "n_either"], ["total"]) for t in (sizes, sizes.select("*"))]
    assert numbers(sums[0]) == numbers(sums[1]) and dict(sizes.dtypes)["n_either"] == "bigint"


def test_a_changed_table_is_rows_again(spark, monkeypatch):
    cells, ids, _ = made(spark, monkeypatch)
    pairs = D.distances(cells, ["manhat"], ids, "feature", "value", width=6)
    assert pairblocks.blocks_of(pairs) and not pairblocks.blocks_of(pairs.where("d > 3")) and not pairblocks.blocks_of(pairs.drop("metric"))
    assert not pairblocks.blocks_of(D.symmetrize(pairs.where("d > 3"), ids))


def test_one_sample_has_no_pairs_and_no_metric(spark, monkeypatch):
    cells, ids, _ = made(spark, monkeypatch)
    one = ids.where("sample_id = '5'")
    full = D.symmetrize(D.distances(cells.where("sample_id = '5'"), ["info"], one, "feature", "value", width=6), one)
    assert full.count() == 0 and D.row_statistics(full, ["a"]).count() == 0


def test_vectors_are_made_whole_without_a_shuffle_of_cells(spark, monkeypatch):
    cells, ids, _ = made(spark, monkeypatch)
    monkeypatch.setattr(D, "VECTOR_ROWS", 3)
    monkeypatch.setattr(D, "WIDE_BLOCK", 5)
    full, train = D.symmetrize(D.distances(cells, ["info"], ids, "feature", "value", width=6), ids), ids.where("sample_id % 3 <> 1")
    whole, packed = D.distance_features(full, train), D.distance_features(full.select("*"), train)
    assert "Exchange" not in plan(whole) and whole.schema == packed.schema
    assert numbers(whole.select("sample_id", F.concat_ws(",", "features"))) == numbers(packed.select("sample_id", F.concat_ws(",", "features")))
    # a matrix that lacks samples of its pairs is read as rows
    part = D.symmetrize(D.distances(cells, ["info"], ids, "feature", "value", width=6), train)
    assert "Exchange" in plan(D.distance_features(part, train))


def test_scaling_does_not_store_the_matrix(spark, monkeypatch):
    cells, ids, matrix = made(spark, monkeypatch, int)
    full = D.symmetrize(D.distances(cells, ["manhat"], ids, "feature", "value", width=6), ids)
    monkeypatch.setattr(eigen, "SIDE", 4)
    monkeypatch.setattr(eigen, "BROADCAST_COLUMNS", 13 * 40)
    tables_of = [eigen.PairMatrix(m, F.col("d") * F.col("d"), ids, centered=True, power=2) for m in (full, full.select("*"))]
    assert tables_of[0].chunks is None and tables_of[1].chunks is not None
    d = np.abs(matrix[:, None] - matrix[None]).sum(axis=2) ** 2
    c = np.eye(13) - 1 / 13
    wanted = np.sort(np.abs(np.linalg.eigvalsh(c @ d @ c / -2)))[::-1][:3]
    assert all(np.allclose(np.abs(eigen.leading_pairs(t, 3)[0]), wanted) for t in tables_of)


def test_centered_cells_are_added_up_by_blocks(spark, monkeypatch):
    cells, ids, _ = made(spark, monkeypatch)
    full = D.symmetrize(D.distances(cells, ["manhat"], ids, "feature", "value", width=6), ids)
    centered = embedding.double_center(full)
    rows = embedding.double_center(full.select("*"))
    assert pairblocks.blocks_of(centered) and not pairblocks.blocks_of(rows)
    sums = [D.row_statistics(t, ["a"], ["v"], ["top", "squares"]) for t in (centered, rows)]
    assert numbers(sums[0]) == numbers(sums[1])


def test_metrics_are_written_one_by_one(spark, monkeypatch, tmp_path):
    cells, ids, _ = made(spark, monkeypatch)
    pairs = D.distances(cells, ["manhat", "info"], ids, "feature", "value", width=6)
    tables.write_distances(pairs.select("*"), str(tmp_path / "rows"))
    tables.write_distances(pairs.select("*"), str(tmp_path / "blocks"))
    tables.write_distances(pairs, str(tmp_path / "blocks"))  # over another table
    rows, blocks = (tables.read_distances(spark, str(tmp_path / x)).select("metric", "a", "b", "d") for x in ("rows", "blocks"))
    assert numbers(rows) == numbers(blocks) and blocks.count() == 13 * 12
