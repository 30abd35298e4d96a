"""Plans that have to hold on large tables: streamed block pairs, measured salts, numbering, job folders."""

import json
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.operators import distances as D
from sigloom.operators import skew
from sigloom.plans import report


def cells(spark, matrix):
    rows = [(i, f"f{j}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "sample_id long, feature string, value double")


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_slices_of_a_block_pair_add_up_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 5)
    rng = np.random.default_rng(2)
    matrix = rng.integers(1, 9, (17, 40)) * (rng.random((17, 40)) < 0.4)
    matrix[3] = 0
    ids = spark.range(17).select(F.col("id").alias("sample_id"))
    table = cells(spark, matrix)
    made = {strands: D.distances(table, ["manhat"], ids, "feature", "value", slices=6, strands=strands) for strands in (1, 4)}
    assert exchanges(made[4]) == exchanges(made[1]) + 1
    for pairs in made.values():
        got = {(r["a"], r["b"]): r["d"] for r in pairs.collect()}
        assert len(got) == 17 * 16 // 2
        assert all(d == np.abs(matrix[a] - matrix[b]).sum() for (a, b), d in got.items())


def test_one_chunk_waits_for_its_partner():
    """The order of the chunks and their batches do not matter; a lone chunk adds nothing."""
    side = {0: [10, 11], 1: [20]}
    value = {(0, 0): [(10, "x", 2.0)], (1, 0): [(20, "x", 5.0)], (0, 1): [(11, "y", 1.0)], (1, 1): []}

    def batch(*keys):
        cell = pa.list_(pa.struct([("sample_id", pa.int64()), ("feature", pa.string()), ("value", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([s for _, s in keys]), pa.array([b for b, _ in keys]), pa.array([side[b] for b, _ in keys], pa.list_(pa.int64())),
             pa.array([[dict(zip(("sample_id", "feature", "value"), c)) for c in value[k]] or None for k in keys], cell)],
            ["slice", "block", "roster", "cells"],
        )

    key = (pa.scalar(0), pa.scalar(1), pa.scalar(0))
    orders = [[batch((0, 0), (1, 0), (0, 1), (1, 1))], [batch((1, 1)), batch((1, 0), (0, 1)), batch((0, 0))]]
    for batches in orders:
        (out,) = D._add_slices(key, iter(batches))
        assert sorted(zip(*out.to_pydict().values())) == [(10, 20, 3.0, 1.0, 2.0), (11, 20, 6.0, 0.0, 2.0)]


def test_measured_join_splits_the_heavy_key(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    big = big.unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    small = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (None, "n"), (99, "u")], "k long, w string")
    for how in ("inner", "left"):
        plain = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, skew.measured_join(big, small, ["k"], ["v"], how, rows_per_salt=300).collect())) == plain
    salts = sorted(r["_salts"] for r in skew.heavy_keys(big, ["k"], 300).collect())
    assert salts == [2, 2, 2, 2, 2, 60]  # 400 rows of five keys, 18,000 of the heavy one
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, text in settings.items():
        spark.conf.set(name, text)
    try:
        joined = skew.measured_join(big, small, ["k"], ["v"], rows_per_salt=300).where("k = 0")
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 16
    finally:
        for name, text in before.items():
            spark.conf.set(name, text)


def test_measured_join_tells_types_and_zeros(spark):
    one = spark.createDataFrame([(1, 1)], "k int, v int")
    with pytest.raises(ValueError, match="types"):
        skew.measured_join(one, one.select(F.col("k").cast("long").alias("k")), ["k"], ["v"])
    zeros = spark.createDataFrame([(0.0, 1), (-0.0, 2)], "k double, v int")
    right = spark.createDataFrame([(0.0, "x")], "k double, w string")
    assert skew.measured_join(zeros, right, ["k"], ["v"], rows_per_salt=1).count() == 2


def test_numbering_of_scattered_positions(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("group"), F.xxhash64("id").alias("entry_no"), "id"
    )
    rows = rows.unionByName(spark.range(40).select(F.lit("g1").alias("group"), F.lit(5).cast("bigint").alias("entry_no"), (F.col("id") + 9000).alias("id")))
    got = {r["no"]: (r["group"], r["entry_no"], r["id"]) for r in skew.ordinal_rank(rows, "group", "entry_no", "no", width=100, ties=["id"]).collect()}
    expected = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [got[i + 1] for i in range(len(expected))] == expected
    empty = skew.ordinal_rank(rows.limit(0), "group", "entry_no", "no", ties=["id"])
    assert empty.count() == 0


def test_summary_of_a_folder_of_nested_files(spark, tmp_path):
    """Two experiments: one with points for its best run, one with too many classes for a plot."""
    def run(name, groups, dists, points=None):
        home = tmp_path / "job" / name
        home.mkdir(parents=True)
        (home / "metadata.json").write_text(json.dumps([{"id": f"e{i}", "group": g} for i, g in enumerate(groups)]))
        for dist, stats in dists.items():
            body = {c: {"classes": ["a", "b"], "confusion_matrix": [[2, 0], [1, 1]], "top1": {"accuracy": acc, "misclassified_indexes": missed}} for c, (acc, missed) in stats.items()}
            (home / f"classification-{dist}.json").write_text(json.dumps(body))
        if points:
            (home / "mds10-manhat.json").write_text(json.dumps(points))

    points = [[0.0, 1.0], [2.0, 3.0], [4.0, 3.0], [1.0, 5.0]]
    run("small-k=4", "aabb", {"kmers": {"lda": (0.5, [0, 1])}, "manhat": {"lda": (0.75, [2]), "qda": (0.25, [0, 1, 2])}}, points)
    run("small-k=5", "aabb", {"kmers": {"lda": (0.75, [1])}, "manhat": {"lda": (0.7, [3]), "qda": (0.5, [0])}})
    run("many-k=4", [f"c{i}" for i in range(11)], {"manhat": {"lda": (0.9, [4])}}, [[float(i)] for i in range(11)])
    run("single-k=4", "aaaa", {"manhat": {"lda": (1.0, [])}})
    made = report.summarize(spark, str(tmp_path / "job"), 1, ["lda", "qda", "sgd"], nested=True, plots=True)
    assert [tuple(r) for r in made["summary"].collect()] == [("many", 90.0, "k=4, manhat, lda"), ("small", 75.0, "k=4, manhat, lda")]
    assert sorted(tuple(r) for r in made["classes"].where("base = 'small'").collect()) == [("small", "a", 2), ("small", "b", 2)]
    assert sorted(r["n"] for r in made["confusion"].where("base = 'small'").collect()) == [0, 1, 1, 2]
    status = {r["classifier"]: r["status"] for r in made["status"].where("base = 'small'").collect()}
    assert status == {"lda": "always", "qda": "sometimes", "sgd": "never"}
    plot = {r["sample_id"]: r for r in made["plot"].collect()}
    assert {r["base"] for r in plot.values()} == {"small"} and sorted(plot) == ["0", "1", "2", "3"]
    assert [i for i in sorted(plot) if plot[i]["misclassified"]] == ["2"]
    assert plot["2"]["coords"] == [1.0, 0.0] and plot["3"]["label"] == "b (2)"
