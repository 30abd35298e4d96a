import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sigloom.operators import folds, ranking, skew
from sigloom.operators import selection as sel
from sigloom.plans.grid import experiment_grid, grid_points
from sigloom.plans.job import Experiment, Job, run_job
from sigloom.plans.select import select_sequences
from sigloom.sources.archives import read_archive, write_archives
from sigloom.sources.metadata import read_metadata
from workload import report_queries

ENTRIES = [
    {"id": "e1", "subtype": "A", "recombinant": False},
    {"id": "e2", "subtype": "B", "recombinant": True, "filename": "own/two.fa"},
    {"id": "e3", "subtype": "A", "recombinant": None},
    {"id": "e4", "subtype": "", "recombinant": False},
    {"id": "e5", "subtype": "B", "recombinant": False},
]
DATASET = {"archive": "zoo", "archive_folder": "whole", "metadata": "zoo"}


def zoo(path):
    with zipfile.ZipFile(path / "zoo.zip", "w") as z:
        z.writestr("whole/e1.fasta", ">1\nACGT\n>2\nGG\n")
        z.writestr("own/two.fa", ">x\nTTTT\n")
        z.writestr("whole/e3.fasta", "nothing here\n")
        z.writestr("whole/e5.fasta", ">5\nCC\n")
        z.writestr("whole/unused.fasta", ">u\nAAAAAAAA\n")
    (path / "zoo.json").write_text(json.dumps(ENTRIES))


def test_metadata_keeps_order(spark, tmp_path):
    zoo(tmp_path)
    rows = read_metadata(spark, str(tmp_path / "zoo.json")).orderBy("entry_no").collect()
    assert [r["id"] for r in rows] == ["e1", "e2", "e3", "e4", "e5"]


def test_selection_from_files(spark, tmp_path):
    zoo(tmp_path)
    meta = read_metadata(spark, str(tmp_path / "zoo.json"), "id string, subtype string, recombinant boolean, filename string")
    groups = sel.groups_by_value(meta, "subtype", 2)
    assert sorted(r["group"] for r in groups.collect()) == ["A", "B"]
    picked = sel.pick_group(meta, sel.with_dataset(groups, DATASET).drop("metadata"), "subtype")
    wanted = sel.explode_members(picked, False).select("archive", "member")
    archives = read_archive(spark, str(tmp_path), wanted)
    assert "whole/unused.fasta" not in {r["member"] for r in archives.collect()}
    out = select_sequences(picked, archives).orderBy("sample_no").collect()
    assert [(r["id"], r["group"], r["filename"], r["sequences"]) for r in out] == [
        ("e1", "A", "0000000001.fasta", ["ACGT", "GG"]),
        ("e3", "A", "0000000002.fasta", [""]),
        ("e2", "B", "0000000003.fasta", ["TTTT"]),
        ("e5", "B", "0000000004.fasta", ["CC"]),
    ]


def test_whole_archive_without_a_list(spark, tmp_path):
    zoo(tmp_path)
    assert read_archive(spark, str(tmp_path)).count() == 5


def test_archives_in_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    zoo(tmp_path)
    spark.conf.set("fs.viewfs.mounttable.store.link./zoo", f"file://{tmp_path}")
    folder = "viewfs://store/zoo"
    wanted = spark.createDataFrame([("zoo", "own/two.fa"), ("zoo", "gone.fa")], "archive string, member string")
    assert [tuple(r) for r in read_archive(spark, folder, wanted).collect()] == [("zoo", "own/two.fa", ">x\nTTTT\n")]
    assert {tuple(r) for r in read_archive(spark, folder).collect()} == {tuple(r) for r in read_archive(spark, str(tmp_path)).collect()}
    docs = [(2, "en", "web", "AC"), (4, "en", "web", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(report_queries, "scratch", lambda spark, name: f"{folder}/{name}")
    found = report_queries.archive_scan(spark, f"{tmp_path}/in").collect()
    assert [tuple(r) for r in found] == [(2, "AC")]


def test_archive_scan_of_odd_ids(spark, tmp_path):
    docs = [(-4, "AC"), (-3, "A"), (None, "C"), (6, "GG"), (6, "TT"), (6, "TT"), (8, ""), (2**62, "T")]
    rows = spark.createDataFrame([(i, "en", "web", t) for i, t in docs], "doc_id long, lang string, source string, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in report_queries.archive_scan(spark, str(tmp_path)).collect())
    assert found == [(-4, "AC"), (6, "GG"), (6, "TT"), (6, "TT"), (2**62, "T")]


def test_archives_are_cut_at_a_size(spark, tmp_path, monkeypatch):
    rows = [(f"m{i}", "\u00fc" * 600_000) for i in range(60)] + [("last", "x\n\n")]
    docs = spark.createDataFrame(rows, "member string, content string").coalesce(1)
    write_archives(docs, f"{tmp_path}/out")
    back = read_archive(spark, f"{tmp_path}/out", pattern="part-*").select("archive", F.regexp_extract("member", "([^/]*)$", 1), "content").collect()
    assert sorted(r[1:] for r in back) == sorted(rows)
    assert len({r[0] for r in back}) == 3
    assert all(zipfile.is_zipfile(f) for f in (tmp_path / "out").glob("part-*"))


def test_archive_without_members_among_others(spark, tmp_path):
    zoo(tmp_path)
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    assert {r["archive"] for r in read_archive(spark, str(tmp_path)).collect()} == {"zoo"}


def test_entry_in_two_groups_is_two_rows(spark):
    meta = spark.createDataFrame([("e", 0, "A")], "id string, entry_no long, subtype string")
    groups = spark.createDataFrame([("g1", ["A", "B"]), ("g2", ["A", "A"])], "group string, values array<string>")
    rows = sel.pick_group(meta, groups, "subtype").collect()
    assert sorted(r["group"] for r in rows) == ["g1", "g2"]


def test_flag_and_value_predicates(spark):
    meta = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, flag boolean")
    assert sorted(r["id"] for r in sel.exclude_flagged(meta, "flag", False).collect()) == ["b", "c"]
    assert sel.exclude_flagged(meta, "flag", True).count() == 3


def test_numbering_with_narrow_buckets(spark):
    rows = [(g, p) for g in "ba" for p in (5, 70, 3, 130, 131)]
    df = spark.createDataFrame(rows, "group string, entry_no long")
    got = skew.ordinal_rank(df, "group", "entry_no", "no", width=64).orderBy("no").collect()
    assert [(r["group"], r["entry_no"], r["no"]) for r in got] == [
        (g, p, i + 1) for i, (g, p) in enumerate(sorted(rows))
    ]


def sizes(n, v):
    return [n // v + (1 if i < n % v else 0) for i in range(v)]


def test_fold_sizes_and_reproducibility(spark):
    for n, v in ((10, 3), (11, 4), (7, 7), (3, 5), (200, 10), (5, 1)):
        df = spark.range(n).select(F.col("id").alias("sample_id"))
        one = {r["sample_id"]: r["fold"] for r in folds.assign_folds(df, v, seed=1).collect()}
        two = {r["sample_id"]: r["fold"] for r in folds.assign_folds(df.orderBy(F.col("sample_id").desc()), v, seed=1).collect()}
        assert one == two
        assert [list(one.values()).count(f) for f in range(v)] == sizes(n, v)
    df = spark.range(200).select(F.col("id").alias("sample_id"))
    other = {r["sample_id"]: r["fold"] for r in folds.assign_folds(df, 10, seed=2).collect()}
    assert other != {r["sample_id"]: r["fold"] for r in folds.assign_folds(df, 10, seed=1).collect()}


def test_group_folds_keep_values_together(spark):
    df = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") % 7).alias("site"))
    rows = folds.assign_folds(df, 3, seed=4, split_by="site").collect()
    per_site = {}
    for r in rows:
        per_site.setdefault(r["site"], set()).add(r["fold"])
    assert len(rows) == 100 and all(len(f) == 1 for f in per_site.values())
    assert [sum(f == {i} for f in per_site.values()) for i in range(3)] == sizes(7, 3)


def test_salted_join_keeps_every_match(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k long, w string")
    plain = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, skew.salted_join(big, small, ["k"], ["v"]).collect())) == plain


def test_ranking_ties_differ_on_purpose(spark):
    scores = spark.createDataFrame([("s", "a", 0.4), ("s", "b", 0.4), ("s", "c", 0.2)], "sample_id string, cls string, prob double")
    assert [r["cls"] for r in ranking.rank_eval(scores).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r["cls"] for r in ranking.rank_predict(scores).orderBy("rank").collect()] == ["a", "b", "c"]


def test_class_absent_from_training_is_always_a_miss(spark):
    ranked = spark.createDataFrame(
        [(0, "s", "z", "a", 0.7, 1), (0, "s", "z", "b", 0.2, 2), (0, "s", "z", "c", 0.1, 3), (0, "t", "b", "b", 0.9, 1), (0, "t", "b", "a", 0.1, 2), (0, "t", "b", "c", 0.0, 3)],
        "fold int, sample_id string, actual string, cls string, prob double, rank int",
    )
    out = ranking.outcomes(ranked)
    acc = {r["n"]: r["accuracy"] for r in ranking.topn_accuracy(out).collect()}
    assert acc == {1: 0.5, 2: 0.5}
    assert sorted((r["n"], r["sample_id"]) for r in ranking.misclassified(out).collect()) == [(1, "s"), (2, "s")]
    mean = {r["n"]: r["accuracy"] for r in ranking.cv_accuracy(ranking.topn_accuracy(out), 2).collect()}
    assert mean == {1: 0.25, 2: 0.25}


def test_label_only_results_have_top1_only(spark):
    ranked = spark.createDataFrame(
        [(0, "s", "a", "a", None, 1), (0, "t", "b", "a", None, 1)],
        "fold int, sample_id string, actual string, cls string, prob double, rank int",
    )
    acc = ranking.topn_accuracy(ranking.outcomes(ranked)).collect()
    assert [(r["n"], r["accuracy"]) for r in acc] == [(1, 0.5)]


def test_grid_names_and_shared_selection(spark):
    ids = spark.range(2).select(F.col("id").alias("sample_id"))
    rows = experiment_grid(ids, "sub", {"k": "3..4", "m": ["x", "y"]}, {"m": "fixed", "z": 9}, copy_for=["k"]).collect()
    assert len(rows) == 8
    assert {(r["experiment"], r["selection"], r["k"], r["m"], r["z"]) for r in rows} == {
        (f"sub-k={k}-m={m}", f"sub-k=3-m={m}", k, "fixed", 9) for k in (3, 4) for m in "xy"
    }
    points = grid_points("sub", {"k": "3..4", "m": ["x", "y"]}, {"m": "fixed"}, ("k",))
    assert [(p[0], p[1]) for p in points] == [
        ("sub-k=3-m=x", "sub-k=3-m=x"), ("sub-k=3-m=y", "sub-k=3-m=y"), ("sub-k=4-m=x", "sub-k=3-m=x"), ("sub-k=4-m=y", "sub-k=3-m=y"),
    ]
    assert all(p[2]["m"] == "fixed" for p in points)


def test_missing_members_are_an_error(spark):
    picked = spark.createDataFrame([("e1", 1, "A", "zoo", None), ("gone", 2, "A", "zoo", None)], "id string, entry_no long, group string, archive string, archive_folder string")
    archives = spark.createDataFrame([("zoo", "e1.fasta", ">1\nACGT")], "archive string, member string, content string")
    with pytest.raises(Exception, match="no such member: zoo/gone.fasta"):
        select_sequences(picked, archives).collect()


def test_job_with_functions_and_two_datasets(spark, tmp_path):
    """Groups and entries chosen by functions with options, a group of another dataset, members read as needed."""
    zoo(tmp_path)
    meta = {
        "zoo": read_metadata(spark, str(tmp_path / "zoo.json"), "id string, subtype string, recombinant boolean, filename string"),
        "more": spark.createDataFrame([("m1", "A", False, 0), ("m2", "C", True, 1)], "id string, subtype string, recombinant boolean, entry_no long"),
    }
    asked = []

    def archives(members):
        asked.extend(tuple(r) for r in members.collect())
        more = spark.createDataFrame([("extra", "m1.fasta", ">m\nGATT")], "archive string, member string, content string")
        return read_archive(spark, str(tmp_path), members).unionByName(more)

    def groups(options, metadata):
        found = sel.groups_by_value(metadata, options["selection_key"], options["min_group_pts"])
        return [{"group": r["group"], "values": r["values"], "selection_key": options["selection_key"]} for r in found.orderBy("group").collect()] + [
            {"group": "other", "values": ["A", "C"], "selection_key": "subtype", "archive": "extra", "metadata": "more"}
        ]

    def pick(metadata, group, options):
        flagged = F.coalesce(F.col("recombinant"), F.lit(False))
        return (F.lit(options["include_recombinants"]) | ~flagged) & F.col(group["selection_key"]).isin(group["values"])

    experiment = Experiment(groups, DATASET, {"selection_key": "subtype", "min_group_pts": 2, "include_recombinants": False}, {"k": "2..2"})
    steps = [{"type": "kmers", "output_file": "cgrs", "mode": "frequencies", "k": "from_options"}, {"type": "kmers", "output_file": "counts-2", "mode": "counts", "k": 2}]
    job = Job("j", {"sub": experiment}, steps, meta, archives, pick)
    run_job(spark, job, str(tmp_path / "out"))
    chosen = spark.read.parquet(str(tmp_path / "out/j/sub-k=2/selection.parquet")).orderBy("sample_no").collect()
    assert [(r["id"], r["group"], r["sequences"]) for r in chosen] == [
        ("e1", "A", ["ACGT", "GG"]), ("e3", "A", [""]), ("e5", "B", ["CC"]), ("m1", "other", ["GATT"]),
    ]
    assert sorted(asked) == [("extra", "m1.fasta"), ("zoo", "whole/e1.fasta"), ("zoo", "whole/e3.fasta"), ("zoo", "whole/e5.fasta")]
    counts = spark.read.parquet(str(tmp_path / "out/j/sub-k=2/counts-2.parquet"))
    assert {(r["kmer"], r["n"]) for r in counts.where("sample_id = '0000000001.fasta'").collect()} == {("AC", 1), ("CG", 1), ("GT", 1), ("GG", 1)}
