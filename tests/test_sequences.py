from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigloom.functions import naming
from sigloom.functions import sequences as S
from sigloom.operators import kmers as K
from sigloom.sources.fasta import parse_fasta, read_fasta, write_fasta


def records(spark, text, keep=False):
    df = spark.createDataFrame([("f", text)], "file string, content string")
    rows = parse_fasta(df, "content", keep, with_headers=True).orderBy("record_no").collect()
    return [(r["header"], r["seq"]) for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        (">a\nACG\nTT\n", [(">a", "ACGTT")]),
        (">a\nAC\n\nGT\n", [(">a", "AC"), (None, "GT")]),
        (">a\nAC\n \t \n\n\nGT\n", [(">a", "AC"), (None, "GT")]),
        (">a\nnnn\nxx\n>b\nA\n", [(">a", ""), (">b", "A")]),
        (">a\n>b\nACGT\n", [(">b", "ACGT")]),
        (">a\nacgtACGT\n", [(">a", "ACGT")]),
        (">a x\r\nAC\r\nGT\r\n>b\r\nTT", [(">a x", "ACGT"), (">b", "TT")]),
        ("ACGT\n>a\nTT", [(None, "ACGT"), (">a", "TT")]),
        ("\n\n  >a  \n  AC  \nGT", [(">a", "ACGT")]),
        (">a\nANNC\n", [(">a", "AC")]),
        (">only header\n", []),
        ("", []),
    ],
)
def test_fasta_rules(spark, text, expected):
    assert records(spark, text) == expected


def test_keep_other_letters_strips_lines_only(spark):
    assert records(spark, ">a\n  AC N \nacg\n", keep=True) == [(">a", "AC Nacg")]


def reference_records(lines):
    """Independent restatement over lines: header and blank lines end a record."""
    out, current = [], []
    for line in lines:
        line = line.strip(" \t\r\n\x0b\f")
        if line == "" or line.startswith(">"):
            if current:
                out.append("".join(current))
            current = []
        else:
            current.append("".join(c for c in line if c in "ACGT"))
    return out + (["".join(current)] if current else [])


def test_random_texts_agree_with_line_rules(spark):
    import random

    rng = random.Random(5)
    pieces = [">h", "", "  ", "ACGT", "acgN", " TT ", ">", "\t", "A>C", "  >x"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    rows = parse_fasta(df, "content").orderBy("i", "record_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], []).append(r["seq"])
    for i, text in enumerate(texts):
        assert got.get(i, []) == reference_records(text.split("\n")), repr(text)


def test_read_fasta_directory(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">one\nACGT\n\nGG\n>two\nTT")
    (tmp_path / "a b.fasta").write_text(">z\nAAAA\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "hidden.fasta").write_text(">no\nCC\n")
    whole = read_fasta(spark, str(tmp_path), with_headers=True).collect()
    assert sorted((r["file"], r["record_no"], r["header"], r["seq"]) for r in whole) == [
        ("a b.fasta", 1, ">z", "AAAA"), ("x.fasta", 1, ">one", "ACGT"), ("x.fasta", 2, None, "GG"), ("x.fasta", 3, ">two", "TT"),
    ]
    split = read_fasta(spark, str(tmp_path), with_headers=True, split_files=True).collect()
    assert sorted((r["file"], r["seq"]) for r in split) == sorted((r["file"], r["seq"]) for r in whole)
    ordered = sorted(((r["record_no"], r["piece_no"], r["seq"]) for r in split if r["file"] == "x.fasta"))
    assert [s for _, _, s in ordered] == ["ACGT", "GG", "TT"]


def test_write_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, "ACGT"), ("s1", 2, "GG"), ("s2", 1, "T")], "sample_id string, record_no int, seq string")
    write_fasta(df, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    rows = parse_fasta(back.withColumnRenamed("value", "content"), "content").collect()
    assert sorted((r["sample_id"], r["seq"]) for r in rows) == [("s1", "ACGT"), ("s1", "GG"), ("s2", "T")]


def brute(sequences, k):
    return Counter(s[i : i + k] for s in sequences for i in range(len(s) - k + 1))


@pytest.mark.parametrize("k", [1, 2, 5, 31, 32])
def test_counts_against_brute_force(spark, k, monkeypatch):
    import random

    monkeypatch.setattr(K, "CHUNK", 7)
    rng = random.Random(k)
    data = [(i % 3, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 1, 6, 7, 8, 13, 14, 15, 40, 75])]
    df = spark.createDataFrame(data, "sample_id int, seq string")
    got = {(r["sample_id"], r["kmer"]): r["n"] for r in K.kmer_counts(df, k).collect()}
    expected = {}
    for sample in range(3):
        for kmer, n in brute([s for i, s in data if i == sample], k).items():
            expected[(sample, kmer)] = n
    assert got == expected


def test_several_k_in_one_scan_match_single_k(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 5)
    df = spark.createDataFrame([(1, "ACGTACGTTAGC"), (2, "ACG")], "sample_id int, seq string")
    together = {tuple(r) for r in K.kmer_counts(df, [2, 3, 7]).collect()}
    apart = {tuple(r) for k in (2, 3, 7) for r in K.kmer_counts(df, k).collect()}
    assert together == apart


def test_k_outside_range_is_refused(spark):
    for k in (0, 33):
        with pytest.raises(ValueError):
            S.check_k(k)


def test_frequencies_sum_to_one_and_empty_sample_has_no_rows(spark):
    df = spark.createDataFrame([(1, "ACGTAC"), (2, ""), (3, "A")], "sample_id int, seq string")
    rows = K.kmer_frequencies(K.kmer_counts(df, 2)).groupBy("sample_id").agg(F.sum("freq").alias("t")).collect()
    assert [(r["sample_id"], round(r["t"], 12)) for r in rows] == [(1, 1.0)]


def test_cgr_cells_are_a_bijection(spark):
    import itertools

    words = [("".join(w),) for w in itertools.product("ACGT", repeat=3)]
    df = spark.createDataFrame(words, "kmer string").select("kmer", S.cgr_cell("kmer", 3).alias("c")).collect()
    assert sorted(r["c"]["idx"] for r in df) == list(range(64))
    cells = {r["kmer"]: (r["c"]["row"], r["c"]["col"]) for r in df}
    assert (cells["AAA"], cells["CCC"], cells["GGG"], cells["TTT"]) == ((0, 0), (0, 7), (7, 7), (7, 0))
    # the last letter picks the quadrant
    assert all((cells[w][0] >= 4) == (w[2] in "GT") and (cells[w][1] >= 4) == (w[2] in "CG") for w in cells)


def test_names(spark):
    df = spark.createDataFrame([("a-k=12-x=1",)], "run string")
    row = df.select(naming.parse_run("run").alias("p")).first()["p"]
    assert (row["base"], row["k"]) == ("a-x=1", 12)
    with pytest.raises(Exception, match="no parameter k"):
        spark.createDataFrame([("plain",)], "run string").select(naming.parse_run("run").alias("p")).collect()
    names = ["x10", "x9", "x9b", "a2", "10", "x"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(naming.natural_key("n")).collect()
    assert [r["n"] for r in got] == ["10", "a2", "x", "x9", "x9b", "x10"]
    path = "file:/job/run-k=3/classification-manhat.json/part-0.json"
    assert df.select(naming.dist_name(F.lit(path)).alias("d")).first()["d"] == "manhat"
    assert df.select(naming.percent_label(F.lit("A1"), F.lit(0.973)).alias("d")).first()["d"] == "A1 (97.3%)"
    assert df.select(S.ordinal_name(F.lit(12345678901)).alias("d")).first()["d"] == "12345678901.fasta"


def test_long_kmers_are_counted_as_numbers(spark):
    from sigloom.operators.kmers import kmer_totals

    texts = ["T" * 33, "A" * 32, "G" + "A" * 31, "ACGT" * 8, "ACGT" * 8, "ACG", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "sample_id long, seq string")
    got = kmer_totals(rows, 32)
    assert {r.kmer: r.n for r in got.collect()} == {"T" * 32: 2, "A" * 32: 1, "G" + "A" * 31: 1, "ACGT" * 8: 2}
    assert "hashpartitioning(code" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.kmer: r.n for r in kmer_totals(rows, 3).where("n > 30").collect()} == {"TTT": 31, "AAA": 30 + 29}


def test_codes_of_long_texts_are_cut_without_a_loss(monkeypatch):
    import random

    import pyarrow as pa

    from sigloom.operators import kmers

    dice = random.Random(3)
    texts = ["".join(dice.choices("ACGT", k=n)) for n in (0, 5, 40, 7, 13)]
    monkeypatch.setattr(kmers, "_LETTERS_AT_ONCE", 9)
    for k in (1, 3, 5, 6):
        got = [int(c) for part in kmers._codes(pa.array(texts), k) for c in part]
        assert got == [int("".join(str("ACGT".index(x)) for x in t[i : i + k]), 4) for t in texts for i in range(len(t) - k + 1)]
