"""Sequence text functions and k-mer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import sequences as S
from sigloom.operators import kmers as K
from sigloom.session import spread
from workload.base import SEQ, Registry, counts_sql, samples, sequences, table

REGISTRY = Registry()

_LINES = r"""lines AS (SELECT doc_id, pos, trim(line, E' \t\r\n\f\x0b') AS line FROM (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (
      SELECT doc_id, string_split({text}, chr(10)) AS lines FROM documents))),
  marked AS (SELECT *, (line = '' OR line[1] = '>') AS brk,
    sum(CASE WHEN line = '' OR line[1] = '>' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS rec
    FROM lines),
  records AS (SELECT doc_id, rec, max(CASE WHEN line[1] = '>' THEN line END) AS header,
    string_agg(CASE WHEN NOT brk THEN {clean} END, '' ORDER BY pos) AS seq
    FROM marked GROUP BY doc_id, rec HAVING count(CASE WHEN NOT brk THEN 1 END) > 0)"""


def _fasta_sql(text: str, clean: str) -> str:
    return "WITH " + _LINES.format(text=text, clean=clean)


_WITH_HEADER = "concat('>', doc_id, chr(10), text)"


def _as_fasta(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.col("text")).alias("content"))



@REGISTRY.query(
    _fasta_sql(_WITH_HEADER, "regexp_replace(line, '[^ACGT]', '', 'g')")
    + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rec) AS record_no, header, seq FROM records"""
)
def fasta_scan(spark, sf_dir):
    from sigloom.sources.fasta import parse_fasta

    return parse_fasta(_as_fasta(spark, sf_dir), "content", with_headers=True)


@REGISTRY.query(
    _fasta_sql(_WITH_HEADER, "line")
    + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rec) AS record_no, md5(seq) AS digest FROM records"""
)
def fasta_scan_other_letters(spark, sf_dir):
    from sigloom.sources.fasta import parse_fasta

    rows = parse_fasta(_as_fasta(spark, sf_dir), "content", keep_other_letters=True)
    return rows.select("doc_id", "record_no", F.md5("seq").alias("digest"))


@REGISTRY.query(
    "SELECT doc_id, regexp_replace(text, '[^ACGT]', '', 'g') AS seq FROM documents"
)
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.sanitize("text").alias("seq"))


@REGISTRY.query(f"WITH {counts_sql(4)} SELECT sample_id, k, kmer, n FROM counts")
def kmer_counts_k4(spark, sf_dir):
    return K.kmer_counts(sequences(spark, sf_dir), 4)


@REGISTRY.query(f"WITH {counts_sql(6)} SELECT k, kmer, sum(n)::BIGINT AS n, count(*) AS samples FROM counts GROUP BY ALL")
def kmer_counts_k6_totals(spark, sf_dir):
    counts = K.kmer_counts(sequences(spark, sf_dir), 6)
    return counts.groupBy("k", "kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("samples"))


@REGISTRY.query(f"WITH {counts_sql(2, 3, 5)} SELECT sample_id, k, sum(n)::BIGINT AS total, count(*) AS distinct_kmers, max(n) AS top FROM counts GROUP BY ALL")
def kmer_counts_several_k(spark, sf_dir):
    counts = K.kmer_counts(sequences(spark, sf_dir), [2, 3, 5])
    return counts.groupBy("sample_id", "k").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_kmers"), F.max("n").alias("top")
    )


@REGISTRY.query(f"""WITH {SEQ} SELECT kmer, count(*) AS n FROM (
  SELECT unnest(list_transform(generate_series(1, length(seq) - 31), lambda i: substr(seq, i, 32))) AS kmer
  FROM seqs WHERE length(seq) >= 32) GROUP BY kmer""")
def kmers_k32(spark, sf_dir):
    return K.kmer_totals(sequences(spark, sf_dir), 32)


@REGISTRY.query(f"""WITH {counts_sql(3)} SELECT sample_id, k, kmer,
  round(n / sum(n) OVER (PARTITION BY sample_id, k), 10) AS freq FROM counts""")
def kmer_frequencies_k3(spark, sf_dir):
    freqs = K.kmer_frequencies(K.kmer_counts(sequences(spark, sf_dir), 3))
    return freqs.withColumn("freq", F.round("freq", 10))


@REGISTRY.query(f"""WITH {counts_sql(4)},
  cells AS (SELECT kmer, n, sample_id,
    CAST(list_sum(list_transform(generate_series(1, 4), lambda i: CASE WHEN substr(kmer, i, 1) IN ('G','T') THEN 1 << (i - 1) ELSE 0 END)) AS BIGINT) AS r,
    CAST(list_sum(list_transform(generate_series(1, 4), lambda i: CASE WHEN substr(kmer, i, 1) IN ('C','G') THEN 1 << (i - 1) ELSE 0 END)) AS BIGINT) AS c
    FROM counts)
  SELECT sample_id, r AS "row", c AS col, r * 16 + c AS idx, n FROM cells""")
def chaos_game_cells(spark, sf_dir):
    counts = K.kmer_counts(sequences(spark, sf_dir), 4)
    return counts.select("sample_id", S.cgr_cell("kmer", 4).alias("cell"), "n").select("sample_id", "cell.*", "n")


@REGISTRY.query(f"""WITH {counts_sql(5)} SELECT CAST(floor(
  (SELECT count(*) FROM counts WHERE n <> 0) / (SELECT count(*) FROM documents)) AS BIGINT) AS avg_nonzero""")
def avg_nonzero_entries(spark, sf_dir):
    return K.avg_nonzero(K.kmer_counts(sequences(spark, sf_dir), 5), samples(spark, sf_dir))


@REGISTRY.query(f"""WITH {counts_sql(3)} SELECT s.lang AS "group", kmer, sum(n)::BIGINT AS n, count(*) AS samples
  FROM counts JOIN seqs s USING (sample_id) GROUP BY ALL""")
def labelled_features(spark, sf_dir):
    rows = K.label_features(K.kmer_counts(sequences(spark, sf_dir), 3), samples(spark, sf_dir))
    return rows.groupBy("group", "kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("samples"))
