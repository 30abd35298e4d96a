"""Run names, reports over many runs, and tables written and read back."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from sigloom.functions import naming
from sigloom.functions.sequences import ordinal_name
from sigloom.operators import distances as D
from sigloom.operators import kmers as K
from sigloom.operators.classifiers import Options
from sigloom.plans import report
from sigloom.plans.evaluate import fit_final
from sigloom.plans.predict import kmer_vectors, predict_sequences
from sigloom.sources import archives, fasta, models, results, tables
from sigloom.sources.metadata import read_metadata
from workload.base import SEQ, Registry, counts_sql, samples, scratch, sequences, table

REGISTRY = Registry()

NAMES = ("linear-svm", "lda", "qda", "sgd", "random-forest")
DISTS = ("kmers", "manhat", "info")

# accuracies measured over all documents: one run per language and k, two values of N
RUNS = """marks AS (SELECT concat('lang-', lang, '-k=', doc_id % 4 + 2) AS run, concat('lang-', lang) AS base,
    CAST(doc_id % 4 + 2 AS INTEGER) AS k, ['kmers', 'manhat', 'info'][n_chars % 3 + 1] AS dist,
    ['linear-svm', 'lda', 'qda', 'sgd', 'random-forest'][doc_id // 7 % 5 + 1] AS classifier, n_chars FROM documents),
  res AS (SELECT run, base, k, dist, classifier, 1 AS n, avg(CASE WHEN n_chars % 5 < 2 THEN 1.0 ELSE 0.0 END) AS accuracy FROM marks GROUP BY ALL
    UNION ALL SELECT run, base, k, dist, classifier, 2, avg(CASE WHEN n_chars % 5 < 4 THEN 1.0 ELSE 0.0 END) FROM marks
      WHERE classifier <> 'linear-svm' GROUP BY ALL),
  sizes AS (SELECT concat('lang-', lang) AS base, concat('c', doc_id % (ascii(lang) % 4 + 1)) AS "group", count(*) AS n FROM documents GROUP BY ALL),
  classes AS (SELECT base, count(*) AS n_classes FROM sizes GROUP BY base)"""

BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY accuracy DESC, k, dist, classifier) AS r
  FROM res WHERE n = {n}) WHERE r = 1)"""


def _marks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, dists = F.array(*[F.lit(x) for x in NAMES]), F.array(*[F.lit(x) for x in DISTS])
    return docs.select(
        F.format_string("lang-%s-k=%s", "lang", (F.col("doc_id") % 4 + 2).cast("string")).alias("run"),
        dists[(F.col("n_chars") % 3).cast("int")].alias("dist"),
        names[(F.floor(F.col("doc_id") / 7) % 5).cast("int")].alias("classifier"),
        "n_chars",
    )


def _results(spark, sf_dir):
    marks = _marks(spark, sf_dir)

    def part(n, limit, rows):
        hit = F.when(F.col("n_chars") % 5 < limit, 1.0).otherwise(0.0)
        acc = rows.groupBy("run", "dist", "classifier").agg(F.avg(hit).alias("accuracy"))
        return acc.select("run", "dist", "classifier", F.lit(n).alias("n"), "accuracy")

    return part(1, 2, marks).unionByName(part(2, 4, marks.where("classifier <> 'linear-svm'")))


def _class_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    group = F.concat(F.lit("c"), F.expr("doc_id % (ascii(lang) % 4 + 1)"))
    return docs.groupBy(F.concat(F.lit("lang-"), "lang").alias("base"), group.alias("group")).agg(F.count(F.lit(1)).alias("n"))


def _class_counts(spark, sf_dir):
    return _class_sizes(spark, sf_dir).groupBy("base").agg(F.count(F.lit(1)).alias("n_classes"))


def _rounded(df):
    return df.withColumn("accuracy", F.round("accuracy", 9))


@REGISTRY.query("SELECT doc_id, concat('src', lang, '-mode=x') AS base, CAST(n_chars % 32 + 1 AS INTEGER) AS k FROM documents")
def run_names(spark, sf_dir):
    name = F.format_string("src%s-k=%s-mode=x", "lang", (F.col("n_chars") % 32 + 1).cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", naming.parse_run(name).alias("r"))
    return docs.select("doc_id", "r.base", "r.k")


@REGISTRY.query("SELECT doc_id, concat(lang, '-', source) AS dist FROM documents")
def dist_names(spark, sf_dir):
    path = F.format_string("/job/run-k=%s/classification-%s-%s.json", F.col("doc_id").cast("string"), "lang", "source")
    return table(spark, sf_dir, "documents").select("doc_id", naming.dist_name(path).alias("dist"))


@REGISTRY.query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY CAST(substr(source, 4) AS INTEGER), n_chars, doc_id) AS position FROM documents""")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    name = F.format_string("%s-n%s-%s", "source", F.col("n_chars").cast("string"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", naming.natural_key(name).alias("key"))
    return docs.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("key")).alias("position"))


@REGISTRY.query("""SELECT doc_id, concat(lpad(CAST(n_chars AS VARCHAR), 10, '0'), '.fasta') AS name,
  printf('%s (%.1f%%)', lang, (doc_id % 8) / 8.0 * 100) AS label,
  concat('k=', doc_id % 5, ', ', lang, ', ', source) AS info FROM documents""")
def labels_and_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", ordinal_name("n_chars").alias("name"), naming.percent_label("lang", (F.col("doc_id") % 8) / 8.0).alias("label"),
        naming.run_info(F.col("doc_id") % 5, "lang", "source").alias("info"),
    )


@REGISTRY.query(f"WITH {RUNS} SELECT run, dist, classifier, base, k, round(accuracy, 9) AS accuracy FROM res SEMI JOIN (SELECT base FROM classes WHERE n_classes > 1) USING (base) WHERE n = 2")
def gated_results(spark, sf_dir):
    shown = report.gate(report.with_run(_results(spark, sf_dir)), _class_counts(spark, sf_dir), 1)
    return _rounded(report.metric_present(shown, 2).drop("n"))


@REGISTRY.query(f"WITH {RUNS}, {BEST.format(n=1)} SELECT base, round(accuracy, 9) AS accuracy, k, dist, classifier, run FROM best")
def best_classifier(spark, sf_dir):
    return _rounded(report.best_classifier(report.with_run(_results(spark, sf_dir)), 1))


@REGISTRY.query(f"""WITH {RUNS} SELECT base, dist, k, round(accuracy, 9) AS accuracy, classifier FROM (SELECT *,
  row_number() OVER (PARTITION BY base, dist, k ORDER BY accuracy DESC, classifier) AS r FROM res WHERE n = 1) WHERE r = 1""")
def best_by_k(spark, sf_dir):
    return _rounded(report.best_by_k(report.with_run(_results(spark, sf_dir)), 1))


@REGISTRY.query(f"""WITH {RUNS}, {BEST.format(n=1)}, rows AS (SELECT res.base, res.k, res.classifier, res.dist, res.accuracy FROM res JOIN best b ON b.base = res.base AND b.k = res.k WHERE res.n = 1)
  SELECT base, k, classifier, {', '.join(f"coalesce(printf('%.2f', max(CASE WHEN dist = '{d}' THEN accuracy END) * 100), 'N/A') AS {d}" for d in DISTS)}
  FROM rows GROUP BY base, k, classifier""")
def classifiers_at_best_k(spark, sf_dir):
    rows = report.classifiers_at_best_k(report.with_run(_results(spark, sf_dir)), 1)
    return report.pivot_dists(rows, DISTS)


@REGISTRY.query(f"""WITH {RUNS}, planned AS (SELECT base, count(DISTINCT k) * count(DISTINCT dist) AS planned FROM res GROUP BY base)
  SELECT base, classifier, count(*) AS runs, planned, CASE WHEN count(*) = planned THEN 'always' ELSE 'sometimes' END AS status
  FROM res JOIN planned USING (base) WHERE n = 1 GROUP BY base, classifier, planned""")
def classifier_coverage(spark, sf_dir):
    return report.classifier_coverage(report.with_run(_results(spark, sf_dir)), 1)


@REGISTRY.query(f"""WITH {RUNS}, planned AS (SELECT base, count(DISTINCT k) * count(DISTINCT dist) AS planned FROM res GROUP BY base),
  known AS (SELECT unnest(['linear-svm', 'lda', 'qda', 'sgd', 'random-forest', 'adaboost', 'cubic-svm']) AS classifier),
  ran AS (SELECT base, classifier, count(*) AS runs FROM res WHERE n = 2 GROUP BY ALL)
  SELECT p.base, k.classifier, CASE WHEN runs IS NULL THEN 'never' WHEN runs = planned THEN 'always' ELSE 'sometimes' END AS status
  FROM planned p CROSS JOIN known k LEFT JOIN ran USING (base, classifier)""")
def classifier_status(spark, sf_dir):
    coverage = report.classifier_coverage(report.with_run(_results(spark, sf_dir)), 2)
    return report.classifier_status([*NAMES, "adaboost", "cubic-svm"], coverage)


@REGISTRY.query(f"""WITH {RUNS}, shown AS (SELECT * FROM res SEMI JOIN (SELECT base FROM classes WHERE n_classes > 1) USING (base)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY accuracy DESC, k, dist, classifier) AS r FROM shown WHERE n = 1) WHERE r = 1)
  SELECT 'best' AS part, base, run AS a, classifier AS b, round(accuracy, 9) AS v FROM best
  UNION ALL SELECT 'classes', base, "group", NULL, n FROM sizes SEMI JOIN best USING (base)
  UNION ALL SELECT 'confusion', b.base, concat(b.classifier, '/', m.n_chars % 3), CAST(m.n_chars % 2 AS VARCHAR), count(*) FROM best b
    JOIN marks m ON m.run = b.run AND m.dist = b.dist AND m.classifier = b.classifier GROUP BY ALL""")
def experiment_report(spark, sf_dir):
    confusion = _marks(spark, sf_dir).groupBy(
        "run", "dist", "classifier", (F.col("n_chars") % 3).cast("string").alias("actual"), (F.col("n_chars") % 2).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    made = report.experiment_report(_results(spark, sf_dir), confusion, _class_sizes(spark, sf_dir), 1, NAMES)
    parts = [
        made["best"].select(F.lit("best").alias("part"), "base", F.col("run").alias("a"), F.col("classifier").alias("b"), F.round("accuracy", 9).alias("v")),
        made["classes"].select(F.lit("classes").alias("part"), "base", F.col("group").alias("a"), F.lit(None).cast("string").alias("b"), F.col("n").cast("double").alias("v")),
        made["confusion"].select(F.lit("confusion").alias("part"), "base", F.concat("classifier", F.lit("/"), "actual").alias("a"), F.col("predicted").alias("b"), F.col("n").cast("double").alias("v")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@REGISTRY.query(f"""WITH {RUNS}, {BEST.format(n=1)} SELECT base AS experiment, round(accuracy * 100, 7) AS best_accuracy,
  concat('k=', k, ', ', dist, ', ', classifier) AS run_info FROM best SEMI JOIN (SELECT base FROM classes WHERE n_classes > 1) USING (base)""")
def experiment_summary(spark, sf_dir):
    made = report.summary(_results(spark, sf_dir), _class_counts(spark, sf_dir), 1)
    return made.withColumn("best_accuracy", F.round("best_accuracy", 7))


@REGISTRY.query(f"WITH {counts_sql(2, 3)} SELECT sample_id, kmer, n FROM counts WHERE k = 2")
def feature_table_round_trip(spark, sf_dir):
    path = scratch(spark, "features")
    tables.write_features(K.kmer_counts(sequences(spark, sf_dir), [2, 3]), path)
    return tables.read_features(spark, path, k=2).select("sample_id", "kmer", "n")


@REGISTRY.query(f"""WITH {counts_sql(2)}, sizes AS (SELECT s.sample_id, coalesce(sum(c.n), 0) AS total FROM seqs s LEFT JOIN counts c USING (sample_id) GROUP BY s.sample_id),
  met AS (SELECT x.sample_id AS a, y.sample_id AS b, sum(least(x.n, y.n)) AS low FROM counts x JOIN counts y ON x.kmer = y.kmer AND x.sample_id < y.sample_id GROUP BY ALL)
  SELECT x.sample_id AS a, count(*) AS n, sum(x.total + y.total - 2 * coalesce(low, 0))::BIGINT AS total
  FROM sizes x JOIN sizes y ON x.sample_id < y.sample_id LEFT JOIN met ON met.a = x.sample_id AND met.b = y.sample_id GROUP BY x.sample_id""")
def distance_table_round_trip(spark, sf_dir):
    path = scratch(spark, "distances")
    pairs = D.distances(K.kmer_counts(sequences(spark, sf_dir), 2), ["manhat", "info"], samples(spark, sf_dir), width=16)
    tables.write_distances(pairs, path)
    back = tables.read_distances(spark, path, "manhat")
    return back.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("d").cast("bigint").alias("total"))


@REGISTRY.query(f"""WITH {SEQ} SELECT concat(source, '-', sample_id) AS header, seq,
  row_number() OVER (PARTITION BY source ORDER BY sample_id) AS record_no FROM seqs WHERE seq <> ''""")
def fasta_export(spark, sf_dir):
    """One file per source, read back as FASTA; a header without a sequence is no record."""
    path = scratch(spark, "fasta")
    rows = sequences(spark, sf_dir).select(
        F.col("source").alias("sample_id"), F.col("sample_id").alias("record_no"), F.concat("source", F.lit("-"), "sample_id").alias("header"), "seq"
    )
    fasta.write_fasta(rows, path)
    back = fasta.read_fasta(spark, f"{path}/*", with_headers=True)
    return back.select(F.ltrim("header", F.lit(">")).alias("header"), "seq", F.col("record_no").cast("bigint").alias("record_no"))


@REGISTRY.query("SELECT concat('e', doc_id) AS id, lang AS subtype, row_number() OVER (ORDER BY doc_id) - 1 AS entry_no FROM documents")
def metadata_scan(spark, sf_dir):
    """Entries in several files of JSON lines, numbered in the order of the files."""
    path = scratch(spark, "metadata")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("e"), "doc_id").alias("id"), F.col("lang").alias("subtype"), "doc_id")
    rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.json(path)
    return read_metadata(spark, path, "id string, subtype string", lines=True)


@REGISTRY.query(f"WITH {RUNS} SELECT run, dist, classifier, CAST(n AS INTEGER) AS n, round(accuracy, 9) AS accuracy FROM res")
def json_round_trip(spark, sf_dir):
    path = scratch(spark, "json")
    tables.write_json(_results(spark, sf_dir).select("run", "dist", "classifier", "n", "accuracy"), path)
    return _rounded(spark.read.schema("run string, dist string, classifier string, n int, accuracy double").json(path))


@REGISTRY.query(f"WITH {RUNS} SELECT run, dist, classifier, CAST(n AS INTEGER) AS n, round(accuracy, 9) AS accuracy FROM res WHERE k = 2")
def result_files_round_trip(spark, sf_dir):
    path = scratch(spark, "results")
    rows = _results(spark, sf_dir).where("run like '%-k=2'").persist()
    empty = rows.limit(0)
    for run in [r[0] for r in rows.select("run").distinct().collect()]:
        for dist in DISTS:
            part = rows.where((F.col("run") == run) & (F.col("dist") == dist)).select("classifier", "n", "accuracy")
            bundle = SimpleNamespace(topn=part, confusion=empty, misclassified=empty, timing=empty)
            results.write_results(bundle, f"{path}/{run}", dist)
    rows.unpersist()
    return _rounded(results.read_results(spark, path))


@REGISTRY.query("SELECT doc_id AS sample_id, true AS same_ranking, true AS sums_to_one FROM documents")
def saved_model_predictions(spark, sf_dir):
    """A saved classifier predicts what the one in memory does, on features made from its own options."""
    rows, seqs = samples(spark, sf_dir), sequences(spark, sf_dir).select("sample_id", "seq")
    vectors = kmer_vectors(seqs, rows, 3, "frequencies")
    fitted = fit_final(vectors, rows, "multilayer-perceptron", Options(), generation={"mode": "frequencies", "k": 3})
    path = scratch(spark, "model")
    models.save_model(fitted, path, spark)

    def ranking(model):
        ranked = predict_sequences(model, seqs, rows)
        order = F.array_sort(F.collect_list(F.struct("rank", "cls")))
        return ranked.groupBy("sample_id").agg(order.alias("r"), F.sum("prob").alias("p"))

    here = ranking(fitted)
    there = ranking(models.load_model(spark, path)).select("sample_id", F.col("r").alias("r2"))
    return here.join(there, "sample_id").select(
        "sample_id", (F.col("r") == F.col("r2")).alias("same_ranking"), (F.abs(F.col("p") - 1) < 1e-9).alias("sums_to_one")
    )


@REGISTRY.query(f"WITH {SEQ} SELECT sample_id, seq FROM seqs WHERE sample_id % 2 = 0 AND seq <> ''")
def archive_scan(spark, sf_dir):
    """Documents packed into zip archives, of which every second member is wanted."""
    folder = scratch(spark, "archives")
    docs = sequences(spark, sf_dir).select(
        F.format_string("whole/%s.fasta", "sample_id").alias("member"),
        F.format_string(">%s\n%s\n", "sample_id", "seq").alias("content"), "sample_id",
    )
    archives.write_archives(docs, folder)
    listing = archives.read_archive(spark, folder, pattern="part-*").select("archive", "member")
    number = F.regexp_extract("member", "/(-?[0-9]+)[.]", 1).try_cast("bigint")  # a null id has no number
    wanted = listing.where(number % 2 == 0)
    rows = fasta.parse_fasta(archives.read_archive(spark, folder, wanted, pattern="part-*"), "content")
    return rows.where("seq <> ''").select(number.alias("sample_id"), "seq")
