"""Folds, rankings, accuracies, confusion, scaling and plot tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigloom.functions import naming
from sigloom.operators import distances as D
from sigloom.operators import embedding as E
from sigloom.operators import folds, ranking
from sigloom.operators.kmers import kmer_counts
from workload.base import POINTS, Registry, counts_sql, points, samples, sequences, table

REGISTRY = Registry()

FOLDS = """ranked_ids AS (SELECT doc_id AS sample_id, lang, row_number() OVER (ORDER BY md5(concat('7:', doc_id))) - 1 AS r,
    count(*) OVER () AS n FROM documents),
  folds AS (SELECT sample_id, lang, CAST(CASE WHEN r < (n % 6) * (n // 6 + 1) THEN r // (n // 6 + 1)
    ELSE n % 6 + (r - (n % 6) * (n // 6 + 1)) // (n // 6) END AS INTEGER) AS fold FROM ranked_ids)"""

SCORES = f"""{FOLDS}, langs AS (SELECT DISTINCT lang AS cls FROM documents),
  scores AS (SELECT d.doc_id AS sample_id, cls, ((d.doc_id * (ascii(cls[2]) % 11 + 1) + d.n_chars) % 5) / 5.0 AS prob
    FROM documents d, langs),
  ranked AS (SELECT fold, s.sample_id, lang AS actual, cls, prob,
    row_number() OVER (PARTITION BY s.sample_id ORDER BY prob DESC, cls DESC) AS rank FROM scores s JOIN folds USING (sample_id)),
  outcome AS (SELECT fold, sample_id, actual, max(CASE WHEN rank = 1 THEN cls END) AS predicted,
    min(CASE WHEN cls = actual THEN rank END) AS true_rank FROM ranked GROUP BY ALL)"""


def _scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    langs = F.array_sort(F.collect_set("lang"))
    names = docs.agg(langs).scalar()
    rows = docs.withColumn("_names", names).select("doc_id", "n_chars", F.explode("_names").alias("cls"))
    mixed = F.col("doc_id") * (F.ascii(F.substring("cls", 2, 1)) % 11 + 1) + F.col("n_chars")
    return rows.select(F.col("doc_id").alias("sample_id"), "cls", ((mixed % 5) / 5.0).alias("prob"))


def _ranked(spark, sf_dir):
    folded = folds.assign_folds(samples(spark, sf_dir), 6, seed=7)
    actual = folded.select("sample_id", "fold", F.col("group").alias("actual"))
    return ranking.rank_eval(_scores(spark, sf_dir)).join(actual, "sample_id")


def _outcomes(spark, sf_dir):
    return ranking.outcomes(_ranked(spark, sf_dir))


@REGISTRY.query(f"WITH {FOLDS} SELECT sample_id, fold FROM folds")
def fold_split(spark, sf_dir):
    return folds.assign_folds(samples(spark, sf_dir), 6, seed=7).select("sample_id", "fold")


@REGISTRY.query("""WITH vals AS (SELECT source, row_number() OVER (ORDER BY md5(concat('7:', source))) - 1 AS r,
    count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
  SELECT doc_id AS sample_id, source, CAST(CASE WHEN r < (n % 6) * (n // 6 + 1) THEN r // (n // 6 + 1)
    ELSE n % 6 + (r - (n % 6) * (n // 6 + 1)) // (n // 6) END AS INTEGER) AS fold FROM documents JOIN vals USING (source)""")
def fold_split_by_source(spark, sf_dir):
    return folds.assign_folds(samples(spark, sf_dir), 6, seed=7, split_by="source").select("sample_id", "source", "fold")


@REGISTRY.query(f"""WITH {FOLDS} SELECT f.fold AS held_out, t.lang AS "group", count(*) AS n FROM folds t
  JOIN (SELECT DISTINCT fold FROM folds) f ON t.fold <> f.fold GROUP BY ALL""")
def training_sides(spark, sf_dir):
    folded = folds.assign_folds(samples(spark, sf_dir), 6, seed=7)
    parts = [
        folds.train_split(folded, f).groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("held_out", F.lit(f))
        for f in range(6)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@REGISTRY.query(f"WITH {SCORES} SELECT sample_id, cls, rank FROM ranked")
def rank_for_evaluation(spark, sf_dir):
    return ranking.rank_eval(_scores(spark, sf_dir)).select("sample_id", "cls", "rank")


@REGISTRY.query(f"WITH {SCORES} SELECT sample_id, cls, row_number() OVER (PARTITION BY sample_id ORDER BY prob DESC, cls) AS rank FROM scores")
def rank_for_prediction(spark, sf_dir):
    return ranking.rank_predict(_scores(spark, sf_dir)).select("sample_id", "cls", "rank")


@REGISTRY.query(f"""WITH {SCORES}, best AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY prob DESC, cls) AS r FROM scores)
  SELECT sample_id, concat('doc-', sample_id, '.fasta') AS file, cls, printf('%s (%.1f%%)', cls, prob * 100.0) AS label FROM best WHERE r = 1""")
def top1_predictions(spark, sf_dir):
    files = samples(spark, sf_dir).select("sample_id", F.concat(F.lit("doc-"), "sample_id", F.lit(".fasta")).alias("file"))
    named = ranking.name_predictions(ranking.rank_predict(_scores(spark, sf_dir)), files)
    return ranking.top1(named).select("sample_id", "file", "cls", "label")


@REGISTRY.query(f"WITH {SCORES} SELECT fold, sample_id, CAST(n AS INTEGER) AS n, coalesce(true_rank <= n, false) AS hit FROM outcome, generate_series(1, 3) t(n)")
def topn_hits(spark, sf_dir):
    return ranking.topn_hits(_outcomes(spark, sf_dir))


TOPN = """per_fold AS (SELECT fold, n, count(*) AS points, count(*) FILTER (true_rank > n) AS misses,
  1 - count(*) FILTER (true_rank > n) / count(*) AS accuracy FROM outcome, generate_series(1, 3) t(n) GROUP BY ALL)"""


@REGISTRY.query(f"WITH {SCORES}, {TOPN} SELECT fold, n, points, misses, round(accuracy, 9) AS accuracy FROM per_fold")
def topn_accuracy_per_fold(spark, sf_dir):
    return ranking.topn_accuracy(_outcomes(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@REGISTRY.query(f"WITH {SCORES}, {TOPN} SELECT n, round(sum(accuracy) / 6, 9) AS accuracy FROM per_fold GROUP BY n")
def cv_accuracy(spark, sf_dir):
    acc = ranking.cv_accuracy(ranking.topn_accuracy(_outcomes(spark, sf_dir)), 6)
    return acc.withColumn("accuracy", F.round("accuracy", 9))


@REGISTRY.query(f"WITH {SCORES} SELECT n, sample_id FROM outcome, generate_series(1, 3) t(n) WHERE true_rank > n")
def misclassified_samples(spark, sf_dir):
    return ranking.misclassified(_outcomes(spark, sf_dir))


@REGISTRY.query(f"WITH {SCORES} SELECT DISTINCT n, sample_id FROM outcome, generate_series(1, 3) t(n) WHERE true_rank > n")
def united_misses(spark, sf_dir):
    out = _outcomes(spark, sf_dir)
    return ranking.union_misses([ranking.misclassified(folds.test_split(out, f)) for f in range(6)])


@REGISTRY.query(f"""WITH {SCORES} SELECT a.cls AS actual, p.cls AS predicted, count(o.sample_id) AS n
  FROM langs a CROSS JOIN langs p LEFT JOIN outcome o ON o.actual = a.cls AND o.predicted = p.cls GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return ranking.confusion_matrix(_outcomes(spark, sf_dir), ranking.classes(samples(spark, sf_dir)))


@REGISTRY.query("""WITH c AS (SELECT DISTINCT source AS s FROM documents) SELECT a.s AS actual, p.s AS predicted, count(d.doc_id) AS n
  FROM c a CROSS JOIN c p LEFT JOIN documents d ON d.source = a.s AND p.s = concat('src', d.n_chars % 40) GROUP BY ALL""")
def confusion_with_empty_cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.col("source").alias("actual"), F.concat(F.lit("src"), F.col("n_chars") % 40).alias("predicted"))
    names = docs.select(F.col("source").alias("group")).distinct()
    return ranking.confusion_grid(names, counts.agg(F.count(F.lit(1)).alias("n")))


@REGISTRY.query('SELECT lang AS "group", count(*) AS n FROM documents GROUP BY lang')
def class_sizes(spark, sf_dir):
    return ranking.class_sizes(samples(spark, sf_dir))


@REGISTRY.query('SELECT "group", CAST(row_number() OVER (ORDER BY "group") AS INTEGER) AS position FROM (SELECT DISTINCT source AS "group" FROM documents)')
def sorted_classes(spark, sf_dir):
    rows = ranking.classes(samples(spark, sf_dir, "source"))
    listed = rows.agg(F.array_sort(F.collect_list("group")).alias("_g"))
    return listed.select(F.posexplode("_g").alias("_p", "group")).select("group", (F.col("_p") + 1).alias("position"))


COORDS = """co AS (SELECT vec_id AS sample_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
  generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings),
  rng AS (SELECT axis, min(x) AS low, max(x) AS high FROM co GROUP BY axis)"""


def _coords(spark, sf_dir):
    return points(spark, sf_dir).select("sample_id", F.col("values").alias("coords"))


@REGISTRY.query(f"WITH {COORDS} SELECT CAST(axis AS INTEGER) AS axis, low, high FROM rng")
def axis_ranges(spark, sf_dir):
    return E.axis_ranges(_coords(spark, sf_dir))


@REGISTRY.query(f"""WITH {COORDS} SELECT sample_id, CAST(axis AS INTEGER) AS axis, round((x - low) * 2 / (high - low) - 1, 9) AS x
  FROM co JOIN rng USING (axis)""")
def scaled_points(spark, sf_dir):
    scaled = E.scale_points(_coords(spark, sf_dir))
    return scaled.select("sample_id", F.posexplode("coords").alias("axis", "x")).withColumn("x", F.round("x", 9))


@REGISTRY.query(f"""WITH {COORDS}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
  SELECT sample_id, round(max(CASE WHEN axis = 0 THEN (x - low) * 2 / (high - low) - 1 END), 9) AS x,
    round(max(CASE WHEN axis = 1 THEN (x - low) * 2 / (high - low) - 1 END), 9) AS y,
    CAST(label AS VARCHAR) AS "group", concat(label, ' (', sizes.n, ')') AS label, sample_id % 7 = 0 AS misclassified
  FROM co JOIN rng USING (axis) JOIN sizes USING (label) GROUP BY sample_id, co.label, sizes.label, sizes.n, label""")
def plot_rows(spark, sf_dir):
    rows = points(spark, sf_dir)
    misses = rows.where("sample_id % 7 = 0").select("sample_id")
    out = E.plot_table(E.first_dims(_coords(spark, sf_dir), 2), rows.select("sample_id", "group"), misses)
    return out.select("sample_id", F.round(F.col("coords")[0], 9).alias("x"), F.round(F.col("coords")[1], 9).alias("y"), "group", "label", "misclassified")


def _matrix(spark, sf_dir):
    rows = points(spark, sf_dir)
    cells = rows.select("sample_id", F.posexplode("values").alias("feature", "value"))
    pairs = D.distances(cells, ["manhat"], rows, feature="feature", value="value", width=64)
    return D.symmetrize(pairs, rows)


@REGISTRY.query(f"""WITH {POINTS}, m AS (SELECT x.sample_id AS a, y.sample_id AS b, pow(sum(abs(x.x - y.x)), 2) AS sq
    FROM pts x JOIN pts y ON x.j = y.j GROUP BY ALL),
  rm AS (SELECT a, avg(sq) AS mean FROM m GROUP BY a), g AS (SELECT avg(mean) AS grand FROM rm),
  bm AS (SELECT m.a, m.b, (sq - r.mean - c.mean + grand) * -0.5 AS v FROM m JOIN rm r ON r.a = m.a JOIN rm c ON c.a = m.b, g)
  SELECT a, count(*) AS n, abs(round(sum(v), 5)) AS total, round(max(v), 6) AS top, round(sum(v * v), 3) AS squares FROM bm GROUP BY a""")
def double_centering(spark, sf_dir):
    found = D.row_statistics(E.double_center(_matrix(spark, sf_dir)), ["a"], ["v"], ["total", "top", "squares"])
    return found.select(
        "a", "n", F.abs(F.round("v_total", 5)).alias("total"), F.round("v_top", 6).alias("top"), F.round("v_squares", 3).alias("squares")
    )


@REGISTRY.query("SELECT doc_id AS sample_id, 1 AS axes, round(abs(n_chars / 1000.0 - (SELECT avg(n_chars / 1000.0) FROM documents)), 4) AS x FROM documents")
def mds_of_a_line(spark, sf_dir):
    """Distances between points on a line have one exact axis, known up to its sign."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("n_chars") / 1000.0).alias("value"))
    pairs = D.distances(docs.withColumn("feature", F.lit(0)), ["manhat"], docs, feature="feature", value="value", width=1)
    found = E.mds(D.symmetrize(pairs, docs), docs, 3)
    return found.select("sample_id", F.size("coords").alias("axes"), F.round(F.abs(F.col("coords")[0]), 4).alias("x"))


@REGISTRY.query(f"""WITH {counts_sql(3)}, sets AS (SELECT kmer, count(*) AS c FROM counts GROUP BY kmer),
  ids AS (SELECT doc_id AS sample_id FROM documents), total AS (SELECT count(*) AS docs FROM ids),
  spread AS (SELECT i.sample_id, (SELECT sum(c) FROM sets) + coalesce(sum(docs - 2 * s.c), 0) AS apart
    FROM ids i CROSS JOIN total LEFT JOIN counts USING (sample_id) LEFT JOIN sets s USING (kmer) GROUP BY i.sample_id),
  steps AS (SELECT sample_id, sum(CASE WHEN times = 1 THEN 1 ELSE 0 END) AS d FROM (
    SELECT sample_id, kmer, count(*) AS times FROM (SELECT sample_id, kmer FROM counts WHERE sample_id + 1 IN (SELECT sample_id FROM ids)
      UNION ALL SELECT sample_id - 1, kmer FROM counts WHERE sample_id - 1 IN (SELECT sample_id FROM ids)) GROUP BY ALL) GROUP BY sample_id)
  SELECT sample_id, round(apart / docs - (SELECT sum(apart) FROM spread) / (2.0 * docs * docs), 4) AS square,
    CASE WHEN sample_id + 1 IN (SELECT sample_id FROM ids) THEN round(coalesce(d, 0)::DOUBLE, 4) END AS step
  FROM spread CROSS JOIN total LEFT JOIN steps USING (sample_id)""")
def mds_of_kmer_sets(spark, sf_dir):
    """Roots of the sizes by which 3-mer sets differ are Euclidean: 64 axes give back every distance to the centre and to the next document."""
    docs = samples(spark, sf_dir)
    counts = kmer_counts(sequences(spark, sf_dir), [3])
    sizes = D.set_sizes(counts, docs, width=4**3)
    root = F.sqrt(F.col("n_either") - F.col("n_common"))
    pairs = D.measured(sizes, root, lambda v: np.sqrt(v["n_either"] - v["n_common"]), "root")
    found = E.mds(D.symmetrize(pairs, docs), docs, 64)
    square = F.aggregate("coords", F.lit(0.0), lambda s, x: s + x * x)
    after = found.select((F.col("sample_id") - 1).alias("sample_id"), F.col("coords").alias("other"))
    step = F.aggregate(F.zip_with("coords", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    # adding zero turns -0.0 into 0.0
    return found.join(after, "sample_id", "left").select("sample_id", (F.round(square, 4) + 0.0).alias("square"), (F.round(step, 4) + 0.0).alias("step"))


@REGISTRY.query()
def mds_points(spark, sf_dir):
    rows = points(spark, sf_dir).select("sample_id")
    return E.mds(_matrix(spark, sf_dir), rows, 10)
