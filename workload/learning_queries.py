"""Feature transforms, classifiers and cross-validation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sigloom.operators import centroids, kmers, ranking
from sigloom.operators.classifiers import CLASSIFIER_NAMES, Options, fit_classifier
from sigloom.operators.transforms import TruncatedSVD, UnitVarianceScaler, explained_variance_ratio
from sigloom.operators.vectors import to_vectors
from sigloom.operators.selection import groups_by_value
from sigloom.plans.evaluate import cross_validate, evaluate, fit_final
from sigloom.plans.job import Experiment, Job, run_job
from sigloom.sources.results import read_results
from workload.base import POINTS, Query, Registry, counts_sql, points, samples, scratch, sequences, table

REGISTRY = Registry()

PLAIN = Options(skip_normalization=True)
DEFAULT = Options()


def _points(spark, sf_dir):
    return points(spark, sf_dir).select("sample_id", array_to_vector("values").alias("features"), "group")


def _counts(spark, sf_dir, k):
    return kmers.kmer_counts(sequences(spark, sf_dir), k)


def _kmer_vectors(spark, sf_dir, k, frequencies=False):
    counts = _counts(spark, sf_dir, k)
    made = kmers.kmer_frequencies(counts) if frequencies else counts
    rows = samples(spark, sf_dir)
    return to_vectors(made, rows, k, "freq" if frequencies else "n").join(rows, "sample_id")


def _code(expr, k):
    return f"list_sum(list_transform(generate_series(1, {k}), lambda i: (strpos('ACGT', substr({expr}, i, 1)) - 1) * pow(4, {k} - i)))"


@REGISTRY.query(f"""WITH {counts_sql(3)}, total AS (SELECT count(*) AS big FROM documents),
  spread AS (SELECT kmer, sqrt(sum(n * n) / max(big) - pow(sum(n) / max(big), 2)) AS sd FROM counts, total GROUP BY kmer)
  SELECT sample_id, CAST({_code('kmer', 3)} AS INTEGER) AS feature, round(n / CASE WHEN sd > 0 THEN sd ELSE 1 END, 7) AS value
  FROM counts JOIN spread USING (kmer)""")
def unit_variance_scaling(spark, sf_dir):
    rows = _kmer_vectors(spark, sf_dir, 3)
    scaled = UnitVarianceScaler(inputCol="features", outputCol="scaled").fit(rows).transform(rows)
    cells = centroids.vector_cells(scaled, "sample_id", "scaled")
    return cells.select(F.col("label").alias("sample_id"), "feature", F.round("value", 7).alias("value"))


@REGISTRY.query(f"WITH {POINTS} SELECT sample_id, round(sqrt(sum(x * x)), 7) AS length, 1.0 AS ratio FROM pts GROUP BY sample_id")
def svd_keeps_lengths(spark, sf_dir):
    """With every dimension kept the projection is a rotation: row lengths and variance stay."""
    rows = _points(spark, sf_dir)
    model = TruncatedSVD(inputCol="features", outputCol="reduced", components=64).fit(rows)
    out = model.transform(rows)
    ratio = explained_variance_ratio(out, "features", "reduced")
    squares = F.aggregate(vector_to_array("reduced"), F.lit(0.0), lambda a, x: a + x * x)
    return out.select("sample_id", F.round(F.sqrt(squares), 7).alias("length"), F.lit(round(ratio, 7)).alias("ratio"))


@REGISTRY.query()
def truncated_svd(spark, sf_dir):
    rows = _kmer_vectors(spark, sf_dir, 4)
    scaled = UnitVarianceScaler(inputCol="features", outputCol="scaled").fit(rows).transform(rows)
    model = TruncatedSVD(inputCol="scaled", outputCol="reduced", components=10).fit(scaled)
    return model.transform(scaled).select("sample_id", vector_to_array("reduced").alias("reduced"))


@REGISTRY.query(f"""WITH {counts_sql(2)}, sizes AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
  feats AS (SELECT DISTINCT lang, kmer FROM counts JOIN seqs USING (sample_id)),
  cells AS (SELECT f.lang, f.kmer, coalesce(c.n, 0) AS n FROM feats f JOIN seqs s ON s.lang = f.lang
    LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.kmer = f.kmer)
  SELECT lang AS "group", kmer AS feature, round(avg(n), 7) AS mean, CAST(median(n) AS DOUBLE) AS median, round(var_pop(n), 5) AS variance,
    round(max(size) / (SELECT count(*) FROM documents), 9) AS prior
  FROM cells JOIN sizes USING (lang) GROUP BY lang, kmer""")
def class_statistics(spark, sf_dir):
    stats = centroids.class_stats(_counts(spark, sf_dir, 2), samples(spark, sf_dir))
    return stats.withColumns(
        {"mean": F.round("mean", 7), "variance": F.round("variance", 5), "prior": F.round("prior", 9)}
    )


CENTROIDS = """{ctes},
  cents AS (SELECT "group" AS cls, j, {stat}(x) AS c FROM pts GROUP BY ALL),
  d AS (SELECT sample_id, cls, round({dist}, 9) AS d FROM pts JOIN cents USING (j) GROUP BY ALL)
  SELECT sample_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, cls) AS r FROM d) WHERE r = 1"""


def _kmer_points_sql(k, value):
    """CTE ``pts(sample_id, group, j, x)``: the dense k-mer matrix of the documents."""
    return f"""{counts_sql(k)}, words AS (SELECT DISTINCT kmer AS j FROM counts),
  totals AS (SELECT sample_id, sum(n) AS total FROM counts GROUP BY sample_id),
  pts AS (SELECT s.sample_id, s.lang AS "group", w.j, coalesce({value}, 0.0) AS x FROM seqs s CROSS JOIN words w
    LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.kmer = w.j LEFT JOIN totals t ON t.sample_id = s.sample_id)"""


def _fitted_scores(rows, name, width):
    rows = rows.persist()
    fitted = fit_classifier(name, rows, width, avg_nonzero=width, options=PLAIN)
    return fitted.scores(rows.select("sample_id", "features"))


@REGISTRY.query("WITH " + CENTROIDS.format(ctes=_kmer_points_sql(3, "c.n / t.total"), stat="avg", dist="sqrt(sum(pow(x - c, 2)))"))
def nearest_centroid_mean(spark, sf_dir):
    rows = _kmer_vectors(spark, sf_dir, 3, frequencies=True)
    return _fitted_scores(rows, "nearest-centroid-mean", 64).select("sample_id", "cls")


@REGISTRY.query("WITH " + CENTROIDS.format(ctes=_kmer_points_sql(3, "CAST(c.n AS DOUBLE)"), stat="median", dist="sum(abs(x - c))"))
def nearest_centroid_median(spark, sf_dir):
    return _fitted_scores(_kmer_vectors(spark, sf_dir, 3), "nearest-centroid-median", 64).select("sample_id", "cls")


@REGISTRY.query(f"""WITH {POINTS},
  d AS (SELECT x.sample_id, y.sample_id AS other, max(y."group") AS cls, round(sqrt(sum(pow(x.x - y.x, 2))), 9) AS d
    FROM pts x JOIN pts y USING (j) GROUP BY x.sample_id, y.sample_id),
  near AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS r FROM d),
  names AS (SELECT DISTINCT "group" AS cls FROM pts), ids AS (SELECT DISTINCT sample_id FROM pts)
  SELECT i.sample_id, c.cls, count(n.r) / 10 AS prob FROM ids i CROSS JOIN names c
    LEFT JOIN near n ON n.sample_id = i.sample_id AND n.cls = c.cls AND n.r <= 10 GROUP BY i.sample_id, c.cls""")
def ten_nearest_neighbors(spark, sf_dir):
    return _fitted_scores(_points(spark, sf_dir), "10-nearest-neighbors", 64)


BAYES = """par AS (SELECT "group" AS cls, j, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM {train} GROUP BY ALL),
  eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT j, var_pop(x) AS v FROM {train} GROUP BY j)),
  tot AS (SELECT count(DISTINCT sample_id) AS n FROM {train}),
  logp AS (SELECT t.sample_id, cls, ln(max(par.n) / max(tot.n)) - 0.5 * sum(ln(2 * pi() * (v + e)) + pow(x - m, 2) / (v + e)) AS lp
    FROM {test} t JOIN par USING (j), eps, tot GROUP BY t.sample_id, cls),
  post AS (SELECT sample_id, cls, exp(lp - max(lp) OVER w) / sum(exp(lp - top)) OVER w AS prob
    FROM (SELECT *, max(lp) OVER (PARTITION BY sample_id) AS top FROM logp) WINDOW w AS (PARTITION BY sample_id))"""


@REGISTRY.query(f"WITH {POINTS}, {BAYES.format(train='pts', test='pts')} SELECT sample_id, cls, round(prob, 6) AS prob FROM post")
def gaussian_naive_bayes(spark, sf_dir):
    return _fitted_scores(_points(spark, sf_dir), "gaussian-naive-bayes", 64).withColumn("prob", F.round("prob", 6))


POINT_FOLDS = """ranked_ids AS (SELECT sample_id, "group" AS actual, row_number() OVER (ORDER BY md5(concat('11:', sample_id))) - 1 AS r,
    count(*) OVER () AS n FROM (SELECT DISTINCT sample_id, "group" FROM pts)),
  folds AS (SELECT sample_id, actual, CAST(CASE WHEN r < (n % 3) * (n // 3 + 1) THEN r // (n // 3 + 1)
    ELSE n % 3 + (r - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold FROM ranked_ids)"""

CV_CENTROID = f"""{POINT_FOLDS},
  cents AS (SELECT f.fold, p."group" AS cls, p.j, avg(p.x) AS c FROM pts p JOIN folds t USING (sample_id)
    JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> t.fold GROUP BY ALL),
  d AS (SELECT p.sample_id, t.fold, t.actual, c.cls, round(sqrt(sum(pow(p.x - c.c, 2))), 9) AS d
    FROM pts p JOIN folds t USING (sample_id) JOIN cents c ON c.fold = t.fold AND c.j = p.j GROUP BY ALL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, cls) AS r FROM d) WHERE r = 1)"""


@REGISTRY.query(f"""WITH {_kmer_points_sql(3, 'c.n / t.total')}, {CV_CENTROID},
  names AS (SELECT DISTINCT "group" AS g FROM pts)
  SELECT a.g AS actual, p.g AS predicted, count(b.sample_id) AS n FROM names a CROSS JOIN names p
  LEFT JOIN best b ON b.actual = a.g AND b.cls = p.g GROUP BY ALL""")
def cross_validated_confusion(spark, sf_dir):
    rows = _kmer_vectors(spark, sf_dir, 3, frequencies=True)
    result = cross_validate(rows.select("sample_id", "features"), samples(spark, sf_dir), "nearest-centroid-mean", 3, seed=11, options=PLAIN)
    return result.confusion.drop("classifier")


@REGISTRY.query(f"""WITH {POINTS}, {CV_CENTROID},
  nb_par AS (SELECT f.fold, p."group" AS cls, p.j, avg(p.x) AS m, var_pop(p.x) AS v, count(*) AS n FROM pts p JOIN folds t USING (sample_id)
    JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> t.fold GROUP BY ALL),
  nb_eps AS (SELECT fold, 1e-9 * max(v) AS e FROM (SELECT f.fold, p.j, var_pop(p.x) AS v FROM pts p JOIN folds t USING (sample_id)
    JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> t.fold GROUP BY ALL) GROUP BY fold),
  nb AS (SELECT p.sample_id, t.fold, t.actual, q.cls,
      ln(max(q.n)) - 0.5 * sum(ln(2 * pi() * (q.v + e)) + pow(p.x - q.m, 2) / (q.v + e)) AS lp
    FROM pts p JOIN folds t USING (sample_id) JOIN nb_par q ON q.fold = t.fold AND q.j = p.j JOIN nb_eps z ON z.fold = t.fold
    GROUP BY p.sample_id, t.fold, t.actual, q.cls),
  nb_rank AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY lp DESC, cls DESC) AS r FROM nb),
  hits AS (SELECT fold, sample_id, min(CASE WHEN cls = actual THEN r END) AS tr FROM nb_rank GROUP BY fold, sample_id)
  SELECT 'nearest-centroid-mean' AS classifier, 1 AS n, round(sum(acc) / 3, 9) AS accuracy
    FROM (SELECT fold, avg(CASE WHEN cls = actual THEN 1.0 ELSE 0.0 END) AS acc FROM best GROUP BY fold)
  UNION ALL SELECT 'gaussian-naive-bayes', CAST(n AS INTEGER), round(sum(acc) / 3, 9) FROM (SELECT fold, n, avg(CASE WHEN tr <= n THEN 1.0 ELSE 0.0 END) AS acc
    FROM hits, generate_series(1, 9) t(n) GROUP BY fold, n) GROUP BY n""")
def cross_validated_accuracy(spark, sf_dir):
    rows = _points(spark, sf_dir)
    result = evaluate(
        rows.select("sample_id", "features"), rows.select("sample_id", "group"),
        ["nearest-centroid-mean", "gaussian-naive-bayes"], 3, seed=11, options=PLAIN,
    )
    return result.topn.withColumn("accuracy", F.round("accuracy", 9))


def _evaluation(name):
    def run(spark, sf_dir):
        rows = _points(spark, sf_dir)
        result = cross_validate(
            rows.select("sample_id", "features"), rows.select("sample_id", "group"), name, 2, seed=3,
            options=Options(dim_reduce_fraction=0.2),
        )
        return result.confusion

    return run


for _name in CLASSIFIER_NAMES:
    REGISTRY.append(Query("evaluate_" + _name.replace("-", "_"), _evaluation(_name)))


@REGISTRY.query()
def evaluate_kmer_linear_svm(spark, sf_dir):
    rows = _kmer_vectors(spark, sf_dir, 4, frequencies=True)
    result = cross_validate(
        rows.select("sample_id", "features"), samples(spark, sf_dir), "linear-svm", 2, seed=3,
        split_by="source", options=DEFAULT,
    )
    return result.topn


@REGISTRY.query()
def predictions_of_final_model(spark, sf_dir):
    rows = _kmer_vectors(spark, sf_dir, 3, frequencies=True)
    fitted = fit_final(rows.select("sample_id", "features"), samples(spark, sf_dir), "multilayer-perceptron", DEFAULT)
    return ranking.rank_predict(fitted.scores(rows.select("sample_id", "features")))


@REGISTRY.query()
def cross_validation_timing(spark, sf_dir):
    rows = _points(spark, sf_dir)
    result = cross_validate(
        rows.select("sample_id", "features"), rows.select("sample_id", "group"), "multilayer-perceptron", 2, seed=3,
        options=DEFAULT,
    )
    return result.timing


@REGISTRY.query(f"""WITH {POINTS}, {POINT_FOLDS},
  d AS (SELECT x.sample_id, t.fold, t.actual, y.sample_id AS other, max(y."group") AS cls, round(sqrt(sum(pow(x.x - y.x, 2))), 9) AS d
    FROM pts x JOIN folds t ON t.sample_id = x.sample_id JOIN pts y USING (j) JOIN folds u ON u.sample_id = y.sample_id AND u.fold <> t.fold
    GROUP BY x.sample_id, t.fold, t.actual, y.sample_id),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS r FROM d) WHERE r <= 10),
  names AS (SELECT DISTINCT f.fold, u.actual AS cls FROM folds u JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> u.fold),
  votes AS (SELECT t.sample_id, t.fold, t.actual, c.cls, count(n.r) AS votes FROM folds t JOIN names c ON c.fold = t.fold
    LEFT JOIN near n ON n.sample_id = t.sample_id AND n.cls = c.cls GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, cls DESC) AS rank FROM votes),
  hits AS (SELECT fold, sample_id, min(CASE WHEN cls = actual THEN rank END) AS tr FROM ranked GROUP BY fold, sample_id)
  SELECT CAST(n AS INTEGER) AS n, round(sum(acc) / 3, 9) AS accuracy FROM (
    SELECT fold, n, avg(CASE WHEN tr <= n THEN 1.0 ELSE 0.0 END) AS acc FROM hits, generate_series(1, 9) t(n) GROUP BY fold, n) GROUP BY n""")
def cross_validated_neighbors(spark, sf_dir):
    rows = _points(spark, sf_dir)
    result = cross_validate(
        rows.select("sample_id", "features"), rows.select("sample_id", "group"), "10-nearest-neighbors", 3, seed=11, options=PLAIN
    )
    return result.topn.select("n", F.round("accuracy", 9).alias("accuracy"))


def _job_sql(k):
    return f"""SELECT 'lang-k={k}' AS run, round(sum(acc) / 3, 9) AS accuracy FROM (SELECT fold, avg(CASE WHEN cls = actual THEN 1.0 ELSE 0.0 END) AS acc FROM (
    WITH {counts_sql(k)}, words AS (SELECT DISTINCT c.kmer AS j FROM counts c),
    totals AS (SELECT sample_id, sum(n) AS total FROM counts GROUP BY sample_id),
    kept AS (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 120),
    named AS (SELECT sample_id, lang, concat(lpad(CAST(row_number() OVER (ORDER BY lang, sample_id) AS VARCHAR), 10, '0'), '.fasta') AS name
      FROM seqs SEMI JOIN kept USING (lang)),
    pts AS (SELECT m.name AS sample_id, m.lang AS "group", w.j, coalesce(c.n / t.total, 0.0) AS x FROM named m CROSS JOIN words w
      LEFT JOIN counts c ON c.sample_id = m.sample_id AND c.kmer = w.j LEFT JOIN totals t ON t.sample_id = m.sample_id),
    {CV_CENTROID} SELECT fold, actual, cls FROM best) GROUP BY fold)"""


@REGISTRY.query(f"{_job_sql(2)} UNION ALL {_job_sql(3)}")
def job_results(spark, sf_dir):
    """A whole job over the documents: selection, features for two k, distances, evaluation, stored results."""
    docs = table(spark, sf_dir, "documents")
    metadata = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("entry_no"), F.col("lang").alias("subtype"))
    archives = docs.select(
        F.lit("docs").alias("archive"), F.concat("doc_id", F.lit(".fasta")).alias("member"),
        F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.upper("text")).alias("content"),
    )
    job = Job(
        name="documents",
        experiments={
            "lang": Experiment(
                groups=lambda options, meta: groups_by_value(meta, options["selection_key"], options["min_group_pts"]),
                dataset={"archive": "docs", "metadata": "docs"},
                options={"selection_key": "subtype", "min_group_pts": 120},
                expand={"k": "2..3"},
            )
        },
        steps=[
            {"type": "kmers", "output_file": "cgrs", "mode": "frequencies", "k": "from_options"},
            {"type": "distances", "input_file": "cgrs", "output_prefix": "dists", "distances": ["info"]},
            {"type": "classify", "features_file": "cgrs", "output_file": "classification-kmers.json", "validation_count": 3,
             "classifiers": ["nearest-centroid-mean"], "skip_normalization": True, "save_model": False},
        ],
        metadata=metadata, archives=archives, pick_group="subtype", seed=11,
    )
    output = scratch(spark, "job")
    run_job(spark, job, output)
    found = read_results(spark, f"{output}/documents")
    return found.select("run", F.round("accuracy", 9).alias("accuracy"))
