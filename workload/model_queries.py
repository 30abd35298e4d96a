"""Models whose answers SQL can give: rank-limited decompositions, closed forms, separated classes, predictions of files."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sigloom.operators.classifiers import CLASSIFIER_NAMES, MOMENT_MODELS, Options, fit_classifier
from sigloom.operators.transforms import TruncatedSVD, explained_variance_ratio
from sigloom.operators.vectors import sparse_vector
from sigloom.plans.evaluate import cross_validate, fit_final
from sigloom.plans.predict import kmer_vectors, predict
from sigloom.sources.fasta import write_fasta
from sigloom.sources.models import save_model
from workload.base import POINTS, Query, Registry, points, samples, scratch, sequences, table
from workload.learning_queries import CENTROIDS, PLAIN, _kmer_points_sql

REGISTRY = Registry()
WIDE, COPIES, STRIDE = 1 << 20, 16, 16_001

LETTERS = """letters AS (SELECT doc_id, lang, length(seq) AS size, unnest([1, 2, 3, 4]) AS l, unnest([length(seq) - length(replace(seq, 'A', '')),
    length(seq) - length(replace(seq, 'C', '')), length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))]) AS n
  FROM (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents))"""


def _letter_counts(spark, sf_dir):
    counted = [(F.length("seq") - F.length(F.replace("seq", F.lit(x), F.lit("")))).cast("double") for x in "ACGT"]
    return sequences(spark, sf_dir).select("sample_id", F.col("lang").alias("group"), F.length("seq").alias("size"), F.array(*counted).alias("n"))


@REGISTRY.query(f"""WITH {LETTERS} SELECT doc_id AS sample_id, round(sqrt(sum(n * n * c.s)), 4) AS length, 1.0 AS ratio
  FROM letters, (SELECT sum(pow(1 + i, 2)) AS s FROM range({COPIES}) t(i)) c GROUP BY doc_id""")
def svd_of_wide_rows(spark, sf_dir):
    """Rows of a million features whose rank is four: the axes, a table, keep every length and all variance."""
    rows = _letter_counts(spark, sf_dir)
    places = F.array(*[F.lit(i * STRIDE) for i in range(4 * COPIES)])
    values = F.flatten(F.transform("n", lambda n: F.array(*[n * (1 + c) for c in range(COPIES)])))
    wide = rows.select("sample_id", sparse_vector(places, values, WIDE).alias("features"))
    model = TruncatedSVD(inputCol="features", outputCol="reduced", components=6).fit(wide)
    out = model.transform(wide)
    ratio = explained_variance_ratio(out, "features", "reduced")
    squares = F.aggregate(vector_to_array("reduced"), F.lit(0.0), lambda a, x: a + x * x)
    return out.select("sample_id", F.round(F.sqrt(squares), 4).alias("length"), F.lit(round(ratio, 7)).alias("ratio"))


SCALED = f"""raw AS (WITH {POINTS} SELECT * FROM pts),
  sd AS (SELECT j, stddev_pop(x) AS s FROM raw GROUP BY j),
  pts AS (SELECT sample_id, "group", j, x / CASE WHEN s > 0 THEN s ELSE 1 END AS x FROM raw JOIN sd USING (j))"""


@REGISTRY.query("WITH " + CENTROIDS.format(ctes=SCALED, stat="avg", dist="sqrt(sum(pow(x - c, 2)))"))
def normalised_centroids(spark, sf_dir):
    """The whole preparation, with every dimension kept: scaling changes distances, the rotation does not."""
    rows = points(spark, sf_dir).select("sample_id", array_to_vector("values").alias("features"), "group").persist()
    fitted = fit_classifier("nearest-centroid-mean", rows, 64, 64, Options(dim_reduce_fraction=1.0))
    return fitted.scores(rows.select("sample_id", "features")).select("sample_id", "cls")


TWO = f"""{LETTERS}, xs AS (SELECT doc_id AS sample_id, lang AS "group", max(n / greatest(size, 1)) FILTER (l = 1) AS x,
    max(n / greatest(size, 1)) FILTER (l = 2) AS y FROM letters GROUP BY ALL),
  cls AS (SELECT "group" AS cls, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy,
    var_pop(y) * count(*) AS yy FROM xs GROUP BY ALL), total AS (SELECT sum(n) AS n, count(*) AS k, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM cls)"""
POSTERIOR = """SELECT sample_id, cls, round(exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY sample_id), 6) AS prob
  FROM (SELECT *, max(s) OVER (PARTITION BY sample_id) AS top FROM scores)"""


def _two_shares(spark, sf_dir, name):
    rows = _letter_counts(spark, sf_dir)
    shares = F.array(*[F.col("n")[i] / F.greatest(F.col("size"), F.lit(1)) for i in range(2)])
    vectors = rows.select("sample_id", "group", array_to_vector(shares).alias("features")).persist()
    found = fit_classifier(name, vectors, 2, 2, PLAIN).scores(vectors.select("sample_id", "features"))
    return found.withColumn("prob", F.round("prob", 6))


@REGISTRY.query(f"""WITH {TWO}, inv AS (SELECT n, yy / d AS a, -xy / d AS b, xx / d AS c FROM (SELECT n, xx / (n - k) AS xx, xy / (n - k) AS xy, yy / (n - k) AS yy,
    (xx * yy - xy * xy) / ((n - k) * (n - k)) AS d FROM total)),
  scores AS (SELECT sample_id, cls, ln(c.n / i.n) + (a * mx + b * my) * (x - mx / 2) + (b * mx + i.c * my) * (y - my / 2) AS s FROM xs, cls c, inv i)
  {POSTERIOR}""")
def lda_closed_form(spark, sf_dir):
    return _two_shares(spark, sf_dir, "lda")


@REGISTRY.query(f"""WITH {TWO}, one AS (SELECT *, xx / (n - 1) AS p, xy / (n - 1) AS q, yy / (n - 1) AS r FROM cls),
  scores AS (SELECT sample_id, cls, ln(o.n / t.n) - 0.5 * ln(p * r - q * q) - 0.5 * (r * pow(x - mx, 2) - 2 * q * (x - mx) * (y - my) + p * pow(y - my, 2)) / (p * r - q * q) AS s
    FROM xs, one o, total t) {POSTERIOR}""")
def qda_closed_form(spark, sf_dir):
    return _two_shares(spark, sf_dir, "qda")


def _separated(spark, sf_dir):
    """Documents with a wide margin between their languages, besides the share of a letter."""
    names = sorted(r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().collect())
    rows = _letter_counts(spark, sf_dir)
    marks = [F.when(F.col("group") == n, 10.0).otherwise(0.0) for n in names]
    share = F.col("n")[0] / F.greatest(F.col("size"), F.lit(1))
    return rows.select("sample_id", "group", array_to_vector(F.array(*marks, share)).alias("features"))


def _held_out(name):
    def run(spark, sf_dir):
        rows = _separated(spark, sf_dir).persist()
        if name == "adaboost":  # trees of one split tell two classes apart, more only where each has a split of its own
            rows = rows.withColumn("group", F.when(F.col("group") == "en", "en").otherwise("other"))
        result = cross_validate(rows.select("sample_id", "features"), rows.select("sample_id", "group"), name, 2, seed=5, options=PLAIN)
        return result.outcomes.select("sample_id", "fold", F.col("predicted").alias("cls"))

    return run


HELD_OUT = """SELECT sample_id, lang AS cls, CAST(CASE WHEN r < (n + 1) // 2 THEN 0 ELSE 1 END AS INTEGER) AS fold FROM (SELECT doc_id AS sample_id, lang,
  row_number() OVER (ORDER BY md5(concat('5:', doc_id))) - 1 AS r, count(*) OVER () AS n FROM documents)"""

for _name in CLASSIFIER_NAMES:
    if _name not in MOMENT_MODELS:
        _sql = HELD_OUT.replace("lang AS cls", "CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS cls") if _name == "adaboost" else HELD_OUT
        REGISTRY.append(Query("held_out_" + _name.replace("-", "_"), _held_out(_name), _sql))


@REGISTRY.query("SELECT doc_id AS sample_id, lang AS cls FROM documents")
def final_fit_of_network(spark, sf_dir):
    """The final fit on all samples, as it is saved."""
    rows = _separated(spark, sf_dir).persist()
    fitted = fit_final(rows.select("sample_id", "features"), rows.select("sample_id", "group"), "multilayer-perceptron", PLAIN)
    best = F.max_by("cls", "prob").alias("cls")
    return fitted.scores(rows.select("sample_id", "features")).groupBy("sample_id").agg(best)


@REGISTRY.query("WITH " + CENTROIDS.format(ctes=_kmer_points_sql(2, "c.n / t.total"), stat="avg", dist="sqrt(sum(pow(x - c, 2)))").replace(
    "SELECT sample_id, cls FROM (SELECT *", "SELECT CAST(sample_id AS VARCHAR) AS file, cls FROM (SELECT *"))
def predicted_files(spark, sf_dir):
    """A saved model applied to a folder of FASTA files: every document is exported, read back and classified."""
    records = sequences(spark, sf_dir).select("sample_id", "lang", "seq").persist()
    vectors = kmer_vectors(records, records, 2, "frequencies")
    generation = {"mode": "frequencies", "k": 2}
    fitted = fit_final(vectors, samples(spark, sf_dir), "nearest-centroid-mean", PLAIN, generation=generation)
    folder = scratch(spark, "prediction")
    save_model(fitted, f"{folder}/model", spark)
    write_fasta(records.select("sample_id", "seq"), f"{folder}/files")
    return predict(spark, f"{folder}/model", f"{folder}/files/*", by_folder=True).where("rank = 1").select("file", "cls")
