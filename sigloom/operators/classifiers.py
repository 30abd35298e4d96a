"""The classifiers by name, assembled into Spark ML pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml.feature import ElementwiseProduct, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import moments
from sigloom.operators.boosting import AdaBoost
from sigloom.operators.centroids import NearestCentroid
from sigloom.operators.discriminant import LDA, QDA
from sigloom.operators.margins import FourierFeatures, OneVsRestLinear, PolynomialSketch
from sigloom.operators.models import MatrixModel
from sigloom.operators.neighbors import KNN
from sigloom.operators.transforms import TruncatedSVD, UnitVarianceScaler
from sigloom.session import dealt

NEIGHBORS = 10
TREES = 10
ROUNDS = 50
HIDDEN = 100
ALPHA = 1e-4
# every step is a pass over the training rows, so it matters when to stop
TOLERANCE = {"hinge": 1e-3, "logistic": 1e-4}
MAX_DEPTH = 30  # the deepest that Spark ML grows
BINS = 256
FOURIER_SIZE = 256
SKETCH_SIZE = 1024
#: numbers (features, or a tenth of the weights that a network's row meets) of the rows that a task shall pass over
CELLS_PER_TASK = 500_000


@dataclass(frozen=True)
class Options:
    """Training options of one evaluation.

    ``fourier_size`` and ``sketch_size`` are the numbers of features that stand for the radial and the polynomial kernels,
    ``max_depth`` and ``max_bins`` (split candidates per feature) are those of the trees.
    """

    skip_normalization: bool = False
    dim_reduce_fraction: float = 0.1
    seed: int = 0
    max_iter: int | None = None
    rounds: int = ROUNDS
    fourier_size: int = FOURIER_SIZE
    sketch_size: int = SKETCH_SIZE
    max_depth: int = MAX_DEPTH
    max_bins: int = BINS


@dataclass(frozen=True)
class Context:
    """What a classifier needs to know about its training rows."""

    n: int
    n_classes: int
    width: int
    source: str
    options: Options

    def iterations(self, default: int) -> int:
        return self.options.max_iter or default

    @property
    def common(self) -> dict:
        return {"featuresCol": self.source, "labelCol": "label"}


def _linear(ctx: Context, loss: str, penalty: float, through: Estimator | None = None) -> list:
    answer = "probability" if loss == "logistic" else "scores"
    return [
        OneVsRestLinear(
            inputCol=ctx.source, outputCol=answer, loss=loss, regParam=penalty,
            maxIter=ctx.iterations(100), tol=TOLERANCE[loss], through=through,
        )
    ]


def _svm(ctx: Context, through: Estimator | None = None) -> list:
    # a penalty of C = 1 on the summed loss is 1/n on the mean loss
    return _linear(ctx, "hinge", 1.0 / ctx.n, through)


def _logistic(ctx: Context) -> list:
    return _linear(ctx, "logistic", 1.0 / ctx.n)


def _sgd(ctx: Context) -> list:
    # mean hinge loss plus ALPHA/2 |w|^2: the objective is what defines the model, Spark ML minimises it
    return _linear(ctx, "hinge", ALPHA)


def _poly(degree: int) -> Callable[[Context], list]:
    def stages(ctx: Context) -> list:
        sketch = PolynomialSketch(
            inputCol=ctx.source, outputCol="expanded", size=ctx.options.sketch_size, degree=degree, seed=ctx.options.seed
        )
        return _svm(ctx, sketch)

    return stages


def _rbf(ctx: Context) -> list:
    waves = FourierFeatures(inputCol=ctx.source, outputCol="waves", size=ctx.options.fourier_size, seed=ctx.options.seed)
    return _svm(ctx, waves)


def _tree(ctx: Context) -> dict:
    return {"maxDepth": ctx.options.max_depth, "maxBins": ctx.options.max_bins, "seed": ctx.options.seed, **ctx.common}


def _perceptron(ctx: Context) -> list:
    layers = [ctx.width, HIDDEN, max(ctx.n_classes, 2)]
    return [
        mlc.MultilayerPerceptronClassifier(layers=layers, maxIter=ctx.iterations(200), seed=ctx.options.seed, **ctx.common)
    ]


def _tasks(name: str, n: int, width: int, n_classes: int) -> int:
    """Tasks of one pass over the training rows."""
    cells = (width + n_classes) * HIDDEN // 10 if name == "multilayer-perceptron" else width
    return -(-n * cells // CELLS_PER_TASK)


@dataclass(frozen=True)
class Recipe:
    """Stages of a classifier and the column its answer is read from."""

    stages: Callable[[Context], list]
    answer: str


RECIPES: dict[str, Recipe] = {
    "10-nearest-neighbors": Recipe(
        lambda c: [KNN(inputCol=c.source, k=NEIGHBORS, nClasses=c.n_classes)], "probability"
    ),
    "nearest-centroid-mean": Recipe(lambda c: [NearestCentroid(inputCol=c.source, statistic="mean")], "scores"),
    "nearest-centroid-median": Recipe(lambda c: [NearestCentroid(inputCol=c.source, statistic="median")], "scores"),
    "logistic-regression": Recipe(_logistic, "probability"),
    "sgd": Recipe(_sgd, "scores"),
    "linear-svm": Recipe(_svm, "scores"),
    "quadratic-svm": Recipe(_poly(2), "scores"),
    "cubic-svm": Recipe(_poly(3), "scores"),
    "rbf-svm": Recipe(_rbf, "scores"),
    "decision-tree": Recipe(
        lambda c: [mlc.DecisionTreeClassifier(**_tree(c))], "probability"
    ),
    "random-forest": Recipe(lambda c: [mlc.RandomForestClassifier(numTrees=TREES, **_tree(c))], "probability"),
    "adaboost": Recipe(
        lambda c: [AdaBoost(inputCol=c.source, rounds=c.options.rounds, nClasses=c.n_classes)], "probability"
    ),
    "gaussian-naive-bayes": Recipe(lambda c: [mlc.NaiveBayes(modelType="gaussian", **c.common)], "probability"),
    "lda": Recipe(lambda c: [LDA(inputCol=c.source)], "probability"),
    "qda": Recipe(lambda c: [QDA(inputCol=c.source)], "probability"),
    "multilayer-perceptron": Recipe(_perceptron, "probability"),
}

CLASSIFIER_NAMES = tuple(RECIPES)


def preparation(source: str, components: int) -> list:
    """Variance scaling, then dimension reduction."""
    return [
        UnitVarianceScaler(inputCol=source, outputCol="scaled"),
        TruncatedSVD(inputCol="scaled", outputCol="reduced", components=components),
    ]


@dataclass
class FittedClassifier:
    """A fitted pipeline with its class names; ``scores`` reads it out in long form.

    ``index`` numbers the k-mers of its vectors, for features made of sequences.
    """

    name: str
    labels: list[str]
    model: PipelineModel
    generation: dict = field(default_factory=dict)
    index: DataFrame | None = None

    @property
    def has_probabilities(self) -> bool:
        return RECIPES[self.name].answer == "probability"

    def scores(self, df: DataFrame) -> DataFrame:
        """``(sample_id, cls, prob)``: every class with its probability, or the chosen class with null."""
        names = F.array(*[F.lit(label) for label in self.labels])
        out = self.model.transform(df)
        values = vector_to_array(RECIPES[self.name].answer)
        if self.has_probabilities:
            rows = out.select("sample_id", F.posexplode(values).alias("_c", "prob"))
            # a network has at least two outputs, also for a single class
            return rows.where(F.col("_c") < len(self.labels)).select("sample_id", names[F.col("_c")].alias("cls"), "prob")
        chosen = F.array_position(values, F.array_max(values)).cast("int") - 1
        return out.select("sample_id", names[chosen].alias("cls"), F.lit(None).cast("double").alias("prob"))


#: classifiers made of class moments: the kernel that applies them, and what it needs
MOMENT_MODELS = {
    "nearest-centroid-mean": ("nearest_euclidean", moments.centroid_parts),
    "gaussian-naive-bayes": ("bayes_probability", moments.bayes_parts),
    "lda": ("linear_probability", moments.lda_parts),
    "qda": ("gaussian_probability", moments.qda_parts),
}


def reduced_width(avg_nonzero: int, width: int, n: float, options: Options) -> int:
    return max(1, min(math.ceil(avg_nonzero * options.dim_reduce_fraction), width, int(n)))


def fit_moments(
    name: str, classes: dict[str, moments.Moments], avg_nonzero: int, options: Options | None = None
) -> tuple[FittedClassifier, float | None]:
    """Fit one of ``MOMENT_MODELS`` on the moments of each class alone, without a pass over any row.

    Returns the classifier and the share of variance its reduction keeps (none without normalisation).
    """
    options = options or Options()
    labels = sorted(classes)
    own, source, stages, ratio = [classes[label] for label in labels], "features", [], None
    if not own:
        raise ValueError("no training rows")
    width = len(own[0].mean)
    if not options.skip_normalization:
        factors = moments.scaling(moments.merge_all(own))
        scaled = [m.turned(np.diag(factors)) for m in own]
        whole = moments.merge_all(scaled)
        axes = moments.leading_axes(whole, reduced_width(avg_nonzero, width, whole.n, options))
        own = [m.turned(axes) for m in scaled]
        before = whole.variance().sum()
        ratio = float(whole.turned(axes).variance().sum() / before) if before > 0 else 0.0
        stages = [
            ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol="features", outputCol="scaled"),
            MatrixModel(inputCol="scaled", outputCol="reduced", kernel="project", width=width, parts={"axes": axes}),
        ]
        source, width = "reduced", axes.shape[1]
    kernel, parts = MOMENT_MODELS[name]
    head = MatrixModel(inputCol=source, outputCol=RECIPES[name].answer, kernel=kernel, width=width, parts=parts(own))
    return FittedClassifier(name, labels, PipelineModel(stages=[*stages, head])), ratio


def fit_classifier(
    name: str, train: DataFrame, width: int, avg_nonzero: int, options: Options | None = None
) -> FittedClassifier:
    """Fit one classifier on ``(sample_id, features, group)``.

    Labels are numbered in alphabetical order over the training rows only, so a class
    missing from them gets no score.
    """
    options = options or Options()
    if name not in RECIPES:
        raise ValueError(f"unknown classifier: {name}")
    own = train.storageLevel == StorageLevel.NONE
    if own:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = train.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in sizes)
    if n == 0:
        raise ValueError("no training rows")
    labels = sorted(r["group"] for r in sizes)
    rows = StringIndexerModel.from_labels(labels, inputCol="group", outputCol="label").transform(train)
    prepared, source, done = rows, "features", []
    if not options.skip_normalization:
        width = reduced_width(avg_nonzero, width, n, options)
        fitted = Pipeline(stages=preparation(source, width)).fit(rows)
        prepared, source, done = fitted.transform(rows), "reduced", fitted.stages
    # classifiers pass over their training rows many times, and every pass starts a task per partition
    prepared = dealt(prepared.select("sample_id", "label", source), _tasks(name, n, width, len(labels)))
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    ctx = Context(n=n, n_classes=len(labels), width=width, source=source, options=options)
    head = Pipeline(stages=RECIPES[name].stages(ctx)).fit(prepared)
    prepared.unpersist()
    if own:
        train.unpersist()
    stages = [s for stage in head.stages for s in (stage.stages if isinstance(stage, PipelineModel) else [stage])]
    return FittedClassifier(name, labels, PipelineModel(stages=[*done, *stages]))
