"""The delay-probability ensemble on MLlib.

Features are standardised once. For each of three stratified folds, two boosted-tree models
and a forest are fitted on the other folds, their weighted vote is scored on the
held-out fold, and an isotonic (or sigmoid) map turns votes into probabilities. A prediction is
the mean of the three calibrated votes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylag.functions import fixed, flight
from skylag.functions.lookup import half_even
from skylag.operators import trees
from skylag.operators.features import align_features, feature_value
from skylag.operators.stats import class_weights
from skylag.sources.scratch import ensure_checkpoint_dir, materialize

FOLDS = 3
SCORE_DIGITS = 6
PROBABILITY = "delay_probability"
#: Trees of a forest that are grown at once: for each of them MLlib keeps a count and a node of every row.
TREES_AT_ONCE = 50
#: Rows of a task of a fit: boosting runs thousands of jobs, which on few rows are nothing but the starts of their tasks.
FIT_ROWS = 100_000


@dataclass
class BoostedParams:
    max_iter: int = 400
    max_depth: int = 6
    step_size: float = 0.05
    subsample: float = 0.8
    feature_share: float = 0.8
    max_bins: int = 256
    #: Rounds end early once one lowers the loss on `validation_share` of the rows by less than this share of it; 0: never.
    validation_tol: float = 0.0
    validation_share: float = 0.1


@dataclass
class ForestParams:
    num_trees: int = 250
    max_depth: int = 12
    max_bins: int = 256


@dataclass
class EnsembleParams:
    boosted_first: BoostedParams = field(default_factory=BoostedParams)
    boosted_second: BoostedParams = field(default_factory=BoostedParams)
    forest: ForestParams = field(default_factory=ForestParams)
    positive_weight: float = 3.0
    seed: int = 42
    calibration: str = "isotonic"  # or "sigmoid"

    @classmethod
    def of_rounds(cls, rounds: int, trees: int) -> EnsembleParams:
        """Trees of the full depth and bins, but so many of them."""
        return cls(BoostedParams(max_iter=rounds), BoostedParams(max_iter=rounds), ForestParams(num_trees=trees))

    @classmethod
    def early_stopping(cls, tol: float = 0.01, trees: int = 250) -> EnsembleParams:
        """The full recipe, whose boosting ends where further rounds gain nothing on rows held out for that."""
        return cls(BoostedParams(validation_tol=tol), BoostedParams(validation_tol=tol), ForestParams(num_trees=trees))

    @classmethod
    def small(cls) -> EnsembleParams:
        """A quick ensemble for trials."""
        return cls(BoostedParams(max_iter=2, max_depth=3), BoostedParams(max_iter=2, max_depth=3), ForestParams(4, 4))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = {
        c: F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
        for c in columns
    }
    helpers = [f"_{k}_{c}" for k in "ms" for c in columns]
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*helpers)  # one row


def with_folds(
    df: DataFrame, label: str, columns: list[str], seed: int, id_column: str | None = "flight_id", folds: int = FOLDS
) -> DataFrame:
    """Add `_fold`: the row's rank by hash within its label, modulo `folds`.

    Per label the folds differ by one row at most. Rows are range-partitioned by (label, hash, tie), so a label
    with most rows is many slices; ranks are counted within a slice and start from the sum of those before it.
    """
    return _ranked(_sliced(df, label, columns, seed, id_column), folds)


_ORDER = ["_label", "_hash", "_tie"]


def _sliced(df: DataFrame, label: str, columns: list[str], seed: int, id_column: str | None) -> DataFrame:
    keyed = df.withColumns(
        {"_label": F.col(label).cast("double"), "_hash": row_hash(df, columns, seed, id_column), "_tie": F.monotonically_increasing_id()}
    )
    # Stored, because the borders of the slices are sampled and must be the same for counts and rows.
    return materialize(keyed.repartitionByRange(*_ORDER).withColumn("_slice", F.spark_partition_id()), "folds")


def _ranked(sliced: DataFrame, folds: int) -> DataFrame:
    counts = sliced.groupBy("_label", "_slice").agg(F.count(F.lit(1)).alias("_n"))  # slices and labels, not rows
    before = Window.partitionBy("_label").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_label", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_label", "_slice").orderBy("_hash", "_tie"))
    ranked = sliced.join(starts.hint("shuffle_hash"), ["_label", "_slice"]).withColumn("_fold", F.pmod(F.col("_start") + nth - 1, F.lit(folds)).cast("int"))
    return ranked.drop(*_ORDER, "_slice", "_start")


def row_hash(df: DataFrame, columns: list[str], seed: int, id_column: str | None = "flight_id") -> Column:
    """Hash of the id; rows without one are told apart by the given columns."""
    whole = F.xxhash64(*columns, F.lit(seed))
    if not id_column or id_column not in df.columns:
        return whole
    return F.when(F.col(id_column).isNull(), whole).otherwise(F.xxhash64(id_column, F.lit(seed)))


def _named(learner, name: str):
    """Own output columns per learner; the class column is not needed."""
    return learner.setPredictionCol("").setRawPredictionCol(f"_raw_{name}").setProbabilityCol(f"_prob_{name}")


def _boosted(p: BoostedParams, weight: str, seed: int) -> GBTClassifier:
    watched = {"validationIndicatorCol": "_watched", "validationTol": p.validation_tol} if p.validation_tol else {}
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol=weight,
        maxIter=p.max_iter, maxDepth=p.max_depth, maxBins=p.max_bins, stepSize=p.step_size,
        subsamplingRate=p.subsample, featureSubsetStrategy=str(p.feature_share), seed=seed, **watched,
    )


def _forest(p: ForestParams, weight: str, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol=weight,
        numTrees=p.num_trees, maxDepth=p.max_depth, maxBins=p.max_bins, seed=seed,
        cacheNodeIds=True,  # else every row walks down each tree again on every level
    )


def _grown(p: ForestParams, weight: str, seed: int, name: str, rows: DataFrame) -> RandomForestClassificationModel:
    """The whole forest, so many trees after another that what MLlib keeps of each row stays bounded."""
    sizes = [min(TREES_AT_ONCE, p.num_trees - done) for done in range(0, p.num_trees, TREES_AT_ONCE)]
    return _joined([_named(_forest(replace(p, num_trees=n), weight, seed + i), name).fit(rows) for i, n in enumerate(sizes)], rows.sparkSession)


def _joined(parts: list[RandomForestClassificationModel], spark: SparkSession) -> RandomForestClassificationModel:
    """One forest of the trees of all parts; each tree counts alike."""
    if len(parts) == 1:
        return parts[0]
    context, java = spark.sparkContext, parts[0]._java_obj
    classes = context._jvm.org.apache.spark.ml.classification
    grown = [tree for part in parts for tree in part._java_obj.trees()]
    array = context._gateway.new_array(classes.DecisionTreeClassificationModel, len(grown))
    for i, tree in enumerate(grown):
        array[i] = tree
    whole = RandomForestClassificationModel(classes.RandomForestClassificationModel(java.uid(), array, java.numFeatures(), java.numClasses()))
    whole = parts[0]._copyValues(whole)._set(numTrees=len(grown))
    whole._transfer_params_to_java()
    return whole


class DelayEnsemble(Estimator):
    """Fits the calibrated ensemble on numeric feature columns and a 0/1 label."""

    def __init__(
        self,
        features: list[str],
        label: str = "is_delayed",
        settings: EnsembleParams | None = None,
        id_column: str | None = "flight_id",
        parallelism: int = FOLDS,
    ):
        super().__init__()
        self.parallelism = parallelism
        self.features, self.label, self.id_column = list(features), label, id_column
        self.settings = settings or EnsembleParams()
        if self.settings.calibration not in ("isotonic", "sigmoid"):
            raise ValueError(f"unknown calibration {self.settings.calibration!r}")

    def _fit(self, df: DataFrame) -> DelayEnsembleModel:
        p = self.settings
        ensure_checkpoint_dir(df.sparkSession)
        keep = [self.label] + ([self.id_column] if self.id_column in df.columns else [])
        aligned = align_features(df, self.features, keep).where(F.col(self.label).isNotNull())
        watched = F.pmod(row_hash(aligned, self.features, p.seed + 1, self.id_column), F.lit(10_000)) < int(
            10_000 * max(p.boosted_first.validation_share, p.boosted_second.validation_share)
        )
        labelled = aligned.withColumns({"label": F.col(self.label).cast("double"), "_watched": watched})
        sliced = _sliced(labelled, "label", self.features, p.seed, self.id_column)
        if not sliced.where("label NOT IN (0, 1)").limit(1).isEmpty():
            raise ValueError("training needs labels 0 and 1, found others")
        balanced = {r["label"]: r["weight"] for r in class_weights(sliced, "label").collect()}  # two rows
        if set(balanced) != {0.0, 1.0}:
            raise ValueError(f"training needs labels 0 and 1, found {sorted(balanced)}")
        prepare = Pipeline(
            stages=[
                VectorAssembler(inputCols=self.features, outputCol="_assembled"),
                StandardScaler(inputCol="_assembled", outputCol="features", withMean=True),
            ]
        ).fit(sliced)
        # Every fit reads this table several times; without it each would derive, assemble and scale the features again.
        # One folder per fold, so that a fit opens the files of its own folds only.
        rows = materialize(
            prepare.transform(_ranked(sliced, FOLDS)).select("label", "features", "_watched", "_fold"), "training", partition_by="_fold"
        )
        is_late = F.col("label") == 1
        scaled = rows.withColumns(
            {
                "_w_scaled": F.when(is_late, p.positive_weight).otherwise(1.0),
                "_w_balanced": F.when(is_late, balanced[1.0]).otherwise(balanced[0.0]),
            }
        )
        # The folds are independent jobs; side by side they fill each other's gaps.
        with ThreadPool(self.parallelism) as pool:
            fit_fold = inheritable_thread_target(df.sparkSession)(lambda k: self._fit_fold(scaled, k))
            folds = pool.map(fit_fold, range(FOLDS))
        return DelayEnsembleModel(self.features, prepare, folds, self.settings)

    def _fit_fold(self, rows: DataFrame, k: int) -> FoldModels:
        p = self.settings
        train, held_out = rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)
        train = train.coalesce(max(1, -(-train.count() // FIT_ROWS)))  # counted from the files' footers; never more tasks than before
        # The forest takes most of the time; boosting, many short jobs that wait for the forests' tasks, runs in its gaps, both learners
        # at once, else the second one outlasts the forest. The nodes of a learner are read as soon as it is fitted.
        planned = [
            ("c", lambda name: _grown(p.forest, "_w_balanced", p.seed, name, train)),
            ("a", lambda name: _named(_boosted(p.boosted_first, "_w_scaled", p.seed), name).fit(train)),
            ("b", lambda name: _named(_boosted(p.boosted_second, "_w_balanced", p.seed + 1), name).fit(train)),
        ]

        def fitted(name: str, fit: Callable) -> tuple:
            found = fit(f"{name}{k}")
            return found, trees.nodes(found, k, name, rows.sparkSession)

        with ThreadPool(len(planned)) as pool:
            forest, *boosted = pool.map(inheritable_thread_target(rows.sparkSession)(lambda one: fitted(*one)), planned, chunksize=1)
        learners, forests = map(list, zip(*boosted, forest, strict=True))
        # Ties are averaged by an isotonic fit anyway, so equal votes become one weighted
        # point. Rounded votes bound the points (and MLlib's merge on the driver) by 10^6.
        # Stored, because the fit reads them more than once and would score the rows again each time.
        points = materialize(
            _with_votes(held_out, [forests], k)
            .groupBy(half_even(f"_vote_{k}", SCORE_DIGITS).alias("_vote"))
            .agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("n")),
            "points",
        )
        if p.calibration == "sigmoid":
            return FoldModels(learners, sigmoid=_fit_sigmoid(points), forests=forests)
        isotonic = IsotonicRegression(
            featuresCol="_vote", labelCol="label", weightCol="n", predictionCol=f"_calibrated_{k}"
        ).fit(points)
        return FoldModels(learners, isotonic.setFeaturesCol(f"_vote_{k}"), forests=forests)


def _fit_sigmoid(points: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic map from votes to labels; a point is its late and its other rows."""
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("label")).alias("n")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("label"))).alias("n")),
    )
    rows = points.select("_vote", F.inline(sides)).where("n > 0")
    vector = VectorAssembler(inputCols=["_vote"], outputCol="_features").transform(rows)
    fitted = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="n").fit(vector)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def _with_votes(df: DataFrame, folds: list[list[trees.Forest]], first: int = 0) -> DataFrame:
    """Add `_vote_k` per fold, counted from `first`: blocks of rows go down the trees in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(folds)  # as large as the model

    @F.arrow_udf("array<double>")
    def votes(features: pa.Array) -> pa.Array:
        return trees.rowwise(lambda x: trees.votes(shared.value, x), features)

    voted = df.withColumn("_votes", votes(vector_to_array("features")))
    return voted.withColumns({f"_vote_{first + i}": F.col("_votes")[i] for i in range(len(folds))}).drop("_votes")


@dataclass
class Curve:
    """A calibration as numpy applies it to an array of votes."""

    boundaries: np.ndarray | None = None
    predictions: np.ndarray | None = None
    sigmoid: tuple[float, float] | None = None

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        if self.sigmoid is None:
            return np.interp(votes, self.boundaries, self.predictions)
        slope, intercept = self.sigmoid
        return 1 / (1 + np.exp(-(slope * votes + intercept)))


def with_tier(
    scored: DataFrame, cuts: tuple[float, float, float] = fixed.MODEL_TIER_CUTS, method: str = "tier"
) -> DataFrame:
    """Add tier and expected minutes, and round the probability they were read from."""
    p = F.col(PROBABILITY)
    return scored.withColumns(
        {
            "delay_tier": flight.delay_tier(p, cuts),
            "expected_delay_minutes": flight.expected_minutes(p, method, cuts),
            PROBABILITY: half_even(p, SCORE_DIGITS),
        }
    )


@dataclass
class FoldModels:
    learners: list
    isotonic: IsotonicRegressionModel | None = None
    sigmoid: tuple[float, float] | None = None
    #: The learners' nodes; read from the learners where absent.
    forests: list[trees.Forest] | None = field(default=None, repr=False)

    def curve(self) -> Curve:
        if self.isotonic is None:
            return Curve(sigmoid=self.sigmoid)
        return Curve(self.isotonic.boundaries.toArray(), self.isotonic.predictions.toArray())

    def calibrate(self, df: DataFrame, k: int) -> DataFrame:
        if self.isotonic is not None:
            return self.isotonic.transform(df)
        slope, intercept = self.sigmoid
        return df.withColumn(f"_calibrated_{k}", 1 / (1 + F.exp(-(slope * F.col(f"_vote_{k}") + intercept))))


class DelayEnsembleModel(Model):
    def __init__(self, features: list[str], prepare: PipelineModel, folds: list[FoldModels], settings: EnsembleParams):
        super().__init__()
        self.features, self.prepare, self.folds, self.settings = features, prepare, folds, settings

    def rounds(self) -> DataFrame:
        """fold, learner, trees: how many trees each learner has, after early stopping."""
        rows = [(k, name, m.getNumTrees) for k, fold in enumerate(self.folds) for name, m in zip("abc", fold.learners, strict=True)]
        return SparkSession.getActiveSession().createDataFrame(rows, "fold int, learner string, trees int")

    def forests(self) -> list[list[trees.Forest]]:
        """The nodes of every learner, by fold."""
        for k, fold in enumerate(self.folds):
            if fold.forests is None:
                spark = SparkSession.getActiveSession()
                fold.forests = [trees.nodes(m, k, name, spark) for name, m in zip("abc", fold.learners, strict=True)]
        return [fold.forests for fold in self.folds]

    def _score(self, df: DataFrame) -> DataFrame:
        df = _with_votes(df, self.forests())
        for k, fold in enumerate(self.folds):
            df = fold.calibrate(df, k)
        calibrated = [F.col(f"_calibrated_{k}") for k in range(len(self.folds))]
        votes = [F.col(f"_vote_{k}") for k in range(len(self.folds))]
        mean = lambda cols: reduce(lambda a, b: a + b, cols) / len(cols)
        return df.withColumns(
            {
                "ensemble_vote": mean(votes),
                PROBABILITY: mean(calibrated),
            }
        ).drop(*[f"_vote_{k}" for k in range(FOLDS)], *[f"_calibrated_{k}" for k in range(FOLDS)])

    def score_vectors(self, df: DataFrame) -> DataFrame:
        """Score rows whose unscaled feature vector is in `_assembled`."""
        scaler = self.prepare.stages[1]
        return self._score(scaler.transform(df)).drop("_assembled", "features")

    def _transform(self, df: DataFrame) -> DataFrame:
        """Add `ensemble_vote` and `delay_probability`; absent features count as 0."""
        values = [feature_value(df, c).alias(f"_x_{c}") for c in self.features]
        wide = df.select("*", *values)
        assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in self.features], outputCol="_assembled")
        return self.score_vectors(assembler.transform(wide).drop(*[f"_x_{c}" for c in self.features]))

    def predict(
        self, df: DataFrame, cuts: tuple[float, float, float] = fixed.MODEL_TIER_CUTS, method: str = "tier"
    ) -> DataFrame:
        """`transform` plus `delay_tier` and `expected_delay_minutes`, the probability rounded."""
        return with_tier(self.transform(df), cuts, method)

    def save(self, path: str) -> None:
        """A folder per fitted part and a manifest naming the features and settings."""
        self.prepare.write().overwrite().save(f"{path}/prepare")
        for k, fold in enumerate(self.folds):
            for name, model in zip("abc", fold.learners, strict=True):
                model.write().overwrite().save(f"{path}/fold={k}/{name}")
            if fold.isotonic is not None:
                fold.isotonic.write().overwrite().save(f"{path}/fold={k}/isotonic")
        spark = SparkSession.getActiveSession()
        settings = asdict(self.settings) | {"_sigmoid": [fold.sigmoid for fold in self.folds]}
        manifest = [(self.features, len(self.folds), json.dumps(settings))]
        spark.createDataFrame(manifest, "features array<string>, folds int, settings string").coalesce(
            1
        ).write.mode("overwrite").json(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DelayEnsembleModel:
        schema = "features array<string>, folds int, settings string"
        row = spark.read.schema(schema).json(f"{path}/manifest").first()
        raw = json.loads(row["settings"])
        sigmoid = raw.pop("_sigmoid", [None] * row["folds"])
        params = EnsembleParams(
            BoostedParams(**raw.pop("boosted_first")),
            BoostedParams(**raw.pop("boosted_second")),
            ForestParams(**raw.pop("forest")),
            **raw,
        )
        kinds = {"a": GBTClassificationModel, "b": GBTClassificationModel, "c": RandomForestClassificationModel}
        folds = [
            FoldModels(
                [kind.load(f"{path}/fold={k}/{name}") for name, kind in kinds.items()],
                None if sigmoid[k] else IsotonicRegressionModel.load(f"{path}/fold={k}/isotonic"),
                tuple(sigmoid[k]) if sigmoid[k] else None,
            )
            for k in range(row["folds"])
        ]
        return cls(list(row["features"]), PipelineModel.load(f"{path}/prepare"), folds, params)
