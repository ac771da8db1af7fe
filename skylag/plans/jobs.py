"""Train, score, check and retrain as plain functions that any scheduler can call."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.functions import fixed
from skylag.operators.drift import drift_halves
from skylag.operators.features import FlightFeatures, FlightFeaturesModel, label_delayed
from skylag.operators.explain import ATTRIBUTIONS, explain
from skylag.operators.metrics import long_metrics, ranking_metrics
from skylag.operators.model import PROBABILITY, DelayEnsemble, DelayEnsembleModel, EnsembleParams, row_hash, with_tier
from skylag.operators.risk import risk_all_carriers, with_carrier_risk
from skylag.operators.stats import mean_score
from skylag.operators.validate import fill_defaults, validate
from skylag.functions.flight import departure_time
from skylag.sources import branches
from skylag.sources.files import read_flights
from skylag.sources.scratch import materialize
from skylag.sources.schema import LABEL, feature_columns, nan_to_null, typed


@dataclass
class Fitted:
    features: FlightFeaturesModel
    ensemble: DelayEnsembleModel

    def save(self, path: str) -> None:
        self.features.save(f"{path}/features")
        self.ensemble.save(f"{path}/ensemble")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        return cls(
            FlightFeaturesModel.load(spark, f"{path}/features"),
            DelayEnsembleModel.load(spark, f"{path}/ensemble"),
        )


def fit(
    flights: DataFrame, params: EnsembleParams | None = None, zero_if_unknown: bool = False
) -> tuple[Fitted, DataFrame]:
    """(fitted parts, labelled feature matrix) from labelled or delay-carrying flights."""
    labelled = label_delayed(nan_to_null(flights), zero_if_unknown=zero_if_unknown)
    features = FlightFeatures().fit(labelled)
    matrix = features.transform(labelled)
    columns = [c for c in feature_columns(matrix) if c != PROBABILITY]
    return Fitted(features, DelayEnsemble(columns, LABEL, params).fit(matrix)), matrix


def evaluate(fitted: Fitted, flights: DataFrame) -> DataFrame:
    """One row of figures for a stored model on a table: features are derived first."""
    scored = materialize(
        fitted.ensemble.transform(fitted.features.transform(label_delayed(nan_to_null(flights)))).select(
            LABEL, PROBABILITY
        ),
        "evaluation",
    )
    size = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(LABEL).alias("delay_rate"))
    # Three tables of one row.
    return (
        ranking_metrics(scored, PROBABILITY, LABEL)
        .crossJoin(F.broadcast(mean_score(scored, PROBABILITY)))
        .crossJoin(F.broadcast(size))
    )


def train(
    flights: DataFrame,
    model_dir: str | None = None,
    params: EnsembleParams | None = None,
    validation_fraction: float = 0.0,
    zero_if_unknown: bool = False,
) -> tuple[Fitted, DataFrame]:
    """Fit and save; returns the parts and metrics (model, split, metric, value).

    A validation share is split off by hash of `flight_id`, so that it stays the same
    in every run; the carrier statistics are fitted on the training share only.
    """
    if not 0.0 <= validation_fraction < 1.0:
        raise ValueError("validation_fraction must be in [0, 1)")
    splits = {"train": flights}
    if validation_fraction:
        bucket = F.pmod(row_hash(flights, flights.columns, seed=7), F.lit(10_000))
        held_out = bucket < int(validation_fraction * 10_000)
        splits = {"train": flights.where(~held_out), "val": flights.where(held_out)}
    fitted, _ = fit(splits["train"], params, zero_if_unknown)
    metrics = None
    for name, part in splits.items():
        rows = long_metrics(evaluate(fitted, label_delayed(part, zero_if_unknown=zero_if_unknown)), "delay-ensemble", name)
        metrics = rows if metrics is None else metrics.unionAll(rows)
    metrics = materialize(metrics, "metrics")
    if model_dir is not None:
        fitted.save(model_dir)
        metrics.write.mode("overwrite").parquet(f"{model_dir}/metrics")
    return fitted, metrics


def train_file(spark: SparkSession, data_path: str, model_dir: str, **options) -> tuple[Fitted, DataFrame]:
    return train(read_flights(spark, data_path), model_dir, **options)


def score(
    flights: DataFrame,
    fitted: Fitted,
    history: DataFrame | None = None,
    cuts: tuple[float, float, float] = fixed.SERVICE_TIER_CUTS,
    method: str = "linear",
    attributions: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(scored flights, rejected flights with their errors), each in one plan.

    With `attributions` = k every flight also gets the map of its k strongest features.
    """
    valid, rejected = validate(nan_to_null(flights))
    matrix = fitted.features.transform(fill_defaults(typed(valid)))
    out = ["flight_id", PROBABILITY, "delay_tier", "expected_delay_minutes", "carrier_risk_score"]
    if attributions:
        scored = with_tier(explain(fitted.ensemble, matrix, attributions, ("flight_id", "carrier_code")), cuts, method)
        out.append(ATTRIBUTIONS)
    else:
        scored = fitted.ensemble.predict(matrix, cuts, method)
    return with_carrier_risk(scored, history).select(*out), rejected


def score_to_log(
    spark: SparkSession, data_path: str, model_dir: str, log_root: str | None, rejected_path: str | None = None
) -> str | None:
    """Score a file with a stored model and append the result to the prediction log."""
    scored, rejected = score(read_flights(spark, data_path, keep_text=True), Fitted.load(spark, model_dir))
    if rejected_path is not None:
        rejected.write.mode("append").parquet(rejected_path)
    return branches.log_predictions(scored, log_root)


@dataclass
class RetrainResult:
    version: str
    risk: DataFrame
    drift: DataFrame
    metrics: DataFrame
    fitted: Fitted = field(repr=False)


def retrain(
    spark: SparkSession,
    data_root: str,
    model_root: str,
    branch: str = "master",
    params: EnsembleParams | None = None,
    validation_fraction: float = 0.2,
) -> RetrainResult:
    """Fetch a branch, score carrier risk, compare its halves, train, evaluate, publish.

    The model goes to `model_root/version=<UTC time>`; its metrics are appended to
    `model_root/metrics` and thereby name the versions there are.
    """
    flights = branches.read_branch(spark, data_root, branch)
    if flights.isEmpty():
        raise ValueError("no flights to train on")
    risk = materialize(risk_all_carriers(flights), "risk")
    order = F.unix_seconds(departure_time(F.col("scheduled_departure")).cast("timestamp"))
    drift = materialize(drift_halves(flights, order), "drift")
    version = datetime.now(UTC).strftime("%Y%m%d_%H%M%S_%f")
    target = f"{model_root}/version={version}"
    fitted, metrics = train(flights, target, params, validation_fraction)
    metrics = metrics.withColumn("version", F.lit(version))
    branches.push_metrics(metrics, f"{model_root}/metrics")
    return RetrainResult(version, risk, drift, metrics, fitted)
