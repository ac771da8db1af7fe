"""Every registered query: an operator over the whole tables, with flat output columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.functions import fixed, flight
from skylag.functions.lookup import half_even, number
from skylag.operators import cumulative, drift, explain, features, impact, metrics, model, quality, risk, stats, validate
from skylag.operators.lineage import lineage as trace
from skylag.plans import jobs, views
from skylag.sources import branches, files
from skylag.sources.scratch import scratch_path
from skylag.sources.session import tune
from skylag.sources.schema import feature_columns
from skylag.streaming import records, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PART = "historical_component", "weather_component", "congestion_component"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- sources and sinks --------------------------------------------------------


@query
def scan_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scan")
    views.flights(spark, sf_dir).write.parquet(path)
    return (
        files.read_flights(spark, path)
        .where(F.col("dep_delay_minutes") >= 15)
        .select("flight_id", "carrier_code", "dep_delay_minutes")
    )


@query
def read_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "branch")
    branches.write(views.flights(spark, sf_dir), root)
    limited = branches.read_branch(spark, root, limit=1000)
    whole = branches.read_branch(spark, root)
    return limited.agg(F.count(F.lit(1)).alias("n_limited")).crossJoin(
        F.broadcast(whole.agg(F.count(F.lit(1)).alias("n_rows")))  # one row each
    )


@query
def write_snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "snapshot")
    flights = views.flights(spark, sf_dir)
    branches.write(flights.select("flight_id", "origin"), root)
    branches.write(flights, root)  # replaces the first snapshot
    return branches.read_branch(spark, root).select("flight_id", "origin", "destination", "delay_probability")


def _changes(flights: DataFrame) -> DataFrame:
    """Corrected delays of the flights of one carrier, and a new flight for each."""
    fixed_rows = flights.where(F.col("carrier_code") == "WN").withColumn(
        "dep_delay_minutes", F.coalesce("dep_delay_minutes", F.lit(0.0)) + 5
    )
    return fixed_rows.unionByName(fixed_rows.withColumn("flight_id", F.concat("flight_id", F.lit("-B"))))


_KEYED = ("flight_id", "carrier_code", "dep_delay_minutes")


@query
def upsert_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "upsert")
    flights = views.flights(spark, sf_dir).select(*_KEYED)
    branches.write(flights, root)
    branches.write(_changes(flights), root, mode="update", key="flight_id")
    return branches.read_branch(spark, root)


@query
def delete_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "delete")
    flights = views.flights(spark, sf_dir).select(*_KEYED)
    branches.write(flights, root)
    branches.write(_changes(flights), root, mode="delete", key="flight_id")
    return branches.read_branch(spark, root)


_BY_CARRIER = ["carrier_code", "flight_id"]


@query
def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `upsert_flights`, in a branch laid out by carrier: only the buckets of the changed carrier are read and written."""
    root = scratch_path(spark, "upsert-buckets")
    flights = views.flights(spark, sf_dir).select(*_KEYED)
    branches.write(flights, root, bucket_by="carrier_code")
    branches.write(_changes(flights), root, mode="update", key=_BY_CARRIER)
    return branches.read_branch(spark, root)


@query
def delete_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "delete-buckets")
    flights = views.flights(spark, sf_dir).select(*_KEYED)
    branches.write(flights, root, bucket_by="carrier_code")
    branches.write(_changes(flights), root, mode="delete", key=_BY_CARRIER)
    return branches.read_branch(spark, root)


@query
def log_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "log")
    scores = views.flights(spark, sf_dir).select("flight_id", "delay_probability")
    branches.log_predictions(scores, root)
    branches.log_predictions(scores, root)
    log = branches.read_branch(spark, root)
    return log.groupBy("flight_id", "delay_probability").agg(
        F.count(F.lit(1)).alias("n"), F.count("logged_at").alias("n_stamped")
    )


@query
def append_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "append")
    flights = views.flights(spark, sf_dir)
    frames = [flights.select("flight_id", "origin"), flights.select("flight_id", "distance_miles")]
    branches.append_many(frames, root)
    return (
        branches.read_branch(spark, root)
        .groupBy("origin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("distance_miles").alias("miles"))
    )


@query
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, path = scratch_path(spark, "export"), scratch_path(spark, "export-csv") + ".csv"
    branches.write(views.flights(spark, sf_dir), root)
    branches.export_branch(spark, root, path, fmt="csv")
    return files.read_flights(spark, path).select(
        "flight_id", "carrier_code", "distance_miles", "is_holiday", "dep_delay_minutes"
    )


@query
def list_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "branches")
    flights = views.flights(spark, sf_dir)
    branches.write(flights, root)
    branches.write(flights.where(F.col("dep_delay_minutes") >= 15), root, "delayed")
    names = branches.list_branches(spark, root)
    per_branch = [
        branches.read_branch(spark, root, n).agg(F.lit(n).alias("branch"), F.count(F.lit(1)).alias("n_rows"))
        for n in names
    ]
    return per_branch[0].unionAll(per_branch[1])


@query
def model_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "metrics")
    row = metrics.ranking_metrics(_labelled(spark, sf_dir))
    branches.push_metrics(metrics.long_metrics(row, "given-score", "all"), root)
    return branches.read_branch(spark, root).select("model", "split", "metric", r6("value").alias("value"))


# --- validation and quality -----------------------------------------------------


@query
def validate_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.error_summary(views.raw_flights(spark, sf_dir))


@query
def validation_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.errors_per_row(views.raw_flights(spark, sf_dir))


@query
def valid_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = validate.validate(views.raw_flights(spark, sf_dir))
    return valid.select("flight_id", "origin", "destination", "departure_hour", "month")


@query
def rejected_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = validate.validate(views.raw_flights(spark, sf_dir))
    return rejected.select(
        "flight_id", "scheduled_departure", F.concat_ws(",", F.col("errors.field")).alias("fields")
    )


@query
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.fill_defaults(views.raw_flights(spark, sf_dir)).select(
        "flight_id", "aircraft_type", "departure_hour", "day_of_week", "month", "is_holiday",
        "prior_leg_delay_minutes", "weather_condition", "distance_miles",
    )


@query
def enforce_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.enforce_schema(
        views.flights(spark, sf_dir), ["destination", "origin", "flight_id", "dep_delay_minutes"]
    )


@query
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.data_quality(
        views.flights(spark, sf_dir), required=("flight_id", "gate"), max_null_fraction=0.02
    )
    return _rounded(report, "value")


@query
def null_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.null_fractions(views.flights(spark, sf_dir)), "null_fraction")


@query
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flights(spark, sf_dir).select("carrier_code", "origin", "destination", "weather_condition")
    return quality.duplicate_rows(rows)


@query
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = views.raw_flights(spark, sf_dir)
    return features.align_features(flights, feature_columns(flights), ["flight_id", "scheduled_departure"])


@query
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["distance_miles", "prior_leg_delay_minutes", "is_holiday", "scheduled_departure", "runway_heading"]
    return features.align_features(views.flights(spark, sf_dir), columns, ["flight_id"])


@query
def label_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_delayed(views.flights(spark, sf_dir)).select("flight_id", "is_delayed")


# --- aggregates ---------------------------------------------------------------------


@query
def carrier_delay_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.carrier_delay_rate(views.flights(spark, sf_dir)), "delay_rate")


@query
def carrier_mean_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.carrier_mean_delay(views.flights(spark, sf_dir)), "mean_delay")


@query
def fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.fit_stats(views.flights(spark, sf_dir)).drop("n"), "delay_rate", "mean_delay")


@query
def carrier_rate_from_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir).drop("dep_delay_minutes")
    return _rounded(stats.fit_stats(labelled).drop("n"), "delay_rate", "mean_delay")


_HISTORY = ("delay_rate", "mean_delay_minutes", "p90_delay_minutes")


@query
def carrier_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.carrier_history(views.flights(spark, sf_dir)), *_HISTORY)


@query
def route_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.route_history(views.flights(spark, sf_dir)), *_HISTORY, "route_distance_miles")


@query
def delay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.delay_stats(views.flights(spark, sf_dir))


@query
def delay_stats_one_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.delay_stats(views.flights(spark, sf_dir), carrier="dl")


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.class_weights(_labelled(spark, sf_dir)), "share", "weight")


@query
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_histogram(views.flights(spark, sf_dir))


@query
def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.mean_score(views.flights(spark, sf_dir)), "mean_score")


# --- features -----------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_delayed(views.flights(spark, sf_dir))


@query
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.temporal_features(views.flights(spark, sf_dir), holiday="explicit").select(
        "flight_id", "departure_hour", "day_of_week", "month", "day_of_month",
        "hour_bucket", "is_weekend", "quarter", "is_peak_season",
    )


@query
def holiday_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.temporal_features(views.flights(spark, sf_dir), "auto").select("flight_id", "is_holiday")


@query
def holiday_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = views.flights(spark, sf_dir).withColumn("is_holiday", F.lit(None).cast("boolean"))
    return features.temporal_features(blank, "auto").select("flight_id", "is_holiday")


@query
def schedule_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = features.temporal_features(views.flights(spark, sf_dir), "explicit")
    return features.schedule_slot(timed).select("flight_id", "schedule_slot")


@query
def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.route_features(views.flights(spark, sf_dir)).select(
        "flight_id", "is_hub_origin", "is_hub_dest", "is_hub_to_hub", "distance_bucket", "distance_log"
    )
    return _rounded(out, "distance_log")


@query
def flight_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.route_features(views.flights(spark, sf_dir)).select("flight_id", "flight_direction")


def _fitted_features(spark: SparkSession, sf_dir: str) -> tuple[features.FlightFeaturesModel, DataFrame]:
    flights = views.flights(spark, sf_dir)
    return features.FlightFeatures(holiday="explicit").fit(flights), flights


@query
def carrier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, flights = _fitted_features(spark, sf_dir)
    out = features.carrier_features(flights, fitted.stats, fitted.global_rate, fitted.global_mean)
    return _rounded(
        out.select("flight_id", "carrier_delay_rate", "carrier_mean_delay"),
        "carrier_delay_rate",
        "carrier_mean_delay",
    )


@query
def aircraft_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.aircraft_features(views.flights(spark, sf_dir)).select(
        "flight_id", "is_narrow_body", "is_wide_body", "is_regional"
    )


@query
def chaining_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.chaining_features(views.flights(spark, sf_dir))
    return _rounded(
        out.select("flight_id", "prior_leg_delay_minutes", "has_prior_delay", "prior_delay_log"), "prior_delay_log"
    )


@query
def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.weather_features(views.flights(spark, sf_dir)).select("flight_id", "weather_severity")


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, flights = _fitted_features(spark, sf_dir)
    matrix = fitted.transform(flights)
    return matrix.select("flight_id", *[half_even(F.col(c).cast("double"), 6).alias(c) for c in features.FEATURES])


def _impact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    timed = views.flights(spark, sf_dir).withColumn(
        "departure_hour", F.hour(flight.departure_time(F.col("scheduled_departure")))
    )
    return impact.weather_impact(timed)


@query
def weather_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = _impact(spark, sf_dir)
    return known.select(
        "flight_id", "delay_multiplier", "avg_added_delay_min", "adjusted_on_time_pct", "severity"
    )


@query
def weather_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = _impact(spark, sf_dir)
    return known.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))


@query
def weather_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unknown = _impact(spark, sf_dir)
    return unknown.select("flight_id", "weather_condition")


def _tiers(spark: SparkSession, sf_dir: str, cuts: tuple[float, float, float]) -> DataFrame:
    return views.flights(spark, sf_dir).select(
        "flight_id", flight.delay_tier(F.col("delay_probability"), cuts).alias("delay_tier")
    )


@query
def delay_tier_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, fixed.SERVICE_TIER_CUTS)


@query
def delay_tier_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, fixed.MODEL_TIER_CUTS)


@query
def expected_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("delay_probability")
    return views.flights(spark, sf_dir).select(
        "flight_id",
        flight.expected_minutes(p, "tier").alias("minutes_by_tier"),
        flight.expected_minutes(p, "linear").alias("minutes_linear"),
    )


# --- risk ---------------------------------------------------------------------------


def _flat_risk(profile: DataFrame) -> DataFrame:
    return profile.select("*", *[F.col(f"breakdown.{p}").alias(p) for p in PART]).drop("breakdown")


@query
def carrier_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_risk(risk.carrier_risk(stats.carrier_history(views.flights(spark, sf_dir))))


@query
def carrier_risk_by_hour_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = views.flights(spark, sf_dir)
    hour = F.hour(flight.departure_time(F.col("scheduled_departure")))
    contexts = (
        flights.where(F.col("carrier_code").isNotNull())
        .select(F.upper("carrier_code").alias("carrier_code"), hour.alias("departure_hour"), "weather_condition")
        .distinct()
    )
    scored = risk.carrier_risk(stats.carrier_history(flights), contexts)
    return scored.select("carrier_code", "departure_hour", "weather_condition", "risk_score")


@query
def carrier_risk_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every carrier that occurs, scored as if none had a history."""
    seen = views.flights(spark, sf_dir).where(F.col("carrier_code").isNotNull())
    return _flat_risk(risk.carrier_risk(None, seen.select(F.upper("carrier_code").alias("carrier_code")).distinct()))


@query
def risk_all_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.risk_all_carriers(views.flights(spark, sf_dir))


@query
def flight_carrier_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = views.flights(spark, sf_dir)
    scored = risk.with_carrier_risk(flights, stats.carrier_history(flights))
    return scored.select("flight_id", "carrier_risk_score")


@query
def route_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.route_risk(views.flights(spark, sf_dir)).drop("breakdown")


@query
def route_risk_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route that occurs, scored as if none had a history."""
    routes = views.flights(spark, sf_dir).select(
        F.upper("origin").alias("origin"), F.upper("destination").alias("destination")
    )
    return risk.route_risk(None, routes.distinct()).drop("breakdown")


# --- model --------------------------------------------------------------------------

_MODELS: dict[tuple[str, str], jobs.Fitted] = {}


def _model(spark: SparkSession, sf_dir: str) -> jobs.Fitted:
    """The ensemble on all flights of one folder, fitted once per application: the full recipe, 400 rounds and 250 trees."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        tune(spark)
        _MODELS[key], _ = jobs.fit(views.flights(spark, sf_dir), model.EnsembleParams())
    return _MODELS[key]


@query
def rounds_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of each learner: one at least and as many as the recipe has at most, and all of a forest's."""
    fitted = _model(spark, sf_dir).ensemble
    recipe = model.EnsembleParams()
    most = F.when(F.col("learner") == "c", recipe.forest.num_trees).when(F.col("learner") == "a", recipe.boosted_first.max_iter).otherwise(recipe.boosted_second.max_iter)
    whole = (F.col("learner") != "c") | (F.col("trees") == recipe.forest.num_trees)
    return fitted.rounds().select("fold", "learner", F.col("trees").between(1, most).alias("within"), whole.alias("whole_forest"))


@query
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.flights(spark, sf_dir).where("dep_delay_minutes IS NOT NULL")
    labelled = known.select("flight_id", "carrier_code", (F.col("dep_delay_minutes") >= 15).cast("int").alias("label"))
    folds = model.with_folds(labelled, "label", ["carrier_code"], 42)
    return folds.groupBy("label", "_fold").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_fold", "fold")


@query
def path_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each learner, and those whose base value and path contributions do not add up to its margin."""
    fitted = _model(spark, sf_dir)
    flights = views.flights(spark, sf_dir).drop("delay_probability")
    found = explain.path_contributions(fitted.ensemble, fitted.features.transform(flights))
    summed = F.aggregate(F.map_values("contributions"), F.col("base_value"), lambda a, v: a + v)
    wrong = F.coalesce(F.abs(summed - F.col("margin")) > 1e-9, F.lit(True))
    return found.groupBy("fold", "learner").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_wrong"))


@query
def vote_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and those whose base vote and attributions do not add up to their vote."""
    fitted = _model(spark, sf_dir)
    flights = views.flights(spark, sf_dir).drop("delay_probability")
    found = explain.vote_entries(fitted.ensemble, fitted.features.transform(flights), ["flight_id"])
    summed = F.aggregate("entries", F.col("base_vote"), lambda a, e: a + e["value"])
    # Each of the features is rounded to 6 digits.
    wrong = F.coalesce(F.abs(summed - F.col("ensemble_vote")) > 2e-5, F.lit(True))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_wrong"))


@query
def retrain_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what a retraining of all flights leaves: risks, drift rows, metrics by split, versions. Few shallow trees."""
    data, models = scratch_path(spark, "retrain-data"), scratch_path(spark, "retrain-models")
    branches.write(views.flights(spark, sf_dir).drop("delay_probability"), data)
    result = jobs.retrain(spark, data, models, params=model.EnsembleParams.small())
    log = branches.read_branch(spark, f"{models}/metrics")
    logged = log.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"),
        F.countDistinct("version").alias("n_versions"),
        F.count_if((F.col("metric") != "n_rows") & ~F.col("value").between(0, 1)).alias("n_outside"),
        F.sum(F.when(F.col("metric") == "n_rows", F.col("value"))).cast("long").alias("n_rows"),
    )
    return logged.crossJoin(F.broadcast(result.risk.agg(F.count(F.lit(1)).alias("n_risks"))))  # one row each


@query
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["distance_miles", "prior_leg_delay_minutes", "dep_delay_minutes"]
    flights = views.flights(spark, sf_dir).select("flight_id", *columns)
    return _rounded(model.standardize(flights, columns), *columns)


@query
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("delay_probability")
    second = F.least(F.lit(1.0), F.coalesce(number("prior_leg_delay_minutes"), F.lit(0.0)) / 120)
    third = F.coalesce(number("distance_miles"), F.lit(0.0)) / 2801
    vote = flight.soft_vote(first, second, third)
    return views.flights(spark, sf_dir).select("flight_id", r6(vote).alias("vote"))


@query
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _model(spark, sf_dir)
    scored = fitted.ensemble.transform(fitted.features.transform(views.flights(spark, sf_dir).drop("delay_probability")))
    return scored.select("flight_id", r6("ensemble_vote").alias("ensemble_vote"))


@query
def calibrated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _model(spark, sf_dir)
    scored = fitted.ensemble.transform(fitted.features.transform(views.flights(spark, sf_dir).drop("delay_probability")))
    return scored.select("flight_id", r6("delay_probability").alias("delay_probability"))


@query
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = jobs.score(views.raw_flights(spark, sf_dir), _model(spark, sf_dir))
    return scored


@query
def score_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows, and those whose tier, minutes or probability do not fit each other."""
    scored, rejected = jobs.score(views.raw_flights(spark, sf_dir), _model(spark, sf_dir))
    p = F.col("delay_probability")
    severe, moderate, minor = fixed.SERVICE_TIER_CUTS
    tier = F.when(p >= severe, "SEVERE").when(p >= moderate, "MODERATE").when(p >= minor, "MINOR").otherwise("ON_TIME")
    counted = scored.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count_if(~p.between(0, 1) | p.isNull()).alias("n_outside"),
        F.count_if(F.col("delay_tier") != tier).alias("n_wrong_tier"),
        F.count_if(F.abs(F.col("expected_delay_minutes") - p * 120) > 0.051).alias("n_wrong_minutes"),
    )
    return counted.crossJoin(F.broadcast(rejected.agg(F.count(F.lit(1)).alias("n_rejected"))))  # one row each


@query
def score_file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file scored by a stored model into the prediction log; bad lines go to their own folder."""
    path, model_dir, log, bad = (scratch_path(spark, name) for name in ("file", "stored-model", "prediction-log", "rejected"))
    files.export(views.text_flights(spark, sf_dir), f"{path}.csv", "csv")
    _model(spark, sf_dir).save(model_dir)
    jobs.score_to_log(spark, f"{path}.csv", model_dir, log, bad)
    logged = branches.read_branch(spark, log).agg(F.count(F.lit(1)).alias("n_logged"), F.count("logged_at").alias("n_stamped"))
    return logged.crossJoin(F.broadcast(spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("n_rejected"))))  # one row each


def _differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """How many rows there are, and how many of either table the other one lacks."""
    unlike = one.exceptAll(other).unionAll(other.exceptAll(one))
    return one.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(
        F.broadcast(unlike.agg(F.count(F.lit(1)).alias("n_different")))  # one row each
    )


@query
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flights scored with the model before and after it was saved and loaded."""
    path, raw = scratch_path(spark, "model"), views.raw_flights(spark, sf_dir)
    fitted = _model(spark, sf_dir)
    fitted.save(path)
    before, _ = jobs.score(raw, fitted)
    after, _ = jobs.score(raw, jobs.Fitted.load(spark, path))
    return _differences(before, after)


@query
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = views.flights(spark, sf_dir).drop("delay_probability")
    return jobs.evaluate(_model(spark, sf_dir), flights)


@query
def occlusion_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _model(spark, sf_dir)
    matrix = fitted.features.transform(views.flights(spark, sf_dir))
    return explain.occlusion(fitted.ensemble, matrix)


@query
def topk_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 of five given attribution columns per flight, as rows."""
    given = {
        "distance": (F.coalesce(number("distance_miles"), F.lit(800.0)) - 1450) / 1000,
        "prior_leg": F.coalesce(number("prior_leg_delay_minutes"), F.lit(0.0)) / 50,
        "delay": F.coalesce(number("dep_delay_minutes"), F.lit(0.0)) / 60,
        "score": F.col("delay_probability") - 0.5,
        "holiday": F.when(F.col("is_holiday"), 1.0).otherwise(-0.1),
    }
    columns = views.flights(spark, sf_dir).select("flight_id", *[v.alias(n) for n, v in given.items()])
    top = explain.top_attributions(columns, list(given), 3)
    return top.select("flight_id", F.explode(explain.ATTRIBUTIONS).alias("feature", "value"))


@query
def auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auc_roc(_labelled(spark, sf_dir)), "value")


@query
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_labelled(spark, sf_dir)), "value")


@query
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.brier_score(_labelled(spark, sf_dir)), "value")


# --- drift --------------------------------------------------------------------------


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.flights_ref(spark, sf_dir), views.flights_cur(spark, sf_dir)


@query
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.ks_drift(*_pair(spark, sf_dir)).select("feature", "statistic")


@query
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.ks_drift(*_pair(spark, sf_dir))


@query
def score_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.score_shift(*_pair(spark, sf_dir))


@query
def missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.missing_ratio(views.flights(spark, sf_dir))


def _joined_features(summary: DataFrame) -> DataFrame:
    return summary.withColumn("drifted_features", F.concat_ws(",", "drifted_features"))


@query
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_features(drift.drift_summary(*_pair(spark, sf_dir)))


@query
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor's stored baseline, its second run, and the JSON report it leaves."""
    ref, cur = _pair(spark, sf_dir)
    path = scratch_path(spark, "monitor")
    drift.DriftMonitor(spark, path).run(ref)
    drift.DriftMonitor(spark, path).run(cur)
    report = spark.read.json(f"{path}/reports")
    return report.select(
        "batch_size", "n_numeric_tested", "n_drifted", F.concat_ws(",", "drifted_features").alias("drifted_features"),
        "score_shift", "missing_ratio", "drift_detected",
    )


@query
def drift_first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monitor without a baseline keeps the batch as one and reports no drift."""
    ref, _ = _pair(spark, sf_dir)
    path = scratch_path(spark, "first-run")
    tests, summary = drift.DriftMonitor(spark, path).run(ref)
    kept = spark.read.parquet(f"{path}/baseline").where("feature = 'distance_miles'").agg(F.sum("n").alias("n_kept"))
    none = tests.agg(F.count(F.lit(1)).alias("n_tests"))
    return _joined_features(summary).crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(none))  # one row each


@query
def dataset_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.dataset_drift(drift.ks_drift(*_pair(spark, sf_dir))), "share_drifted")


@query
def drift_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.unix_seconds(flight.departure_time(F.col("scheduled_departure")).cast("timestamp"))
    return drift.drift_halves(views.flights(spark, sf_dir), order)


@query
def rejected_csv_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the lines of a CSV file, as it is written."""
    path = scratch_path(spark, "rejected") + ".csv"
    files.export(views.text_flights(spark, sf_dir), path, "csv")
    return validate.error_summary(files.read_flights(spark, path, keep_text=True))


@query
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested routes by what is wrong with them; NULL counts the good ones."""
    asked = views.raw_flights(spark, sf_dir).select(
        "origin", F.when(F.col("flight_id").isNotNull(), F.col("destination")).alias("destination")
    )
    good, bad = validate.validate_routes(asked)
    both = good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return both.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# --- paging, lineage and streams ------------------------------------------------------


@query
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = views.flights(spark, sf_dir).select("flight_id", "origin", "destination")
    return cumulative.page(flights, ["flight_id", "origin", "destination"], offset=1000, limit=500)


@query
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page but one hundred rows."""
    flights = views.flights(spark, sf_dir).select("flight_id", "origin", "destination")
    return cumulative.page(flights, ["origin", "flight_id"], offset=flights.count() - 600, limit=500)


@query
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flights, walked in pages of a fifth by an order key of few values."""
    flights = views.flights(spark, sf_dir).select("flight_id", "is_holiday")
    size = -(-flights.count() // 5)
    pages = [cumulative.page(flights, ["is_holiday"], i * size, size).withColumn("page", F.lit(i)) for i in range(5)]
    walked = reduce(DataFrame.unionAll, pages)
    return walked.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_pages"))


@query
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(views.lineage_edges(spark, sf_dir), "nation-3", depth=3)


def _stored(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "stream")
    branches.write(views.flights(spark, sf_dir), root)
    return root


@query
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = records.stream_records(spark, _stored(spark, sf_dir), files_per_chunk=2)
    sink = scratch_path(spark, "chunks")
    records.write_all(stream.select("flight_id", "carrier_code", "distance_miles"), sink)
    return (
        spark.read.parquet(sink)
        .groupBy("carrier_code")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("distance_miles").alias("miles"))
    )


@query
def stream_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber hears of a snapshot, an append, an update and a delete after its start."""
    root, checkpoint, sink = (scratch_path(spark, name) for name in ("subscribed", "subscriber", "commits"))
    # The first version stays as it is, so it serves as the table of flights.
    flights = spark.read.parquet(branches.write(views.derived_flights(spark, sf_dir).select(*_KEYED), root))

    def on_commit(rows: DataFrame, commit: branches.Commit) -> None:
        counted = rows.agg(
            F.lit(commit.version).alias("version"), F.lit(commit.number).alias("number"),
            F.count(F.lit(1)).alias("n_rows"), F.count("dep_delay_minutes").alias("n_delays"),
        )
        counted.write.mode("append").parquet(sink)

    records.subscribe(spark, root, on_commit, checkpoint)  # the baseline
    changes = _changes(flights)
    branches.write(flights.where("carrier_code = 'AA'"), root, mode="append")
    records.subscribe(spark, root, on_commit, checkpoint)
    branches.write(flights, root)
    branches.write(changes, root, mode="update", key="flight_id")
    branches.write(changes, root, mode="delete", key="flight_id")
    records.subscribe(spark, root, on_commit, checkpoint)
    return spark.read.schema("version int, number int, n_rows bigint, n_delays bigint").parquet(sink)


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights validated, featurised and tiered as a stream, on the given scores."""
    fitted, _ = _fitted_features(spark, sf_dir)
    stream = records.stream_records(spark, _stored(spark, sf_dir), files_per_chunk=2)
    tiered = scoring.tiers(scoring.prepare_stream(stream, fitted))
    sink = scratch_path(spark, "scored")
    records.write_all(
        tiered.select(
            "flight_id", "delay_tier", "departure_hour", "hour_bucket", "is_holiday", "flight_direction",
            r6("carrier_delay_rate").alias("carrier_delay_rate"), "is_regional",
            r6("prior_delay_log").alias("prior_delay_log"), "weather_severity",
        ),
        sink,
    )
    return spark.read.parquet(sink)


@query
def stream_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scoring path with the fitted ensemble, on a stream and as a batch."""
    fitted = _model(spark, sf_dir)
    stream = records.stream_records(spark, _stored(spark, sf_dir), files_per_chunk=2)
    sink = scratch_path(spark, "predictions")
    scored = scoring.score_stream(stream.drop("delay_probability"), fitted.features, fitted.ensemble)
    records.write_all(scored, sink)
    batch, _ = jobs.score(views.flights(spark, sf_dir).drop("delay_probability"), fitted)
    return _differences(spark.read.parquet(sink).drop("logged_at"), batch)


@query
def stream_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = records.stream_records(spark, _stored(spark, sf_dir), files_per_chunk=2)
    latest: dict[str, str] = {}

    def keep(counts: DataFrame, batch_id: int) -> None:
        latest["path"] = scratch_path(spark, f"histogram-{batch_id}")
        counts.write.parquet(latest["path"])

    running = scoring.running_counts(stream)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    running.writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    return scoring.cumulative_histogram(spark.read.parquet(latest["path"]))
