from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skylag.operators import features
from skylag.sources.schema import FLIGHT_SCHEMA, feature_columns, nan_to_null

COLUMNS = [f.name for f in FLIGHT_SCHEMA][:13]
ROWS = [
    ("AA-001", "AA", "ORD", "LAX", "2024-06-15T08:30:00", "B737", 1745.0, 8, 4, 6, False, 0.0, "clear"),
    ("DL-002", "DL", "ATL", "JFK", "2024-01-10T17:45:00", "A320", 880.0, 17, 2, 1, False, 45.0, "snow"),
]


@pytest.fixture(scope="module")
def two(spark):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FLIGHT_SCHEMA.fields[:13])
    return spark.createDataFrame(ROWS, schema)


@pytest.fixture(scope="module")
def matrix(two):
    return features.FlightFeatures().fit_transform(two)


def test_two_flights_by_hand(matrix):
    first, second = (r.asDict() for r in matrix.orderBy("flight_id").collect())
    expected = {
        "departure_hour": 8, "day_of_week": 5, "month": 6, "day_of_month": 15, "hour_bucket": 1.0,
        "is_weekend": 1, "quarter": 2, "is_holiday": 0, "is_peak_season": 1, "schedule_slot": 1,
        "is_hub_origin": 1, "is_hub_dest": 1, "is_hub_to_hub": 1, "distance_bucket": 2.0,
        "flight_direction": 1, "is_narrow_body": 1, "weather_severity": 0, "has_prior_delay": 0,
    }
    assert {k: first[k] for k in expected} == expected
    expected = {
        "departure_hour": 17, "day_of_week": 2, "hour_bucket": 3.0, "is_weekend": 0, "quarter": 1,
        "is_peak_season": 0, "schedule_slot": 4, "distance_bucket": 1.0, "flight_direction": 0,
        "has_prior_delay": 1, "weather_severity": 4,
    }
    assert {k: second[k] for k in expected} == expected
    assert second["prior_delay_log"] == pytest.approx(math.log(46))
    assert first["carrier_delay_rate"] == 0.22 and first["carrier_mean_delay"] == 32.0


def test_no_missing_values_and_all_features(matrix):
    columns = feature_columns(matrix)
    assert set(columns) == set(features.FEATURES)
    assert matrix.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict() == dict.fromkeys(
        columns, 0
    )


def test_unfitted_transform_raises(two):
    with pytest.raises(RuntimeError):
        features.FlightFeatures().transform(two)


def test_absent_columns_fall_back_to_constants(spark):
    bare = spark.createDataFrame([("X",)], "flight_id string")
    row = features.FlightFeatures().fit(bare).transform(bare).first().asDict()
    assert (row["hour_bucket"], row["is_weekend"], row["quarter"], row["is_holiday"]) == (0.0, 0, 1, 0)
    assert (row["schedule_slot"], row["is_hub_origin"], row["flight_direction"]) == (0, 0, 1)
    assert (row["distance_bucket"], row["distance_log"]) == (1.0, pytest.approx(math.log1p(800)))
    assert (row["carrier_delay_rate"], row["carrier_mean_delay"]) == (0.22, 32.0)
    assert (row["is_narrow_body"], row["is_wide_body"], row["is_regional"]) == (1, 0, 0)
    assert (row["prior_leg_delay_minutes"], row["has_prior_delay"], row["prior_delay_log"]) == (0.0, 0, 0.0)
    assert row["weather_severity"] == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame(
        [("AA", float("nan")), ("AA", 20.0), ("aa", None), (None, 15.0)], "carrier_code string, dep_delay_minutes double"
    )
    stats = {r["carrier_code"]: r for r in features.FlightFeatures().fit(df).stats.collect()}
    assert stats["AA"]["delay_rate"] == pytest.approx(1 / 3) and stats["AA"]["mean_delay"] == 20.0
    assert stats[None]["is_global"] == 1 and stats[None]["delay_rate"] == 0.5 and stats[None]["mean_delay"] == 17.5
    assert nan_to_null(df).where("dep_delay_minutes IS NULL").count() == 2


def test_holiday_modes(spark):
    df = spark.createDataFrame(
        [("2024-07-04T10:00:00", None), ("2024-07-05T10:00:00", None)], "scheduled_departure string, is_holiday boolean"
    )
    flags = lambda d: [r[0] for r in d.orderBy("scheduled_departure").select("is_holiday").collect()]
    assert flags(features.temporal_features(df, "auto")) == [1, 0]
    assert flags(features.temporal_features(df, "explicit")) == [0, 0]
    one_set = df.withColumn("is_holiday", F.when(F.col("scheduled_departure") > "2024-07-05", F.lit(True)))
    assert flags(features.temporal_features(one_set, "auto")) == [0, 1]
    assert flags(features.temporal_features(one_set, "derive")) == [1, 0]
    with pytest.raises(ValueError):
        features.temporal_features(df, "maybe")


def test_save_and_load(spark, two, matrix, tmp_path):
    fitted = features.FlightFeatures(holiday="derive").fit(two.withColumn("dep_delay_minutes", F.lit(30.0)))
    fitted.save(str(tmp_path / "stats"))
    loaded = features.FlightFeaturesModel.load(spark, str(tmp_path / "stats"))
    assert loaded.holiday == "derive" and (loaded.global_rate, loaded.global_mean) == (1.0, 30.0)
    assert sorted(loaded.stats.collect(), key=str) == sorted(fitted.stats.collect(), key=str)


def test_label_needs_a_source(two):
    with pytest.raises(ValueError):
        features.label_delayed(two)
    assert features.label_delayed(two, zero_if_unknown=True).where("is_delayed <> 0").count() == 0


def test_feature_plan_has_no_python_and_no_fact_shuffle(spark):
    from conftest import SF

    from skylag.plans import views

    flights = views.flights(spark, SF)
    fitted = features.FlightFeatures().fit(flights)
    scan = spark.read.schema(flights.schema).parquet(_written(flights))
    plan = fitted.transform(scan)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def _written(df):
    from skylag.sources.scratch import scratch_path

    path = scratch_path(df.sparkSession, "flights")
    df.write.parquet(path)
    return path
