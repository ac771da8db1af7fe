from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skylag.operators import impact, risk, stats


def _contexts(spark, *rows):
    return spark.createDataFrame(rows, "carrier_code string, departure_hour int, weather_condition string")


def test_carrier_without_history_by_hand(spark):
    rows = risk.carrier_risk(None, _contexts(spark, ("aa", None, None), ("AA", 8, "snow"))).collect()
    by_hour = {r["departure_hour"]: r for r in rows}
    assert by_hour[None]["risk_score"] == 0.1929
    assert by_hour[8]["risk_score"] == 0.4295
    assert (by_hour[8]["sample_size"], by_hour[8]["mean_delay_minutes"], by_hour[8]["p90_delay_minutes"]) == (0, 32.0, 75.0)
    assert by_hour[8]["breakdown"].asDict() == {
        "historical_component": 0.109, "weather_component": 0.1063, "congestion_component": 0.2143,
    }


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        risk.carrier_risk(None, _contexts(spark, ("AA", 8, "snow")), weights=(0.5, 0.5, 0.5))


def test_history_joins_contexts_and_keeps_unknown_carriers(spark):
    flights = spark.createDataFrame([("AA", 20.0), ("AA", 0.0), ("aa", 40.0)], "carrier_code string, dep_delay_minutes double")
    history = stats.carrier_history(flights)
    rows = {r["carrier_code"]: r for r in risk.carrier_risk(history, _contexts(spark, ("AA", None, None), ("ZZ", None, None))).collect()}
    assert rows["AA"]["sample_size"] == 3 and rows["AA"]["base_delay_rate"] == 0.6667
    assert rows["AA"]["mean_delay_minutes"] == 30.0 and rows["AA"]["p90_delay_minutes"] == 38.0
    assert rows["ZZ"]["sample_size"] == 0 and rows["ZZ"]["base_delay_rate"] == 0.22


def test_carrier_never_delayed(spark):
    flights = spark.createDataFrame([("AA", 3.0), ("AA", None)], "carrier_code string, dep_delay_minutes double")
    row = stats.carrier_history(flights).first()
    assert (row["sample_size"], row["delay_rate"], row["mean_delay_minutes"], row["p90_delay_minutes"]) == (2, 0.0, 0.0, 0.0)


def test_route_without_history_by_hand(spark):
    routes = spark.createDataFrame([("ord", "LAX")], "origin string, destination string")
    row = risk.route_risk(None, routes).first()
    assert row["risk_score"] == 0.2538 and row["is_hub_to_hub"] and not row["is_eastbound"]
    assert row["route_distance_miles"] is None and row["sample_size"] == 0


def test_percentiles_against_pandas_on_skewed_continuous_delays(spark):
    """A third of all rows in one carrier, and nearly as many values as rows."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "AA").otherwise(F.concat(F.lit("C"), F.col("id") % 7)).alias("carrier_code"),
        (F.pow(F.rand(3), F.lit(3.0)) * 400 - 10).alias("dep_delay_minutes"),
        F.lit("ORD").alias("origin"),
        F.lit("LAX").alias("destination"),
        F.when(F.col("id") % 5 > 0, F.rand(4) * 1000).alias("distance_miles"),
    )
    path = _written(df)
    df = spark.read.parquet(path)
    pdf = df.toPandas()
    late = pdf[pdf.dep_delay_minutes >= 15]
    expected = late.groupby("carrier_code").dep_delay_minutes.quantile(0.9)
    rows = stats.carrier_history(df).collect()
    assert len(rows) == 8
    for r in rows:
        assert r["p90_delay_minutes"] == pytest.approx(expected[r["carrier_code"]], abs=1e-9)
    route = stats.route_history(df).first()
    assert route["sample_size"] == 30_000
    assert route["p90_delay_minutes"] == pytest.approx(late.dep_delay_minutes.quantile(0.9), abs=1e-9)
    assert route["route_distance_miles"] == pytest.approx(pdf.distance_miles.median(), abs=1e-9)


def _written(df):
    from skylag.sources.scratch import scratch_path

    path = scratch_path(df.sparkSession, "flights")
    df.write.parquet(path)
    return path


def test_weather_impact_by_hand(spark):
    df = spark.createDataFrame(
        [("snow", 8, True), (None, None, None), ("hail", 8, True)],
        "weather_condition string, departure_hour int, is_holiday boolean",
    )
    known, unknown = impact.weather_impact(df)
    rows = {r["weather_condition"]: r for r in known.collect()}
    snow, clear = rows["snow"], rows[None]
    assert (snow["delay_multiplier"], snow["avg_added_delay_min"], snow["adjusted_on_time_pct"]) == (3.081, 83.5, 26.6)
    assert snow["severity"] == "severe" and snow["recommendation"].startswith("Severe")
    assert (clear["delay_multiplier"], clear["adjusted_on_time_pct"], clear["severity"]) == (1.0, 82.0, "none")
    assert [r["weather_condition"] for r in unknown.collect()] == ["hail"]
