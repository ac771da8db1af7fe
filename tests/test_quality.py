from __future__ import annotations

import pytest

from skylag.operators import quality, validate
from skylag.sources.files import enforce_schema

GOOD = ("F1", "AA", "ORD", "LAX", "2024-06-15T08:30:00", 1745.0, 8, 4, 6, 0.0, "clear")
SCHEMA = (
    "flight_id string, carrier_code string, origin string, destination string, scheduled_departure string, "
    "distance_miles double, departure_hour int, day_of_week int, month int, prior_leg_delay_minutes double, "
    "weather_condition string"
)


def _row(**changes):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD, strict=True))


@pytest.mark.parametrize(
    ("changes", "field"),
    [
        ({"flight_id": None}, "flight_id"),
        ({"departure_hour": 25}, "departure_hour"),
        ({"weather_condition": "tornado"}, "weather_condition"),
        ({"weather_condition": "Snow"}, "weather_condition"),
        ({"origin": "OR"}, "origin"),
        ({"prior_leg_delay_minutes": -5.0}, "prior_leg_delay_minutes"),
        ({"distance_miles": 0.0}, "distance_miles"),
        ({"month": 0}, "month"),
        ({"day_of_week": 7}, "day_of_week"),
    ],
)
def test_broken_rules(spark, changes, field):
    valid, rejected = validate.validate(spark.createDataFrame([_row(**changes), GOOD], SCHEMA))
    assert valid.count() == 1
    assert [e["field"] for e in rejected.first()["errors"]] == [field]


def test_lower_case_carrier_and_nulls_are_fine(spark):
    row = _row(carrier_code="aa", distance_miles=None, departure_hour=None, weather_condition=None)
    valid, rejected = validate.validate(spark.createDataFrame([row], SCHEMA))
    assert rejected.isEmpty()
    filled = validate.fill_defaults(valid).first()
    assert (filled["departure_hour"], filled["weather_condition"], filled["aircraft_type"]) == (12, "clear", "unknown")
    assert filled["distance_miles"] is None and filled["is_holiday"] is False


def test_text_columns_are_read_as_numbers(spark):
    text = spark.createDataFrame([GOOD, _row(flight_id="F2")], SCHEMA).selectExpr(
        "flight_id", "carrier_code", "origin", "destination", "scheduled_departure",
        "CASE WHEN flight_id = 'F2' THEN 'far' ELSE '12.5' END AS distance_miles", "'8' AS departure_hour",
    )
    valid, rejected = validate.validate(text)
    assert valid.first()["distance_miles"] == 12.5 and valid.first()["departure_hour"] == 8
    assert rejected.first()["errors"][0]["message"] == validate.BAD_NUMBER


def test_missing_required_column(spark):
    _, rejected = validate.validate(spark.createDataFrame([("F1",)], "flight_id string"))
    assert len(rejected.first()["errors"]) == 4


def test_route_requests(spark):
    df = spark.createDataFrame([("ORD", "LAX"), ("", "LAX"), ("ORDX", "LAX"), (None, None)], "origin string, destination string")
    good, bad = validate.validate_routes(df)
    assert good.count() == 1
    assert sorted(r["error"] for r in bad.collect()) == sorted(
        [validate.ROUTE_REQUIRED, validate.ROUTE_LENGTH, validate.ROUTE_REQUIRED]
    )


def test_quality_issues(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (None, 2), (None, 3)], "a double, b int")
    report = quality.data_quality(df, required=["a", "missing_col"])
    failed = {(r["check"], r["column"], r["value"]) for r in report.collect() if not r["passed"]}
    assert failed == {("required_column", "missing_col", 0.0), ("duplicate_rows", None, 1.0)}
    assert quality.passed(report).first().asDict() == {"passed": False, "n_issues": 2}


def test_quality_of_clean_and_empty_tables(spark):
    clean = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, b string")
    assert quality.passed(quality.data_quality(clean, ["a", "b"])).first()["passed"]
    empty = quality.data_quality(clean.where("a > 9")).collect()
    assert [(r["check"], r["passed"]) for r in empty if not r["passed"]] == [("row_count", False)]


def test_duplicates_treat_null_and_nan_as_equal(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 1.0), ("x", float("nan")), ("x", float("nan")), ("x", 0.0), ("x", -0.0)], "a string, b double"
    )
    assert quality.duplicate_rows(df).first()[0] == 3


def test_one_row_repeated_in_a_third_of_the_table(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "'text' AS t")
    assert quality.duplicate_rows(df).first()[0] == 9_999


def test_schema_order_and_missing_column(spark):
    df = spark.createDataFrame([(0, 2, 1)], "extra int, b int, a int")
    assert enforce_schema(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        enforce_schema(df, ["a", "c"])
