"""The feature matrix: fit carrier statistics, then derive features from flights.

Every group tests which columns the table has when the plan is built and falls back
to a constant for an absent one. Apart from one lookup join on the fitted statistics
the whole transform is a projection, so it runs inside the scan stage and on streams.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.functions import fixed, flight
from skylag.functions.lookup import flag, number
from skylag.operators.stats import fit_stats
from skylag.sources.scratch import materialize

HOLIDAY_MODES = ("auto", "explicit", "derive")

FEATURES = (
    "distance_miles", "departure_hour", "day_of_week", "month", "is_holiday",
    "prior_leg_delay_minutes", "day_of_month", "hour_bucket", "is_weekend", "quarter",
    "is_peak_season", "schedule_slot", "is_hub_origin", "is_hub_dest", "is_hub_to_hub",
    "distance_bucket", "distance_log", "flight_direction", "carrier_delay_rate",
    "carrier_mean_delay", "is_narrow_body", "is_wide_body", "is_regional",
    "has_prior_delay", "prior_delay_log", "weather_severity",
)


def _column(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _derive_holiday(df: DataFrame, holiday: str) -> bool:
    if "is_holiday" not in df.columns or holiday == "derive":
        return True
    if holiday == "explicit":
        return False
    if df.isStreaming:
        raise ValueError("holiday='auto' looks at the whole table; use 'explicit' or 'derive' on a stream")
    # Stops at the first flag found instead of counting them all.
    return df.where(F.col("is_holiday").isNotNull()).select("is_holiday").isEmpty()


def temporal_features(df: DataFrame, holiday: str = "auto") -> DataFrame:
    if holiday not in HOLIDAY_MODES:
        raise ValueError(f"holiday must be one of {HOLIDAY_MODES}, not {holiday!r}")
    derive = _derive_holiday(df, holiday)
    has_time = "scheduled_departure" in df.columns
    if has_time:
        time = flight.departure_time(F.col("scheduled_departure"))
        df = df.withColumn("_time", time).withColumns(
            {
                "departure_hour": F.hour("_time"),
                "day_of_week": F.weekday("_time"),
                "month": F.month("_time"),
                "day_of_month": F.day("_time"),
            }
        )
    hour = _column(df, "departure_hour", 0)
    month = _column(df, "month", 1)
    if derive:
        holiday_flag = flight.holiday_by_date(F.col("month"), F.col("day_of_month")) if has_time else F.lit(0)
    else:
        holiday_flag = F.coalesce(F.col("is_holiday").cast("int"), F.lit(0))
    return df.withColumns(
        {
            "hour_bucket": flight.hour_bucket(hour),
            "is_weekend": flag(_column(df, "day_of_week", 0) >= 5),
            "quarter": flight.quarter(month),
            "is_holiday": holiday_flag,
            "is_peak_season": flag(month.isin(*fixed.PEAK_MONTHS)),
        }
    ).drop("_time")


def schedule_slot(df: DataFrame) -> DataFrame:
    return df.withColumn("schedule_slot", flight.schedule_slot(_column(df, "departure_hour", 0)))


def route_features(df: DataFrame) -> DataFrame:
    origin, destination = _column(df, "origin", ""), _column(df, "destination", "")
    miles = F.coalesce(number(_column(df, "distance_miles", None)), F.lit(800.0))
    from_hub, to_hub = flight.hub(origin), flight.hub(destination)
    return df.withColumns(
        {
            "is_hub_origin": from_hub,
            "is_hub_dest": to_hub,
            "is_hub_to_hub": from_hub * to_hub,
            "distance_bucket": flight.distance_bucket(miles),
            "distance_log": F.log1p(miles),
            "flight_direction": flight.direction(origin, destination),
        }
    )


def carrier_features(
    df: DataFrame, stats: DataFrame, global_rate: float, global_mean: float
) -> DataFrame:
    """Left lookup of the fitted statistics by upper-cased carrier code.

    `stats` is a stored table, so its size is known to the planner: it is broadcast
    below the session's broadcast limit and shuffled above it.
    """
    if "carrier_code" not in df.columns:
        return df.withColumns(
            {"carrier_delay_rate": F.lit(global_rate), "carrier_mean_delay": F.lit(global_mean)}
        )
    table = stats.where(F.col("is_global") == 0).select(
        F.col("carrier_code").alias("_code"), "delay_rate", "mean_delay"
    )
    return (
        df.join(table, F.upper("carrier_code") == F.col("_code"), "left")
        .withColumns(
            {
                "carrier_delay_rate": F.coalesce("delay_rate", F.lit(global_rate)),
                "carrier_mean_delay": F.coalesce("mean_delay", F.lit(global_mean)),
            }
        )
        .drop("_code", "delay_rate", "mean_delay")
    )


def aircraft_features(df: DataFrame) -> DataFrame:
    if "aircraft_type" not in df.columns:
        return df.withColumns(
            {"is_narrow_body": F.lit(1), "is_wide_body": F.lit(0), "is_regional": F.lit(0)}
        )
    return df.withColumns(flight.body_flags(F.col("aircraft_type")))


def chaining_features(df: DataFrame) -> DataFrame:
    prior = F.greatest(F.coalesce(number(_column(df, "prior_leg_delay_minutes", None)), F.lit(0.0)), F.lit(0.0))
    return df.withColumns(
        {
            "prior_leg_delay_minutes": prior,
            "has_prior_delay": flag(prior > 0),
            "prior_delay_log": F.log1p(prior),
        }
    )


def weather_features(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "weather_severity", flight.weather_ordinal(_column(df, "weather_condition", None).cast("string"))
    )


class FlightFeatures(Estimator):
    """Learns delay statistics per carrier; `fit` scans the table once."""

    def __init__(self, threshold: float = fixed.DELAY_THRESHOLD, holiday: str = "auto"):
        super().__init__()
        self.threshold = threshold
        self.holiday = holiday

    def _fit(self, df: DataFrame) -> FlightFeaturesModel:
        usable = "carrier_code" in df.columns and (
            "dep_delay_minutes" in df.columns or "is_delayed" in df.columns
        )
        if usable:
            stats = fit_stats(df, self.threshold)
        else:
            stats = df.sparkSession.createDataFrame(
                [], "carrier_code string, is_global int, n bigint, delay_rate double, mean_delay double"
            )
        return FlightFeaturesModel(materialize(stats, "carrier-stats"), self.holiday)

    def transform(self, df: DataFrame) -> DataFrame:
        raise RuntimeError("FlightFeatures is not fitted: call fit() and transform with its result")

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class FlightFeaturesModel(Model):
    """Applies the feature groups with fitted statistics (`stats`, a small stored table)."""

    def __init__(self, stats: DataFrame, holiday: str = "auto"):
        super().__init__()
        self.stats = stats
        self.holiday = holiday
        # The one global row; an empty fit leaves the defaults.
        row = stats.where(F.col("is_global") == 1).select("delay_rate", "mean_delay").first()
        known = lambda i, default: default if row is None or row[i] is None else row[i]
        self.global_rate = known(0, fixed.DEFAULT_BASE_RATE)
        self.global_mean = known(1, fixed.DEFAULT_MEAN_DELAY)

    def _transform(self, df: DataFrame) -> DataFrame:
        df = temporal_features(df, self.holiday)
        df = schedule_slot(df)
        df = route_features(df)
        df = carrier_features(df, self.stats, self.global_rate, self.global_mean)
        df = aircraft_features(df)
        df = chaining_features(df)
        return weather_features(df)

    def with_holiday(self, holiday: str) -> FlightFeaturesModel:
        return FlightFeaturesModel(self.stats, holiday)

    def save(self, path: str) -> None:
        self.stats.withColumn("holiday", F.lit(self.holiday)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlightFeaturesModel:
        table = spark.read.parquet(path)
        mode = table.select("holiday").first()
        return cls(table.drop("holiday"), "auto" if mode is None else mode[0])


def feature_value(df: DataFrame, name: str) -> Column:
    """The column as a model input: absent or unreadable values become 0."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(number(F.col(name).try_cast("double")), F.lit(0.0))


def align_features(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly these numeric columns, after the ones to keep as they are."""
    return df.select(*(keep or []), *[feature_value(df, c).alias(c) for c in columns])


def label_delayed(
    df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD, zero_if_unknown: bool = False
) -> DataFrame:
    """Add `is_delayed` where absent, from the actual or the departure delay."""
    if "is_delayed" in df.columns:
        return df
    for source in ("actual_delay_minutes", "dep_delay_minutes"):
        if source in df.columns:
            return df.withColumn("is_delayed", flight.delayed(source, threshold))
    if zero_if_unknown:
        return df.withColumn("is_delayed", F.lit(0))
    raise ValueError("no label: the table has neither is_delayed nor a delay column")
