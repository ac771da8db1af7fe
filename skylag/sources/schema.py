"""The flight record and its ingest rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.functions import fixed

FLIGHT_SCHEMA = T.StructType(
    [
        T.StructField("flight_id", T.StringType()),
        T.StructField("carrier_code", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("scheduled_departure", T.StringType()),
        T.StructField("aircraft_type", T.StringType()),
        T.StructField("distance_miles", T.DoubleType()),
        T.StructField("departure_hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("is_holiday", T.BooleanType()),
        T.StructField("prior_leg_delay_minutes", T.DoubleType()),
        T.StructField("weather_condition", T.StringType()),
        T.StructField("dep_delay_minutes", T.DoubleType()),
        T.StructField("actual_delay_minutes", T.DoubleType()),
        T.StructField("is_delayed", T.IntegerType()),
        T.StructField("delay_probability", T.DoubleType()),
    ]
)

LABEL = "is_delayed"
# A label is derived from these; as model inputs they would leak it.
LABEL_SOURCES = ("dep_delay_minutes", "actual_delay_minutes", LABEL)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, the one missing value of this library."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns(
        {c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}
    )


def typed(df: DataFrame) -> DataFrame:
    """Cast the known columns that are still text to their types; bad text becomes NULL."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    known = {f.name: f.dataType for f in FLIGHT_SCHEMA if f.name in text}
    return df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of a numeric type, in table order; booleans are not numbers."""
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def feature_columns(df: DataFrame) -> list[str]:
    return numeric_columns(df, (*fixed.NON_FEATURES, *LABEL_SOURCES))
