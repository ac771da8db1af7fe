"""Operating impact of the weather on each flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.functions import fixed
from skylag.functions.flight import impact_columns


def weather_impact(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flights with impact columns, flights whose weather word is unknown).

    Reads `weather_condition`, `departure_hour` and `is_holiday`; absent or NULL ones
    count as clear, noon and no holiday. Both results are projections of one scan.
    """
    have = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    columns = impact_columns(
        have("weather_condition", "string"), have("departure_hour", "int"), have("is_holiday", "boolean")
    )
    word = F.lower(F.coalesce(have("weather_condition", "string"), F.lit("clear")))
    known = word.isin(*fixed.WEATHER_IMPACT)
    return df.where(known).withColumns(columns), df.where(~known)
