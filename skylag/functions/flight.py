"""Scalar expressions over one flight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylag.functions import fixed
from skylag.functions.lookup import airport, flag, half_even, literal_map, literal_struct_map, lookup, number


def delayed(minutes: str | Column, threshold: float = fixed.DELAY_THRESHOLD) -> Column:
    """1 when the delay reaches the threshold; a missing delay counts as not delayed."""
    return flag(number(minutes) >= F.lit(float(threshold)))


# --- time -----------------------------------------------------------------


def departure_time(text: Column) -> Column:
    """Lenient parse: text that is not a timestamp becomes NULL."""
    return text.try_cast("timestamp_ntz")


def hour_bucket(hour: Column) -> Column:
    return (
        F.when((hour <= -1) | (hour > 23), None)
        .when(hour <= 5, 0.0)
        .when(hour <= 11, 1.0)
        .when(hour <= 13, 2.0)
        .when(hour <= 17, 3.0)
        .when(hour <= 20, 4.0)
        .when(hour <= 23, 5.0)
        .cast("double")
    )


def schedule_slot(hour: Column) -> Column:
    return (
        F.when(hour.between(0, 4), 0)
        .when(hour.between(5, 8), 1)
        .when(hour.between(9, 11), 2)
        .when(hour.between(12, 16), 3)
        .when(hour.between(17, 19), 4)
        .when(hour.between(20, 23), 5)
        .otherwise(3)
    )


def quarter(month: Column) -> Column:
    return F.ceil(month / 3).cast("int")


def holiday_by_date(month: Column, day: Column) -> Column:
    dates = [m * 100 + d for m, d in fixed.HOLIDAYS]
    return flag((month * 100 + day).isin(dates))


# --- route ----------------------------------------------------------------


def hub(code: Column) -> Column:
    return flag(F.upper(code).isin(*fixed.HUBS))


def distance_bucket(miles: Column) -> Column:
    return (
        F.when(miles <= -1, None).when(miles <= 500, 0.0).when(miles <= 1500, 1.0).when(miles > 1500, 2.0)
        .cast("double")
    )


def _delta(origin: Column, destination: Column, axis: str) -> Column:
    at = lambda code: F.coalesce(airport(code)[axis], F.lit(0.0))
    return at(destination) - at(origin)


def direction(origin: Column, destination: Column) -> Column:
    """0 east, 1 west, 2 north, 3 south; airports that are not known sit at (0, 0)."""
    lon, lat = _delta(origin, destination, "lon"), _delta(origin, destination, "lat")
    return F.when(
        F.abs(lon) >= F.abs(lat), F.when(lon > 0, 0).otherwise(1)
    ).otherwise(F.when(lat > 0, 2).otherwise(3))


def eastbound(origin: Column, destination: Column) -> Column:
    return _delta(origin, destination, "lon") > 0


# --- aircraft and weather ---------------------------------------------------


def body_flags(aircraft: Column) -> dict[str, Column]:
    code = F.coalesce(F.upper(aircraft), F.lit(""))
    narrow, wide = code.isin(*fixed.NARROW_BODIES), code.isin(*fixed.WIDE_BODIES)
    return {
        "is_narrow_body": flag(narrow),
        "is_wide_body": flag(wide),
        "is_regional": flag(~narrow & ~wide),
    }


def weather_ordinal(weather: Column) -> Column:
    return lookup(F.lower(weather), fixed.WEATHER_ORDINAL, 0)


def weather_factor(weather: Column) -> Column:
    return lookup(F.lower(weather), fixed.WEATHER_FACTOR, fixed.DEFAULT_WEATHER_FACTOR)


# --- weather impact -----------------------------------------------------------


def impact_columns(weather: Column, hour: Column, holiday: Column) -> dict[str, Column]:
    """Operating impact of a weather word at an hour; all NULL for an unknown word."""
    row = literal_struct_map(fixed.WEATHER_IMPACT, ("multiplier", "minutes", "severity"))[
        F.lower(F.coalesce(weather, F.lit("clear")))
    ]
    hour = F.coalesce(hour, F.lit(12))
    peak = hour.between(6, 9) | hour.between(16, 20)
    multiplier = (
        row["multiplier"]
        * F.when(peak, fixed.IMPACT_PEAK_MULTIPLIER).otherwise(1.0)
        * F.when(F.coalesce(holiday.cast("boolean"), F.lit(False)), fixed.IMPACT_HOLIDAY_MULTIPLIER).otherwise(1.0)
    )
    on_time = F.greatest(F.lit(fixed.IMPACT_ON_TIME_FLOOR), F.lit(fixed.IMPACT_ON_TIME_PCT) / multiplier)
    return {
        "delay_multiplier": half_even(multiplier, 3),
        "avg_added_delay_min": half_even(row["minutes"] * (multiplier / row["multiplier"]), 1),
        "adjusted_on_time_pct": F.when(multiplier.isNotNull(), half_even(on_time, 1)),
        "severity": row["severity"],
        "recommendation": F.when(multiplier.isNotNull(), advice(multiplier)),
    }


def advice(multiplier: Column) -> Column:
    *bounded, (_, last) = fixed.ADVICE
    (bound, text), *rest = bounded
    case = F.when(multiplier < bound, text)
    for bound, text in rest:
        case = case.when(multiplier < bound, text)
    return case.otherwise(last)


# --- score ------------------------------------------------------------------


def delay_tier(probability: Column, cuts: tuple[float, float, float] = fixed.MODEL_TIER_CUTS) -> Column:
    severe, moderate, minor = cuts
    top, second, third, rest = fixed.TIERS
    return (
        F.when(probability >= severe, top)
        .when(probability >= moderate, second)
        .when(probability >= minor, third)
        .otherwise(rest)
    )


def expected_minutes(
    probability: Column,
    method: str = "tier",
    cuts: tuple[float, float, float] = fixed.MODEL_TIER_CUTS,
) -> Column:
    """Minutes from the tier table, or proportional to the probability."""
    if method == "tier":
        return literal_map(fixed.TIER_MINUTES)[delay_tier(probability, cuts)]
    if method == "linear":
        return half_even(probability * fixed.MINUTES_PER_UNIT_PROBABILITY, 1)
    raise ValueError(f"method must be 'tier' or 'linear', not {method!r}")


def soft_vote(*probabilities: Column, weights: tuple[float, ...] = fixed.VOTE_WEIGHTS) -> Column:
    total = sum(weights)
    votes = [p * F.lit(w / total) for p, w in zip(probabilities, weights, strict=True)]
    out = votes[0]
    for vote in votes[1:]:
        out = out + vote
    return out
