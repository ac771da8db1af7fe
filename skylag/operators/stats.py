"""Delay statistics per carrier and per route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylag.functions import fixed
from skylag.functions.flight import delayed
from skylag.functions.lookup import flag, half_even, number
from skylag.operators.cumulative import cumulative_counts, linear_percentile


def _by_carrier(df: DataFrame, threshold: float) -> DataFrame:
    """(carrier_code, n, n_delayed, delay_sum): everything later figures derive from."""
    late = delayed("dep_delay_minutes", threshold)
    return df.groupBy(F.upper("carrier_code").alias("carrier_code")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(late).alias("n_delayed"),
        F.sum(F.when(late == 1, number("dep_delay_minutes"))).alias("delay_sum"),
    )


def fit_stats(df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD) -> DataFrame:
    """Delay rate and mean delay per carrier, and one global row (`is_global` = 1).

    The table is aggregated once by carrier; the global row adds up those few rows,
    so the flights themselves are never expanded for a second grouping. Without delay
    minutes the rates come from `is_delayed`, and means stay at their default.
    """
    if "dep_delay_minutes" in df.columns:
        per = _by_carrier(df, threshold)
    else:
        label = number("is_delayed")
        per = df.groupBy(F.upper("carrier_code").alias("carrier_code")).agg(
            F.count(label).alias("n"),
            F.sum(label).alias("n_delayed"),
            F.lit(None).cast("double").alias("delay_sum"),
        )
    both = per.rollup("carrier_code").agg(
        F.grouping("carrier_code").cast("int").alias("is_global"),
        F.sum("n").alias("n"),
        F.sum("n_delayed").alias("n_delayed"),
        F.sum("delay_sum").alias("delay_sum"),
    )
    mean = F.try_divide("delay_sum", "n_delayed")
    default = F.when(F.col("is_global") == 1, fixed.DEFAULT_MEAN_DELAY)
    if "dep_delay_minutes" in df.columns:
        default = default.otherwise(0.0)
    return both.where((F.col("is_global") == 1) | F.col("carrier_code").isNotNull()).select(
        "carrier_code",
        "is_global",
        "n",
        F.try_divide("n_delayed", "n").cast("double").alias("delay_rate"),
        F.coalesce(mean, default).cast("double").alias("mean_delay"),
    )


def carrier_delay_rate(df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD) -> DataFrame:
    per = _by_carrier(df.where(F.col("carrier_code").isNotNull()), threshold)
    return per.select("carrier_code", (F.col("n_delayed") / F.col("n")).alias("delay_rate"))


def carrier_mean_delay(df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD) -> DataFrame:
    per = _by_carrier(df.where(F.col("carrier_code").isNotNull()), threshold)
    mean = F.coalesce(F.try_divide("delay_sum", "n_delayed"), F.lit(0.0))
    return per.select("carrier_code", mean.alias("mean_delay"))


def _history(counts: DataFrame, keys: list[str], value: str, extra=()) -> DataFrame:
    """Rate, mean and exact p90 of the delayed values from (keys, value, n, n_late)."""
    mean = F.try_divide(F.sum(F.col(value) * F.col("n_late")), F.sum("n_late"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("sample_size"),
        (F.sum("n_late") / F.sum("n")).alias("delay_rate"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_delay_minutes"),
        F.coalesce(linear_percentile(value, "n_late", 0.9), F.lit(0.0)).alias("p90_delay_minutes"),
        *extra,
    )


def carrier_history(df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD) -> DataFrame:
    """Flights, delay rate, mean and exact 90th percentile of delays per carrier."""
    counts = (
        df.where(F.col("carrier_code").isNotNull())
        .groupBy(
            F.upper("carrier_code").alias("carrier_code"),
            number("dep_delay_minutes").alias("minutes"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_late", delayed("minutes", threshold) * F.col("n"))
    )
    return _history(
        cumulative_counts(counts, ["carrier_code"], "minutes", ["n", "n_late"]),
        ["carrier_code"],
        "minutes",
    )


def route_history(df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD) -> DataFrame:
    """The same per route, with the exact median distance.

    Delays and distances go through one scan and one cumulative table, told apart by
    `measure`; only the delay rows count as flights.
    """
    has_distance = "distance_miles" in df.columns
    distance = number("distance_miles") if has_distance else F.lit(None).cast("double")
    entry = lambda name, col: F.struct(F.lit(name).alias("measure"), col.alias("value"))
    counts = (
        df.where(F.col("origin").isNotNull() & F.col("destination").isNotNull())
        .select(
            F.upper("origin").alias("origin"),
            F.upper("destination").alias("destination"),
            F.inline(F.array(entry("delay", number("dep_delay_minutes")), entry("miles", distance))),
        )
        .groupBy("origin", "destination", "measure", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    is_delay = F.col("measure") == "delay"
    counts = counts.select(
        "origin",
        "destination",
        "measure",
        "value",
        F.when(is_delay, F.col("rows")).otherwise(0).alias("n"),
        # The rows whose percentile is taken: delayed ones, or those with a distance.
        (
            F.when(is_delay, delayed("value", threshold)).otherwise(flag(F.col("value").isNotNull()))
            * F.col("rows")
        ).alias("ranked"),
    )
    table = cumulative_counts(
        counts, ["origin", "destination", "measure"], "value", ["n", "ranked"]
    )
    per_measure = table.groupBy("origin", "destination", "measure").agg(
        F.sum("n").alias("n"),
        F.sum("ranked").alias("ranked"),
        F.sum(F.col("value") * F.col("ranked")).alias("value_sum"),
        linear_percentile("value", "ranked", 0.9).alias("p90"),
        linear_percentile("value", "ranked", 0.5).alias("median"),
    )
    pick = lambda measure, col: F.max(F.when(F.col("measure") == measure, F.col(col)))
    mean = F.try_divide(pick("delay", "value_sum"), pick("delay", "ranked"))
    return per_measure.groupBy("origin", "destination").agg(
        F.sum("n").alias("sample_size"),
        (pick("delay", "ranked") / F.sum("n")).alias("delay_rate"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_delay_minutes"),
        F.coalesce(pick("delay", "p90"), F.lit(0.0)).alias("p90_delay_minutes"),
        pick("miles", "median").alias("route_distance_miles"),
    )


def delay_stats(
    df: DataFrame, carrier: str | None = None, threshold: float = fixed.DELAY_THRESHOLD
) -> DataFrame:
    """On-time share and mean delay per carrier, and for all flights (`carrier` NULL)."""
    stats = fit_stats(df, threshold)
    if carrier is not None:
        stats = stats.where((F.col("is_global") == 1) | (F.col("carrier_code") == carrier.upper()))
    return stats.select(
        F.col("carrier_code").alias("carrier"),
        half_even((1 - F.col("delay_rate")) * 100, 1).alias("on_time_pct"),
        half_even("mean_delay", 1).alias("avg_delay_min"),
    )


def class_weights(df: DataFrame, label: str = "is_delayed") -> DataFrame:
    """Count, share and balanced weight n / (classes * n_c) of each label value."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy(F.lit(0))  # one row per class by now
    total, n_classes = F.sum("n").over(classes), F.count(F.lit(1)).over(classes)
    return counts.select(
        label,
        "n",
        (F.col("n") / total).alias("share"),
        (total / (n_classes * F.col("n"))).alias("weight"),
    )


def score_histogram(
    df: DataFrame, column: str = "delay_probability", edges: tuple[float, ...] = fixed.HISTOGRAM_EDGES
) -> DataFrame:
    """Cumulative counts (`le`, `n`) in one aggregation; `+Inf` counts every score."""
    bounds = [(str(e), F.col(column) <= e) for e in edges]
    bounds.append(("+Inf", F.col(column).isNotNull()))
    row = df.agg(*[F.coalesce(F.sum(flag(c)), F.lit(0)).alias(name) for name, c in bounds])
    pairs = [F.struct(F.lit(name).alias("le"), F.col(f"`{name}`").alias("n")) for name, _ in bounds]
    return row.select(F.inline(F.array(*pairs)))


def mean_score(df: DataFrame, column: str = "delay_probability") -> DataFrame:
    return df.agg(
        F.coalesce(F.avg(column), F.lit(fixed.MEAN_SCORE_WHEN_EMPTY)).alias("mean_score")
    )
