"""The registered queries again, as plain SQL over the base tables."""

from __future__ import annotations

from skylag.functions import fixed
from skylag.operators import validate
from skylag.plans.views import ctes


def _values(rows) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def even(expr: str, digits: int) -> str:
    """Rounding of the binary value, ties to even (a cast to an integer does that)."""
    scale = f"1e{digits}::DOUBLE"
    return f"CAST(CAST(({expr}) * {scale} AS BIGINT) / {scale} AS DOUBLE)"


AIRPORTS = "airports(code, lon, lat) AS (VALUES " + _values((c, *p) for c, p in fixed.AIRPORTS.items()) + ")"
HUBS = "hubs(code) AS (VALUES " + _values((c,) for c in fixed.HUBS) + ")"
CARRIERS = (
    "carriers(code, base_rate, sensitivity) AS (VALUES "
    + _values((c, r, fixed.CARRIER_WEATHER_SENSITIVITY[c]) for c, r in fixed.CARRIER_BASE_RATES.items())
    + ")"
)
WEATHER = (
    "weather(word, ordinal, factor, multiplier, minutes, severity) AS (VALUES "
    + _values((w, o, fixed.WEATHER_FACTOR[w], *fixed.WEATHER_IMPACT[w]) for w, o in fixed.WEATHER_ORDINAL.items())
    + ")"
)

FLIGHTS = ctes("flights")
RAW = ctes("flights", "raw_flights")
PAIR = ctes("flights", "flights_ref", "flights_cur")

LATE = "CASE WHEN dep_delay_minutes >= 15 THEN 1 ELSE 0 END"
HISTORY = f"""
  count(*) AS sample_size,
  avg({LATE}) AS delay_rate,
  coalesce(avg(dep_delay_minutes) FILTER (WHERE dep_delay_minutes >= 15), 0) AS mean_delay_minutes,
  coalesce(quantile_cont(dep_delay_minutes, 0.9) FILTER (WHERE dep_delay_minutes >= 15), 0) AS p90_delay_minutes
"""
CARRIER_HISTORY = f"""history AS (
  SELECT upper(carrier_code) AS carrier_code, {HISTORY}
  FROM flights WHERE carrier_code IS NOT NULL GROUP BY 1)"""
ROUTE_HISTORY = f"""history AS (
  SELECT upper(origin) AS origin, upper(destination) AS destination, {HISTORY},
         median(distance_miles) AS route_distance_miles
  FROM flights GROUP BY 1, 2)"""
STATS = f"""stats AS (
  SELECT upper(carrier_code) AS code, avg({LATE}) AS delay_rate,
         coalesce(avg(dep_delay_minutes) FILTER (WHERE dep_delay_minutes >= 15), 0) AS mean_delay
  FROM flights WHERE carrier_code IS NOT NULL GROUP BY 1),
overall AS (
  SELECT avg({LATE}) AS delay_rate,
         coalesce(avg(dep_delay_minutes) FILTER (WHERE dep_delay_minutes >= 15), 32.0) AS mean_delay
  FROM flights)"""
TIMED = "timed AS (SELECT *, try_cast(scheduled_departure AS TIMESTAMP) AS ts FROM flights)"

HOUR_BUCKET = """CAST(CASE WHEN hour(ts) <= 5 THEN 0 WHEN hour(ts) <= 11 THEN 1 WHEN hour(ts) <= 13 THEN 2
  WHEN hour(ts) <= 17 THEN 3 WHEN hour(ts) <= 20 THEN 4 WHEN hour(ts) <= 23 THEN 5 END AS DOUBLE)"""
SLOT = """CASE WHEN hour(ts) <= 4 THEN 0 WHEN hour(ts) <= 8 THEN 1 WHEN hour(ts) <= 11 THEN 2
  WHEN hour(ts) <= 16 THEN 3 WHEN hour(ts) <= 19 THEN 4 WHEN hour(ts) <= 23 THEN 5 ELSE 3 END"""
HOLIDAY_DATE = (
    "CASE WHEN strftime(ts, '%m-%d') IN ("
    + ", ".join(f"'{m:02d}-{d:02d}'" for m, d in fixed.HOLIDAYS)
    + ") THEN 1 ELSE 0 END"
)
PEAK_SEASON = "CASE WHEN month(ts) IN (6, 7, 8, 12) THEN 1 ELSE 0 END"
DIRECTION = """CASE WHEN abs(coalesce(d.lon, 0) - coalesce(o.lon, 0)) >= abs(coalesce(d.lat, 0) - coalesce(o.lat, 0))
  THEN CASE WHEN coalesce(d.lon, 0) - coalesce(o.lon, 0) > 0 THEN 0 ELSE 1 END
  ELSE CASE WHEN coalesce(d.lat, 0) - coalesce(o.lat, 0) > 0 THEN 2 ELSE 3 END END"""
PLACES = """LEFT JOIN airports o ON o.code = upper(origin) LEFT JOIN airports d ON d.code = upper(destination)"""


def _isin(column: str, words) -> str:
    return f"{column} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def _hub(column: str) -> str:
    return f"CASE WHEN upper({column}) IN (SELECT code FROM hubs) THEN 1 ELSE 0 END"


NARROW = _isin("upper(aircraft_type)", fixed.NARROW_BODIES)
WIDE = _isin("upper(aircraft_type)", fixed.WIDE_BODIES)
BUCKET = """CAST(CASE WHEN coalesce(distance_miles, 800) <= 500 THEN 0
  WHEN coalesce(distance_miles, 800) <= 1500 THEN 1 ELSE 2 END AS DOUBLE)"""
PRIOR = "greatest(coalesce(prior_leg_delay_minutes, 0.0), 0.0)"


def _tier(column: str, cuts) -> str:
    severe, moderate, minor = cuts
    return (
        f"CASE WHEN {column} >= {severe} THEN 'SEVERE' WHEN {column} >= {moderate} THEN 'MODERATE' "
        f"WHEN {column} >= {minor} THEN 'MINOR' ELSE 'ON_TIME' END"
    )


def _carrier_risk(source: str, extra: str = "") -> str:
    """Carrier score of rows with code, rate, means and hour/weather columns."""
    return f"""
scored AS (
  SELECT r.*, coalesce(r.delay_rate, c.base_rate, 0.22) AS base, coalesce(c.sensitivity, 1.05) AS sens,
         CASE WHEN r.hour IS NULL THEN 1.10 WHEN r.hour IN (7, 8, 9, 16, 17, 18, 19) THEN 1.30 ELSE 1.00 END AS peak,
         coalesce(w.factor, 0.10) AS wf
  FROM {source} r LEFT JOIN carriers c ON c.code = r.carrier_code LEFT JOIN weather w ON w.word = lower(r.word)),
parts AS (
  SELECT *, 0.50 * base AS hc, 0.25 * least(1.0, (sens - 0.9) / 0.4 * wf) AS wc,
         0.25 * least(1.0, (peak - 1.0) / 0.35) AS cc FROM scored)
SELECT {extra} carrier_code, {even("least(1.0, hc + wc + cc)", 4)} AS risk_score"""


RISK_COLUMNS = f""", {even("base", 4)} AS base_delay_rate, CAST(round(sens, 4) AS DOUBLE) AS weather_sensitivity,
  CAST(peak AS DOUBLE) AS peak_hour_multiplier, CAST(coalesce(sample_size, 0) AS BIGINT) AS sample_size,
  {even("coalesce(mean_delay_minutes, 32.0)", 2)} AS mean_delay_minutes,
  {even("coalesce(p90_delay_minutes, 75.0)", 2)} AS p90_delay_minutes,
  {even("hc", 4)} AS historical_component, {even("wc", 4)} AS weather_component, {even("cc", 4)} AS congestion_component
FROM parts"""
OPEN = "CAST(NULL AS INT) AS hour, CAST(NULL AS VARCHAR) AS word"
NO_HISTORY = """CAST(NULL AS BIGINT) AS sample_size, CAST(NULL AS DOUBLE) AS delay_rate,
  CAST(NULL AS DOUBLE) AS mean_delay_minutes, CAST(NULL AS DOUBLE) AS p90_delay_minutes"""

ROUTE_RISK = f"""
SELECT origin, destination,
  {even("least(1.0, rate * CASE WHEN hubs = 1 THEN 1.12 ELSE 0.95 END * CASE WHEN east THEN 0.97 ELSE 1.03 END)", 4)} AS risk_score,
  {even("rate", 4)} AS historical_delay_rate,
  {even("coalesce(mean_delay_minutes, 32.0)", 2)} AS mean_delay_minutes,
  {even("coalesce(p90_delay_minutes, 75.0)", 2)} AS p90_delay_minutes,
  hubs = 1 AS is_hub_to_hub, east AS is_eastbound,
  {even("route_distance_miles", 1)} AS route_distance_miles,
  CAST(coalesce(sample_size, 0) AS BIGINT) AS sample_size
FROM (
  SELECT h.*, CAST(coalesce(delay_rate, 0.22) AS DOUBLE) AS rate, {_hub("origin")} * {_hub("destination")} AS hubs,
         coalesce(d.lon, 0) > coalesce(o.lon, 0) AS east
  FROM history h {PLACES})"""

RULES = (
    ("flight_id", "Missing data for required field.", "flight_id IS NULL"),
    ("carrier_code", "Missing data for required field.", "carrier_code IS NULL"),
    ("origin", "Missing data for required field.", "origin IS NULL"),
    ("destination", "Missing data for required field.", "destination IS NULL"),
    ("scheduled_departure", "Missing data for required field.", "scheduled_departure IS NULL"),
    ("origin", "origin must be a 3-letter IATA code.", "length(origin) <> 3"),
    ("destination", "destination must be a 3-letter IATA code.", "length(destination) <> 3"),
    ("distance_miles", "distance_miles must be > 0.", "distance_miles <= 0"),
    ("departure_hour", "departure_hour must be 0-23.", "departure_hour NOT BETWEEN 0 AND 23"),
    ("day_of_week", "day_of_week must be 0-6.", "day_of_week NOT BETWEEN 0 AND 6"),
    ("month", "month must be 1-12.", "month NOT BETWEEN 1 AND 12"),
    ("prior_leg_delay_minutes", "prior_leg_delay_minutes must be >= 0.", "prior_leg_delay_minutes < 0"),
    (
        "weather_condition",
        "weather_condition must be one of: ['clear', 'rain', 'snow', 'fog', 'wind'].",
        "weather_condition NOT IN ('clear', 'rain', 'snow', 'fog', 'wind')",
    ),
)
N_ERRORS = " + ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END" for _, _, rule in RULES)
ERROR_FIELDS = "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{f}' END" for f, _, rule in RULES) + ")"
FLIGHT_RULES = " + ".join(
    f"CASE WHEN {rule} THEN 1 ELSE 0 END"
    for f, _, rule in RULES
    if f not in ("departure_hour", "day_of_week", "month")
)

FLIGHT_COLUMNS = (
    "flight_id", "carrier_code", "origin", "destination", "scheduled_departure", "aircraft_type",
    "distance_miles", "is_holiday", "prior_leg_delay_minutes", "weather_condition",
    "dep_delay_minutes", "delay_probability",
)
NULL_SHARES = " UNION ALL ".join(
    f"SELECT '{c}' AS col, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM flights"
    for c in FLIGHT_COLUMNS
)

CHANGES = f"""{FLIGHTS}, fixed_rows AS (
  SELECT flight_id, carrier_code, coalesce(dep_delay_minutes, 0) + 5 AS dep_delay_minutes
  FROM flights WHERE carrier_code = 'WN'),
changes AS (SELECT * FROM fixed_rows UNION ALL
  SELECT flight_id || '-B', carrier_code, dep_delay_minutes FROM fixed_rows),
kept AS (SELECT flight_id, carrier_code, dep_delay_minutes FROM flights
         WHERE NOT EXISTS (SELECT 1 FROM changes WHERE changes.flight_id = flights.flight_id))"""

RANKED = f"""{FLIGHTS}, s AS (
  SELECT delay_probability AS score, sum({LATE}) AS pos, sum(1 - {LATE}) AS neg FROM flights GROUP BY 1),
t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""
AUC = "CAST(sum(neg * (tp - pos + pos / 2.0)) AS DOUBLE) / max(CAST(p AS DOUBLE) * n)"
AVERAGE_PRECISION = "sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(p)"
BRIER = f"SELECT avg((delay_probability - {LATE}) ** 2) AS value FROM flights"


def _ks(ref: str, cur: str, columns) -> str:
    """CTEs ending in `ks(feature, d, n_ref, n_cur, p_value)` for two relations."""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {a} AS r, {1 - a} AS k FROM {t} WHERE {c} IS NOT NULL"
        for c in columns
        for t, a in ((ref, 1), (cur, 0))
    )
    return f"""long AS ({long}),
grouped AS (SELECT feature, v, sum(r) AS r, sum(k) AS k FROM long GROUP BY 1, 2),
running AS (SELECT feature, sum(r) OVER w AS cr, sum(k) OVER w AS ck,
                   sum(r) OVER (PARTITION BY feature) AS nr, sum(k) OVER (PARTITION BY feature) AS nk
            FROM grouped WINDOW w AS (PARTITION BY feature ORDER BY v)),
distances AS (SELECT feature, max(abs(CAST(cr AS DOUBLE) / nr - CAST(ck AS DOUBLE) / nk)) AS d,
                     CAST(max(nr) AS BIGINT) AS n_ref, CAST(max(nk) AS BIGINT) AS n_cur
              FROM running GROUP BY 1 HAVING max(nr) >= 30 AND max(nk) >= 30),
scaled AS (SELECT *, d * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS l FROM distances),
ks AS (SELECT feature, d, n_ref, n_cur, CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
         list_sum(list_transform(range(1, 101), lambda j: 2.0 * pow(-1.0, j - 1) * exp(-2.0 * j * j * l * l))))) END AS p_value
       FROM scaled)"""


KS_COLUMNS = ("distance_miles", "prior_leg_delay_minutes", "delay_probability")
KS = f"{PAIR}, {_ks('flights_ref', 'flights_cur', KS_COLUMNS)}"
KS_SELECT = """SELECT feature, round(d, 6) AS statistic, round(p_value, 6) AS p_value,
  p_value < 0.05 AS drifted, n_ref, n_cur FROM ks"""
SHIFT = """(SELECT avg(delay_probability) FROM flights_cur) - (SELECT avg(delay_probability) FROM flights_ref)"""
CUR_MISSING = """(SELECT avg((CASE WHEN flight_id IS NULL THEN 1 ELSE 0 END + CASE WHEN distance_miles IS NULL THEN 1 ELSE 0 END
  + CASE WHEN prior_leg_delay_minutes IS NULL THEN 1 ELSE 0 END + CASE WHEN delay_probability IS NULL THEN 1 ELSE 0 END) / 4.0)
  FROM flights_cur)"""
DRIFT_SUMMARY = f"""WITH {KS}, tests AS ({KS_SELECT})
SELECT (SELECT count(*) FROM flights_cur) AS batch_size, CAST(3 AS INT) AS n_numeric_tested,
  count(*) FILTER (WHERE drifted) AS n_drifted,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE drifted), '') AS drifted_features,
  {even(SHIFT, 4)} AS score_shift, {even(CUR_MISSING, 4)} AS missing_ratio,
  (count(*) FILTER (WHERE drifted)) > 0 OR abs({SHIFT}) > 0.07 AS drift_detected
FROM tests"""

IMPACT = f"""{FLIGHTS}, {TIMED}, {WEATHER}, impact AS (
  SELECT flight_id, w.multiplier * CASE WHEN coalesce(hour(ts), 12) BETWEEN 6 AND 9 OR coalesce(hour(ts), 12) BETWEEN 16 AND 20
           THEN 1.22::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN coalesce(is_holiday, false) THEN 1.18::DOUBLE ELSE 1.0::DOUBLE END AS m,
         w.multiplier AS base, w.minutes, w.severity
  FROM timed JOIN weather w ON w.word = lower(coalesce(weather_condition, 'clear')))"""

FEATURES = f"""{FLIGHTS}, {TIMED}, {AIRPORTS}, {HUBS}, {WEATHER}, {STATS}, features AS (
  SELECT flight_id, carrier_code, timed.origin, timed.destination, scheduled_departure, weather_condition,
    timed.prior_leg_delay_minutes AS given_prior, delay_probability,
    distance_miles, hour(ts) AS departure_hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
    CASE WHEN is_holiday THEN 1 ELSE 0 END AS is_holiday, {PRIOR} AS prior_leg_delay_minutes,
    day(ts) AS day_of_month, {HOUR_BUCKET} AS hour_bucket,
    CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, ceil(month(ts) / 3.0) AS quarter,
    {PEAK_SEASON} AS is_peak_season, {SLOT} AS schedule_slot,
    {_hub("origin")} AS is_hub_origin, {_hub("destination")} AS is_hub_dest,
    {_hub("origin")} * {_hub("destination")} AS is_hub_to_hub, {BUCKET} AS distance_bucket,
    ln(1 + coalesce(distance_miles, 800)) AS distance_log, {DIRECTION} AS flight_direction,
    coalesce(s.delay_rate, g.delay_rate) AS carrier_delay_rate, coalesce(s.mean_delay, g.mean_delay) AS carrier_mean_delay,
    CASE WHEN {NARROW} THEN 1 ELSE 0 END AS is_narrow_body, CASE WHEN {WIDE} THEN 1 ELSE 0 END AS is_wide_body,
    CASE WHEN {NARROW} OR {WIDE} THEN 0 ELSE 1 END AS is_regional,
    CASE WHEN {PRIOR} > 0 THEN 1 ELSE 0 END AS has_prior_delay, ln(1 + {PRIOR}) AS prior_delay_log,
    coalesce(w.ordinal, 0) AS weather_severity
  FROM timed {PLACES} LEFT JOIN stats s ON s.code = upper(carrier_code) CROSS JOIN overall g
  LEFT JOIN weather w ON w.word = lower(weather_condition))"""
MATRIX = (
    "distance_miles", "departure_hour", "day_of_week", "month", "is_holiday", "prior_leg_delay_minutes",
    "day_of_month", "hour_bucket", "is_weekend", "quarter", "is_peak_season", "schedule_slot",
    "is_hub_origin", "is_hub_dest", "is_hub_to_hub", "distance_bucket", "distance_log", "flight_direction",
    "carrier_delay_rate", "carrier_mean_delay", "is_narrow_body", "is_wide_body", "is_regional",
    "has_prior_delay", "prior_delay_log", "weather_severity",
)


def _histogram(source: str) -> str:
    bounds = [(str(e), f"delay_probability <= {e}") for e in fixed.HISTOGRAM_EDGES]
    bounds.append(("+Inf", "delay_probability IS NOT NULL"))
    return " UNION ALL ".join(
        f"SELECT '{n}' AS le, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS n FROM {source}" for n, c in bounds
    )


GIVEN = f"""{FLIGHTS}, given AS (
  SELECT flight_id, 'distance' AS feature, (coalesce(distance_miles, 800.0::DOUBLE) - 1450) / 1000 AS value FROM flights
  UNION ALL SELECT flight_id, 'prior_leg', coalesce(CAST(prior_leg_delay_minutes AS DOUBLE), 0) / 50 FROM flights
  UNION ALL SELECT flight_id, 'delay', coalesce(dep_delay_minutes, 0) / 60 FROM flights
  UNION ALL SELECT flight_id, 'score', delay_probability - 0.5 FROM flights
  UNION ALL SELECT flight_id, 'holiday', CASE WHEN is_holiday THEN 1.0::DOUBLE ELSE (-0.1)::DOUBLE END FROM flights)"""

HALF_COLUMNS = ("distance_miles", "prior_leg_delay_minutes", "dep_delay_minutes", "delay_probability")
HALVES = f"""{FLIGHTS}, keyed AS (
  SELECT *, epoch(try_cast(scheduled_departure AS TIMESTAMP)) AS k FROM flights),
ordered AS (SELECT k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM keyed),
cut AS (SELECT k AS middle FROM ordered WHERE i = n // 2),
earlier AS (SELECT keyed.* FROM keyed, cut WHERE k IS NULL OR k < middle),
later AS (SELECT keyed.* FROM keyed, cut WHERE k IS NOT NULL AND (middle IS NULL OR k >= middle)),
{_ks("earlier", "later", HALF_COLUMNS)}"""

LINEAGE = f"""WITH RECURSIVE {ctes("lineage_edges")},
up(node, depth) AS (SELECT 'nation-3', 0 UNION
  SELECT src, depth + 1 FROM up JOIN lineage_edges ON dst = node WHERE depth < 3),
down(node, depth) AS (SELECT 'nation-3', 0 UNION
  SELECT dst, depth + 1 FROM down JOIN lineage_edges ON src = node WHERE depth < 3)
SELECT node, 'upstream' AS direction, CAST(min(depth) AS INT) AS depth FROM up WHERE node <> 'nation-3' GROUP BY 1
UNION ALL
SELECT node, 'downstream', CAST(min(depth) AS INT) FROM down WHERE node <> 'nation-3' GROUP BY 1"""


def _z(column: str) -> str:
    return f"round(({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER (), 6) AS {column}"


ORACLES: dict[str, str] = {
    # sources and sinks
    "scan_flights": f"WITH {FLIGHTS} SELECT flight_id, carrier_code, dep_delay_minutes FROM flights WHERE dep_delay_minutes >= 15",
    "read_branch": f"WITH {FLIGHTS} SELECT least(1000, count(*)) AS n_limited, count(*) AS n_rows FROM flights",
    "write_snapshot_roundtrip": f"WITH {FLIGHTS} SELECT flight_id, origin, destination, delay_probability FROM flights",
    "upsert_flights": f"WITH {CHANGES} SELECT * FROM kept UNION ALL SELECT * FROM changes",
    "delete_flights": f"WITH {CHANGES} SELECT * FROM kept",
    "upsert_buckets": f"WITH {CHANGES} SELECT * FROM kept UNION ALL SELECT * FROM changes",
    "delete_buckets": f"WITH {CHANGES} SELECT * FROM kept",
    "log_predictions": f"""WITH {FLIGHTS} SELECT flight_id, delay_probability, 2 * count(*) AS n, 2 * count(*) AS n_stamped
        FROM flights GROUP BY 1, 2""",
    "append_many": f"""WITH {FLIGHTS} SELECT origin, count(*) AS n, CAST(NULL AS DOUBLE) AS miles FROM flights GROUP BY 1
        UNION ALL SELECT NULL, count(*), sum(distance_miles) FROM flights""",
    "export_roundtrip": f"WITH {FLIGHTS} SELECT flight_id, carrier_code, distance_miles, is_holiday, dep_delay_minutes FROM flights",
    "list_branches": f"""WITH {FLIGHTS} SELECT 'master' AS branch, count(*) AS n_rows FROM flights
        UNION ALL SELECT 'delayed', count(*) FROM flights WHERE dep_delay_minutes >= 15""",
    "model_metrics_long": f"""WITH {RANKED}, brier AS ({BRIER})
        SELECT 'given-score' AS model, 'all' AS split, 'auc_roc' AS metric, round({AUC}, 6) AS value FROM t
        UNION ALL SELECT 'given-score', 'all', 'average_precision', round({AVERAGE_PRECISION}, 6) FROM t
        UNION ALL SELECT 'given-score', 'all', 'brier_score', round(value, 6) FROM brier""",
    # validation and quality
    "validate_flights": f"WITH {RAW} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{m.replace(chr(39), chr(39) * 2)}' AS message, count(*) AS n FROM raw_flights WHERE {rule}"
        for f, m, rule in RULES
    )
    + ") WHERE n > 0",
    "validation_error_counts": f"""WITH {RAW} SELECT CAST({N_ERRORS} AS INT) AS n_errors, count(*) AS n_rows
        FROM raw_flights GROUP BY 1""",
    "valid_flights": f"""WITH {RAW} SELECT flight_id, origin, destination, departure_hour, month
        FROM raw_flights WHERE {N_ERRORS} = 0""",
    "rejected_flights": f"""WITH {RAW} SELECT flight_id, scheduled_departure, {ERROR_FIELDS} AS fields
        FROM raw_flights WHERE {N_ERRORS} > 0""",
    "fill_defaults": f"""WITH {RAW} SELECT flight_id, coalesce(aircraft_type, 'unknown') AS aircraft_type,
        coalesce(departure_hour, 12) AS departure_hour, coalesce(day_of_week, 0) AS day_of_week, coalesce(month, 1) AS month,
        coalesce(is_holiday, false) AS is_holiday,
        coalesce(CAST(prior_leg_delay_minutes AS DOUBLE), 0) AS prior_leg_delay_minutes,
        coalesce(weather_condition, 'clear') AS weather_condition, distance_miles FROM raw_flights""",
    "enforce_schema": f"WITH {FLIGHTS} SELECT destination, origin, flight_id, dep_delay_minutes FROM flights",
    "data_quality": f"""WITH {FLIGHTS}, shares AS ({NULL_SHARES}), repeats AS (
        SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM flights GROUP BY ALL, {", ".join(FLIGHT_COLUMNS)}))
        SELECT 'row_count' AS "check", NULL AS "column", CAST(count(*) AS DOUBLE) AS value, count(*) > 0 AS passed FROM flights
        UNION ALL SELECT 'required_column', 'flight_id', 1.0, true
        UNION ALL SELECT 'required_column', 'gate', 0.0, false
        UNION ALL SELECT 'null_fraction', col, round(share, 6), share <= 0.02 FROM shares
        UNION ALL SELECT 'duplicate_rows', NULL, CAST(d AS DOUBLE), d = 0 FROM repeats""".replace("GROUP BY ALL, ", "GROUP BY "),
    "null_fractions": f"""WITH {FLIGHTS}, shares AS ({NULL_SHARES})
        SELECT col AS "column", round(share, 6) AS null_fraction FROM shares""",
    "duplicate_rows": f"""WITH {FLIGHTS} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (
        SELECT count(*) AS n FROM flights GROUP BY carrier_code, origin, destination, weather_condition)""",
    "numeric_features": f"""WITH {RAW} SELECT flight_id, scheduled_departure, coalesce(distance_miles, 0) AS distance_miles,
        CAST(coalesce(departure_hour, 0) AS DOUBLE) AS departure_hour, CAST(coalesce(day_of_week, 0) AS DOUBLE) AS day_of_week,
        CAST(coalesce(month, 0) AS DOUBLE) AS month,
        CAST(coalesce(prior_leg_delay_minutes, 0) AS DOUBLE) AS prior_leg_delay_minutes FROM raw_flights""",
    "align_features": f"""WITH {FLIGHTS} SELECT flight_id, coalesce(distance_miles, 0) AS distance_miles,
        CAST(coalesce(prior_leg_delay_minutes, 0) AS DOUBLE) AS prior_leg_delay_minutes,
        CASE WHEN is_holiday THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_holiday,
        CAST(0 AS DOUBLE) AS scheduled_departure, CAST(0 AS DOUBLE) AS runway_heading FROM flights""",
    "label_delayed": f"WITH {FLIGHTS} SELECT flight_id, CAST({LATE} AS INT) AS is_delayed FROM flights",
    # aggregates
    "carrier_delay_rate": f"WITH {FLIGHTS}, {STATS} SELECT code AS carrier_code, round(delay_rate, 6) AS delay_rate FROM stats",
    "carrier_mean_delay": f"WITH {FLIGHTS}, {STATS} SELECT code AS carrier_code, round(mean_delay, 6) AS mean_delay FROM stats",
    "fit_stats": f"""WITH {FLIGHTS}, {STATS} SELECT code AS carrier_code, CAST(0 AS INT) AS is_global,
        round(delay_rate, 6) AS delay_rate, round(mean_delay, 6) AS mean_delay FROM stats
        UNION ALL SELECT NULL, 1, round(delay_rate, 6), round(mean_delay, 6) FROM overall""",
    "carrier_rate_from_label": f"""WITH {FLIGHTS}, {STATS} SELECT code AS carrier_code, CAST(0 AS INT) AS is_global,
        round(delay_rate, 6) AS delay_rate, CAST(NULL AS DOUBLE) AS mean_delay FROM stats
        UNION ALL SELECT NULL, 1, round(delay_rate, 6), 32.0 FROM overall""",
    "carrier_history": f"""WITH {FLIGHTS}, {CARRIER_HISTORY} SELECT carrier_code, sample_size, round(delay_rate, 6) AS delay_rate,
        round(mean_delay_minutes, 6) AS mean_delay_minutes, round(p90_delay_minutes, 6) AS p90_delay_minutes FROM history""",
    "route_history": f"""WITH {FLIGHTS}, {ROUTE_HISTORY} SELECT origin, destination, sample_size, round(delay_rate, 6) AS delay_rate,
        round(mean_delay_minutes, 6) AS mean_delay_minutes, round(p90_delay_minutes, 6) AS p90_delay_minutes,
        round(route_distance_miles, 6) AS route_distance_miles FROM history""",
    "delay_stats": f"""WITH {FLIGHTS}, {STATS} SELECT code AS carrier, {even("(1 - delay_rate) * 100", 1)} AS on_time_pct,
        {even("mean_delay", 1)} AS avg_delay_min FROM stats
        UNION ALL SELECT NULL, {even("(1 - delay_rate) * 100", 1)}, {even("mean_delay", 1)} FROM overall""",
    "delay_stats_one_carrier": f"""WITH {FLIGHTS}, {STATS} SELECT code AS carrier, {even("(1 - delay_rate) * 100", 1)} AS on_time_pct,
        {even("mean_delay", 1)} AS avg_delay_min FROM stats WHERE code = 'DL'
        UNION ALL SELECT NULL, {even("(1 - delay_rate) * 100", 1)}, {even("mean_delay", 1)} FROM overall""",
    "class_weights": f"""WITH {FLIGHTS}, c AS (SELECT CAST({LATE} AS INT) AS is_delayed, count(*) AS n FROM flights GROUP BY 1)
        SELECT is_delayed, n, round(n / CAST((SELECT count(*) FROM flights) AS DOUBLE), 6) AS share,
        round((SELECT count(*) FROM flights) / (2.0 * n), 6) AS weight FROM c""",
    "score_histogram": f"WITH {FLIGHTS} {_histogram('flights')}",
    "mean_score": f"WITH {FLIGHTS} SELECT round(coalesce(avg(delay_probability), 0.5), 6) AS mean_score FROM flights",
    # features
    "temporal_features": f"""WITH {FLIGHTS}, {TIMED} SELECT flight_id, CAST(hour(ts) AS INT) AS departure_hour,
        CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day_of_month,
        {HOUR_BUCKET} AS hour_bucket, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        CAST(ceil(month(ts) / 3.0) AS INT) AS quarter, {PEAK_SEASON} AS is_peak_season FROM timed""",
    "holiday_explicit": f"WITH {FLIGHTS} SELECT flight_id, CASE WHEN is_holiday THEN 1 ELSE 0 END AS is_holiday FROM flights",
    "holiday_derived": f"WITH {FLIGHTS}, {TIMED} SELECT flight_id, {HOLIDAY_DATE} AS is_holiday FROM timed",
    "schedule_slot": f"WITH {FLIGHTS}, {TIMED} SELECT flight_id, {SLOT} AS schedule_slot FROM timed",
    "route_features": f"""WITH {FLIGHTS}, {HUBS} SELECT flight_id, {_hub("origin")} AS is_hub_origin, {_hub("destination")} AS is_hub_dest,
        {_hub("origin")} * {_hub("destination")} AS is_hub_to_hub, {BUCKET} AS distance_bucket,
        round(ln(1 + coalesce(distance_miles, 800)), 6) AS distance_log FROM flights""",
    "flight_direction": f"WITH {FLIGHTS}, {AIRPORTS} SELECT flight_id, {DIRECTION} AS flight_direction FROM flights {PLACES}",
    "carrier_features": f"""WITH {FEATURES} SELECT flight_id, round(carrier_delay_rate, 6) AS carrier_delay_rate,
        round(carrier_mean_delay, 6) AS carrier_mean_delay FROM features""",
    "aircraft_features": f"""WITH {FLIGHTS} SELECT flight_id, CASE WHEN {NARROW} THEN 1 ELSE 0 END AS is_narrow_body,
        CASE WHEN {WIDE} THEN 1 ELSE 0 END AS is_wide_body, CASE WHEN {NARROW} OR {WIDE} THEN 0 ELSE 1 END AS is_regional FROM flights""",
    "chaining_features": f"""WITH {FLIGHTS} SELECT flight_id, CAST({PRIOR} AS DOUBLE) AS prior_leg_delay_minutes,
        CASE WHEN {PRIOR} > 0 THEN 1 ELSE 0 END AS has_prior_delay, round(ln(1 + {PRIOR}), 6) AS prior_delay_log FROM flights""",
    "weather_features": f"""WITH {FLIGHTS}, {WEATHER} SELECT flight_id, CAST(coalesce(ordinal, 0) AS INT) AS weather_severity
        FROM flights LEFT JOIN weather ON word = lower(weather_condition)""",
    "feature_matrix": f"WITH {FEATURES} SELECT flight_id, "
    + ", ".join(f"{even(c, 6)} AS {c}" for c in MATRIX)
    + " FROM features",
    "weather_impact": f"""WITH {IMPACT} SELECT flight_id, {even("m", 3)} AS delay_multiplier,
        {even("minutes * (m / base)", 1)} AS avg_added_delay_min, {even("greatest(20.0, 82.0 / m)", 1)} AS adjusted_on_time_pct,
        severity FROM impact""",
    "weather_recommendation": f"""WITH {IMPACT} SELECT CASE WHEN m < 1.1 THEN 'Normal operations expected. No action required.'
        WHEN m < 1.4 THEN 'Minor delays possible. Allow extra buffer time for connections.'
        WHEN m < 1.8 THEN 'Moderate delays likely. Consider rebooking connecting flights with < 90-min layovers.'
        ELSE 'Severe delays expected. Check airline alerts and consider flexible rebooking.' END AS recommendation,
        count(*) AS n FROM impact GROUP BY 1""",
    "weather_unknown": f"""WITH {FLIGHTS}, {WEATHER} SELECT flight_id, weather_condition FROM flights
        WHERE lower(coalesce(weather_condition, 'clear')) NOT IN (SELECT word FROM weather)""",
    "delay_tier_service": f"WITH {FLIGHTS} SELECT flight_id, {_tier('delay_probability', fixed.SERVICE_TIER_CUTS)} AS delay_tier FROM flights",
    "delay_tier_model": f"WITH {FLIGHTS} SELECT flight_id, {_tier('delay_probability', fixed.MODEL_TIER_CUTS)} AS delay_tier FROM flights",
    "expected_delay": f"""WITH {FLIGHTS} SELECT flight_id, CAST(CASE {_tier("delay_probability", fixed.MODEL_TIER_CUTS)}
        WHEN 'SEVERE' THEN 95.0 WHEN 'MODERATE' THEN 42.0 WHEN 'MINOR' THEN 18.0 ELSE 0.0 END AS DOUBLE) AS minutes_by_tier,
        {even("delay_probability * 120", 1)} AS minutes_linear FROM flights""",
    # risk
    "carrier_risk": f"WITH {FLIGHTS}, {CARRIERS}, {WEATHER}, {CARRIER_HISTORY}, rows_in AS (SELECT *, {OPEN} FROM history),"
    + _carrier_risk("rows_in")
    + RISK_COLUMNS,
    "carrier_risk_by_hour_weather": f"""WITH {FLIGHTS}, {CARRIERS}, {WEATHER}, {CARRIER_HISTORY},
        contexts AS (SELECT DISTINCT upper(carrier_code) AS carrier_code,
          CAST(hour(try_cast(scheduled_departure AS TIMESTAMP)) AS INT) AS hour, weather_condition AS word
          FROM flights WHERE carrier_code IS NOT NULL),
        rows_in AS (SELECT contexts.*, delay_rate FROM contexts LEFT JOIN history USING (carrier_code)),"""
    + _carrier_risk("rows_in", "hour AS departure_hour, word AS weather_condition,")
    + " FROM parts",
    "carrier_risk_baseline": f"""WITH {FLIGHTS}, {CARRIERS}, {WEATHER}, rows_in AS (
        SELECT DISTINCT upper(carrier_code) AS carrier_code, {NO_HISTORY}, {OPEN} FROM flights WHERE carrier_code IS NOT NULL),"""
    + _carrier_risk("rows_in")
    + RISK_COLUMNS,
    "risk_all_carriers": f"WITH {FLIGHTS}, {CARRIERS}, {WEATHER}, {CARRIER_HISTORY}, rows_in AS (SELECT *, {OPEN} FROM history),"
    + _carrier_risk("rows_in")
    + " FROM parts",
    "flight_carrier_risk": f"""WITH {FLIGHTS}, {CARRIERS}, {WEATHER}, {CARRIER_HISTORY}, rows_in AS (
        SELECT flight_id, coalesce(upper(f.carrier_code), 'XX') AS carrier_code, delay_rate, {OPEN}
        FROM flights f LEFT JOIN history h ON h.carrier_code = upper(f.carrier_code)), risk AS (
        SELECT * FROM ("""
    + "WITH " + _carrier_risk("rows_in", "flight_id,").lstrip()
    + " FROM parts)) SELECT flight_id, risk_score AS carrier_risk_score FROM risk",
    "route_risk": f"WITH {FLIGHTS}, {AIRPORTS}, {HUBS}, {ROUTE_HISTORY} {ROUTE_RISK}",
    "route_risk_baseline": f"""WITH {FLIGHTS}, {AIRPORTS}, {HUBS}, history AS (
        SELECT DISTINCT upper(origin) AS origin, upper(destination) AS destination, {NO_HISTORY},
        CAST(NULL AS DOUBLE) AS route_distance_miles FROM flights) {ROUTE_RISK}""",
    # model
    "standardize": f"""WITH {FLIGHTS} SELECT flight_id, {_z("distance_miles")}, {_z("prior_leg_delay_minutes")},
        {_z("dep_delay_minutes")} FROM flights""",
    "soft_vote": f"""WITH {FLIGHTS} SELECT flight_id, round(0.4::DOUBLE * delay_probability
        + 0.4::DOUBLE * least(1.0::DOUBLE, coalesce(prior_leg_delay_minutes::DOUBLE, 0) / 120)
        + 0.2::DOUBLE * coalesce(distance_miles, 0) / 2801, 6) AS vote FROM flights""",
    "model_roundtrip": f"""WITH {RAW} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different
        FROM raw_flights WHERE {N_ERRORS} = 0""",
    "topk_attributions": f"""WITH {GIVEN} SELECT flight_id, feature, round(value, 6) AS value FROM given
        QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY abs(value) DESC, feature) <= 3""",
    "auc_roc": f"WITH {RANKED} SELECT round({AUC}, 6) AS value FROM t",
    "average_precision": f"WITH {RANKED} SELECT round({AVERAGE_PRECISION}, 6) AS value FROM t",
    "brier_score": f"WITH {FLIGHTS}, b AS ({BRIER}) SELECT round(value, 6) AS value FROM b",
    # drift
    "ks_statistic": f"WITH {KS} SELECT feature, round(d, 6) AS statistic FROM ks",
    "ks_drift": f"WITH {KS} {KS_SELECT}",
    "score_shift": f"WITH {PAIR} SELECT {even(SHIFT, 4)} AS score_shift, abs({SHIFT}) > 0.07 AS alert",
    "missing_ratio": f"WITH {FLIGHTS}, shares AS ({NULL_SHARES}) SELECT {even("avg(share)", 4)} AS missing_ratio FROM shares",
    "drift_summary": DRIFT_SUMMARY,
    "drift_report": DRIFT_SUMMARY.replace("CAST(3 AS INT)", "CAST(3 AS BIGINT)"),
    "drift_first_run": f"""WITH {PAIR} SELECT count(*) AS batch_size, CAST(0 AS INT) AS n_numeric_tested, CAST(0 AS BIGINT) AS n_drifted,
        '' AS drifted_features, CAST(0 AS DOUBLE) AS score_shift, CAST(0 AS DOUBLE) AS missing_ratio, false AS drift_detected,
        count(*) AS n_kept, CAST(0 AS BIGINT) AS n_tests FROM flights_ref""",
    "dataset_drift": f"""WITH {KS} SELECT round(avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share_drifted,
        avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END) >= 0.2 AS dataset_drift FROM ks""",
    "drift_halves": f"WITH {HALVES} {KS_SELECT}",
    "rejected_csv_flights": f"""WITH {ctes("flights", "text_flights")}, counted AS (
        SELECT unnest([
          struct_pack(field := 'carrier_code', message := '{validate.MISSING}', n := count(*) FILTER (WHERE carrier_code IS NULL)),
          struct_pack(field := 'distance_miles', message := '{validate.BAD_NUMBER}', n := count(*) FILTER (WHERE distance_miles = 'abc')),
          struct_pack(field := 'distance_miles', message := '{validate.SPECIAL}', n := count(*) FILTER (WHERE distance_miles IN ('Infinity', 'nan'))),
          struct_pack(field := 'departure_hour', message := '{validate.BAD_INTEGER}', n := count(*) FILTER (WHERE departure_hour = 'xx')),
          struct_pack(field := 'departure_hour', message := 'departure_hour must be 0-23.', n := count(*) FILTER (WHERE departure_hour IN ('24', '25'))),
          struct_pack(field := 'is_holiday', message := '{validate.BAD_BOOLEAN}', n := count(*) FILTER (WHERE is_holiday = 'maybe'))
        ], recursive := true) FROM text_flights) SELECT field, message, n FROM counted WHERE n > 0""",
    "route_requests": f"""WITH {RAW}, asked AS (
          SELECT origin, CASE WHEN flight_id IS NOT NULL THEN destination END AS destination FROM raw_flights)
        SELECT error, count(*) AS n FROM (
          SELECT CASE WHEN coalesce(origin, '') = '' OR coalesce(destination, '') = '' THEN '{validate.ROUTE_REQUIRED.replace("'", "''")}'
                      WHEN length(origin) <> 3 OR length(destination) <> 3 THEN '{validate.ROUTE_LENGTH}' END AS error FROM asked)
        GROUP BY 1""",
    "score_consistency": f"""WITH {RAW}, judged AS (SELECT {N_ERRORS} AS n_errors FROM raw_flights)
        SELECT count(*) FILTER (WHERE n_errors = 0) AS n_scored, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_wrong_tier,
        CAST(0 AS BIGINT) AS n_wrong_minutes, count(*) FILTER (WHERE n_errors > 0) AS n_rejected FROM judged""",
    "score_file_log": f"""WITH {ctes("flights", "text_flights")}, judged AS (SELECT carrier_code IS NULL
          OR coalesce(distance_miles IN ('abc', 'Infinity', 'nan') OR TRY_CAST(distance_miles AS DOUBLE) <= 0, false)
          OR coalesce(departure_hour IN ('xx', '24', '25'), false) OR is_holiday = 'maybe' AS bad FROM text_flights)
        SELECT count(*) FILTER (WHERE NOT bad) AS n_logged, count(*) FILTER (WHERE NOT bad) AS n_stamped,
               count(*) FILTER (WHERE bad) AS n_rejected FROM judged""",
    # paging, lineage and streams
    "page_records": f"""WITH {FLIGHTS} SELECT flight_id, origin, destination FROM flights
        ORDER BY flight_id, origin, destination LIMIT 500 OFFSET 1000""",
    "page_deep": f"""WITH {FLIGHTS}, numbered AS (
          SELECT flight_id, origin, destination, row_number() OVER (ORDER BY origin, flight_id, destination) AS i, count(*) OVER () AS n
          FROM flights) SELECT flight_id, origin, destination FROM numbered WHERE i > n - 600 AND i <= n - 100""",
    "page_walk": f"WITH {FLIGHTS} SELECT flight_id, CAST(1 AS BIGINT) AS n_pages FROM flights",
    "lineage": LINEAGE,
    "stream_chunks": f"WITH {FLIGHTS} SELECT carrier_code, count(*) AS n, sum(distance_miles) AS miles FROM flights GROUP BY 1",
    "stream_subscribe": f"""WITH {CHANGES}, appended AS (SELECT dep_delay_minutes FROM flights WHERE carrier_code = 'AA')
        SELECT CAST(1 AS INT) AS version, CAST(1 AS INT) AS number, count(*) AS n_rows, count(dep_delay_minutes) AS n_delays FROM appended
        UNION ALL SELECT 2, 0, count(*), count(dep_delay_minutes) FROM flights
        UNION ALL SELECT 3, 0, count(*), count(dep_delay_minutes) FROM (SELECT * FROM kept UNION ALL SELECT * FROM changes)
        UNION ALL SELECT 4, 0, count(*), count(dep_delay_minutes) FROM kept""",
    "stream_score": f"""WITH {FEATURES} SELECT flight_id, {_tier("delay_probability", fixed.SERVICE_TIER_CUTS)} AS delay_tier,
        CAST(departure_hour AS INT) AS departure_hour, hour_bucket, is_holiday, flight_direction,
        round(carrier_delay_rate, 6) AS carrier_delay_rate, is_regional, round(prior_delay_log, 6) AS prior_delay_log,
        CAST(weather_severity AS INT) AS weather_severity
        FROM (SELECT * EXCLUDE (prior_leg_delay_minutes), given_prior AS prior_leg_delay_minutes FROM features)
        WHERE {FLIGHT_RULES} = 0""",
    "rounds_used": """SELECT CAST(f AS INT) AS fold, l AS learner, true AS within, true AS whole_forest
        FROM (VALUES (0), (1), (2)) AS folds(f), (VALUES ('a'), ('b'), ('c')) AS learners(l)""",
    "fold_sizes": f"""WITH {FLIGHTS}, labels AS (SELECT CAST(dep_delay_minutes >= 15 AS INT) AS label, count(*) AS m
            FROM flights WHERE dep_delay_minutes IS NOT NULL GROUP BY 1)
        SELECT label, CAST(f AS INT) AS fold, m // 3 + CASE WHEN f < m % 3 THEN 1 ELSE 0 END AS n FROM labels, (VALUES (0), (1), (2)) AS folds(f)""",
    "path_attributions": f"""WITH {FLIGHTS} SELECT CAST(f AS INT) AS fold, l AS learner, n_rows, CAST(0 AS BIGINT) AS n_wrong
        FROM (SELECT count(*) AS n_rows FROM flights), (VALUES (0), (1), (2)) AS folds(f), (VALUES ('a'), ('b'), ('c')) AS learners(l)""",
    "vote_attributions": f"WITH {FLIGHTS} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong FROM flights",
    "retrain_outputs": f"""WITH {FLIGHTS} SELECT CAST(6 AS BIGINT) AS n_train, CAST(6 AS BIGINT) AS n_val, CAST(1 AS BIGINT) AS n_versions,
        CAST(0 AS BIGINT) AS n_outside, count(*) AS n_rows, count(DISTINCT upper(carrier_code)) AS n_risks FROM flights""",
    "stream_model_score": f"""WITH {FLIGHTS} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different
        FROM flights WHERE {FLIGHT_RULES} = 0""",
    "stream_score_histogram": f"WITH {FLIGHTS} {_histogram('flights')}",
}
