"""Fixed values. Results depend on every number and word in this file."""

# Twenty large hub airports.
HUBS = (
    "ATL", "LAX", "ORD", "DFW", "DEN", "JFK", "SFO", "SEA", "LAS", "MCO",
    "CLT", "PHX", "MIA", "EWR", "BOS", "MSP", "DTW", "FLL", "LGA", "BWI",
)

# Airport code -> (longitude, latitude), one decimal.
AIRPORTS = {
    "ATL": (-84.4, 33.6), "BOS": (-71.0, 42.4), "BWI": (-76.7, 39.2), "CLT": (-80.9, 35.2),
    "DCA": (-77.0, 38.9), "DEN": (-104.7, 39.9), "DFW": (-97.0, 32.9), "DTW": (-83.4, 42.2),
    "EWR": (-74.2, 40.7), "FLL": (-80.2, 26.1), "IAD": (-77.5, 38.9), "IAH": (-95.3, 29.7),
    "JFK": (-73.8, 40.6), "LAS": (-115.2, 36.1), "LAX": (-118.4, 33.9), "LGA": (-73.9, 40.8),
    "MCO": (-81.3, 28.4), "MDW": (-87.7, 41.8), "MIA": (-80.3, 25.8), "MSP": (-93.2, 44.9),
    "ORD": (-87.9, 42.0), "PDX": (-122.6, 45.6), "PHL": (-75.2, 39.9), "PHX": (-112.0, 33.4),
    "SEA": (-122.3, 47.4), "SFO": (-122.4, 37.6), "SLC": (-112.0, 40.8), "STL": (-90.4, 38.7),
}

# Single-aisle and twin-aisle type codes; any other type counts as regional.
NARROW_BODIES = (
    "B737", "B738", "B739", "B73W", "B73H", "A319", "A320", "A321",
    "MD80", "MD88", "MD90", "E175", "E170", "CRJ9", "CRJ7", "ERJ",
)
WIDE_BODIES = (
    "B777", "B787", "B788", "B789", "B78X", "B767", "B763", "B764",
    "A330", "A332", "A333", "A350", "A359", "A380", "A388",
)

# (month, day) of the fixed-date holidays, and the months of the peak season.
HOLIDAYS = ((1, 1), (1, 2), (7, 4), (11, 11), (12, 25), (12, 26))
PEAK_MONTHS = (6, 7, 8, 12)

# Carrier code -> long-run delay rate, and carrier code -> weather sensitivity.
CARRIER_BASE_RATES = {
    "AA": 0.218, "DL": 0.183, "UA": 0.212, "WN": 0.234, "B6": 0.252,
    "AS": 0.163, "NK": 0.286, "F9": 0.279, "G4": 0.271, "SY": 0.262,
}
CARRIER_WEATHER_SENSITIVITY = {
    "AA": 1.10, "DL": 0.95, "UA": 1.05, "WN": 1.15, "B6": 1.20,
    "AS": 1.00, "NK": 1.25, "F9": 1.22, "G4": 1.18, "SY": 1.12,
}
DEFAULT_BASE_RATE = 0.22
DEFAULT_WEATHER_SENSITIVITY = 1.05
DEFAULT_MEAN_DELAY = 32.0
DEFAULT_P90_DELAY = 75.0

# Weather word -> ordinal (feature), severity factor (risk) and operating impact
# (delay multiplier, added minutes, severity word).
WEATHER_ORDINAL = {"clear": 0, "rain": 1, "wind": 2, "fog": 3, "snow": 4}
WEATHER_FACTOR = {"clear": 0.00, "rain": 0.35, "wind": 0.45, "fog": 0.60, "snow": 0.85}
DEFAULT_WEATHER_FACTOR = 0.10
WEATHER_IMPACT = {
    "clear": (1.00, 0.0, "none"),
    "rain": (1.28, 12.0, "low"),
    "wind": (1.35, 18.0, "medium"),
    "fog": (1.62, 35.0, "high"),
    "snow": (2.14, 58.0, "severe"),
}
IMPACT_PEAK_MULTIPLIER = 1.22  # hours 6-9 and 16-20
IMPACT_HOLIDAY_MULTIPLIER = 1.18
IMPACT_ON_TIME_PCT = 82.0
IMPACT_ON_TIME_FLOOR = 20.0

# (upper bound of the multiplier, advice); the last line has no bound.
ADVICE = (
    (1.1, "Normal operations expected. No action required."),
    (1.4, "Minor delays possible. Allow extra buffer time for connections."),
    (1.8, "Moderate delays likely. Consider rebooking connecting flights with < 90-min layovers."),
    (None, "Severe delays expected. Check airline alerts and consider flexible rebooking."),
)

# Risk score: peak hours and multipliers, the spans that scale each part, weights.
RISK_PEAK_HOURS = (7, 8, 9, 16, 17, 18, 19)
RISK_PEAK_MULTIPLIER = 1.30
RISK_OFF_PEAK_MULTIPLIER = 1.00
RISK_UNKNOWN_HOUR_MULTIPLIER = 1.10
RISK_SENSITIVITY_FLOOR = 0.9
RISK_SENSITIVITY_SPAN = 0.4
RISK_CONGESTION_SPAN = 0.35
RISK_WEIGHTS = (0.50, 0.25, 0.25)  # historical, weather, congestion
ROUTE_HUB_FACTOR = 1.12
ROUTE_OTHER_FACTOR = 0.95
ROUTE_EAST_FACTOR = 0.97
ROUTE_OTHER_DIRECTION_FACTOR = 1.03

# Delay threshold (minutes), tiers (name, lower bound) and minutes per tier.
DELAY_THRESHOLD = 15.0
MODEL_TIER_CUTS = (0.80, 0.55, 0.30)
SERVICE_TIER_CUTS = (0.75, 0.50, 0.25)
TIERS = ("SEVERE", "MODERATE", "MINOR", "ON_TIME")
TIER_MINUTES = {"SEVERE": 95.0, "MODERATE": 42.0, "MINOR": 18.0, "ON_TIME": 0.0}
MINUTES_PER_UNIT_PROBABILITY = 120.0

# Score histogram bounds; a last bucket is open ("+Inf").
HISTOGRAM_EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

# Drift limits.
KS_P_VALUE = 0.05
KS_MIN_SAMPLES = 30
SCORE_SHIFT_LIMIT = 0.07
DATASET_DRIFT_SHARE = 0.20

# Ensemble vote weights: boosted trees, boosted trees, forest.
VOTE_WEIGHTS = (0.4, 0.4, 0.2)
MEAN_SCORE_WHEN_EMPTY = 0.5

# Valid weather words of an incoming record, in the order the message lists them.
VALID_WEATHER = ("clear", "rain", "snow", "fog", "wind")

# Columns that are never model inputs.
NON_FEATURES = (
    "flight_id", "carrier_code", "origin", "destination",
    "scheduled_departure", "aircraft_type", "weather_condition",
)
