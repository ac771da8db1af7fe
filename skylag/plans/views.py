"""Flight tables derived from the order tables, in SQL that Spark and DuckDB share.

Names in braces are the tables a view reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylag.sources.scratch import materialize

AIRPORT_LIST = (
    "ATL,BOS,BWI,CLT,DCA,DEN,DFW,DTW,EWR,FLL,IAD,IAH,JFK,LAS,LAX,LGA,MCO,MDW,MIA,MSP,ORD,PDX,PHL,PHX,SEA,SFO,SLC,STL"
)

FLIGHTS = f"""
SELECT
  concat('F', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-',
         cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS flight_id,
  CASE WHEN l_partkey % 97 = 0 THEN 'aa' WHEN l_partkey % 89 = 0 THEN 'ZZ' WHEN l_partkey % 101 = 0 THEN NULL
       ELSE split_part('AA,DL,UA,WN,B6,AS,NK,F9,G4,SY', ',', cast(l_suppkey % 10 + 1 AS int)) END AS carrier_code,
  CASE WHEN l_partkey % 83 = 0 THEN 'QQQ' WHEN l_partkey % 79 = 0 THEN 'ord'
       ELSE split_part('{AIRPORT_LIST}', ',', cast(l_partkey % 28 + 1 AS int)) END AS origin,
  split_part('{AIRPORT_LIST}', ',', cast((l_suppkey * 3 + l_linenumber) % 28 + 1 AS int)) AS destination,
  CASE WHEN l_orderkey % 211 = 0 THEN 'not-a-date'
       ELSE concat(cast(cast(o_orderdate AS date) AS string), 'T',
                   lpad(cast((l_orderkey * 7 + l_linenumber * 5) % 24 AS string), 2, '0'), ':',
                   lpad(cast(l_partkey % 60 AS string), 2, '0'), ':00') END AS scheduled_departure,
  CASE WHEN l_partkey % 61 = 0 THEN NULL
       ELSE split_part('B737,B757,B777,A320,a321,E175,A380,CRJ9', ',', cast(l_partkey % 8 + 1 AS int)) END AS aircraft_type,
  CASE WHEN l_suppkey % 37 = 0 THEN NULL
       ELSE cast(100 + (l_partkey * 13 + l_suppkey * 7) % 2701 AS double) END AS distance_miles,
  CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE l_linenumber = 3 AND l_suppkey % 10 = 0 END AS is_holiday,
  CASE WHEN l_partkey % 43 = 0 THEN NULL WHEN l_partkey % 10 < 7 THEN 0.0
       ELSE cast((l_partkey * 11) % 125 - 5 AS double) END AS prior_leg_delay_minutes,
  CASE WHEN l_partkey % 47 = 0 THEN NULL
       ELSE split_part('clear,rain,wind,fog,snow,Snow,hail', ',', cast((l_orderkey + l_linenumber) % 7 + 1 AS int)) END AS weather_condition,
  CASE WHEN l_partkey % 59 = 0 THEN NULL WHEN l_quantity <= 36 THEN l_quantity - 30 + l_suppkey % 10
       ELSE (l_quantity - 37) * 9 + 15 + l_suppkey % 10 END AS dep_delay_minutes,
  round(0.05 + l_discount * 5 + l_tax * 2.5 + l_quantity * 0.004, 4) AS delay_probability
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

RAW_FLIGHTS = """
SELECT
  CASE WHEN cast(distance_miles AS bigint) % 113 = 0 THEN NULL ELSE flight_id END AS flight_id,
  carrier_code,
  CASE WHEN cast(distance_miles AS bigint) % 71 = 0 THEN 'OR' ELSE origin END AS origin,
  destination, scheduled_departure, aircraft_type,
  CASE WHEN cast(distance_miles AS bigint) % 67 = 0 THEN cast(0 AS double) ELSE distance_miles END AS distance_miles,
  cast(cast(distance_miles AS bigint) % 26 AS int) AS departure_hour,
  cast(cast(distance_miles AS bigint) % 8 AS int) AS day_of_week,
  cast(cast(distance_miles AS bigint) % 14 AS int) AS month,
  is_holiday, prior_leg_delay_minutes, weather_condition
FROM {flights}
"""

TEXT_FLIGHTS = """
SELECT flight_id, carrier_code, origin, destination, scheduled_departure,
  CASE WHEN cast(distance_miles AS bigint) % 17 = 0 THEN 'abc' WHEN cast(distance_miles AS bigint) % 19 = 0 THEN 'Infinity'
       WHEN cast(distance_miles AS bigint) % 23 = 0 THEN 'nan' ELSE cast(distance_miles AS string) END AS distance_miles,
  CASE WHEN cast(distance_miles AS bigint) % 13 = 0 THEN 'xx'
       ELSE cast(cast(distance_miles AS bigint) % 26 AS string) END AS departure_hour,
  CASE WHEN cast(distance_miles AS bigint) % 29 = 0 THEN 'maybe' WHEN is_holiday THEN 'true' ELSE 'false' END AS is_holiday
FROM {flights}
"""

# Flights without a readable departure (text sorts behind any year) belong to the reference side.
FLIGHTS_REF = """
SELECT flight_id, distance_miles, prior_leg_delay_minutes, delay_probability
FROM {flights} WHERE scheduled_departure < '1998-06-01' OR scheduled_departure >= '2100'
"""

FLIGHTS_CUR = """
SELECT flight_id, distance_miles * 1.1 AS distance_miles, prior_leg_delay_minutes,
       round(least(0.99, delay_probability + 0.08), 4) AS delay_probability
FROM {flights} WHERE scheduled_departure >= '1998-06-01' AND scheduled_departure < '2100'
"""

LINEAGE_EDGES = """
SELECT concat('region-', cast(n_regionkey AS string)) AS src, concat('nation-', cast(n_nationkey AS string)) AS dst FROM {nation}
UNION ALL SELECT concat('nation-', cast(s_nationkey AS string)), concat('supplier-', cast(s_suppkey AS string)) FROM {supplier}
UNION ALL SELECT concat('nation-', cast(c_nationkey AS string)), concat('customer-', cast(c_custkey AS string)) FROM {customer}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str], DataFrame] = {}


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flights of one folder, derived and stored once per application.

    The operators then scan a flights table, as they would in use: filters and column
    choices reach the files, and the derivation is not compiled into every query.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = materialize(derived_flights(spark, sf_dir), "flights")
    return _STORED[key]


def derived_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flights as a plan, for a caller that stores the few columns it needs itself."""
    return spark.sql(FLIGHTS, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_FLIGHTS, flights=flights(spark, sf_dir))


def text_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXT_FLIGHTS, flights=flights(spark, sf_dir))


def flights_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLIGHTS_REF, flights=flights(spark, sf_dir))


def flights_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLIGHTS_CUR, flights=flights(spark, sf_dir))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "supplier", "customer")
    return spark.sql(LINEAGE_EDGES, **{n: table(spark, sf_dir, n) for n in names})


def ctes(*names: str) -> str:
    """`WITH` clause defining the named views over the base tables."""
    bodies = {
        "flights": FLIGHTS.format(lineitem="lineitem", orders="orders"),
        "raw_flights": RAW_FLIGHTS.format(flights="flights"),
        "text_flights": TEXT_FLIGHTS.format(flights="flights"),
        "flights_ref": FLIGHTS_REF.format(flights="flights"),
        "flights_cur": FLIGHTS_CUR.format(flights="flights"),
        "lineage_edges": LINEAGE_EDGES.format(nation="nation", supplier="supplier", customer="customer"),
    }
    return ",\n".join(f"{name} AS ({bodies[name]})" for name in names)
