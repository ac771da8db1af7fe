"""Session settings that the wide plans of this library profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot never compiles a method above 8000 bytes of bytecode. Spark's own limit for
# falling back from one fused method is far higher, so a wide projection would run
# interpreted; with this value Spark splits such a stage instead.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
