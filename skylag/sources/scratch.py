"""Intermediate tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names; on one machine a fresh local one where none is named."""
    global _local_root
    shared = spark.conf.get(_SETTING, None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share (master is {master})")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="run-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that still read them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """MLlib cuts the lineage of long fits through the checkpoint directory."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` once and return a scan of it.

    Later stages see fixed rows whatever is recomputed, and Catalyst knows the true
    size of the table, so it chooses broadcast or shuffle joins on measured bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)
