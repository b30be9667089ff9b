"""Tables that are written once in the folder that driver and executors share, so that what is derived from them agrees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _local[0]


def settled(df: DataFrame) -> DataFrame:
    """``df``, written and read back: its rows and their partitions' numbers don't change if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
