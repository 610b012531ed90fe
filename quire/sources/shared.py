"""Tables that a plan is cut at: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one makes a folder, a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quire_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._quire_dir = "file://" + tempfile.mkdtemp(prefix="quire-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it came out once: what reads it later, however often, sees the same rows and doesn't make them again."""
    path = f"{shared_dir(df.sparkSession)}/quire-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
