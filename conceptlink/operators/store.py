"""Tables that a step writes once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a temporary one if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="conceptlink-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_path(spark: SparkSession, note: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/conceptlink-{note}-{uuid.uuid4().hex}"


def stored(df: DataFrame, note: str) -> DataFrame:
    """Written and read again: what models have answered is asked once, whatever reads it later."""
    path = fresh_path(df.sparkSession, note)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
