"""Timing of named blocks."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Profiler:
    """Elapsed seconds by name; summaries are made with Spark from the recorded rows."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def block(self, name: str) -> Iterator[None]:
        begin = time.perf_counter()
        try:
            yield
        finally:
            self.add(name, time.perf_counter() - begin)

    def add(self, name: str, elapsed: float) -> None:
        self.rows.append((name, float(elapsed)))

    def summary(self, spark: SparkSession) -> DataFrame:
        return profile_summary(spark.createDataFrame(self.rows, "name string, elapsed double"))


def profile_summary(rows: DataFrame) -> DataFrame:
    """total, calls, mean and percent per name, the longest first."""
    sums = rows.groupBy("name").agg(F.sum("elapsed").alias("total"), F.count("*").alias("calls"), F.avg("elapsed").alias("mean"))
    share = F.coalesce(F.try_divide(100 * F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    return sums.withColumn("percent", share).orderBy(F.desc("total"), "name")
