"""The expression index: derive ids, leave out what is there, embed the rest, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Embedder, embedded
from ..functions.limits import check_rate
from .identity import not_indexed, one_per_id, with_expression_id

MODES = ("skip", "repair", "overwrite")


def index_path(root: str, model: str) -> str:
    return f"{root.rstrip('/')}/index/model_name={model}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build_index(
    dataset: DataFrame, root: str, embedder: Embedder, mode: str = "repair", id_method: str = "md5", rate_limit: int | None = None
) -> DataFrame:
    """Writes the index of a dataset and returns it.

    skip leaves an existing index alone; repair embeds and appends only ids that are not there (rows
    that have gone from the dataset stay); overwrite starts anew.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode}")
    check_rate(rate_limit)
    spark, path = dataset.sparkSession, index_path(root, embedder.name)
    there = exists(spark, path)
    if there and mode == "skip":
        return load_index(spark, root, embedder.name)
    fresh = one_per_id(with_expression_id(dataset, id_method))
    if there and mode == "repair":
        fresh = not_indexed(fresh, spark.read.parquet(path))
    out = embedded(fresh, embedder, "expression", "embedding", rate_limit)
    out.write.mode("append" if mode == "repair" else "overwrite").parquet(path)
    return load_index(spark, root, embedder.name)


def load_index(spark: SparkSession, root: str, model: str) -> DataFrame:
    return spark.read.parquet(index_path(root, model))


def lookup(index: DataFrame, concept_id: str | None = None, code: str | None = None) -> DataFrame:
    """Index rows of a standard concept, by id or by vocabulary code."""
    if (concept_id is None) == (code is None):
        raise ValueError("give either a concept id or a code")
    return index.where(F.col("std_concept_id") == concept_id if code is None else F.col("std_vocabulary_code") == code)
