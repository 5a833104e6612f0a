"""Vocabulary tables: tab-separated files of strings, one table per file."""

from __future__ import annotations

import csv
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import strings

#: The one table that is separated by commas.
COMMA_SEPARATED = ("source_to_concept_map",)
#: Texts that a common dataframe reader takes for missing; used with pandas_na only.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def table_name(path: str) -> str:
    return PurePosixPath(path).stem.lower()


def read_vocabulary_table(spark: SparkSession, path: str, pandas_na: bool = False) -> DataFrame:
    """One file, every column a string; empty cells are null, quotes are ordinary characters in TSV."""
    comma = table_name(path) in COMMA_SEPARATED
    options = {"sep": ",", "quote": '"'} if comma else {"sep": "\t", "quote": ""}
    header = spark.read.text(path).limit(1).first()
    quoting = csv.QUOTE_MINIMAL if comma else csv.QUOTE_NONE
    names = next(csv.reader([header[0]], delimiter=options["sep"], quoting=quoting)) if header else []
    df = spark.read.options(header=True, **options).schema(strings(*names)).csv(path)
    if pandas_na:
        df = df.select(*(F.when(F.col(f"`{c}`").isin(*NA_TEXTS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns))
    return df


def vocabulary_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder, through Spark's file systems, so that any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath()) for f in found if str(f.getPath()).lower().endswith(".csv"))


def load_vocabulary(spark: SparkSession, folder: str, pandas_na: bool = False) -> dict[str, DataFrame]:
    """All tables of a folder by name, each also a temporary view of that name."""
    tables = {table_name(p): read_vocabulary_table(spark, p, pandas_na) for p in vocabulary_files(spark, folder)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def save_vocabulary(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Each table as Parquet under its name; mode is skip or overwrite."""
    if mode not in ("skip", "overwrite"):
        raise ValueError(f"mode must be skip or overwrite, not {mode}")
    for name, df in tables.items():
        df.write.mode("ignore" if mode == "skip" else "overwrite").parquet(f"{root}/{name}")
