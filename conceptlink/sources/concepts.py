"""Source concepts from CSV files, lists or frames, with a stable query_id."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SOURCE, strings


def require_columns(names: Sequence[str], needed: Sequence[str] = SOURCE.names) -> None:
    missing = set(needed) - set(names)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}; needed are {list(needed)}, given are {list(names)}")


def numbered(df: DataFrame, name: str = "query_id") -> DataFrame:
    """Adds the row's place in file order: counts of the partitions before, and the place in its own.

    The counts, one number a partition, come to the driver; no row is shuffled or leaves the JVM.
    """
    bits = 33  # monotonically_increasing_id: the partition above, the place in it below
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    sizes = marked.groupBy(F.shiftright("_at", bits).alias("p")).count().orderBy("p").collect()
    before, pairs = 0, []
    for r in sizes:
        pairs += [F.lit(r.p), F.lit(before)]
        before += r["count"]
    start = F.create_map(*pairs)[F.shiftright("_at", bits)] if pairs else F.lit(0).cast("long")
    return marked.withColumn(name, (start + F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))).cast("long")).drop("_at")


def read_source_csv(
    spark: SparkSession, path: str, column_mapping: Mapping[str, str] | None = None, limit_to: int | None = None
) -> DataFrame:
    """Rows of a CSV as strings: too long rows are skipped, short ones padded with nulls.

    query_id numbers the rows before the limit and before rows without description are dropped.
    """
    if not path.lower().endswith(".csv"):
        raise ValueError(f"only .csv files are read, not {path}")
    header = spark.read.text(path).limit(1).first()
    names = next(csv.reader([header[0]])) if header else []
    extra = "_over"
    while extra in names:
        extra += "_"
    df = spark.read.options(header=True, mode="PERMISSIVE", enforceSchema=True).schema(strings(*names, extra)).csv(path)
    df = numbered(df.where(F.col(extra).isNull()).drop(extra))
    if limit_to is not None:
        df = df.where(F.col("query_id") < limit_to)
    df = df.withColumnsRenamed(dict(column_mapping or {}))
    require_columns(df.columns)
    return df


def rejected_rows(df: DataFrame) -> DataFrame:
    """The query_ids of rows without a description."""
    return df.where(F.col("source_code_description").isNull()).select("query_id")


def null_report(df: DataFrame) -> DataFrame:
    """One row: how many rows have no description."""
    return df.agg(F.count_if(F.col("source_code_description").isNull()).alias("n_null"), F.count("*").alias("n_rows"))


def clean_sources(df: DataFrame) -> DataFrame:
    """query_id and the source columns as strings, nulls as empty texts, rows without description dropped."""
    kept = df.where(F.col("source_code_description").isNotNull())
    return kept.select("query_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SOURCE.names))


def load_source_csv(spark: SparkSession, path: str) -> DataFrame:
    """The plain loader: no check of columns, nulls become empty texts, unknown columns go."""
    df = numbered(spark.read.options(header=True).csv(path))
    return df.select(
        "query_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SOURCE.names)
    )


def sources_from_list(spark: SparkSession, items: Sequence[str | Mapping]) -> DataFrame:
    """Texts (descriptions only) or mappings, numbered in order; one bare text is refused."""
    if isinstance(items, str):
        raise TypeError("give a list of texts; a single text would be read character by character")
    rows = []
    for k, item in enumerate(items):
        values = {"source_code_description": item} if isinstance(item, str) else dict(item)
        rows.append((k, *(None if values.get(c) is None else str(values[c]) for c in SOURCE.names)))
    schema = T.StructType([T.StructField("query_id", T.LongType()), *SOURCE.fields])
    return spark.createDataFrame(rows, schema)


def is_date_or_blank(c: Column) -> Column:
    """Null, empty, or a real date written year-month-day with one or two digits for month and day."""
    shaped = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return c.isNull() | (c == "") | (shaped & F.try_to_date(F.when(shaped, c), "yyyy-M-d").isNotNull())


def check_dates(df: DataFrame, columns: Sequence[str] = ("valid_start_date", "valid_end_date")) -> DataFrame:
    """Raises on the first row with a malformed date."""
    for c in columns:
        if dict(df.dtypes)[c] != "string":
            raise TypeError(f"{c} must be a string in YYYY-MM-DD format")
        bad = F.raise_error(F.concat(F.lit(f"{c} must be in YYYY-MM-DD format: "), F.col(c)))
        df = df.withColumn(c, F.when(is_date_or_blank(F.col(c)), F.col(c)).otherwise(bad))
    return df


def ids_as_strings(df: DataFrame, columns: Sequence[str], null_as_none: bool = False) -> DataFrame:
    """Casts ids to strings; nulls stay, or become the text None."""
    cast = {c: F.col(c).cast("string") for c in columns}
    return df.withColumns({c: F.coalesce(x, F.lit("None")) if null_as_none else x for c, x in cast.items()})


def check_members(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Raises on values outside the closed set; nulls are values outside."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    bad = F.raise_error(F.concat(F.lit(f"{column} is not one of {', '.join(allowed)}: "), F.coalesce(F.col(column), F.lit("null"))))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(bad))
