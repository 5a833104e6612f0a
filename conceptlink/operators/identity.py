"""Deterministic expression ids, first-wins deduplication and the incremental anti-join."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EXPRESSION, ID_PARTS


def id_from_strings(parts: Sequence[str | None], digest_size: int = 16) -> str:
    """BLAKE2b of the parts that are there, joined by two pipes, in hexadecimal."""
    if not parts:
        raise ValueError("at least one part is needed")
    return hashlib.blake2b("||".join(str(p) for p in parts if p is not None).encode(), digest_size=digest_size).hexdigest()


def with_expression_id(df: DataFrame, method: str = "md5") -> DataFrame:
    """Adds expression_id, of 128 bits: md5 stays in the JVM, blake2b gives the ids of older indexes."""
    joined = F.concat_ws("||", *ID_PARTS)
    if method == "md5":
        return df.withColumn("expression_id", F.md5(joined)).select(*EXPRESSION.names)
    if method != "blake2b":
        raise ValueError(f"method must be md5 or blake2b, not {method}")

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.blake2b(x.encode(), digest_size=16).hexdigest())

    return df.withColumn("expression_id", digest(joined)).select(*EXPRESSION.names)


def one_per_id(df: DataFrame) -> DataFrame:
    """One row per expression_id; rows with one id differ in the domain only, the smallest stays."""
    others = [c for c in df.columns if c != "expression_id"]
    return df.groupBy("expression_id").agg(F.min(F.struct(*others)).alias("_row")).select("expression_id", "_row.*").select(*df.columns)


def not_indexed(df: DataFrame, index: DataFrame) -> DataFrame:
    """The rows whose id the index has not."""
    return df.join(index.select("expression_id"), "expression_id", "left_anti")
