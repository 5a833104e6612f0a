"""Mapped source concepts from sources, selections and translations."""

from __future__ import annotations

from dataclasses import make_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MAPPED, SOURCE

CONFIDENCE = ("sync", "async_compat")


def confidence(distance: Column, mode: str = "sync", exact_match: bool = False) -> Column:
    """1 - distance.  sync: null for distance 0 unless ``exact_match``; async_compat: 1 where there is none."""
    if mode not in CONFIDENCE:
        raise ValueError(f"confidence must be one of {CONFIDENCE}, not {mode}")
    if mode == "async_compat":
        return 1 - F.coalesce(distance, F.lit(0.0))
    return 1 - distance if exact_match else F.when(distance != 0, 1 - distance)


def shown_confidence(distance: Column) -> Column:
    """Two decimals, for lists that people read."""
    return F.format_string("%.2f", 1 - distance)


def assemble(
    sources: DataFrame, selections: DataFrame, translations: DataFrame | None = None, mode: str = "sync", exact_match: bool = False
) -> DataFrame:
    """One row per source in the output's column order, with query_id in front.

    ``translations`` has query_id and text; where there is one, it becomes the description.
    """
    chosen = selections.select(
        "query_id", "distance", F.col("std_concept_id").alias("target_concept_id"), F.col("std_vocabulary_id").alias("target_vocabulary_id"),
        F.col("std_vocabulary_code").alias("target_vocabulary_code"), F.col("std_domain_id").alias("domain_id"),
    )
    joined = sources.select("query_id", *SOURCE.names).join(chosen, "query_id", "left")
    joined = joined.withColumn("confidence_score", confidence(F.col("distance"), mode, exact_match))
    if translations is None:
        joined = joined.withColumn("source_code_description_original", F.lit(None).cast("string"))
    else:
        joined = joined.join(translations.select("query_id", F.col("text").alias("_text")), "query_id", "left")
        original = F.when(F.col("_text").isNotNull(), F.col("source_code_description"))
        joined = joined.withColumn("source_code_description_original", original)
        joined = joined.withColumn("source_code_description", F.coalesce("_text", "source_code_description"))
    return joined.select("query_id", *MAPPED)


#: One mapped source concept as an object.
MappedConcept = make_dataclass("MappedConcept", [(c, "str | float | None", None) for c in MAPPED], frozen=True)


def objects(mapped: DataFrame) -> list[MappedConcept]:
    return [MappedConcept(*(r[c] for c in MAPPED)) for r in mapped.orderBy("query_id").collect()]


def save_mapped(mapped: DataFrame, output_dir: str) -> str:
    """mapped_source_concepts.csv with a header, in query order, without query_id."""
    path = f"{output_dir.rstrip('/')}/mapped_source_concepts.csv"
    mapped.orderBy("query_id").drop("query_id").write.mode("overwrite").option("header", True).csv(path)
    return path
