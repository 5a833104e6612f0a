"""The four derivations of expressions of standard concepts, and their union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATASET, ORIGINS


def _valid_standard(alias: str, vocabularies: Sequence[str]) -> Column:
    if not vocabularies:
        raise ValueError("give at least one standard vocabulary")
    return (F.col(f"{alias}.standard_concept") == "S") & F.col(f"{alias}.vocabulary_id").isin(*vocabularies)


def _shape(expression: str, concept_id: str, target: str) -> list[Column]:
    return [
        F.col(expression).alias("expression"),
        F.col(concept_id).alias("expression_concept_id"),
        F.col(f"{target}.concept_id").alias("std_concept_id"),
        F.col(f"{target}.concept_name").alias("std_concept_name"),
        F.col(f"{target}.vocabulary_id").alias("std_vocabulary_id"),
        F.col(f"{target}.concept_code").alias("std_vocabulary_code"),
        F.col(f"{target}.domain_id").alias("std_domain_id"),
    ]


def standard_concepts(concept: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """Valid standard concepts under their own names."""
    c = concept.alias("c").where(_valid_standard("c", vocabularies) & F.col("c.invalid_reason").isNull())
    return c.select(*_shape("c.concept_name", "c.concept_id", "c"))


def standard_synonyms(concept: DataFrame, synonym: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """Valid standard concepts under each of their synonyms."""
    c = concept.alias("c").where(_valid_standard("c", vocabularies) & F.col("c.invalid_reason").isNull())
    joined = c.join(synonym.alias("s"), F.col("c.concept_id") == F.col("s.concept_id"))
    return joined.select(*_shape("s.concept_synonym_name", "s.concept_id", "c"))


def _maps_to(concept: DataFrame, relationship: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """Valid edges to other standard concepts with another name; the target's own validity is not asked."""
    edges = relationship.alias("r").where(
        (F.col("r.relationship_id") == "Maps to") & (F.col("r.concept_id_1") != F.col("r.concept_id_2")) & F.col("r.invalid_reason").isNull()
    )
    origin, target = concept.alias("o"), concept.alias("t")
    joined = edges.join(origin, F.col("r.concept_id_1") == F.col("o.concept_id"), "left")
    joined = joined.join(target, F.col("r.concept_id_2") == F.col("t.concept_id"), "left")
    renamed = F.col("o.concept_name") != F.col("t.concept_name")
    return joined.where(renamed & _valid_standard("t", vocabularies) & F.col("o.invalid_reason").isNull())


def mapped_concepts(concept: DataFrame, relationship: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """Concepts that map to a standard concept, under their own names."""
    return _maps_to(concept, relationship, vocabularies).select(*_shape("o.concept_name", "r.concept_id_1", "t"))


def mapped_synonyms(concept: DataFrame, relationship: DataFrame, synonym: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """The same concepts under their synonyms."""
    edges = _maps_to(concept, relationship, vocabularies)
    joined = edges.join(synonym.alias("s"), F.col("o.concept_id") == F.col("s.concept_id"))
    return joined.select(*_shape("s.concept_synonym_name", "r.concept_id_1", "t"))


def mapped_under_all_names(concept: DataFrame, relationship: DataFrame, synonym: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """Concepts that map to a standard concept, under their names and synonyms, with the origin; the edges are made once."""
    names, synonyms = ORIGINS[2:]
    edges = _maps_to(concept, relationship, vocabularies).select(*_shape("o.concept_name", "r.concept_id_1", "t"))
    each = edges.withColumn("expression_origin", F.explode(F.array(F.lit(names), F.lit(synonyms))))
    wanted = (F.col("expression_origin") == synonyms) & (F.col("expression_concept_id") == F.col("s.concept_id"))
    joined = each.join(synonym.select("concept_id", "concept_synonym_name").alias("s"), wanted, "left")
    joined = joined.where((F.col("expression_origin") == names) | F.col("s.concept_id").isNotNull())
    return joined.withColumn("expression", F.when(F.col("expression_origin") == names, F.col("expression")).otherwise(F.col("s.concept_synonym_name"))).drop(
        "concept_id", "concept_synonym_name"
    )


def expression_dataset(
    concept: DataFrame, synonym: DataFrame, relationship: DataFrame, vocabularies: Sequence[str], origins: Sequence[str] = ORIGINS
) -> DataFrame:
    """The four datasets with their origin: distinct within each, rows with any null dropped."""
    parts = {
        "standard_concept": lambda: standard_concepts(concept, vocabularies),
        "standard_concept_synonym": lambda: standard_synonyms(concept, synonym, vocabularies),
        "mapped_non_standard_concept": lambda: mapped_concepts(concept, relationship, vocabularies),
        "mapped_non_standard_concept_synonym": lambda: mapped_synonyms(concept, relationship, synonym, vocabularies),
    }
    unknown = set(origins) - set(parts)
    if unknown:
        raise ValueError(f"unknown origins {sorted(unknown)}; known are {list(parts)}")
    total = None
    if set(ORIGINS[2:]) <= set(origins):
        total = mapped_under_all_names(concept, relationship, synonym, vocabularies)
        origins = [o for o in origins if o not in ORIGINS[2:]]
    for origin in origins:
        part = parts[origin]().withColumn("expression_origin", F.lit(origin))
        total = part if total is None else total.unionByName(part)
    if total is None:
        raise ValueError("give at least one origin")
    return total.na.drop("any").distinct().select(*DATASET.names, "expression_origin")


def save_datasets(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one folder per origin; mode is skip or overwrite."""
    if mode not in ("skip", "overwrite"):
        raise ValueError(f"mode must be skip or overwrite, not {mode}")
    df.write.mode("ignore" if mode == "skip" else "overwrite").partitionBy("expression_origin").parquet(path)


def concept_fanout(chosen: DataFrame, concept: DataFrame, relationship: DataFrame) -> DataFrame:
    """All concepts of any vocabulary that map to each chosen std_concept_id (an extension)."""
    edges = relationship.where((F.col("relationship_id") == "Maps to") & F.col("invalid_reason").isNull())
    linked = chosen.select("std_concept_id").distinct().join(edges, F.col("std_concept_id") == F.col("concept_id_2"))
    named = linked.join(concept, F.col("concept_id_1") == F.col("concept_id"))
    return named.select("std_concept_id", "concept_id", "concept_name", "vocabulary_id", "concept_code").distinct()
