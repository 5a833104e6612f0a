"""Vocabulary-shaped views of the driver tables, as expressions and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARIES = ("SNOMED", "RxNorm", "LOINC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    vocabulary = F.when(key % 4 == 0, "SNOMED").when(key % 4 == 1, "RxNorm").when(key % 4 == 2, "LOINC").otherwise("ICD10")
    return p.select(
        key.cast("string").alias("concept_id"), F.col("p_name").alias("concept_name"), F.col("p_type").alias("domain_id"),
        vocabulary.alias("vocabulary_id"), F.when(key % 3 != 0, "S").alias("standard_concept"),
        F.concat("p_brand", F.lit("-"), key.cast("string")).alias("concept_code"), F.when(F.col("p_size") % 17 == 0, "D").alias("invalid_reason"),
    )


def concept_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    return p.select(F.col("p_partkey").cast("string").alias("concept_id"), F.concat("p_type", F.lit(" "), "p_name").alias("concept_synonym_name"))


def concept_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").count()
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("concept_id_1"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % n).cast("string").alias("concept_id_2"),
        F.when(F.col("l_linenumber") % 3 == 0, "Is a").otherwise("Maps to").alias("relationship_id"),
        F.when(F.col("l_returnflag") == "R", "D").alias("invalid_reason"),
    )
    return edges.distinct()


SQL = """
concept AS (
  SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_name AS concept_name, p_type AS domain_id,
    CASE p_partkey % 4 WHEN 0 THEN 'SNOMED' WHEN 1 THEN 'RxNorm' WHEN 2 THEN 'LOINC' ELSE 'ICD10' END AS vocabulary_id,
    CASE WHEN p_partkey % 3 <> 0 THEN 'S' END AS standard_concept, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS concept_code,
    CASE WHEN p_size % 17 = 0 THEN 'D' END AS invalid_reason
  FROM part),
concept_synonym AS (
  SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_type || ' ' || p_name AS concept_synonym_name FROM part WHERE p_partkey % 2 = 0),
concept_relationship AS (
  SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS concept_id_1,
    CAST((l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM part) AS VARCHAR) AS concept_id_2,
    CASE WHEN l_linenumber % 3 = 0 THEN 'Is a' ELSE 'Maps to' END AS relationship_id, CASE WHEN l_returnflag = 'R' THEN 'D' END AS invalid_reason
  FROM lineitem)"""
