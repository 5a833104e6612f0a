"""Schemas and closed value sets of the engine."""

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ORIGINS = (
    "standard_concept",
    "standard_concept_synonym",
    "mapped_non_standard_concept",
    "mapped_non_standard_concept_synonym",
)
STANDARD_VOCABULARIES = ("SNOMED", "RxNorm", "LOINC")

DATASET = strings(
    "expression", "expression_concept_id", "std_concept_id", "std_concept_name", "std_vocabulary_id", "std_vocabulary_code", "std_domain_id"
)
EXPRESSION = strings(
    "expression_id", "expression", "expression_concept_id", "expression_origin", "std_concept_id", "std_concept_name",
    "std_vocabulary_id", "std_vocabulary_code", "std_domain_id",
)
#: The inputs of the deterministic id, in order; the domain is not one of them.
ID_PARTS = (
    "expression", "expression_concept_id", "expression_origin", "std_concept_id", "std_concept_name", "std_vocabulary_id", "std_vocabulary_code"
)
SOURCE = strings(
    "source_code", "source_concept_id", "source_vocabulary_id", "source_code_description", "valid_start_date", "valid_end_date", "invalid_reason"
)
MAPPED = (
    *SOURCE.names, "target_concept_id", "target_vocabulary_id", "target_vocabulary_code", "domain_id", "confidence_score",
    "source_code_description_original",
)
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
