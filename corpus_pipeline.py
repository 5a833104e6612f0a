"""The corpus pipeline: five stages over documents, each one operator of conceptlink.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptlink.llm import decontam, packing, quality, simhash, suffix_dedup
from conceptlink.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
#: 51 words of the test tables have 245 to 400 bytes where they repeat; below this length a passage is not found.
PASSAGE_BYTES = 200


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (predicted 0) go.

    Null and empty texts are scored like any other; repeated rows are judged each; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels, keep=REST).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the document with the smallest id stays; of its repeated rows one.

    Five-word shingles at a Jaccard similarity of 0.8 or more.  Null and empty texts have no shingles and
    are one component; null ids are compared as equal; an empty table stays empty.
    """
    linked = simhash.link_similar(docs, words=5, similarity=0.8).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    first = docs.join(linked, docs["doc_id"].eqNullSafe(linked["doc_id"]), "left_semi")
    return first.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of over 50 words that occurs elsewhere too; no row is dropped.

    A passage is looked for by its strings of PASSAGE_BYTES bytes; what repeats with 50 words or fewer stays.
    Null and empty texts become empty ones; repeated rows repeat all their passages.
    """
    done = suffix_dedup.remove_repeated(docs, length=PASSAGE_BYTES, least_words=51, keep=("lang", "source"))
    return done.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or a whole shorter item) go.

    Null and empty texts have no words and stay; repeated rows are judged alike.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_contamination(docs, items, keep=REST).where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left and its place in a training sequence; an empty or null text is its end mark."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("suffix-array dedup", cut_repeated),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
#: Stages that learn or tokenise have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs, "stage"), sf_dir)
    return docs
