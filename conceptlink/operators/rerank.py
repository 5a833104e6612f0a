"""Reranking of candidate lists: BM25 in plain DataFrame terms, model scores, and the common order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored

NEEDED = ("query_id", "query", "expression_id", "expression", "retrieval_rank")


def check_candidates(df: DataFrame) -> None:
    missing = [c for c in NEEDED if c not in df.columns]
    if missing:
        raise TypeError(f"candidates lack the columns {missing}")


def bm25_scored(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """The candidates with rerank_score, each query's candidates being a corpus of its own.

    Tokens are split at single spaces, case and empty tokens kept; repeated query tokens count each;
    a negative idf becomes epsilon times the mean idf of the query's corpus.  Null and empty
    expressions are no documents and have no score.  All steps are grouped or windowed by query, so
    the candidates are read and shuffled once.
    """
    others = [c for c in candidates.columns if c not in ("query_id", "expression_id", "rerank_score", "rank")]
    whole, term = Window.partitionBy("query_id"), Window.partitionBy("query_id", "token")
    is_doc = F.coalesce(F.col("expression") != "", F.lit(False))
    docs = candidates.select("query_id", "expression_id", F.struct(*others).alias("_row"), F.when(is_doc, F.split("expression", " ")).alias("_t"))
    docs = docs.withColumns({"_dl": F.size("_t"), "_n": F.count("_t").over(whole)})
    docs = docs.withColumn("_avgdl", F.avg(F.when(F.col("_t").isNotNull(), F.col("_dl"))).over(whole))
    docs = docs.withColumn("_q", F.split(F.col("_row.query"), " "))
    tokens = docs.select("query_id", "expression_id", "_row", "_dl", "_n", "_avgdl", "_q", F.explode_outer("_t").alias("token"))
    keys = ("query_id", "expression_id", "token")
    tf = tokens.groupBy(*keys).agg(
        F.count("token").alias("tf"), *(F.first(c).alias(c) for c in ("_row", "_dl", "_n", "_avgdl", "_q"))
    )
    tf = tf.withColumn("df", F.count("token").over(term))
    raw = F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    tf = tf.withColumn("raw", F.when(F.col("token").isNotNull(), raw))
    # each token stands in df rows, so weights of 1 / df give the mean over the vocabulary
    mean = F.sum(F.col("raw") / F.col("df")).over(whole) / F.sum(F.when(F.col("raw").isNotNull(), 1 / F.col("df"))).over(whole)
    idf = F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw"))
    asked = F.size(F.filter("_q", lambda x: x == F.col("token")))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl")))
    parts = tf.select("query_id", "expression_id", "_row", F.when(F.col("token").isNotNull(), asked * idf * weight).alias("_s"))
    done = parts.groupBy("query_id", "expression_id").agg(F.sum("_s").alias("rerank_score"), F.first("_row").alias("_row"))
    return done.select("query_id", "expression_id", "_row.*", "rerank_score")


def bm25_scores(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, expression_id, rerank_score) of the candidates that have a score."""
    scored = bm25_scored(candidates, k1, b, epsilon)
    return scored.where(F.col("rerank_score").isNotNull()).select("query_id", "expression_id", "rerank_score")


def sort_key(score: str = "rerank_score") -> Column:
    """Scores of zero and missing scores stand behind all others, negative ones included."""
    return F.coalesce(F.nullif(F.col(score), F.lit(0.0)), F.lit(float("-inf")))


def ranked(scored: DataFrame) -> DataFrame:
    """rank by falling score, ties in retrieval order."""
    order = Window.partitionBy("query_id").orderBy(F.desc(sort_key()), F.asc("retrieval_rank"))
    return scored.withColumn("rank", F.row_number().over(order) - 1)


def with_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    kept = candidates.drop("rerank_score", "rank")
    return ranked(kept.join(scores, ["query_id", "expression_id"], "left"))


def rerank_bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    check_candidates(candidates)
    return ranked(bm25_scored(candidates, k1, b, epsilon))


def keep_order(candidates: DataFrame) -> DataFrame:
    """The reranker for none: rank is the retrieval rank."""
    check_candidates(candidates)
    return candidates.withColumn("rank", F.col("retrieval_rank"))


def yes_probability(no_logit: Column, yes_logit: Column) -> Column:
    """Softmax of two logits, the share of yes."""
    return 1 / (1 + F.exp(no_logit - yes_logit))


def pair_prompt(task: str, query: Column, document: Column) -> Column:
    """The instruction, query and document that a judging model reads (fixed values: the form its training gave it)."""
    return F.concat(F.lit(f"<Instruct>: {task}\n<Query>: "), query, F.lit("\n<Document>: "), document)


def fit_tokens(ids: list[int], prefix: list[int], suffix: list[int], max_length: int) -> list[int]:
    """Cuts a pair's ids so that they and the fixed parts fit."""
    return prefix + ids[: max(0, max_length - len(prefix) - len(suffix))] + suffix


def left_padded(rows: list[list[int]], pad: int) -> list[list[int]]:
    width = max(map(len, rows), default=0)
    return [[pad] * (width - len(r)) + r for r in rows]


def rerank_with_model(candidates: DataFrame, scorer: Callable[[], Callable[[list[str]], list[float]]], task: str) -> DataFrame:
    """Scores by a model: ``scorer`` is called once per task and gives a function of prompts to scores; they are written once."""
    check_candidates(candidates)
    text = F.coalesce(F.col("expression"), F.raise_error(F.lit("a candidate has no expression")).cast("string"))
    prompts = candidates.select("query_id", "expression_id", pair_prompt(task, F.col("query"), text).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for batch in batches:
            yield batch[["query_id", "expression_id"]].assign(rerank_score=[float(x) for x in score(batch["prompt"].tolist())])

    schema = "query_id long, expression_id string, rerank_score double"
    return with_scores(candidates, stored(prompts.mapInPandas(run, schema), "scores"))
