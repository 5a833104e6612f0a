"""Selection of one candidate per query, and checks of the verdicts that models give."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.limits import Pacer, paced
from ..functions.prompts import fill_prompt
from ..schemas import EXPRESSION
from .store import stored

SELECTED = [*EXPRESSION.names, "distance", "rerank_score"]

SELECT_PROMPT = [
    {
        "role": "system",
        "content": "A coder has to file one term of a local code list under a standard vocabulary. You get the term and a JSON array of entries, "
        "each an expression of a standard concept with its expression_id. Compare meaning, not wording: a narrower, wider or merely "
        "related entry is not a match. Reply in JSON only, by the schema {json_format}; expression_id is null when no entry matches.",
    },
    {"role": "user", "content": "TERM\n{query}\n\nENTRIES\n{expressions}"},
]
#: Prompts that go to a judge together.
PROMPTS_AT_ONCE = 16


def _one_row_per_query(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Queries without a choice get a row of nulls."""
    picked = chosen.select("query_id", *SELECTED, "result_list_index")
    return queries.select("query_id", "query").join(picked, "query_id", "left")


def select_first(queries: DataFrame, candidates: DataFrame, threshold: float = float("inf")) -> DataFrame:
    """The candidate of rank 0 if its distance is below the threshold; no other is looked at."""
    first = candidates.where((F.col("rank") == 0) & (F.col("distance") < F.lit(threshold)))
    return _one_row_per_query(queries, first.withColumn("result_list_index", F.lit(0)))


def apply_verdicts(queries: DataFrame, candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (query_id, expression_id): a missing or unknown id selects nothing.

    result_list_index is the smallest rank at which the query's list has the id.
    """
    given = verdicts.where(F.col("expression_id").isNotNull()).select("query_id", "expression_id")
    hits = candidates.join(given, ["query_id", "expression_id"], "left_semi").groupBy("query_id")
    best = hits.agg(F.min(F.struct(F.col("rank").alias("result_list_index"), *SELECTED)).alias("_best"))
    return _one_row_per_query(queries, best.select("query_id", "_best.*"))


def capitalized(c: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def prompt_object() -> Column:
    """What a model is shown of a candidate, as JSON."""
    return F.to_json(
        F.struct(
            F.col("expression_id"), F.col("expression"), F.col("std_concept_id").alias("concept_id"),
            F.col("std_concept_name").alias("concept_name"), F.col("std_vocabulary_id").alias("vocabulary_id"), F.col("std_domain_id").alias("domain_id"),
        )
    )


def judge_prompts(candidates: DataFrame, template: list[dict] | None = None) -> DataFrame:
    """(query_id, prompt): the filled messages, with the candidates in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", prompt_object().alias("o"))))
    shown = candidates.groupBy("query_id").agg(F.first("query").alias("query"), F.transform(listed, lambda x: x["o"]).alias("all"))
    values = {
        "json_format": F.lit(json.dumps({"type": "object", "properties": {"expression_id": {"type": ["string", "null"]}}})),
        "query": capitalized(F.col("query")),
        "expressions": F.concat(F.lit("["), F.array_join("all", ", "), F.lit("]")),
    }
    return shown.select("query_id", fill_prompt(template or SELECT_PROMPT, values).alias("prompt"))


def select_with_judge(
    queries: DataFrame,
    candidates: DataFrame,
    judge: Callable[[], Callable[[list[list[dict]]], list[str]]],
    template: list[dict] | None = None,
    system_as_user: bool = False,
    rate_limit: int | None = None,
) -> DataFrame:
    """A model picks: ``judge`` is called once per task and maps a batch of prompts to JSON replies.

    The replies are written when this is called, ``rate_limit`` prompts a minute at most; each query is asked once.
    """
    asked, rate = paced(judge_prompts(candidates, template), rate_limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pacer = judge(), Pacer(rate)
        for batch in batches:
            prompts = [[{"role": "user" if system_as_user else m["role"], "content": m["content"]} for m in p] for p in batch["prompt"]]
            replies: list[str] = []
            for lo in range(0, len(prompts), PROMPTS_AT_ONCE):
                some = prompts[lo : lo + PROMPTS_AT_ONCE]
                pacer.wait(len(some))
                replies += ask(some)
            yield batch[["query_id"]].assign(reply=replies)

    replies = stored(asked.mapInPandas(run, "query_id long, reply string"), "verdicts")
    verdicts = replies.select("query_id", F.from_json("reply", "expression_id string")["expression_id"].alias("expression_id"))
    return apply_verdicts(queries, candidates, verdicts)
