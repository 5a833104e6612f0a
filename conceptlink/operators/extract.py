"""Structured extraction: texts and prompts to a model, replies to validated records."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.omop import RecordModel, model_of, validated
from ..functions.prompts import check_args, fill, json_schema
from .store import stored


@dataclass(frozen=True)
class ExtractionTask:
    """A template, the texts, the arguments (for all texts or for each) and the records asked for."""

    template: tuple[Mapping[str, str], ...]
    texts: tuple[str, ...]
    model: str | RecordModel
    args: Mapping[str, str] | Sequence[Mapping[str, str]] | None = None

    def __post_init__(self) -> None:
        model_of(self.model)
        check_args(self.template, self.args, len(self.texts))


def extract(spark: SparkSession, tasks: Sequence[ExtractionTask], load: Callable[[], Callable[[list[dict]], str]]) -> DataFrame:
    """Rows (task_id, text_idx, text, reply, record, violations).

    ``record`` is typed where all tasks ask for one model; with several it is JSON text, and every task's
    replies are checked against its own model.  The model is asked once per text, while this runs.
    """
    if isinstance(tasks, ExtractionTask) or not all(isinstance(t, ExtractionTask) for t in tasks):
        raise TypeError("give a list of extraction tasks")
    if not tasks:
        raise ValueError("give at least one task")
    rows = []
    for k, task in enumerate(tasks):
        model, many = model_of(task.model)
        form = json_schema(model.schema)
        form = json.dumps({"type": "object", "properties": {"records": {"type": "array", "items": form}}} if many else form)
        for i, text in enumerate(task.texts):
            args = task.args if isinstance(task.args, Mapping) or task.args is None else task.args[i]
            rows.append((k, i, text, json.dumps(fill(task.template, {"text": text, "json_format": form, **(args or {})}))))
    asked = spark.createDataFrame(rows, "task_id int, text_idx int, text string, prompt string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for batch in batches:
            yield batch[["task_id", "text_idx", "text"]].assign(reply=[ask(json.loads(p)) for p in batch["prompt"]])

    replies = stored(asked.mapInPandas(run, "task_id int, text_idx int, text string, reply string"), "replies")
    kinds = list(dict.fromkeys(str(t.model) for t in tasks))
    if len(kinds) == 1:
        return validated(replies, "reply", tasks[0].model)
    parts = []
    for kind in kinds:
        mine = [k for k, t in enumerate(tasks) if str(t.model) == kind]
        done = validated(replies.where(F.col("task_id").isin(mine)), "reply", tasks[mine[0]].model)
        parts.append(done.withColumn("record", F.to_json("record")))
    return functools.reduce(DataFrame.unionByName, parts)
