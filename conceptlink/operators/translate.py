"""Translation of source descriptions: identity, or a model with retries and the original as fallback."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.limits import Pacer, paced
from ..functions.prompts import fill
from .store import stored

TRANSLATE_PROMPT = [
    {"role": "system", "content": "Translate the clinical term into English. Answer with a JSON object of this form: {json_format}."},
    {"role": "user", "content": "{text}"},
]
REPLY_FORM = '{"text": "the translation"}'


@dataclass(frozen=True)
class Translator:
    """``load`` is called once per task and gives a function from messages to a JSON reply; None: identity.

    Up to ``at_once`` texts of a task are under way at a time.
    """

    name: str
    load: Callable[[], Callable[[list[dict]], str]] | None = None
    retries: int = 3
    template: tuple[dict, ...] = tuple(TRANSLATE_PROMPT)
    at_once: int = 1


IDENTITY = Translator("empty")


def translate(sources: DataFrame, translator: Translator = IDENTITY, rate_limit: int | None = None) -> DataFrame:
    """(query_id, text).  Equal texts are sent once; after ``retries`` failures a text stays as it is.

    The answers are written when this is called, ``rate_limit`` texts a minute at most; reading the result asks nobody.
    """
    asked = sources.select("query_id", F.col("source_code_description").alias("original"))
    if translator.load is None:
        return asked.select("query_id", F.col("original").alias("text"))
    load, retries, template, at_once = translator.load, translator.retries, list(translator.template), translator.at_once
    distinct, rate = paced(asked.select("original").where(F.col("original").isNotNull()).distinct(), rate_limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pacer = load(), Pacer(rate)

        def one(text: str) -> str:
            pacer.wait()
            return attempt(ask, template, text, retries)

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                yield batch.assign(text=list(pool.map(one, batch["original"])))

    done = stored(distinct.mapInPandas(run, "original string, text string"), "translations")
    return asked.join(done, "original", "left").select("query_id", F.coalesce("text", "original").alias("text"))


def attempt(ask: Callable[[list[dict]], str], template: list[dict], text: str, retries: int) -> str:
    for _ in range(max(1, retries)):
        try:
            found = json.loads(ask(fill(template, {"json_format": REPLY_FORM, "text": text})))["text"]
            if isinstance(found, str):
                return found
        except Exception:  # noqa: BLE001  any failure of a model leaves the text as it is
            continue
    return text
