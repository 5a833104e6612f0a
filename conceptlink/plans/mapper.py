"""The mapping pipeline as one lazy plan, its components by name, and piped stages."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed, models
from ..functions.limits import check_rate
from ..functions.registry import Registry
from ..operators import assembly, index, rerank, retrieval, selection, translate
from ..operators.store import stored
from ..sources import concepts
from ..sources.config import MappingTask, load_settings


class Stage:
    """A function of frames that ``frame | stage`` applies; stages chain to stages."""

    def __init__(self, apply: Callable[[Any], Any] = lambda x: x) -> None:
        self.apply = apply

    def __call__(self, value: Any) -> Any:
        return self.apply(value)

    def __or__(self, other: Callable[[Any], Any]) -> Stage:
        return Stage(lambda x: other(self(x)))

    def __ror__(self, value: Any) -> Any:
        return self(value)


@dataclass(frozen=True)
class Retriever:
    """An index with its embedder; ``where`` and ``top_k`` can be overridden per call."""

    index: DataFrame
    embedder: embed.Embedder = embed.OFFLINE
    top_k: int = 10
    where: Mapping[str, Any] | None = None
    metric: str = "l2"

    def __call__(
        self, queries: str | Sequence[str] | DataFrame, where: Mapping[str, Any] | None = None, top_k: int | None = None
    ) -> DataFrame:
        frame = as_queries(self.index.sparkSession, queries)
        texts = embed.embedded(frame.select("query").distinct(), self.embedder, "query")
        if self.embedder.load is not None:
            texts = stored(texts, "query-vectors")  # a model embeds each query once
        return retrieval.retrieve(
            frame.join(texts, "query"), self.index, top_k or self.top_k, self.metric, self.where if where is None else where
        )


@dataclass(frozen=True)
class Reranker:
    apply: Callable[[DataFrame], DataFrame]

    def __call__(self, candidates: DataFrame) -> DataFrame:
        return self.apply(candidates)


@dataclass(frozen=True)
class Selector:
    """``paced`` selectors also take a rate limit: prompts a minute."""

    apply: Callable[..., DataFrame]
    paced: bool = False

    def __call__(self, queries: DataFrame, candidates: DataFrame, rate_limit: int | None = None) -> DataFrame:
        return self.apply(queries, candidates, rate_limit) if self.paced else self.apply(queries, candidates)


def as_queries(spark: SparkSession, queries: str | Sequence[str] | DataFrame) -> DataFrame:
    """(query_id, query) from a text, a list of texts or a frame that has both columns."""
    if isinstance(queries, DataFrame):
        if not {"query_id", "query"} <= set(queries.columns):
            raise TypeError("queries need the columns query_id and query")
        return queries.select("query_id", "query")
    items = [queries] if isinstance(queries, str) else list(queries)
    if not items or not all(isinstance(q, str) for q in items):
        raise AssertionError("give one text or a list of texts that is not empty")
    return spark.createDataFrame(list(enumerate(items)), "query_id long, query string")


TRANSLATORS, RETRIEVERS, RERANKERS, SELECTORS = (Registry(k) for k in ("translator", "retriever", "reranker", "selector"))
EMBEDDERS = Registry("embedder")

TRANSLATORS.register("empty", lambda: translate.IDENTITY)
# The names by which components are asked for, here and below.
for _chat, _names in ((models.openai_chat, models.OPENAI_MODELS), (models.gemini_chat, ("gemini-2.5-flash", "gemini-2.5-pro"))):
    for _name in _names:
        for _suffix, _at_once in (("", 1), ("-async", 16)):
            TRANSLATORS.register(
                _name + _suffix,
                lambda model, chat, at_once, retries=3: translate.Translator(model, chat(model), retries, at_once=at_once),
                model=_name, chat=_chat, at_once=_at_once,
            )

EMBEDDERS.register("offline-hash", lambda dim=64: embed.Embedder("offline-hash", None, dim, True))
for _name, _model in (("Qwen3-0.6B", "Qwen/Qwen3-Embedding-0.6B"), ("Qwen3-4B", "Qwen/Qwen3-Embedding-4B"), ("Qwen3-8B", "Qwen/Qwen3-Embedding-8B")):
    EMBEDDERS.register(_name, lambda name, model: embed.Embedder(name, embed.sentence_model(model, "query"), 0, True), name=_name, model=_model)
EMBEDDERS.register("embeddinggemma-300M", lambda: embed.Embedder("embeddinggemma-300M", embed.sentence_model("google/embeddinggemma-300m"), 768, True))
EMBEDDERS.register("gemini-embedding-001", lambda: embed.Embedder("gemini-embedding-001", embed.hosted_google("gemini-embedding-001"), 3072))
for _name in ("text-embedding-3-small", "text-embedding-3-large"):
    EMBEDDERS.register(_name, lambda model: embed.Embedder(model, embed.hosted_openai(model), 0), model=_name)


def load_retriever(name: str, root: str, spark: SparkSession | None = None, top_k: int = 10, **more: Any) -> Retriever:
    """The retriever over the stored index of an embedder."""
    spark = spark or SparkSession.getActiveSession()
    return Retriever(index.load_index(spark, root, name), EMBEDDERS.load(name), top_k, **more)


for _name in EMBEDDERS.entries:
    RETRIEVERS.register(_name, load_retriever, name=_name)

RERANKERS.register("bm25", lambda k1=1.5, b=0.75, epsilon=0.25: Reranker(lambda c: rerank.rerank_bm25(c, k1, b, epsilon)))
RERANKERS.register("none", lambda: Reranker(rerank.keep_order))
for _name in models.QWEN_RERANKERS:
    RERANKERS.register(
        _name.split("/")[1],
        lambda model, max_length=8192, task="Find the standard concept that means the same as the query": Reranker(
            lambda c: rerank.rerank_with_model(c, models.causal_yes_scorer(model, max_length), task)
        ),
        model=_name,
    )

SELECTORS.register("first", lambda selection_threshold=float("inf"): Selector(lambda q, c: selection.select_first(q, c, selection_threshold)))
for _name in models.OPENAI_MODELS:
    for _wrap, _suffix in ((models.one_by_one, ""), (models.side_by_side, "-async")):
        SELECTORS.register(
            _name + _suffix,
            lambda model, wrap, prompt_template=None: Selector(
                lambda q, c, rate=None: selection.select_with_judge(q, c, wrap(models.openai_chat(model)), prompt_template, rate_limit=rate), True
            ),
            model=_name,
            wrap=_wrap,
        )
for _name in ("gemini-2.5-flash", "gemini-2.5-pro"):
    for _wrap, _suffix in ((models.one_by_one, ""), (models.side_by_side, "-async")):
        SELECTORS.register(
            _name + _suffix,
            lambda model, wrap, prompt_template=None: Selector(
                lambda q, c, rate=None: selection.select_with_judge(q, c, wrap(models.gemini_chat(model)), prompt_template, True, rate), True
            ),
            model=_name,
            wrap=_wrap,
        )


@dataclass
class ConceptMapper:
    """translate, retrieve, rerank, select, assemble: components are None, names or instances."""

    spark: SparkSession
    retriever: Retriever | str
    translator: translate.Translator | str | None = None
    reranker: Reranker | str | None = None
    selector: Selector | str | None = None
    root: str | None = None
    output_dir: str | None = None
    column_mapping: Mapping[str, str] | None = None
    limit_to: int | None = None
    confidence: str = "sync"
    exact_match_confidence: bool = False
    rate_limit: int | None = None
    input_file: str | None = field(default=None)

    def __post_init__(self) -> None:
        check_rate(self.rate_limit)
        self.translator = TRANSLATORS.resolve(self.translator, translate.Translator)
        if isinstance(self.retriever, str):
            self.retriever = RETRIEVERS.load(self.retriever, root=self.root, spark=self.spark)
        self.retriever = RETRIEVERS.resolve(self.retriever, Retriever)
        if self.retriever is None:
            raise TypeError("a retriever is needed")
        self.reranker = RERANKERS.resolve(self.reranker, Reranker) or RERANKERS.load("none")
        self.selector = SELECTORS.resolve(self.selector, Selector) or SELECTORS.load("first")

    @classmethod
    def from_task(cls, spark: SparkSession, task: MappingTask | str, root: str) -> ConceptMapper:
        t: MappingTask = load_settings(task)
        return cls(
            spark, t.retriever_id or embed.OFFLINE.name, t.translator_id, t.reranker_id, t.selector_id, root, t.output_dir,
            t.column_mapping, t.limit_to, rate_limit=t.rate_limit, input_file=t.input_file,
        )

    def sources(self, expressions: Sequence | DataFrame | None = None, file_path: str | None = None, limit_to: int | None = None) -> DataFrame:
        if isinstance(expressions, DataFrame):
            concepts.require_columns(expressions.columns, ("query_id", "source_code_description"))
            return expressions
        if expressions is not None:
            return concepts.sources_from_list(self.spark, expressions)
        path = file_path or self.input_file
        if not path:
            raise ValueError("give expressions or the path of a file")
        read = concepts.read_source_csv(self.spark, path, self.column_mapping, limit_to if limit_to is not None else self.limit_to)
        return concepts.check_dates(concepts.clean_sources(read))

    def map(
        self,
        expressions: Sequence | DataFrame | None = None,
        file_path: str | None = None,
        limit_to: int | None = None,
        output_dir: str | None = None,
        save_to_disk: bool = False,
    ) -> DataFrame:
        """The mapped concepts, one row per source, as a frame; saved as CSV if asked for.

        What models answer (translations, query vectors, scores, verdicts) is written once while this runs,
        at most ``rate_limit`` texts or prompts a minute; everything else is lazy and reads that.
        """
        given = self.sources(expressions, file_path, limit_to)
        texts = translate.translate(given, self.translator, self.rate_limit) if self.translator else None
        query = given.select("query_id", F.col("source_code_description").alias("query")) if texts is None else texts.select("query_id", F.col("text").alias("query"))
        candidates = self.reranker(self.retriever(query))
        chosen = self.selector(query, candidates, self.rate_limit)
        mapped = assembly.assemble(given, chosen, texts, self.confidence, self.exact_match_confidence)
        if save_to_disk:
            target = output_dir or self.output_dir
            if not target:
                raise ValueError("saving needs an output_dir")
            assembly.save_mapped(mapped, target)
        return mapped

    def map_objects(self, *args: Any, **kwargs: Any) -> list[assembly.MappedConcept]:
        """The same as a list of objects in query order, for results that fit the driver."""
        return assembly.objects(self.map(*args, **kwargs))

    def __call__(self, expression: Any) -> DataFrame:
        return self.map([expression] if isinstance(expression, (str, Mapping)) else expression)


class ComponentCache:
    """Loaded components by key, for several threads; the least recently used goes first, its index is unpersisted."""

    def __init__(self, max_size: int = 20) -> None:
        if max_size < 1:
            raise ValueError("max_size must be positive")
        self.max_size, self.held, self.lock = max_size, OrderedDict(), threading.RLock()

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
            self.held[key] = value = make()
            retriever = getattr(value, "retriever", value)
            if isinstance(retriever, Retriever):
                retriever.index.persist()
            while len(self.held) > self.max_size:
                _, old = self.held.popitem(last=False)
                retriever = getattr(old, "retriever", old)
                if isinstance(retriever, Retriever):
                    retriever.index.unpersist()
            return value
