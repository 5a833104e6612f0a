"""Registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import embed, limits, omop, profile, prompts
from ..operators import assembly, datasets, identity, index, rerank, retrieval, selection, translate
from ..operators.store import fresh_path, stored
from ..schemas import ORIGINS, SOURCE
from ..sources import concepts, vocabulary
from . import surrogate
from .mapper import ConceptMapper, Retriever
from .surrogate import SQL, VOCABULARIES, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


STANDARD = "standard_concept = 'S' AND vocabulary_id IN ('SNOMED', 'RxNorm', 'LOINC')"
SHAPE = "{0} AS expression, {1} AS expression_concept_id, {2}.concept_id AS std_concept_id, {2}.concept_name AS std_concept_name, {2}.vocabulary_id AS std_vocabulary_id, {2}.concept_code AS std_vocabulary_code, {2}.domain_id AS std_domain_id"
MAPS = """concept_relationship r JOIN concept o ON r.concept_id_1 = o.concept_id JOIN concept t ON r.concept_id_2 = t.concept_id"""
EDGES = f"r.relationship_id = 'Maps to' AND r.concept_id_1 <> r.concept_id_2 AND o.concept_name <> t.concept_name AND t.{STANDARD.replace('vocabulary_id', 't.vocabulary_id')} AND r.invalid_reason IS NULL AND o.invalid_reason IS NULL"
D1 = f"SELECT {SHAPE.format('c.concept_name', 'c.concept_id', 'c')} FROM concept c WHERE {STANDARD} AND invalid_reason IS NULL"
D2 = f"SELECT {SHAPE.format('s.concept_synonym_name', 's.concept_id', 'c')} FROM concept c JOIN concept_synonym s ON c.concept_id = s.concept_id WHERE {STANDARD} AND invalid_reason IS NULL"
D3 = f"SELECT {SHAPE.format('o.concept_name', 'r.concept_id_1', 't')} FROM {MAPS} WHERE {EDGES}"
D4 = f"SELECT {SHAPE.format('s.concept_synonym_name', 'r.concept_id_1', 't')} FROM {MAPS} JOIN concept_synonym s ON o.concept_id = s.concept_id WHERE {EDGES}"
UNION = " UNION ALL ".join(
    f"SELECT DISTINCT *, '{name}' AS expression_origin FROM ({d}) WHERE expression IS NOT NULL AND std_domain_id IS NOT NULL AND std_vocabulary_code IS NOT NULL"
    for name, d in zip(
        ("standard_concept", "standard_concept_synonym", "mapped_non_standard_concept", "mapped_non_standard_concept_synonym"), (D1, D2, D3, D4), strict=True
    )
)
DATA = f"WITH {SQL}, data AS ({UNION})"
ID = "md5(concat_ws('||', expression, expression_concept_id, expression_origin, std_concept_id, std_concept_name, std_vocabulary_id, std_vocabulary_code))"
COLUMNS = "expression, expression_concept_id, expression_origin, std_concept_id, std_concept_name, std_vocabulary_id, std_vocabulary_code, std_domain_id"
IDS = f"{DATA}, ids AS (SELECT DISTINCT {ID} AS expression_id, {COLUMNS} FROM data)"


@query(f"WITH {SQL} {D1}")
def dataset_standard_concept(spark, d):
    return datasets.standard_concepts(surrogate.concept(spark, d), VOCABULARIES)


@query(f"WITH {SQL} {D2}")
def dataset_standard_synonym(spark, d):
    return datasets.standard_synonyms(surrogate.concept(spark, d), surrogate.concept_synonym(spark, d), VOCABULARIES)


@query(f"WITH {SQL} {D3}")
def dataset_mapped(spark, d):
    return datasets.mapped_concepts(surrogate.concept(spark, d), surrogate.concept_relationship(spark, d), VOCABULARIES)


@query(f"WITH {SQL} {D4}")
def dataset_mapped_synonym(spark, d):
    c, s, r = surrogate.concept(spark, d), surrogate.concept_synonym(spark, d), surrogate.concept_relationship(spark, d)
    return datasets.mapped_synonyms(c, r, s, VOCABULARIES)


@query(f"{DATA} SELECT * FROM data")
def expression_union_distinct(spark, d):
    c, s, r = surrogate.concept(spark, d), surrogate.concept_synonym(spark, d), surrogate.concept_relationship(spark, d)
    return datasets.expression_dataset(c, s, r, VOCABULARIES)


@query(f"{DATA} SELECT {ID} AS expression_id, {COLUMNS} FROM data")
def expression_id_md5(spark, d):
    return identity.with_expression_id(expression_union_distinct(spark, d))


@query()
def expression_id_blake2b(spark, d):
    return identity.with_expression_id(expression_union_distinct(spark, d), "blake2b")


def _expressions(spark: SparkSession, d: str) -> DataFrame:
    return identity.one_per_id(expression_id_md5(spark, d))


@query(f"{DATA} SELECT {ID} AS expression_id, min(std_domain_id) AS std_domain_id FROM data GROUP BY 1")
def dedup_by_id(spark, d):
    return _expressions(spark, d).select("expression_id", "std_domain_id")


@query(f"{IDS} SELECT expression_id, expression FROM ids WHERE expression_id NOT IN (SELECT {ID} FROM data WHERE expression_origin = 'standard_concept')")
def index_antijoin(spark, d):
    every = stored(_expressions(spark, d).select("expression_id", "expression", "expression_origin"), "expressions")
    return identity.not_indexed(every, every.where("expression_origin = 'standard_concept'")).select("expression_id", "expression")


# ---------------------------------------------------------------- vectors; queries: every vec_id divisible by 100


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows


def _knn_sql(distance: str, where: str = "true") -> str:
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id, round({distance}, 9) AS distance FROM v q, v i WHERE q.vec_id % 100 = 0 AND ({where})),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) - 1 AS retrieval_rank FROM pairs)
SELECT query_id, vec_id, round(distance, 6) + 0 AS distance, retrieval_rank FROM placed WHERE retrieval_rank < 10"""


SUM_SQUARES = "list_sum(list_transform(list_zip(q.e, i.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
INNER = "list_sum(list_transform(list_zip(q.e, i.e), lambda p: p[1] * p[2]))"
NORM = "sqrt(list_sum(list_transform({0}.e, lambda x: x * x)))"


def _knn(spark: SparkSession, d: str, metric: str, where: dict | None = None) -> DataFrame:
    queries, rows = _vectors(spark, d)
    found = retrieval.top_k(queries, rows, 10, metric, where, key="vec_id")
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0)).withColumn("retrieval_rank", F.col("retrieval_rank").cast("long"))


@query(_knn_sql(SUM_SQUARES))
def knn_l2_top10(spark, d):
    return _knn(spark, d, "l2")


@query(_knn_sql(f"1 - {INNER} / ({NORM.format('q')} * {NORM.format('i')})"))
def knn_cosine_top10(spark, d):
    return _knn(spark, d, "cosine")


@query(_knn_sql(f"1 - {INNER}"))
def knn_ip_top10(spark, d):
    return _knn(spark, d, "ip")


@query(_knn_sql(SUM_SQUARES, "i.label >= 2 OR i.label = 0"))
def knn_where_label(spark, d):
    return _knn(spark, d, "l2", {"$or": [{"label": {"$gte": 2}}, {"label": 0}]})


@query(
    _knn_sql(SUM_SQUARES, "i.label IN (0, 1, 3) AND i.label NOT IN (1) AND i.vec_id <> 100 AND i.vec_id < 400 AND (i.label = 0 OR i.vec_id >= 50)")
)
def knn_where_lists(spark, d):
    allowed = {"$and": [{"label": {"$in": [0, 1, 3]}}, {"label": {"$nin": [1]}}], "vec_id": {"$ne": 100, "$lt": 400}}
    return _knn(spark, d, "l2", allowed | {"$or": [{"label": {"$eq": 0}}, {"vec_id": {"$gte": 50}}]})


@query()
def knn_inverted_file(spark, d):
    queries, rows = _vectors(spark, d)
    return retrieval.InvertedFile(rows).top_k(queries, 10)


@query()
def offline_embed(spark, d):
    return table(spark, d, "part").select("p_partkey", embed.offline_vector(F.col("p_name")).alias("embedding"))


# ---------------------------------------------------------------- reranking: every concept's name against its expressions


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _expressions(spark, d).withColumnRenamed("std_concept_name", "query").withColumn("query_id", F.col("std_concept_id").cast("long"))
    order = Window.partitionBy("query_id").orderBy("expression_id")
    placed = rows.withColumn("retrieval_rank", F.row_number().over(order) - 1)
    n = F.count("*").over(Window.partitionBy("query_id"))
    return placed.withColumns({"distance": F.round(F.col("retrieval_rank") / n, 6), "std_concept_name": F.col("query")})


CANDIDATES = f"""{IDS}, one AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY expression_id ORDER BY {COLUMNS}) = 1),
cand AS (SELECT *, CAST(std_concept_id AS BIGINT) AS query_id, std_concept_name AS query,
  row_number() OVER (PARTITION BY std_concept_id ORDER BY expression_id) - 1 AS retrieval_rank,
  round((row_number() OVER (PARTITION BY std_concept_id ORDER BY expression_id) - 1) / count(*) OVER (PARTITION BY std_concept_id), 6) AS distance FROM one)"""
BM25 = f"""{CANDIDATES},
docs AS (SELECT query_id, expression_id, string_split(expression, ' ') AS t FROM cand WHERE expression <> ''),
stats AS (SELECT query_id, count(*) AS n, avg(len(t)) AS avgdl FROM docs GROUP BY 1),
tf AS (SELECT query_id, expression_id, token, count(*) AS tf FROM (SELECT query_id, expression_id, unnest(t) AS token FROM docs) GROUP BY 1, 2, 3),
raw AS (SELECT query_id, token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM tf JOIN stats USING (query_id) GROUP BY query_id, token, n),
idf AS (SELECT query_id, token, CASE WHEN v < 0 THEN 0.25 * avg(v) OVER (PARTITION BY query_id) ELSE v END AS idf FROM raw),
asked AS (SELECT query_id, token, count(*) AS qn FROM (SELECT query_id, unnest(string_split(query, ' ')) AS token FROM (SELECT DISTINCT query_id, query FROM cand)) GROUP BY 1, 2),
sums AS (SELECT tf.query_id, tf.expression_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / avgdl))) AS s
  FROM tf JOIN asked USING (query_id, token) JOIN idf USING (query_id, token) JOIN docs d ON d.query_id = tf.query_id AND d.expression_id = tf.expression_id
  JOIN stats ON stats.query_id = tf.query_id GROUP BY 1, 2),
scored AS (SELECT d.query_id, d.expression_id, coalesce(s, 0.0) AS score FROM docs d LEFT JOIN sums USING (query_id, expression_id))"""


@query(f"{BM25} SELECT query_id, expression_id, round(score, 6) + 0 AS rerank_score FROM scored")
def bm25_scores(spark, d):
    scores = rerank.bm25_scores(_candidates(spark, d))
    return scores.withColumn("rerank_score", F.round("rerank_score", 6) + F.lit(0.0))


@query(
    f"{BM25} SELECT query_id, expression_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN round(score, 9) = 0 THEN '-infinity'::DOUBLE ELSE round(score, 9) END DESC, retrieval_rank) - 1 AS rank FROM scored JOIN cand USING (query_id, expression_id)"
)
def bm25_rerank_order(spark, d):
    scored = rerank.bm25_scored(_candidates(spark, d))
    return rerank.ranked(scored.where(F.col("rerank_score").isNotNull()).withColumn("rerank_score", F.round("rerank_score", 9))).select("query_id", "expression_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, round(1 / (1 + exp(CAST(p_size AS DOUBLE) / 10 - p_retailprice / 1000)), 9) AS score FROM part")
def softmax_yes_score(spark, d):
    score = rerank.yes_probability(F.col("p_size") / 10, F.col("p_retailprice") / 1000)
    return table(spark, d, "part").select("p_partkey", F.round(score, 9).alias("score"))


# ---------------------------------------------------------------- selection and assembly: every part is a source


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("source_code"), F.col("p_partkey").cast("string").alias("source_concept_id"),
        F.lit("LOCAL").alias("source_vocabulary_id"), F.col("p_name").alias("source_code_description"),
        F.lit("2020-01-01").alias("valid_start_date"), F.lit("2099-12-31").alias("valid_end_date"), F.lit("").alias("invalid_reason"),
    )


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("query_id", F.col("source_code_description").alias("query"))


def _ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rerank.keep_order(_candidates(spark, d)).withColumn("rerank_score", F.lit(None).cast("double"))


FIRST = f"{CANDIDATES}, sel AS (SELECT p.p_partkey AS query_id, c.* EXCLUDE (query_id) FROM part p LEFT JOIN cand c ON c.query_id = p.p_partkey AND c.retrieval_rank = 0 AND c.distance < {{}})"
CHOSEN = "SELECT query_id, expression_id, std_concept_id, distance, CASE WHEN expression_id IS NOT NULL THEN CAST({} AS INTEGER) END AS result_list_index FROM sel"


def _chosen(df: DataFrame) -> DataFrame:
    return df.select("query_id", "expression_id", "std_concept_id", "distance", F.col("result_list_index").cast("int").alias("result_list_index"))


@query(f"{FIRST.format(1e9)} {CHOSEN.format(0)}")
def select_first(spark, d):
    return _chosen(selection.select_first(_queries(spark, d), _ranked_candidates(spark, d)))


@query(f"{FIRST.format(0.0)} {CHOSEN.format(0)}")
def select_first_threshold(spark, d):
    return _chosen(selection.select_first(_queries(spark, d), _ranked_candidates(spark, d), 0.0))


@query(
    f"""{CANDIDATES}, verdict AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN NULL WHEN 1 THEN max(expression_id) ELSE 'unknown' END AS expression_id FROM cand GROUP BY query_id),
sel AS (SELECT p.p_partkey AS query_id, c.* EXCLUDE (query_id) FROM part p LEFT JOIN (SELECT c.* FROM cand c JOIN verdict v ON c.query_id = v.query_id AND c.expression_id = v.expression_id) c ON c.query_id = p.p_partkey)
{CHOSEN.format('retrieval_rank')}"""
)
def verdict_validation(spark, d):
    candidates = stored(_ranked_candidates(spark, d), "candidates")
    last = candidates.groupBy("query_id").agg(F.max("expression_id").alias("m"))
    verdicts = last.select("query_id", F.when(F.col("query_id") % 3 == 1, F.col("m")).when(F.col("query_id") % 3 == 2, "unknown").alias("expression_id"))
    return _chosen(selection.apply_verdicts(_queries(spark, d), candidates, verdicts))


@query("SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS query FROM part")
def capitalize_query(spark, d):
    return table(spark, d, "part").select("p_partkey", selection.capitalized(F.col("p_type")).alias("query"))


@query(
    f"""{FIRST.format(1e9)} SELECT p_partkey AS query_id, p_brand AS source_code, CAST(p_partkey AS VARCHAR) AS source_concept_id, 'LOCAL' AS source_vocabulary_id,
  CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS source_code_description, '2020-01-01' AS valid_start_date, '2099-12-31' AS valid_end_date, '' AS invalid_reason,
  std_concept_id AS target_concept_id, std_vocabulary_id AS target_vocabulary_id, std_vocabulary_code AS target_vocabulary_code, std_domain_id AS domain_id,
  CASE WHEN distance <> 0 THEN 1 - distance END AS confidence_score, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS source_code_description_original
FROM part JOIN sel ON sel.query_id = p_partkey"""
)
def assemble_mapped(spark, d):
    sources = _sources(spark, d)
    texts = sources.where("query_id % 2 = 0").select("query_id", F.upper("source_code_description").alias("text"))
    return assembly.assemble(sources, selection.select_first(_queries(spark, d), _ranked_candidates(spark, d)), texts)


@query(f"{CANDIDATES} SELECT expression_id, CASE WHEN distance <> 0 THEN round(1 - distance, 6) END AS confidence_score FROM cand")
def confidence_sync(spark, d):
    return _candidates(spark, d).select("expression_id", F.round(assembly.confidence(F.col("distance")), 6).alias("confidence_score"))


@query(f"{CANDIDATES} SELECT expression_id, round(1 - coalesce(nullif(distance, 0.5), 0), 6) AS confidence_score FROM cand")
def confidence_async(spark, d):
    distance = F.nullif("distance", F.lit(0.5))
    return _candidates(spark, d).select("expression_id", F.round(assembly.confidence(distance, "async_compat"), 6).alias("confidence_score"))


@query(f"{CANDIDATES} SELECT expression_id, printf('%.2f', round(1 - distance, 2)) AS shown FROM cand")
def confidence_shown(spark, d):
    return _candidates(spark, d).select("expression_id", assembly.shown_confidence(F.col("distance")).alias("shown"))


# ---------------------------------------------------------------- sources


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    gone = F.when(F.col("source_concept_id").cast("long") % 7 != 0, F.col("source_code_description"))
    return _sources(spark, d).withColumn("source_code_description", gone)


@query("SELECT CAST(count_if(p_partkey % 7 = 0) AS BIGINT) AS n_null, count(*) AS n_rows FROM part")
def source_null_report(spark, d):
    return concepts.null_report(_with_nulls(spark, d))


@query("SELECT p_partkey AS query_id FROM part WHERE p_partkey % 7 = 0")
def source_rejected_rows(spark, d):
    return concepts.rejected_rows(_with_nulls(spark, d))


@query("SELECT p_partkey AS query_id, p_name AS source_code_description FROM part WHERE p_partkey < 150 AND p_partkey % 7 <> 0")
def source_head_then_drop(spark, d):
    head = _with_nulls(spark, d).where("query_id < 150")
    return concepts.clean_sources(head).select("query_id", "source_code_description")


DATES = "CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN strftime(ts, '%Y/%m/%d') WHEN 4 THEN strftime(ts, '%Y') || '-2-' || CAST(event_id % 40 AS VARCHAR) ELSE '0' || strftime(ts, '%Y-%m-%d') END"


@query(
    f"""WITH dated AS (SELECT event_id, {DATES} AS v FROM events)
SELECT event_id, v IS NULL OR v = '' OR (regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL) AS ok FROM dated"""
)
def date_format_check(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    k = F.col("event_id") % 6
    value = F.when(k == 0, day).when(k == 1, "").when(k == 2, F.lit(None)).when(k == 3, F.date_format("ts", "yyyy/MM/dd"))
    value = value.when(k == 4, F.concat(F.date_format("ts", "yyyy"), F.lit("-2-"), (F.col("event_id") % 40).cast("string"))).otherwise(F.concat(F.lit("0"), day))
    return table(spark, d, "events").select("event_id", concepts.is_date_or_blank(value).alias("ok"))


@query("SELECT p_partkey, p_type || ' is ' || replace(p_name, '{size}', CAST(p_size AS VARCHAR)) || ', size ' || CAST(p_size AS VARCHAR) || ', {other}' AS content FROM part")
def prompt_fill(spark, d):
    args = {"type": F.col("p_type"), "name": F.col("p_name"), "size": F.col("p_size")}
    return table(spark, d, "part").select("p_partkey", prompts.fill_column(F.lit("{type} is {name}, size {size}, {other}"), args).alias("content"))


SHOWN = "to_json({'expression_id': expression_id, 'expression': expression, 'concept_id': std_concept_id, 'concept_name': std_concept_name, 'vocabulary_id': std_vocabulary_id, 'domain_id': std_domain_id})"


@query(f"{CANDIDATES} SELECT expression_id, CAST({SHOWN} AS VARCHAR) AS shown FROM cand")
def candidate_prompt_json(spark, d):
    return _candidates(spark, d).select("expression_id", selection.prompt_object().alias("shown"))


@query("SELECT p_partkey, strpos(p_name, substr(p_type, 1, 2)) - 1 AS begin_at, strpos(p_name, substr(p_type, 1, 2)) - 1 + 2 AS end_at FROM part")
def span_offsets(spark, d):
    at = prompts.span_offsets(F.col("p_name"), F.substring("p_type", 1, 2))
    return table(spark, d, "part").select("p_partkey", at[0].cast("long").alias("begin_at"), at[1].cast("long").alias("end_at"))


# ---------------------------------------------------------------- extraction: every event is a record


def _records(spark: SparkSession, d: str, make: Callable) -> DataFrame:
    return table(spark, d, "events").select("event_id", make(F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")).alias("reply"))


def _checked(df: DataFrame, model: str, *fields: str) -> DataFrame:
    done = omop.validated(df, "reply", model)
    return done.select("event_id", F.array_join("violations", ";").alias("violations"), *(F.col(f"record.{f}").alias(f) for f in fields))


@query(
    """SELECT event_id, concat_ws(';', CASE WHEN event_id % 5 = 4 THEN 'unknown field' END, CASE WHEN event_id % 3 = 0 THEN 'condition_source_value: longer than 50' END,
CASE WHEN event_id % 2 = 0 THEN 'condition_end_date: before condition_start_date' END) AS violations, CAST(ts AS DATE) AS condition_start_date FROM events"""
)
def extract_validate_condition(spark, d):
    def make(k, day):
        end = F.when(k % 2 == 0, F.lit("1900-01-01")).otherwise(day)
        value = F.when(k % 3 == 0, F.repeat(F.lit("x"), F.lit(51))).otherwise(F.lit("pain"))
        more = F.when(k % 5 == 4, F.lit(', "colour": "red"')).otherwise(F.lit(""))
        return F.concat(F.lit('{"condition_source_value": "'), value, F.lit('", "condition_start_date": "'), day, F.lit('", "condition_end_date": "'), end, F.lit('"'), more, F.lit("}"))

    return _checked(_records(spark, d, make), "condition_occurrence", "condition_start_date")


@query(
    """SELECT event_id, concat_ws(';', CASE WHEN event_id % 4 = 1 THEN 'days_supply: not a plain integer' END, CASE WHEN event_id % 3 = 0 THEN 'quantity: below 0' END,
CASE WHEN event_id % 4 = 2 THEN 'days_supply: below 1' END) AS violations, CAST(CASE WHEN event_id % 3 = 0 THEN -1.5 ELSE 2.5 END AS DOUBLE) AS quantity,
CAST(CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 0 END AS BIGINT) AS days_supply FROM events"""
)
def extract_validate_drug(spark, d):
    def make(k, day):
        supply = F.when(k % 4 == 0, "7").when(k % 4 == 1, '"5"').when(k % 4 == 2, "0").otherwise("null")
        return F.concat(F.lit('{"quantity": '), F.when(k % 3 == 0, "-1.5").otherwise("2.5"), F.lit(', "days_supply": '), supply, F.lit("}"))

    return _checked(_records(spark, d, make), "drug_exposure", "quantity", "days_supply")


@query(
    """SELECT event_id, concat_ws(';', CASE WHEN event_id % 3 = 1 THEN 'quantity: not a int' END, CASE WHEN event_id % 3 = 2 THEN 'quantity: below 0' END) AS violations,
CAST(CASE event_id % 3 WHEN 0 THEN 3 WHEN 2 THEN -3 END AS BIGINT) AS quantity FROM events"""
)
def extract_validate_device(spark, d):
    def make(k, day):
        return F.concat(F.lit('{"quantity": '), F.when(k % 3 == 0, "3").when(k % 3 == 1, "3.5").otherwise("-3"), F.lit("}"))

    return _checked(_records(spark, d, make), "device_exposure", "quantity")


# ---------------------------------------------------------------- rates and timings


@query(
    """SELECT o_custkey, o_orderkey, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 60 / 3000.0::DOUBLE AS start_s
FROM (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS BIGINT) % 100 + 1 AS n FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders))"""
)
def rate_limit_schedule(spark, d):
    batches = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.floor("o_totalprice") % 100 + 1).alias("n"))
    return limits.schedule(batches, 3000, "o_custkey", "o_orderkey", "n").drop("n")


@query(
    """SELECT name, round(total, 4) AS total, calls, round(total / calls, 6) AS mean, round(100 * total / sum(total) OVER (), 6) AS percent
FROM (SELECT event_type AS name, sum(value) AS total, count(*) AS calls FROM events GROUP BY 1)"""
)
def profile_summary(spark, d):
    done = profile.profile_summary(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("elapsed")))
    return done.select("name", F.round("total", 4).alias("total"), "calls", F.round("mean", 6).alias("mean"), F.round("percent", 6).alias("percent"))


@query("SELECT event_id, coalesce(event_id / nullif(value, 0), 0) AS rate FROM events")
def docs_per_second(spark, d):
    return table(spark, d, "events").select("event_id", limits.docs_per_second(F.col("event_id"), F.col("value")).alias("rate"))


@query(
    f"""{DATA} SELECT DISTINCT s.std_concept_id, c.concept_id, c.concept_name, c.vocabulary_id, c.concept_code
FROM (SELECT DISTINCT std_concept_id FROM data) s JOIN concept_relationship r ON r.concept_id_2 = s.std_concept_id AND r.relationship_id = 'Maps to' AND r.invalid_reason IS NULL
JOIN concept c ON c.concept_id = r.concept_id_1"""
)
def concept_fanout(spark, d):
    return datasets.concept_fanout(expression_union_distinct(spark, d), surrogate.concept(spark, d), surrogate.concept_relationship(spark, d))


@query()
def full_pipeline_map(spark, d):
    """All steps for every part whose key is divisible by 100 against the whole index."""
    index = stored(_expressions(spark, d).withColumn("embedding", embed.offline_vector(F.col("expression"))), "index")
    sources = _sources(spark, d).where("query_id % 100 = 0")
    mapper = ConceptMapper(spark, Retriever(index), reranker="bm25", confidence="sync")
    return mapper.map(sources.select("query_id", *SOURCE.names))


# ---------------------------------------------------------------- models: deterministic stand-ins that answer as a service would


@query(
    f"""{CANDIDATES} SELECT query_id, 'TERM' || chr(10) || upper(substr(any_value(query), 1, 1)) || lower(substr(any_value(query), 2)) || chr(10) || chr(10) || 'ENTRIES' || chr(10)
  || '[' || string_agg({SHOWN}, ', ' ORDER BY retrieval_rank) || ']' AS content FROM cand GROUP BY query_id"""
)
def judge_prompt_content(spark, d):
    """The message with a query's candidates in rank order."""
    asked = selection.judge_prompts(_ranked_candidates(spark, d))
    return asked.select("query_id", F.col("prompt")[1]["content"].alias("content"))


def _last_entry() -> Callable[[list[list[dict]]], list[str]]:
    """A judge that takes the last entry of the list it is shown."""

    def ask(prompts: list[list[dict]]) -> list[str]:
        listed = (json.loads(p[1]["content"].split("ENTRIES\n", 1)[1]) for p in prompts)
        return [json.dumps({"expression_id": x[-1]["expression_id"]}) for x in listed]

    return ask


@query(
    f"""{CANDIDATES}, sel AS (SELECT p.p_partkey AS query_id, c.* EXCLUDE (query_id) FROM part p LEFT JOIN
  (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank DESC) = 1) c ON c.query_id = p.p_partkey) {CHOSEN.format('retrieval_rank')}"""
)
def judge_selection(spark, d):
    return _chosen(selection.select_with_judge(_queries(spark, d), _ranked_candidates(spark, d), _last_entry))


def _upper_or_fail() -> Callable[[list[dict]], str]:
    """A translator that writes in capitals and never answers texts whose length three divides."""

    def ask(messages: list[dict]) -> str:
        text = messages[-1]["content"]
        if len(text) % 3 == 0:
            raise TimeoutError(text)
        return json.dumps({"text": text.upper()})

    return ask


@query("SELECT p_partkey AS query_id, CASE WHEN length(p_name) % 3 = 0 THEN p_name ELSE upper(p_name) END AS text FROM part")
def translate_or_keep(spark, d):
    return translate.translate(_sources(spark, d), translate.Translator("upper", _upper_or_fail, 2))


@query("SELECT p_partkey AS query_id, p_name AS text FROM part")
def translate_identity(spark, d):
    return translate.translate(_sources(spark, d))


def _by_length() -> Callable[[list[str]], list[float]]:
    return lambda prompts: [float(len(p)) for p in prompts]


@query(
    f"""{CANDIDATES}, said AS (SELECT *, CAST(length('<Instruct>: longest' || chr(10) || '<Query>: ' || query || chr(10) || '<Document>: ' || expression) AS DOUBLE) AS rerank_score FROM cand)
SELECT query_id, expression_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank) - 1 AS rank FROM said"""
)
def model_rerank(spark, d):
    done = rerank.rerank_with_model(_candidates(spark, d), _by_length, "longest")
    return done.select("query_id", "expression_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- files: written to the shared folder and read as a user's would be


SOURCE_ROWS = """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'long' WHEN 2 THEN 'short' WHEN 3 THEN 'empty' ELSE 'whole' END AS kind, p_brand, p_name FROM part"""


def _source_file(spark: SparkSession, d: str, names: list[str] = SOURCE.names) -> str:
    """A CSV of whole, too long and short rows, and rows without a description, in the order of the keys."""
    kind = F.col("p_partkey") % 5
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    ends = F.when(kind == 1, ",2020-01-01,2099-12-31,,more").when(kind == 2, "").otherwise(",2020-1-5,2099-12-31,")
    line = F.concat(F.col("p_brand"), F.lit(","), F.col("p_partkey").cast("string"), F.lit(",LOCAL,"), F.when(kind == 3, "").otherwise(name), ends)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), line.alias("value"))
    header = spark.createDataFrame([(-1, ",".join(names))], "k long, value string")
    path = fresh_path(spark, "sources") + ".csv"
    rows.unionByName(header).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


@query(
    f"""WITH r AS ({SOURCE_ROWS}), read AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS query_id FROM r WHERE kind <> 'long')
SELECT query_id, p_brand AS source_code, CAST(p_partkey AS VARCHAR) AS source_concept_id, p_name AS source_code_description,
  CASE WHEN kind = 'short' THEN '' ELSE '2020-1-5' END AS valid_start_date, '' AS invalid_reason FROM read WHERE kind <> 'empty'"""
)
def source_csv(spark, d):
    """Too long rows are skipped, short ones padded, rows without a description dropped after numbering, dates checked."""
    read = concepts.check_dates(concepts.clean_sources(concepts.read_source_csv(spark, _source_file(spark, d))))
    return read.select("query_id", "source_code", "source_concept_id", "source_code_description", "valid_start_date", "invalid_reason")


@query(
    f"""WITH r AS ({SOURCE_ROWS}), read AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS query_id FROM r WHERE kind <> 'long')
SELECT query_id, p_brand AS source_code, p_name AS source_code_description FROM read WHERE query_id < 100 AND kind <> 'empty'"""
)
def source_csv_head(spark, d):
    """The limit counts rows before those without a description are dropped; a column of another name is renamed."""
    path = _source_file(spark, d, ["code", *SOURCE.names[1:]])
    read = concepts.read_source_csv(spark, path, {"code": "source_code"}, limit_to=100)
    return concepts.clean_sources(read).select("query_id", "source_code", "source_code_description")


@query("SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_name || ' \"q' AS concept_name, CASE WHEN p_size % 3 <> 0 THEN p_type END AS domain_id FROM part")
def vocabulary_table(spark, d):
    """A tab-separated table with quotes in it and empty cells, read from its folder by name."""
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("concept_id"), F.concat("p_name", F.lit(' "q')).alias("concept_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("domain_id")
    )
    folder = fresh_path(spark, "vocabulary")
    rows.write.options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(f"{folder}/CONCEPT.csv")
    return vocabulary.load_vocabulary(spark, folder)["concept"]


@query("SELECT p_brand AS source_code, p_partkey || ',' AS target FROM part")
def comma_separated_table(spark, d):
    """The one vocabulary table that is separated by commas, with commas in quotes."""
    folder = fresh_path(spark, "vocabulary")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("source_code"), F.concat(F.col("p_partkey").cast("string"), F.lit(",")).alias("target"))
    rows.write.options(header=True).csv(f"{folder}/SOURCE_TO_CONCEPT_MAP.csv")
    return vocabulary.load_vocabulary(spark, folder)["source_to_concept_map"]


@query(
    f"""{FIRST.format(1e9)} SELECT p_brand AS source_code, p_name AS source_code_description, std_concept_id AS target_concept_id,
  CASE WHEN distance <> 0 THEN round(1 - distance, 6) END AS confidence_score FROM part JOIN sel ON sel.query_id = p_partkey"""
)
def result_csv(spark, d):
    """The mapped concepts as the CSV that is saved."""
    sources = _sources(spark, d)
    mapped = assembly.assemble(sources, selection.select_first(_queries(spark, d), _ranked_candidates(spark, d)))
    read = spark.read.option("header", True).csv(assembly.save_mapped(mapped, fresh_path(spark, "result")))
    score = F.round(F.col("confidence_score").cast("double"), 6).alias("confidence_score")
    return read.select("source_code", "source_code_description", "target_concept_id", score)


@query(f"{IDS} SELECT expression_id, min(std_concept_id) AS std_concept_id, CAST(64 AS INTEGER) AS dim FROM ids GROUP BY 1")
def index_repair(spark, d):
    """An index of standard concepts, left alone by skip, then repaired twice with all expressions: each id is there once."""
    root, data = fresh_path(spark, "root"), stored(expression_union_distinct(spark, d), "dataset")
    standard = data.where(F.col("expression_origin") == ORIGINS[0])
    for part, mode in ((standard, "overwrite"), (data, "skip"), (data, "repair"), (data, "repair")):
        built = index.build_index(part, root, embed.OFFLINE, mode)
    return built.select("expression_id", "std_concept_id", F.size("embedding").alias("dim"))


@query(f"{DATA} SELECT expression_origin, count(*) AS n FROM data WHERE expression_origin <> 'standard_concept' GROUP BY 1")
def saved_datasets(spark, d):
    """The datasets as Parquet by origin; saving again with skip changes nothing."""
    path = fresh_path(spark, "datasets")
    data = expression_union_distinct(spark, d)
    datasets.save_datasets(data.where(F.col("expression_origin") != ORIGINS[0]), path)
    datasets.save_datasets(data, path, "skip")
    read = concepts.check_members(spark.read.parquet(path), "expression_origin", ORIGINS)
    return read.groupBy("expression_origin").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE 'None' END AS part FROM lineitem")
def ids_as_text(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("part"))
    return concepts.ids_as_strings(rows, ["l_orderkey", "part"], null_as_none=True)


@query(f"{DATA} SELECT DISTINCT std_concept_id, std_concept_name FROM data WHERE std_vocabulary_code = (SELECT min(std_vocabulary_code) FROM data)")
def lookup_by_code(spark, d):
    rows = stored(expression_union_distinct(spark, d), "dataset")
    code = rows.agg(F.min("std_vocabulary_code")).first()[0]
    return index.lookup(rows, code=code).select("std_concept_id", "std_concept_name").distinct()
