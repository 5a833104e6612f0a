"""Components on small fixtures."""

import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptlink import service
from conceptlink.functions import embed, limits, omop, prompts
from conceptlink.functions.profile import Profiler
from conceptlink.functions.registry import Registry
from conceptlink.operators import assembly, datasets, extract, index, rerank, retrieval, selection, translate
from conceptlink.plans import mapper
from conceptlink.sources import concepts, config, vocabulary
from conceptlink.streaming.mapping import map_stream

HEADER = "source_code,source_concept_id,source_vocabulary_id,source_code_description,valid_start_date,valid_end_date,invalid_reason\n"


@pytest.fixture
def vocabulary_dir(tmp_path):
    folder = tmp_path / "vocab"
    folder.mkdir()
    (folder / "CONCEPT.csv").write_text(
        "concept_id\tconcept_name\tdomain_id\tvocabulary_id\tstandard_concept\tconcept_code\tinvalid_reason\n"
        '1\tChest "pain"\tCondition\tSNOMED\tS\t007\t\n2\tDor no peito\tCondition\tLOCAL\t\tX\t\n3\tNA\tDrug\tRxNorm\tS\t8\t\n4\tOld\tDrug\tRxNorm\tS\t9\tD\n'
    )
    (folder / "CONCEPT_SYNONYM.csv").write_text("concept_id\tconcept_synonym_name\n1\tthoracic pain\n2\tdor toracica\n")
    (folder / "CONCEPT_RELATIONSHIP.csv").write_text("concept_id_1\tconcept_id_2\trelationship_id\tinvalid_reason\n2\t1\tMaps to\t\n1\t1\tMaps to\t\n2\t4\tMaps to\t\n")
    (folder / "SOURCE_TO_CONCEPT_MAP.csv").write_text('source_code,target_concept_id\n"a,b",1\n')
    return str(folder)


def test_vocabulary_to_mapping_service_and_stream(spark, vocabulary_dir, tmp_path):
    tables = vocabulary.load_vocabulary(spark, vocabulary_dir)
    assert set(tables) == {"concept", "concept_synonym", "concept_relationship", "source_to_concept_map"}
    assert all(t == "string" for df in tables.values() for _, t in df.dtypes)
    assert tables["source_to_concept_map"].first()[0] == "a,b"
    assert {r.concept_name for r in tables["concept"].collect()} == {'Chest "pain"', "Dor no peito", "NA", "Old"}
    gone = vocabulary.load_vocabulary(spark, vocabulary_dir, pandas_na=True)["concept"]
    assert gone.where("concept_name is null").count() == 1
    data = datasets.expression_dataset(tables["concept"], tables["concept_synonym"], tables["concept_relationship"], ["SNOMED", "RxNorm"])
    found = {(r.expression, r.expression_origin, r.std_concept_id) for r in data.collect()}
    # the target's own validity is not asked for, so concept 4 is reached by mapping
    assert found == {
        ('Chest "pain"', "standard_concept", "1"), ("NA", "standard_concept", "3"), ("thoracic pain", "standard_concept_synonym", "1"),
        ("Dor no peito", "mapped_non_standard_concept", "1"), ("Dor no peito", "mapped_non_standard_concept", "4"),
        ("dor toracica", "mapped_non_standard_concept_synonym", "1"), ("dor toracica", "mapped_non_standard_concept_synonym", "4"),
    }
    assert datasets.standard_concepts(tables["concept"], ["SNOMED"]).count() == 1
    with pytest.raises(ValueError):
        datasets.standard_concepts(tables["concept"], [])

    root = str(tmp_path / "root")
    first = index.build_index(data.where("expression_origin = 'standard_concept'"), root, embed.OFFLINE)
    assert first.count() == 2
    assert index.build_index(data, root, embed.OFFLINE, "skip").count() == 2
    assert index.build_index(data, root, embed.OFFLINE, "repair").count() == 7
    assert index.build_index(data, root, embed.OFFLINE, "repair").count() == 7
    assert index.lookup(index.load_index(spark, root, "offline-hash"), code="007").count() == 4

    m = mapper.ConceptMapper(spark, "offline-hash", root=root)
    rows = m.map(["thoracic PAIN", "dor no peito"]).orderBy("query_id").collect()
    assert rows[0].target_concept_id == "1" and rows[0].confidence_score is None  # exact match
    assert m.map(["thoracic pain"]).columns[1:] == list(assembly.MAPPED)
    with pytest.raises(TypeError):
        m.map("bare text")
    with pytest.raises(ValueError):
        m.map()
    with pytest.raises(ValueError):
        m.map(file_path="x.tsv")

    (tmp_path / "in.csv").write_text(HEADER + "a,,L,thoracic pain,2020-1-5,,\nb,,L,,,,\nc,,L,dor\n")
    out = m.map(file_path=str(tmp_path / "in.csv"), save_to_disk=True, output_dir=str(tmp_path / "out"))
    assert [r.source_code for r in out.orderBy("query_id").collect()] == ["a", "c"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "mapped_source_concepts.csv")).count() == 2

    answer = service.search(spark, root, {"queries": ["chest"], "top_k": 2, "where": {"std_concept_id": "1"}})
    assert len(answer[0]["results"]) == 2 and answer[0]["query"] == "chest"
    assert service.map_concepts(spark, root, {"source_concepts": [{"source_code_description": "thoracic pain"}]})[0]["target_concept_id"] == "1"
    for bad in ({}, {"source_concepts": [{"source_code": "x"}]}):
        with pytest.raises(service.BadRequest):
            service.map_concepts(spark, root, bad)

    arriving = tmp_path / "arriving"
    concepts.sources_from_list(spark, ["thoracic pain", "dor"]).drop("query_id").write.parquet(str(arriving))
    stream = spark.readStream.schema(spark.read.parquet(str(arriving)).schema).parquet(str(arriving))
    map_stream(stream, m, str(tmp_path / "mapped"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "mapped")).count() == 2


def test_source_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(HEADER + "a,1,V,pain,2020-01-01,2099-12-31,,too,long\nb,1,V,ache\nc,2,V,,x,,\nd,NA,V,cough,2020-02-30,,\n")
    df = concepts.read_source_csv(spark, str(path))
    assert [(r.query_id, r.source_code) for r in df.orderBy("query_id").collect()] == [(0, "b"), (1, "c"), (2, "d")]
    assert [r.query_id for r in concepts.rejected_rows(df).collect()] == [1]
    assert concepts.null_report(df).first().n_null == 1
    clean = concepts.clean_sources(df).orderBy("query_id").collect()
    assert [(r.source_code, r.source_concept_id, r.valid_start_date) for r in clean] == [("b", "1", ""), ("d", "NA", "2020-02-30")]
    with pytest.raises(Exception, match="YYYY-MM-DD"):
        concepts.check_dates(concepts.clean_sources(df)).collect()
    assert concepts.read_source_csv(spark, str(path), limit_to=1).count() == 1
    with pytest.raises(ValueError):
        concepts.read_source_csv(spark, str(path), {"source_code": "other"})
    assert concepts.load_source_csv(spark, str(path)).count() >= 3
    ids = concepts.ids_as_strings(spark.createDataFrame([(1,), (None,)], "a int"), ["a"], null_as_none=True)
    assert sorted(r.a for r in ids.collect()) == ["1", "None"]
    with pytest.raises(Exception, match="not one of"):
        concepts.check_members(spark.createDataFrame([("x",)], "a string"), "a", ["y"]).collect()


@given(st.dates())
def test_padded_dates_are_dates(d):
    assert __import__("re").match(r"^\d{4}-\d{1,2}-\d{1,2}$", d.isoformat())


def test_where_filters(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "a int, b int")
    count = lambda w: df.where(retrieval.compile_where(w)).count()
    assert count(None) == 9 and count({"b": 1}) == 3 and count({"a": {"$gte": 2, "$lt": 5}}) == 3
    assert count({"$or": [{"a": 0}, {"$and": [{"b": {"$ne": 0}}, {"a": {"$in": [1, 3]}}]}]}) == 2
    assert count({"a": {"$nin": [1, 2]}}) == 7 and count({"a": {"$gt": 7}}) == 1 and count({"a": {"$lte": 0}, "b": {"$eq": 0}}) == 1
    for bad in ({"a": {"$like": 1}}, {"$not": []}, {"$and": []}):
        with pytest.raises(ValueError):
            retrieval.compile_where(bad)


def test_top_k_blocks_ties_and_monotonicity(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_A_PASS", 2)
    rows = spark.createDataFrame([(str(i), [float(i % 4), 1.0]) for i in range(12)], "expression_id string, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "query_id long, embedding array<float>")
    small = {(r.query_id, r.expression_id) for r in retrieval.top_k(queries, rows, 2).collect()}
    large = {(r.query_id, r.expression_id) for r in retrieval.top_k(queries, rows, 5).collect()}
    assert len(small) == 10 and small < large
    assert (0, "0") in small and (0, "4") in small
    assert retrieval.top_k(queries.limit(0), rows, 2).count() == 0


def bm25(query, docs, k1=1.5, b=0.75, eps=0.25):
    """Written from the published formula, independently of the engine."""
    corpus = [d.split(" ") for d in docs]
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {}
    for d in corpus:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query.split(" ")) for d in corpus]


def test_bm25_and_order(spark):
    lists = {1: ("a b a", ["a b", "a", "c  d", "a a b c"]), 2: ("x", ["x y", "x z", "x"]), 3: ("q", ["r"])}
    rows = [(q, query, f"{q}-{i}", d, i, 0.5) for q, (query, docs) in lists.items() for i, d in enumerate(docs)] + [(1, "a b a", "1-e", "", 4, 0.1), (1, "a b a", "1-n", None, 5, 0.1)]
    cand = spark.createDataFrame(rows, "query_id long, query string, expression_id string, expression string, retrieval_rank int, distance double")
    got = {r.expression_id: r for r in rerank.rerank_bm25(cand).collect()}
    for q, (query, docs) in lists.items():
        for i, s in enumerate(bm25(query, docs)):
            assert got[f"{q}-{i}"].rerank_score == pytest.approx(s, abs=1e-9)
    assert got["1-e"].rerank_score is None and got["1-e"].rank == 4 and got["1-n"].rank == 5
    # a zero score stands behind a negative one
    mixed = spark.createDataFrame([(1, "a", 0, 0.0), (1, "b", 1, -1.0), (1, "c", 2, None)], "query_id long, expression_id string, retrieval_rank int, rerank_score double")
    assert [r.expression_id for r in rerank.ranked(mixed).orderBy("rank").collect()] == ["b", "a", "c"]
    with pytest.raises(TypeError):
        rerank.rerank_bm25(cand.drop("query"))
    assert rerank.fit_tokens([1, 2, 3, 4], [9], [8], 4) == [9, 1, 2, 8] and rerank.left_padded([[1], [2, 3]], 0) == [[0, 1], [2, 3]]


def test_selection_and_assembly(spark):
    base = "query_id long, query string, expression_id string, expression string, expression_concept_id string, expression_origin string, std_concept_id string, std_concept_name string, std_vocabulary_id string, std_vocabulary_code string, std_domain_id string, distance double, retrieval_rank int, rerank_score double, rank int"
    make = lambda q, i, d, r: (q, f"q{q}", i, "e", "1", "o", f"c{i}", "n", "SNOMED", "7", "D", d, r, None, r)
    cand = spark.createDataFrame([make(0, "x", 0.0, 0), make(0, "y", 0.1, 1), make(1, "x", None, 0), make(2, "z", 0.4, 0), make(2, "z", 0.5, 1)], base)
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "query_id long, query string")
    pick = lambda df: {r.query_id: (r.expression_id, r.result_list_index) for r in df.collect()}
    assert pick(selection.select_first(queries, cand)) == {0: ("x", 0), 1: (None, None), 2: ("z", 0), 3: (None, None)}
    assert pick(selection.select_first(queries, cand, 0.4))[2] == (None, None)
    judge = lambda: lambda prompts: ['{"expression_id": "y"}', '{"expression_id": "nope"}', '{"expression_id": null}'][: len(prompts)]
    one = cand.where("query_id = 0")
    assert pick(selection.select_with_judge(queries.where("query_id = 0"), one, judge)) == {0: ("y", 1)}
    verdicts = spark.createDataFrame([(0, "gone"), (2, "z"), (1, None)], "query_id long, expression_id string")
    assert pick(selection.apply_verdicts(queries, cand, verdicts)) == {0: (None, None), 1: (None, None), 2: ("z", 0), 3: (None, None)}
    shown = selection.judge_prompts(cand.where("query_id = 0")).first().prompt
    assert shown[1].content.startswith("TERM\nQ0\n") and shown[1].content.index('"x"') < shown[1].content.index('"y"')
    sources = concepts.sources_from_list(spark, ["chest PAIN", "b", "c", "d"])
    chosen = selection.select_first(queries, cand)
    score = lambda **k: [r.confidence_score for r in assembly.assemble(sources, chosen, **k).orderBy("query_id").collect()]
    assert score() == [None, None, 0.6, None] and score(exact_match=True) == [1.0, None, 0.6, None] and score(mode="async_compat") == [1.0, 1.0, 0.6, 1.0]
    texts = spark.createDataFrame([(0, "translated")], "query_id long, text string")
    first = assembly.assemble(sources, chosen, texts).orderBy("query_id").first()
    assert (first.source_code_description, first.source_code_description_original) == ("translated", "chest PAIN")


def test_translation_retries_and_falls_back(spark):
    def load():
        calls = {}

        def ask(messages):
            text = messages[1]["content"]
            calls[text] = calls.get(text, 0) + 1
            if text == "bad" or (text == "late" and calls[text] < 3):
                raise RuntimeError("down")
            return json.dumps({"text": text.upper()})

        return ask

    sources = concepts.sources_from_list(spark, ["dor", "late", "bad", "dor"])
    done = translate.translate(sources, translate.Translator("t", load)).orderBy("query_id").collect()
    assert [r.text for r in done] == ["DOR", "LATE", "bad", "DOR"]
    assert [r.text for r in translate.translate(sources).orderBy("query_id").collect()] == ["dor", "late", "bad", "dor"]


@pytest.mark.parametrize(
    ("template", "args", "want"),
    [
        ([{"role": "user", "content": "Hi {a}"}], {"a": "x"}, ["Hi x"]),
        ([{"content": "{a}"}, {"content": "{b}{c}"}, {"content": "-"}], {"a": 1, "b": 2, "c": 3}, ["1", "23", "-"]),
        ([{"content": "{a}"}], {"z": 1}, ["{a}"]),
        ([{"content": 5}], {"a": 1}, [5]),
        ([{"content": ["{a}"]}], {"a": 1}, [["{a}"]]),
        ([{"content": "{a}"}], {"a": "{b}", "b": "c"}, ["c"]),
    ],
)
def test_prompt_fill(template, args, want):
    before = json.dumps(template)
    assert [m["content"] for m in prompts.fill(template, args)] == want and json.dumps(template) == before


def test_prompt_checks_and_schema():
    template = ({"role": "user", "content": "{text} {x}"},)
    assert prompts.placeholders(template) == {"text", "x"}
    prompts.check_args(template, [{"x": "1"}, {"x": "2"}], 2)
    for bad in ({"y": 1}, [{"x": 1}]):
        with pytest.raises(ValueError):
            prompts.check_args(template, bad, 2)
    assert prompts.format_messages(template, text="a", x="b")[0]["content"] == "a b"
    with pytest.raises(KeyError):
        prompts.format_messages(template, text="a", x="b", q="c")
    assert prompts.json_schema(omop.CONDITION.schema)["additionalProperties"] is False


def test_record_constraints(spark):
    cases = {
        '{"days_supply": 5, "quantity": 0}': [],
        '{"days_supply": "5"}': ["days_supply: not a plain integer"],
        '{"days_supply": 5.0}': ["days_supply: not a plain integer"],
        '{"days_supply": 0}': ["days_supply: below 1"],
        '{"quantity": -1}': ["quantity: below 0"],
        '{"colour": 1}': ["unknown field"],
        '{"drug_exposure_start_date": "2020-02-01", "drug_exposure_end_date": "2020-01-01"}': ["drug_exposure_end_date: before drug_exposure_start_date"],
        '{"drug_exposure_start_date": "2020-02-31"}': ["drug_exposure_start_date: not a date"],
        '{"stop_reason": "' + "x" * 21 + '"}': ["stop_reason: longer than 20"],
        "not json": ["not a JSON object"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    assert {r.reply: r.violations for r in omop.validated(df, "reply", "drug_exposure").collect()} == cases
    many = spark.createDataFrame([('{"records": [{"quantity": 1}, {"quantity": -1}]}',), ('{"records": []}',)], "reply string")
    got = omop.validated(many, "reply", "device_exposure_list").collect()
    assert sorted(len(r.violations) for r in got) == [0, 1, 1]
    full = omop.validated(spark.createDataFrame([("{}",)], "reply string"), "reply", omop.FULL_DEVICE).first()
    assert len(full.violations) == 4
    with pytest.raises(ValueError):
        omop.model_of("nothing")
    with pytest.raises(ValueError):
        omop.register_model(omop.DRUG)


def test_extraction(spark):
    task = extract.ExtractionTask(({"role": "user", "content": "{text} {json_format} {who}"},), ("pain", "ache"), "condition_occurrence", [{"who": "a"}, {"who": "b"}])
    load = lambda: lambda messages: json.dumps({"condition_source_value": messages[0]["content"].split()[0]})
    rows = extract.extract(spark, [task], load).orderBy("text_idx").collect()
    assert [r.record.condition_source_value for r in rows] == ["pain", "ache"] and not any(r.violations for r in rows)
    with pytest.raises(TypeError):
        extract.extract(spark, task, load)
    other = extract.ExtractionTask(({"role": "user", "content": "{text} {json_format}"},), ("tube",), "device_exposure_list")
    both = {(r.task_id, r.text_idx): r for r in extract.extract(spark, [task, other], load).collect()}
    assert json.loads(both[0, 1].record) == {"condition_source_value": "ache"} and set(both) == {(0, 0), (0, 1), (1, 0)}
    at = spark.createDataFrame([("a pain", "pain"), ("a", "zz")], "t string, s string").select(prompts.span_offsets(F.col("t"), F.col("s")).alias("o"))
    assert [list(r.o) for r in at.collect()] == [[2, 6], [-1, 1]]


def test_limits_profile_registry_settings_and_stages(spark, tmp_path):
    wait, at = limits.reserve(100, 3000, 0.0, 10.0)
    assert (wait, at) == (0.0, 12.0) and limits.reserve(50, 3000, at, 10.5) == (1.5, 13.0)
    with pytest.raises(ValueError):
        limits.check_rate(0)
    assert limits.estimated_batch_size(9.5, (1, 1.0), (3, 2.0)) == 16
    profiler = Profiler()
    with profiler.block("a"):
        pass
    profiler.add("b", 3.0)
    profiler.add("b", 1.0)
    top = profiler.summary(spark).first()
    assert (top["name"], top["total"], top["calls"], top["mean"]) == ("b", 4.0, 2, 2.0)
    registry = Registry("thing")
    registry.register("one", lambda x=1: x)
    assert registry.load("one", x=5) == 5
    with pytest.raises(ValueError, match="one"):
        registry.load("two")
    with pytest.raises(TypeError):
        registry.load("one", y=1)
    with pytest.raises(ValueError):
        registry.register("one", lambda: 2)
    with pytest.raises(TypeError):
        registry.resolve(5, str)
    task = config.MappingTask(str(tmp_path / "a.csv"), column_mapping={"x": "y"}, limit_to=3)
    task.save(tmp_path / "t.json")
    assert config.load_settings(tmp_path / "t.json") == task and config.load_settings(task) is task
    with pytest.raises(ValueError):
        config.MappingTask.load(tmp_path / "t.yml")
    double = mapper.Stage(lambda x: 2 * x)
    assert (3 | double) == 6 and (3 | (double | double)) == 12 and mapper.Stage()(4) == 4
    cache = mapper.ComponentCache(2)
    for key in "abac":
        cache.get(key, lambda key=key: key)
    assert list(cache.held) == ["a", "c"]
    for bad in ([], [1]):
        with pytest.raises(AssertionError):
            mapper.as_queries(spark, bad)


def test_models_are_asked_once_and_no_faster_than_the_limit(spark, tmp_path):
    """A translator and a judge leave a file per call: n texts, n calls, however often the result is read."""
    calls = str(tmp_path)

    def load():
        def ask(messages):
            __import__("tempfile").mkstemp(prefix="call-", dir=calls)
            return json.dumps({"text": messages[1]["content"].upper()})

        return ask

    def judge():
        def ask(asked):
            for _ in asked:
                __import__("tempfile").mkstemp(prefix="judge-", dir=calls)
            return [json.dumps({"expression_id": "1"})] * len(asked)

        return ask

    made = lambda kind: sum(p.name.startswith(kind) for p in tmp_path.iterdir())
    base = "expression_id string, expression string, expression_concept_id string, expression_origin string, std_concept_id string, std_concept_name string, std_vocabulary_id string, std_vocabulary_code string, std_domain_id string"
    rows = spark.createDataFrame([(str(i), f"TEXT {i}", "1", "o", f"c{i}", "n", "SNOMED", "7", "D") for i in range(5)], base)
    found = rows.withColumn("embedding", embed.offline_vector(F.col("expression")))
    chooser = mapper.Selector(lambda q, c, rate=None: selection.select_with_judge(q, c, judge, rate_limit=rate), True)
    m = mapper.ConceptMapper(spark, mapper.Retriever(found, top_k=5), translate.Translator("t", load, at_once=4), "bm25", chooser)
    mapped = m.map(["text 0", "text 1", "text 2"])
    assert mapped.count() == 3 and len(mapped.collect()) == 3
    assert made("call-") == 3 and made("judge-") == 3
    assert {r.source_code_description for r in mapped.collect()} == {"TEXT 0", "TEXT 1", "TEXT 2"} and {r.target_concept_id for r in mapped.collect()} == {"c1"}
    listed = m.map_objects(["text 3"])
    assert listed[0].source_code_description_original == "text 3" and made("call-") == 4
    waited = []
    pacer = limits.Pacer(120, clock=lambda: 0.0, sleep=waited.append)
    for _ in range(3):
        pacer.wait()
    assert waited == [0.5, 1.0]
    begin = __import__("time").monotonic()
    sources = concepts.sources_from_list(spark, [f"x{i}" for i in range(9)])
    assert translate.translate(sources, translate.Translator("t", load), rate_limit=720).count() == 9
    assert __import__("time").monotonic() - begin > 0.6 and made("call-") == 13


def test_rows_are_numbered_in_file_order(spark):
    df = spark.range(1000).repartition(7).sortWithinPartitions("id").select("id")
    got = [r.query_id for r in concepts.numbered(df).collect()]
    assert got == list(range(1000)) and concepts.numbered(df.limit(0)).count() == 0


def test_service_settings_and_full_row_models(tmp_path):
    assert service.stored_config(str(tmp_path)).port == 8000
    config.ServiceConfig(port=8123, rate_limit=60).save(tmp_path / "service.json")
    assert (service.stored_config(str(tmp_path)).port, service.stored_config(str(tmp_path)).rate_limit) == (8123, 60)
    assert all(omop.model_of(f"{m}_row")[0].required for m in ("condition_occurrence", "drug_exposure", "device_exposure"))
