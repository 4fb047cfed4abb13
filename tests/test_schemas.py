"""Typed JSON checks: generated questions and research configurations."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import json_schema as js
from lectern.functions import schemas
from lectern.operators import integrity, scoring
from lectern.session import ship

ID = "11111111-1111-4111-8111-111111111111"
DESIGN = {
    "benchmarkType": "PREREQUISITE_RELATIONSHIP", "taskType": "dependency_application", "targetConcept": "가속도",
    "prerequisiteConcepts": [{"concept": "속도 변화", "role": "가속도를 정의하는 데 필요한 변화량", "evidenceChunkIds": [ID]}],
    "prerequisiteRelations": [{"fromConcept": "속도 변화", "toConcept": "가속도", "relationType": "REQUIRES", "explanation": "속도의 변화로 이해한다.", "evidenceChunkIds": [ID]}],
    "requiredReasoningSteps": ["속도 변화를 판별한다.", "시간 간격과 연결한다."], "failureSignals": ["가속도를 속도와 동일시한다."],
}
QUESTION = {"questionText": "원자와 분자의 차이를 설명하시오.", "answerText": "원자는 기본 입자이다.", "acceptedAnswers": ["원자"], "answerOptions": ["① A", "② B"], "designSummary": "비교", "evidenceSummary": "정의", "evidenceChunkIds": [ID], "benchmarkDesign": DESIGN}


def changed(base, path, value):
    """A copy with the value at the path; the ellipsis takes the field away."""
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def found(spark, check, texts, *more):
    df = spark.createDataFrame([(k, x, *m) for k, (x, *m) in enumerate(zip(texts, *more))], ["k", "raw", *[f"m{i}" for i in range(len(more))]])
    return [list(r[0]) for r in df.orderBy("k").select(check(*[F.col(c) for c in df.columns[1:]]).alias("x")).collect()]


QUESTIONS = [
    (QUESTION, []),
    ({k: QUESTION[k] for k in ("questionText", "answerText", "evidenceChunkIds", "benchmarkDesign")}, []),
    (changed(QUESTION, ["questionText"], 12345), ["questionText"]),
    (changed(QUESTION, ["questionText"], "네글자요"), ["questionText"]),
    (changed(QUESTION, ["questionText"], "😀😀."), []),  # five UTF-16 units
    (changed(QUESTION, ["answerText"], True), ["answerText"]),
    (changed(QUESTION, ["answerText"], ...), ["answerText"]),
    (changed(QUESTION, ["acceptedAnswers"], [1]), ["acceptedAnswers[0]"]),
    (changed(QUESTION, ["acceptedAnswers"], None), ["acceptedAnswers"]),
    (changed(QUESTION, ["evidenceChunkIds"], []), ["evidenceChunkIds"]),
    (changed(QUESTION, ["evidenceChunkIds"], ["chunk-1", ID]), ["evidenceChunkIds[0]"]),
    (changed(QUESTION, ["benchmarkDesign"], []), ["benchmarkDesign"]),
    (changed(QUESTION, ["benchmarkDesign", "prerequisiteRelations", 0, "toConcept"], "힘"), ["benchmarkDesign.prerequisiteRelations"]),
    (changed(QUESTION, ["benchmarkDesign", "prerequisiteRelations", 0, "relationType"], "SUPPORTS"), ["benchmarkDesign.prerequisiteRelations[0].relationType"]),
    (changed(QUESTION, ["benchmarkDesign", "prerequisiteConcepts", 0, "evidenceChunkIds"], [7]), ["benchmarkDesign.prerequisiteConcepts[0].evidenceChunkIds[0]"]),
    (changed(QUESTION, ["benchmarkDesign", "requiredReasoningSteps"], ["하나뿐"]), ["benchmarkDesign.requiredReasoningSteps"]),
    (QUESTION | {"extra": 1}, []),
    ([QUESTION], [""]),
    ("text", [""]),
]


def test_questions(spark):
    texts = [json.dumps(q, ensure_ascii=False) for q, _ in QUESTIONS]
    assert found(spark, integrity.question_issues, texts) == [want for _, want in QUESTIONS]
    assert found(spark, integrity.question_issues, ['{"questionText":"깨진 응답"', "", "﻿\n " + texts[0] + "　", texts[0] + "x"]) == [[""], [""], [], [""]]


def test_rules_and_options(spark):
    texts = [json.dumps(QUESTION), json.dumps(QUESTION), json.dumps(changed(QUESTION, ["answerOptions"], list("12345"))), json.dumps(changed(QUESTION, ["acceptedAnswers"], [1])), json.dumps(changed(QUESTION, ["benchmarkDesign"], 3) | {"answerOptions": []})]
    got = found(spark, integrity.question_problems, texts, ["객관식", "서술형", "객관식", "객관식", "서술형"])
    assert got[:4] == [["answerOptions"], ["answerOptions"], [], ["acceptedAnswers", "answerOptions"]]
    assert got[4] == [r for r in integrity.QUESTION_RULES if r.startswith("benchmarkDesign.")]


ABOUT = {"version": "v1.0", "title": "설정", "description": "연구에 쓰는 설정을 설명하는 스무 글자 이상", "applyScope": "새로 등록하는 문서에 적용되는 범위입니다", "reprocessingImpact": "기존 문서는 다시 처리해야만 반영됩니다요", "schemaVersion": 1}
RAG = ABOUT | {"kind": "embedding_rag", "settings": {
    "provider": "gemini", "model": "embedding-1", "dimensions": 3072, "vectorSpaceId": "gemini:v1", "documentTaskType": "RETRIEVAL_DOCUMENT", "queryTaskType": "RETRIEVAL_QUERY", "prefixStrategy": "task_type", "documentPrefix": "",
    "queryPrefix": "", "similarityMetric": "cosine", "chunkTargetTokens": 900, "retrievalTopK": 12, "neighborWindow": 1, "batchSize": 16, "concurrency": 4, "requestTimeoutMs": 60000}}
GENERATION = ABOUT | {"kind": "question_generation", "settings": {
    "provider": "gemini", "model": "m", "directionMaxOutputTokens": 512, "questionMaxOutputTokens": 65536, "thinkingLevel": "LOW", "structuredOutput": True, "responseMimeType": "application/json", "concurrency": 1, "requestTimeoutMs": 1000}}


def model(key, protocol=None):
    return {
        "providerKey": key, "displayName": key, "protocol": protocol or schemas.PROTOCOLS[key], "enabled": True, "modelId": f"{key}-1", "concurrency": 2, "requestIntervalMs": 0, "requestTimeoutMs": 60000,
        "generation": {"maxOutputTokens": 4096, "temperature": 0.2, "topP": None, "presencePenalty": -2, "frequencyPenalty": None, "thinkingLevel": None, "enableThinking": None, "omitTemperature": False, "omitTopP": True, "stopSequences": ["END"], "seed": 42},
    }


MODELS = ABOUT | {"kind": "benchmark_models", "settings": {"models": [model("gemini"), model("upstage"), model("exaone")]}}
G = ["settings", "models", 1, "generation"]
CONFIGS = [
    (RAG, []), (GENERATION, []), (MODELS, []),
    (changed(MODELS, ["settings", "models"], [*MODELS["settings"]["models"], model("openai")]), []),
    (changed(MODELS, ["settings", "models"], [*MODELS["settings"]["models"], model("openai", "openai-compatible")]), ["settings.models[3].protocol"]),
    (changed(MODELS, ["settings", "models"], [model("gemini"), model("gemini"), model("exaone")]), ["settings.models"]),
    (changed(MODELS, ["settings", "models", 0, "providerKey"], "other"), ["settings.models[0].providerKey", "settings.models"]),
    (changed(MODELS, [*G, "temperature"], 2.5), ["settings.models[1].generation.temperature"]),
    (changed(MODELS, [*G, "temperature"], "0.2"), ["settings.models[1].generation.temperature"]),
    (changed(MODELS, [*G, "seed"], 1.5), ["settings.models[1].generation.seed"]),
    (changed(MODELS, [*G, "stopSequences"], ["", 3]), ["settings.models[1].generation.stopSequences[0]", "settings.models[1].generation.stopSequences[1]"]),
    (changed(MODELS, [*G, "stopSequences"], ["x"] * 17), ["settings.models[1].generation.stopSequences"]),
    (changed(MODELS, [*G, "thinkingLevel"], "MAX"), ["settings.models[1].generation.thinkingLevel"]),
    (changed(MODELS, [*G, "topP"], ...), ["settings.models[1].generation.topP"]),
    (changed(MODELS, [*G, "apiKey"], "x"), ["settings.models[1].generation.apiKey"]),
    (changed(RAG, ["settings", "apiKey"], "secret"), ["settings.apiKey"]),
    (changed(RAG, ["settings", "prefixStrategy"], "text_prefix"), ["settings.prefixStrategy"]),
    (changed(changed(changed(RAG, ["settings", "prefixStrategy"], "text_prefix"), ["settings", "documentPrefix"], "d: "), ["settings", "queryPrefix"], "q: "), []),
    (changed(RAG, ["settings", "queryPrefix"], "x"), ["settings.prefixStrategy"]),
    (changed(RAG, ["settings", "dimensions"], 64), ["settings.dimensions"]),
    (changed(RAG, ["settings", "model"], "two words"), ["settings.model"]),
    (changed(GENERATION, ["settings", "structuredOutput"], False), ["settings.structuredOutput"]),
    (changed(GENERATION, ["version"], "V 1"), ["version"]),
    (changed(GENERATION, ["description"], " " * 30), ["description"]),
    (changed(GENERATION, ["schemaVersion"], 2), ["schemaVersion"]),
    (changed(GENERATION, ["kind"], "none"), ["kind"]),
    (GENERATION | {"note": 1}, ["note"]),
]


def test_configurations(spark):
    assert found(spark, integrity.config_issues, [json.dumps(c) for c, _ in CONFIGS]) == [want for _, want in CONFIGS]
    assert found(spark, integrity.config_issues, [json.dumps(RAG)] * 2, ["embedding_rag", "document_parse"]) == [[], ["kind"]]


@pytest.mark.parametrize("schema,good,bad", [
    (js.whole(0, 5), ["0", "5", "3.0", "50e-1"], ["-1", "5.5", '"3"', "null", "true", "[]"]),
    (js.nullable(js.flag(True)), ["true", "null"], ["false", '"true"', "1"]),
    (js.items(js.items(js.number(), 1), 0, 2), ["[]", "[[1],[2.5]]"], ["[[]]", "[[1],[1],[1]]", "[1]", "{}", "null"]),
])
def test_parts(spark, schema, good, bad):
    got = found(spark, lambda c: js.problems(c, schema), [*good, *bad])
    assert [g == [] for g in got] == [True] * len(good) + [False] * len(bad)


def test_answers_and_presence(spark):
    from lectern.functions.scalars import answer_normalised

    ship(spark)
    texts = ["\n\t ", "...", "", None, "　。!?", "Ａ b  C. ", "éⅠ", "a. b.!", ". ."]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k")
    got = df.select(answer_normalised(F.col("x")), scoring.response_present(F.col("x"))).collect()
    assert [r[1] for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert [r[0] for r in got] == ["", "", "", None, "", "ａ b c", "éⅰ", "a. b", "."]


@pytest.mark.parametrize("name", ["config_checks", "question_issues"])
def test_checks_are_dealt_to_all_cores(spark, name):
    """a small file was one task, however long its checks took."""
    from lectern import catalog

    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
