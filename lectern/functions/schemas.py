"""The JSON documents the engine takes: generated questions and research configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import json_schema as js

#: Kinds of relations and tasks, the only type of benchmark, the type with options and their number.
RELATIONS = ["REQUIRES", "BUILDS_ON", "APPLIES", "DISTINGUISHES"]
TASKS = ["dependency_application", "missing_prerequisite_diagnosis", "cross_unit_transfer", "relation_direction_discrimination", "prerequisite_chain_completion"]
BENCHMARK_TYPE, WITH_OPTIONS, OPTIONS = "PREREQUISITE_RELATIONSHIP", "객관식", 5
UUID = "(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}|0{8}-0{4}-0{4}-0{4}-0{12}|f{8}-f{4}-f{4}-f{4}-f{12})$"

_IDS = js.items(js.text(pattern=UUID), least=1)


def _reaches_target(design: Column) -> Column:
    target = js.as_text(js.part(design, "targetConcept"))
    return F.exists(js.elements(js.part(design, "prerequisiteRelations")), lambda x: js.as_text(js.part(x, "toConcept")) == target)


QUESTION = js.fields(
    {
        "questionText": js.text(5),
        "answerText": js.text(1),
        "acceptedAnswers": js.optional(js.items(js.text())),
        "answerOptions": js.optional(js.items(js.text())),
        "designSummary": js.optional(js.text()),
        "evidenceSummary": js.optional(js.text()),
        "evidenceChunkIds": _IDS,
        "benchmarkDesign": js.fields(
            {
                "benchmarkType": js.text(one_of=[BENCHMARK_TYPE]),
                "taskType": js.text(one_of=TASKS),
                "targetConcept": js.text(1),
                "prerequisiteConcepts": js.items(js.fields({"concept": js.text(1), "role": js.text(5), "evidenceChunkIds": _IDS}), least=1),
                "prerequisiteRelations": js.items(
                    js.fields({"fromConcept": js.text(1), "toConcept": js.text(1), "relationType": js.text(one_of=RELATIONS), "explanation": js.text(5), "evidenceChunkIds": _IDS}), least=1
                ),
                "requiredReasoningSteps": js.items(js.text(3), least=2),
                "failureSignals": js.items(js.text(3), least=1),
            },
            rules={"prerequisiteRelations": _reaches_target},
        ),
    }
)

#: Names and ranges of a research configuration.
MEDIA = ["table", "figure", "chart", "equation"]
THINKING = ["MINIMAL", "LOW", "MEDIUM", "HIGH"]
PROTOCOLS = {"gemini": "gemini", "upstage": "openai-compatible", "exaone": "openai-compatible", "openai": "openai-responses"}
CORE_PROVIDERS = ["gemini", "upstage", "exaone"]
_MODEL = js.text(1, 200, r"^\S+$", trim=True)
_TIMEOUT = js.whole(1000, 600_000)
_ABOUT = js.text(20, 1000, trim=True)


def _only(value: str) -> js.Schema:
    return js.text(one_of=[value])


def _each_medium_once(settings: Column) -> Column:
    own = F.transform(js.elements(js.part(settings, "base64Encoding")), js.as_text)
    return F.size(F.array_distinct(own)) == len(MEDIA)


def _prefixes_fit(settings: Column) -> Column:
    given = [js.as_text(js.part(settings, k)) for k in ("documentPrefix", "queryPrefix")]
    both = F.length(js.trimmed(given[0])).cast("boolean") & F.length(js.trimmed(given[1])).cast("boolean")
    return F.when(js.as_text(js.part(settings, "prefixStrategy")) == "text_prefix", both).otherwise((given[0] == "") & (given[1] == ""))


def _providers_once(settings: Column) -> Column:
    own = F.transform(js.elements(js.part(settings, "models")), lambda m: js.as_text(js.part(m, "providerKey")))
    core = F.array(*map(F.lit, CORE_PROVIDERS))
    return (F.size(F.array_distinct(own)) == F.size(own)) & (F.size(F.array_except(core, own)) == 0)


_DPI = js.whole(150, 600)
_RASTER = js.by_field(
    "format",
    {
        "png": js.fields({"format": js.text(), "lossless": js.flag(True), "dpi": _DPI}, strict=True),
        "jpeg": js.fields({"format": js.text(), "lossless": js.flag(False), "dpi": _DPI, "jpegQuality": js.whole(60, 100)}, strict=True),
    },
)
_GENERATION = js.fields(
    {
        "maxOutputTokens": js.whole(1, 131_072),
        "temperature": js.nullable(js.number(0, 2)),
        "topP": js.nullable(js.number(0, 1)),
        "presencePenalty": js.nullable(js.number(-2, 2)),
        "frequencyPenalty": js.nullable(js.number(-2, 2)),
        "thinkingLevel": js.nullable(js.text(one_of=THINKING)),
        "enableThinking": js.nullable(js.flag()),
        "omitTemperature": js.flag(),
        "omitTopP": js.flag(),
        "stopSequences": js.items(js.text(1, 200), most=16),
        "seed": js.nullable(js.whole(0, 2_147_483_647)),
    },
    strict=True,
)
_SETTINGS = {
    "document_parse": js.fields(
        {
            "provider": _only("upstage"), "model": _MODEL, "mode": js.text(one_of=["standard", "enhanced", "auto"]), "ocr": js.text(one_of=["auto", "force"]),
            "outputFormat": js.text(one_of=["html", "markdown", "both"]), "base64Encoding": js.items(js.text(one_of=MEDIA), 4, 4), "rasterization": _RASTER,
            "pagesPerBatch": js.whole(1, 100), "pageConcurrency": js.whole(1, 20), "requestTimeoutMs": _TIMEOUT,
        },
        strict=True, rules={"base64Encoding": _each_medium_once},
    ),
    "embedding_rag": js.fields(
        {
            "provider": _only("gemini"), "model": _MODEL, "dimensions": js.whole(128, 3072), "vectorSpaceId": js.text(3, 200, "^[a-zA-Z0-9._:/-]+$", trim=True),
            "documentTaskType": _only("RETRIEVAL_DOCUMENT"), "queryTaskType": _only("RETRIEVAL_QUERY"), "prefixStrategy": js.text(one_of=["task_type", "text_prefix"]),
            "documentPrefix": js.text(most=120), "queryPrefix": js.text(most=120), "similarityMetric": _only("cosine"), "chunkTargetTokens": js.whole(64, 4096),
            "retrievalTopK": js.whole(1, 100), "neighborWindow": js.whole(0, 5), "batchSize": js.whole(1, 100), "concurrency": js.whole(1, 20), "requestTimeoutMs": _TIMEOUT,
        },
        strict=True, rules={"prefixStrategy": _prefixes_fit},
    ),
    "question_generation": js.fields(
        {
            "provider": _only("gemini"), "model": _MODEL, "directionMaxOutputTokens": js.whole(512, 16_384), "questionMaxOutputTokens": js.whole(4096, 65_536),
            "thinkingLevel": js.text(one_of=THINKING), "structuredOutput": js.flag(True), "responseMimeType": _only("application/json"), "concurrency": js.whole(1, 20), "requestTimeoutMs": _TIMEOUT,
        },
        strict=True,
    ),
    "benchmark_models": js.fields(
        {
            "models": js.items(
                js.by_field(
                    "providerKey",
                    {
                        key: js.fields(
                            {
                                "providerKey": js.text(), "protocol": _only(protocol), "displayName": js.text(1, 80, trim=True), "enabled": js.flag(), "modelId": _MODEL,
                                "concurrency": js.whole(1, 50), "requestIntervalMs": js.whole(0, 60_000), "requestTimeoutMs": _TIMEOUT, "generation": _GENERATION,
                            },
                            strict=True,
                        )
                        for key, protocol in PROTOCOLS.items()
                    },
                ),
                3, 4,
            ),
        },
        strict=True, rules={"models": _providers_once},
    ),
}
CONFIG_KINDS = list(_SETTINGS)
CONFIG = js.by_field(
    "kind",
    {
        kind: js.fields(
            {
                "schemaVersion": js.whole(1, 1), "kind": js.text(), "version": js.text(3, 100, "^[a-z0-9][a-z0-9._-]*$", trim=True), "title": js.text(2, 120, trim=True),
                "description": _ABOUT, "applyScope": _ABOUT, "reprocessingImpact": _ABOUT, "settings": settings,
            },
            strict=True,
        )
        for kind, settings in _SETTINGS.items()
    },
)
