"""Scoring: required metrics, judge answers, completeness, terminal failures, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.json_schema import let
from lectern.functions.scalars import answer_flat, converted, token_cost
from lectern.operators.relational import price_by_pattern

#: Metric keys of the prerequisite type, and the metric no longer in use.
PREREQUISITE_METRICS = [
    "target_concept_correctness",
    "prerequisite_identification",
    "prerequisite_relation_accuracy",
    "prerequisite_application",
    "reasoning_chain_completeness",
    "textbook_grounding",
]
RETIRED_METRICS = ["exact_match"]


def required_metrics(profile: Column, question_type: Column) -> Column:
    """Metrics a response needs, each once, in order of first mention."""
    own = F.filter(F.coalesce(profile, F.array().cast("array<string>")), lambda m: ~m.isin(*RETIRED_METRICS))
    more = F.when(question_type == "PREREQUISITE_RELATIONSHIP", F.array(*map(F.lit, PREREQUISITE_METRICS))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("response_present")), own, more))


def response_present(text: Column) -> Column:
    """1 if something is left of the normalised answer (NFC, as it makes nothing empty, is left out)."""
    return (F.length(answer_flat(F.coalesce(text, F.lit("")))) > 0).cast("int")


#: What stands for a label and a rationale that are missing.
NO_LABEL, NO_RATIONALE = "SCORED", "채점 모델이 설명을 생략했습니다."


def parse_judge(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Scores parsed from judge answers, with ``reject`` saying why an answer does not count.

    The JSON is what stands between the first { and the last }. Numeric texts are numbers,
    blank ones are not; values must lie in 0..1; a metric may occur once. Evidence is a list
    of claims, quotes and chunk ids; a bare text is a claim, anything else is left out.
    """
    v = F.try_parse_json(F.regexp_extract(F.col(raw), r"(?s)(\{.*\})", 1))
    array_of = lambda c, path: F.when(F.schema_of_variant(F.try_variant_get(c, path, "variant")).startswith("ARRAY"), F.try_variant_get(c, path, "array<variant>"))
    text_at = lambda c, path: F.when(F.schema_of_variant(F.try_variant_get(c, path, "variant")) == "STRING", F.try_variant_get(c, path, "string"))
    told = lambda c, path: F.nullif(F.trim(text_at(c, path)), F.lit(""))
    is_text = lambda c: F.schema_of_variant(c) == "STRING"
    evidence = lambda s: F.filter(
        F.transform(
            F.coalesce(array_of(s, "$.evidence"), F.array().cast("array<variant>")),
            lambda e: F.struct(F.when(is_text(e), F.nullif(F.trim(e.cast("string")), F.lit(""))).otherwise(told(e, "$.claim")).alias("claim"), told(e, "$.quote").alias("quote"), told(e, "$.chunkId").alias("chunkId")),
        ),
        lambda e: e.claim.isNotNull() | e.quote.isNotNull() | e.chunkId.isNotNull(),
    )
    score = lambda s: F.struct(
        text_at(s, "$.metricKey").alias("metric_key"), _number(F.try_variant_get(s, "$.value", "variant")).alias("value"),
        F.coalesce(told(s, "$.label"), F.lit(NO_LABEL)).alias("label"), F.coalesce(told(s, "$.rationale"), F.lit(NO_RATIONALE)).alias("rationale"), evidence(s).alias("evidence"),
    )

    def judged(scores: Column) -> Column:
        keys = F.transform(scores, lambda s: s.metric_key)
        reject = (
            F.when(scores.isNull(), "NOT_JSON")
            .when(F.exists(scores, lambda s: s.metric_key.isNull()), "NO_METRIC")
            .when(F.exists(scores, lambda s: s.value.isNull() | (s.value < 0) | (s.value > 1)), "VALUE_OUT_OF_RANGE")
            .when(F.size(F.array_distinct(keys)) < F.size(keys), "DUPLICATE_METRIC")
        )
        return F.struct(scores.alias("scores"), reject.alias("reject"))

    # each step once, whatever becomes of the columns: filters on them repeat this expression
    told_all = let(let(v, lambda x: array_of(x, "$.scores")), lambda own: let(F.transform(own, score), judged))
    return answers.withColumn("__j", told_all).withColumns({"scores": F.col("__j.scores"), "reject": F.col("__j.reject")}).drop("__j")


def _number(value: Column) -> Column:
    """A JSON number, or a text that spells one."""
    kind, text = F.schema_of_variant(value), F.trim(value.cast("string"))
    spelled = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | ((kind == "STRING") & spelled), text.try_cast("double"))


def metric_matches(asked: Column, answered: Column) -> tuple[Column, Column]:
    """(resolved, missing) metric keys of a judge call."""
    return F.array_intersect(asked, answered), F.array_except(asked, answered)


def terminal_metrics(calls: DataFrame, chargeable: int = 3) -> DataFrame:
    """Metrics given up for a response: the latest call of the logical key failed, and so did enough chargeable ones.

    Calls: response_id, logical_key, state, error_code, metrics array, attempt, created_at, id.
    """
    w = Window.partitionBy("response_id", "logical_key").orderBy(F.desc("attempt"), F.desc("created_at"), F.desc("id"))
    failed = F.col("state") == "FAILED"
    seen = calls.withColumn("__rn", F.row_number().over(w)).groupBy("response_id", "logical_key").agg(
        F.max(F.when(F.col("__rn") == 1, F.col("state"))).alias("last"),
        F.count_if(failed & ~F.coalesce(F.col("error_code") == "RATE_LIMIT", F.lit(False))).alias("charged"),
        F.max_by("metrics", -F.col("__rn")).alias("metrics"),
    )
    done = seen.where((F.col("last") == "FAILED") & (F.col("charged") >= chargeable))
    return done.select("response_id", F.explode("metrics").alias("metric_key")).distinct()


def response_costs(responses: DataFrame, prices: DataFrame) -> DataFrame:
    """Native and converted cost of each response by the newest fitting price."""
    priced = price_by_pattern(responses, prices)
    native = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"))
    return priced.withColumn("cost_native", native).withColumn("cost_krw", converted(native, F.col("rate")))


def incomplete_runs(pairs: DataFrame, key: str) -> DataFrame:
    """Runs whose stored (response, metric) pairs differ from those expected."""
    return pairs.groupBy(key).agg(
        F.count_distinct(F.struct("response_id", "metric_key")).alias("expected"),
        F.count_distinct(F.when(F.col("value").isNotNull(), F.struct("response_id", "metric_key"))).alias("stored"),
    ).withColumn("complete", F.col("expected") == F.col("stored"))


def with_metric_names(scores: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Label, category and method of each metric; unknown keys name themselves."""
    out = scores.join(dictionary, "metric_key", "left")
    return out.withColumns({"label": F.coalesce("label", "metric_key"), "category": F.coalesce("category", F.lit("custom"))})
