"""Run details, progress, failures, dashboard and scoreboard. These read all eligible responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED = ("FAILED", "TERMINAL_FAILED")


def execution_stats(items: DataFrame, keys: list[str], failed: tuple[str, ...] = FAILED) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "SUCCEEDED").alias("succeeded"),
        F.count_if(F.col("state").isin(*failed)).alias("failed"),
    )


def response_sums(responses: DataFrame, keys: list[str]) -> DataFrame:
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("cost").alias("cost"),
    )


def failure_groups(items: DataFrame, keys: list[str], code: str, message: str, at: str, key: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Failures by code with count, latest time and the latest message."""
    coded = items.withColumn("error_code", F.coalesce(F.nullif(F.trim(F.col(code)), F.lit("")), F.lit(unknown)))
    return coded.groupBy(*keys, "error_code").agg(
        F.max_by(message, F.struct(at, key)).alias("message"), F.count(F.lit(1)).alias("failures"), F.max(at).alias("latest")
    )


def representative_failure(groups: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("failures"), F.desc("latest"), "error_code")
    return groups.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def capability_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def dashboard_models(models: DataFrame, items: DataFrame, responses: DataFrame) -> DataFrame:
    """Per model with the fan-out of the joins kept; tokens are NULL if either sum is."""
    joined = models.join(items, "run_model_id", "left").join(responses, "run_item_id", "left")
    return joined.groupBy("run_model_id").agg(
        F.count("run_item_id").alias("items"),
        F.count_if(F.col("state") == "TERMINAL_FAILED").alias("failed"),
        F.count("response_id").alias("responses"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("tokens"),
    )


def scoreboard(scores: DataFrame, eligible: DataFrame, run: str = "run_id", limit: int | None = None) -> DataFrame:
    """Mean and count by run, model and metric, the model's eligible responses, and the row total."""
    counts = eligible.groupBy(run, "blind_id").agg(F.count(F.lit(1)).alias("eligible"))
    rows = scores.groupBy(run, "blind_id", "metric_key").agg(F.avg("value").alias("mean"), F.count("value").alias("scored"))
    out = rows.join(counts, [run, "blind_id"], "left")
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.orderBy(run, "blind_id", "metric_key").limit(limit) if limit else out


def required_pairs(responses: DataFrame, scores: DataFrame, required: Column) -> DataFrame:
    """Per response: metrics it needs, and how many of them have a score."""
    need = responses.select("response_id", F.explode(F.array_distinct(required)).alias("metric_key"))
    have = scores.where("value is not null").select("response_id", "metric_key").distinct().withColumn("scored", F.lit(True))
    return (
        need.join(have, ["response_id", "metric_key"], "left")
        .groupBy("response_id")
        .agg(F.count("metric_key").alias("required"), F.count("scored").alias("scored"))
    )


def run_progress(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state").isin("SUCCEEDED", *FAILED)).alias("finished"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"),
        F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"),
    )


def item_summary(items: DataFrame, key: str) -> DataFrame:
    """State counts of a batch's items and its errors in item order."""
    failed = F.col("state") == "FAILED"
    return items.groupBy(key).agg(
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("PENDING", "RUNNING", "COMPLETED", "FAILED")],
        F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("ordinal", "error")))), lambda x: x.error).alias("errors"),
        (F.count_if(F.col("state") != "COMPLETED") == 0).alias("all_completed"),
    )


def stage_counts(counts: DataFrame, stages: list[str]) -> DataFrame:
    """Counts by stage in a fixed order; stages without rows count 0."""
    dim = counts.sparkSession.createDataFrame([(k, s) for k, s in enumerate(stages)], "position int, stage string")
    return F.broadcast(dim).join(counts, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def evidence_report(scores: DataFrame, top: int = 3, small: int = 30) -> DataFrame:
    """Mean per model, mode and metric; the best ``top`` per metric; few responses are flagged."""
    means = scores.groupBy("metric_key", "blind_id", "mode").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    w = Window.partitionBy("metric_key").orderBy(F.desc_nulls_last("mean"), "blind_id", "mode")
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("small_sample", F.col("n") < small)
