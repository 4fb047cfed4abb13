"""Result analytics of a run: metric means, weighted composites, purposes, distributions, heatmap.

Score rows have blind_id, mode, purpose, question_id, metric_key, value DECIMAL(10,6). Means
are rounded to 6 places, and composites are made from the rounded means, then rounded again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import exact_mean, half_up6, histogram_bin
from lectern.operators.relational import densify, latest_attempt

SERIES = ["blind_id", "mode"]


def score_base(items: DataFrame, models: DataFrame, questions: DataFrame, responses: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the latest eligible response of each item, with model and question."""
    last = latest_attempt(responses).select("run_item_id", F.col("id").alias("response_id"))
    return (
        items.join(last, items["id"] == last["run_item_id"])
        .join(models.select(F.col("id").alias("run_model_id"), "blind_id"), "run_model_id")
        .join(questions.select(F.col("id").alias("question_id"), "purpose"), "question_id")
        .join(scores.select("response_id", "metric_key", "value"), "response_id")
        .select("blind_id", "mode", "purpose", "question_id", "metric_key", "value")
    )


def scoped(base: DataFrame) -> DataFrame:
    """Sums and counts by metric for the whole run (scope NULL) and for each purpose: one pass."""
    return (
        base.groupingSets([["blind_id", "mode", "metric_key", "purpose"], ["blind_id", "mode", "metric_key"]], "blind_id", "mode", "metric_key", "purpose")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.grouping("purpose").alias("overall"))
        .withColumn("scope", F.when(F.col("overall") == 0, F.col("purpose")))
        .drop("purpose")
    )


def metric_means(base: DataFrame) -> DataFrame:
    """scope, overall, blind_id, mode, metric_key, mean DECIMAL(12,6), n."""
    return scoped(base).select(
        "scope", "overall", *SERIES, "metric_key", half_up6(F.col("total").cast("double") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"), "n"
    )


def composites(means: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean of rounded metric means; only positive weights count, exact_match never."""
    w = weight.cast("decimal(12,6)")
    counts = (F.col("metric_key") != "exact_match") & (w > 0) & F.col("mean").isNotNull()
    num, den = F.sum(F.when(counts, F.col("mean") * w)), F.sum(F.when(counts, w))
    return means.groupBy("scope", "overall", *SERIES).agg(
        half_up6(F.try_divide(num.cast("double"), den.cast("double"))).alias("composite"),
        F.coalesce(F.sum(F.when(counts, F.col("n"))), F.lit(0)).alias("n"),
    )


def purpose_means(base: DataFrame, metric: str = "accuracy") -> DataFrame:
    own = base.where(F.col("metric_key") == metric).groupBy(*SERIES, "purpose")
    return own.agg(half_up6(exact_mean(F.col("value"))).alias("mean"), F.count("value").alias("n"))


def distribution(base: DataFrame, metric: str, bins: int = 5) -> DataFrame:
    """Counts of a metric's scores per bin, by scope and series; NULL and NaN are in no bin."""
    own = base.where(F.col("metric_key") == metric).withColumn("bin", histogram_bin(F.col("value"), bins))
    counts = [F.count_if(F.col("bin") == k).alias(f"bin{k}") for k in range(bins)]
    return (
        own.groupingSets([[*SERIES, "purpose"], SERIES], *SERIES, "purpose")
        .agg(*counts, F.grouping("purpose").alias("overall"))
        .withColumn("scope", F.when(F.col("overall") == 0, F.col("purpose")))
        .drop("purpose")
    )


def tagged_rows(base: DataFrame, weight: Column, metric: str, bins: int = 5) -> DataFrame:
    """All parts as one long result: kind, scope, series, key, value, n.

    The scores are read and grouped once: sums, counts and histogram counts by metric, series
    and scope. A second, small grouping makes the composites, and each group gives its rows.
    """
    hit = histogram_bin(F.col("value"), bins)
    groups = (
        base.groupingSets([["blind_id", "mode", "metric_key", "purpose"], ["blind_id", "mode", "metric_key"]], "blind_id", "mode", "metric_key", "purpose")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.grouping("purpose").alias("overall"), *[F.count_if(hit == k).alias(f"bin{k}") for k in range(bins)])
        .withColumn("scope", F.when(F.col("overall") == 0, F.col("purpose")))
    )
    mean = half_up6(F.col("total").cast("double") / F.when(F.col("n") > 0, F.col("n")))
    w = weight.cast("decimal(12,6)")
    each = groups.select("scope", "overall", *SERIES, "metric_key", "n", mean.alias("mean"), w.alias("w"), F.array(*[F.col(f"bin{k}") for k in range(bins)]).alias("bins"))
    by = Window.partitionBy("scope", "overall", *SERIES)
    counts = (F.col("metric_key") != "exact_match") & (F.col("w") > 0) & F.col("mean").isNotNull()
    composite = half_up6(F.try_divide(F.sum(F.when(counts, F.col("mean") * F.col("w"))).over(by).cast("double"), F.sum(F.when(counts, F.col("w"))).over(by).cast("double")))
    told = each.withColumns({
        "composite": composite, "n_composite": F.coalesce(F.sum(F.when(counts, F.col("n"))).over(by), F.lit(0)),
        "first": F.row_number().over(by.orderBy("metric_key")) == 1,
    })
    nothing = F.lit(None).cast("decimal(12,6)")
    row = lambda kind, key, value, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), n.alias("n"))
    own = F.col("metric_key") == metric
    rows = F.concat(
        F.array(row("METRIC", F.col("metric_key"), F.col("mean"), F.col("n"))),
        F.when(F.col("first"), F.array(row("MODEL", F.lit("composite"), F.col("composite"), F.col("n_composite")))).otherwise(F.array()),
        F.when(own & (F.col("overall") == 0), F.array(row("PURPOSE", F.lit(metric), F.col("mean"), F.col("n")))).otherwise(F.array()),
        F.when(own, F.array(*[row("DISTRIBUTION", F.lit(f"bin{k}"), nothing, F.col("bins")[k]) for k in range(bins)])).otherwise(F.array()),
    )
    return told.select("scope", *SERIES, F.explode(rows).alias("r")).select("r.kind", "scope", *SERIES, "r.key", "r.value", "r.n")


def in_display_order(rows: DataFrame) -> DataFrame:
    kind = F.expr("CASE kind WHEN 'METRIC' THEN 1 WHEN 'PURPOSE' THEN 2 WHEN 'MODEL' THEN 3 ELSE 4 END")
    return rows.orderBy(F.asc_nulls_first("scope"), kind, "key", *SERIES)


def series_maps(means: DataFrame) -> DataFrame:
    """One row per scope and metric with a map series -> mean; the series is blind_id::mode."""
    series = F.concat_ws("::", *SERIES)
    return means.groupBy("scope", "metric_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(series.alias("series"), "mean")))).alias("by_series")
    )


def model_stats(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Responses, mean latency and summed cost by model and mode (and purpose)."""
    return responses.groupBy(*keys).agg(
        F.count("response_id").alias("responses"), F.avg("latency_ms").alias("avg_latency_ms"), F.sum("cost").alias("cost")
    )


def dense_model_stats(stats: DataFrame) -> DataFrame:
    """Every purpose x model x mode; combinations without responses count 0 and have no mean."""
    return densify(stats, [["purpose"], ["blind_id"], ["mode"]], {"responses": 0})


def heatmap(base: DataFrame, metric: str, page: int = 1, size: int = 25, most: int = 100) -> DataFrame:
    """Cells of a page of questions; the total is that of all questions, even past the end.

    Paging is over distinct questions first, so only their scores are read for cells.
    """
    page, size = max(1, page), min(max(1, size), most)
    asked = base.select("question_id").distinct()
    rows = asked.orderBy("question_id").offset((page - 1) * size).limit(size)
    cells = (
        base.where((F.col("metric_key") == metric) & F.col("value").isNotNull())
        .join(F.broadcast(rows), "question_id", "left_semi")
        .groupBy("question_id", *SERIES)
        .agg(half_up6(exact_mean(F.col("value"))).alias("value"))
    )
    filled = rows.join(cells, "question_id", "left")
    return asked.agg(F.count(F.lit(1)).alias("total")).join(filled, F.lit(True), "left")


def ranked_series(summary: DataFrame, modes: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Chosen series by falling composite (NULL last), with the composite in percent for charts.

    A summary has a row per model and mode, a few dozen at most, so one window ranks them all.
    """
    for name, wanted in (("mode", modes), ("blind_id", models)):
        if wanted:
            summary = summary.where(F.col(name).isin(wanted))
    w = Window.orderBy(F.desc_nulls_last("composite"), *SERIES)
    return summary.select(*SERIES, "composite", (F.col("composite") * 100).alias("percent"), F.row_number().over(w).alias("rank"))
