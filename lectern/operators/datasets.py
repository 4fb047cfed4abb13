"""Datasets: freezing question sets into versions, run matrices, audit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns in the order in which each way of publishing hashes them.
SET_FIELDS = ["ordinal", "question_id", "question_revision", "status"]
DATASET_FIELDS = ["question_id", "current_revision"]


def content_hash(rows: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """sha256 of the rows' JSON per key, rows in order, columns as listed.

    A version's rows meet in one group, as its hash is over all of them in order.
    """
    one = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    lined = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), one.alias("j")))).alias("__r"))
    return lined.select(key, F.sha2(F.concat(F.lit("["), F.array_join(F.transform("__r", lambda r: r.j), ","), F.lit("]")), 256).alias("content_hash"), F.size("__r").alias("questions"))


def distributions(rows: DataFrame, key: str, facets: list[str]) -> DataFrame:
    """Counts by value of each facet, long."""
    long = rows.unpivot([key], facets, "facet", "value")
    return long.groupBy(key, "facet", "value").agg(F.count(F.lit(1)).alias("n"))


def with_evidence(questions: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with their evidence in order; an empty list where there is none."""
    lists = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "quote"))).alias("evidence"))
    return questions.join(lists, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(lists.schema["evidence"].dataType)))


def score_maps(scores: DataFrame, key: str) -> DataFrame:
    """metric -> (value, label) maps."""
    return scores.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_key", F.struct("value", "label").alias("score"))))).alias("scores"))


def run_matrix(questions: DataFrame, models: DataFrame, modes: DataFrame) -> DataFrame:
    """Every question x model x mode; models get blind ids M01, M02, ... in their order.

    Models and modes are a handful by contract (at most 12 and 3), so they are broadcast.
    """
    blind = F.concat(F.lit("M"), F.lpad(F.row_number().over(Window.orderBy("position")).cast("string"), 2, "0"))
    lanes = models.withColumn("blind_id", blind).crossJoin(modes)
    if models.limit(13).count() > 12:
        raise ValueError("a run takes at most 12 models")
    return questions.crossJoin(F.broadcast(lanes))


def audit_list(questions: DataFrame, query: str | None, fields: list[Column], facets: dict[str, str | None]) -> DataFrame:
    from lectern.operators.relational import optional_filters, text_search

    out = optional_filters(questions, **facets)
    return text_search(out, query, fields) if query and query.strip() else out


def flags(sources: DataFrame) -> DataFrame:
    """Derived flags: what needs reprocessing, and whose revision moved on."""
    return sources.withColumns(
        {
            "reprocess_required": ~F.coalesce((F.col("parse_hash") == F.col("active_parse_hash")) & (F.col("embed_hash") == F.col("active_embed_hash")), F.lit(False)),
            "revision_drift": F.col("revision") != F.col("current_revision"),
        }
    )


def expanded_items(batches: DataFrame, count: str = "requested") -> DataFrame:
    """One row per requested question, numbered from 1; task types go round."""
    return batches.where(F.col(count) > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.col(count))))


#: Task types in turn.
TASKS = ["dependency_application", "missing_prerequisite_diagnosis", "cross_unit_transfer", "relation_direction_discrimination", "prerequisite_chain_completion"]


def task_of(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TASKS)), F.pmod(F.greatest(F.lit(1), ordinal) - 1, F.lit(len(TASKS))).cast("int") + 1)


def cycled(units: Column, ordinal: Column, pair: bool = False) -> Column:
    """Units of an item: the next in turn, and with ``pair`` the one after it as well."""
    at = lambda k: F.element_at(units, F.pmod(ordinal - 1 + k, F.size(units)).cast("int") + 1)
    return F.array_distinct(F.array(at(0), at(1))) if pair else F.array(at(0))


def rewritten(items: Column, wanted: Column, change) -> Column:
    """An array with the elements equal to ``wanted`` changed, order kept."""
    return F.transform(items, lambda x: F.when(x == wanted, change(x)).otherwise(x))


def backfilled(child: DataFrame, parent: DataFrame, key: str, column: str) -> DataFrame:
    p = parent.select(F.col(key), F.col(column).alias("__v"))
    return child.join(p, key, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v")
