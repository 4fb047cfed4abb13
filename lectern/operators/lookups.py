"""Joins by pinned, JSON, polymorphic and alternative keys; pivots and small summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import numbered


def pinned_revisions(links: DataFrame, revisions: DataFrame) -> DataFrame:
    """Links with the content of exactly the revision they were made with."""
    return links.join(revisions, ["question_id", "revision"])


def join_by_json_key(jobs: DataFrame, sources: DataFrame, payload: str, path: str, key: str) -> DataFrame:
    """Jobs with the row that their JSON payload points to."""
    return jobs.withColumn("__k", F.get_json_object(payload, path)).join(sources, F.col("__k") == F.col(key).cast("string"), "left").drop("__k")


def resolve_polymorphic(events: DataFrame, targets: dict[str, tuple[DataFrame, str, str]], kind: str = "resolved_type", ref: str = "resolved_id") -> DataFrame:
    """Name of each event's target, whose table depends on its type: type -> (table, key, name)."""
    out = events
    for value, (table, key, name) in targets.items():
        t = table.select(F.col(key).alias(f"__k_{value}"), F.col(name).alias(f"__n_{value}"))
        out = out.join(t, (F.col(kind) == value) & (F.col(ref) == F.col(f"__k_{value}")), "left").drop(f"__k_{value}")
    names = [f"__n_{v}" for v in targets]
    return out.withColumn("target_name", F.coalesce(*names)).drop(*names)


def needed_providers(models: DataFrame, runs: DataFrame, embedding: str = "gemini") -> DataFrame:
    """(run_id, provider_key) a run needs: its models', the embedder's for vector modes, the judge's."""
    vector = runs.where(F.arrays_overlap("retrieval_modes", F.array(F.lit("VECTOR"), F.lit("PIKE"))))
    parts = [
        models.select("run_id", "provider_key"),
        vector.select("run_id", F.lit(embedding).alias("provider_key")),
        runs.where("judge_provider is not null").select("run_id", F.col("judge_provider").alias("provider_key")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def not_blocked(items: DataFrame, blocked: DataFrame, embedding: str = "gemini") -> DataFrame:
    """Items that no cooldown stops: neither their provider's nor, for VECTOR, the embedder's.

    The two alternatives of the condition become two keyed anti joins instead of one loop join.
    """
    own = items.join(blocked.select("provider_key"), "provider_key", "left_anti")
    stopped = blocked.where(F.col("provider_key") == embedding).select(F.lit("VECTOR").alias("mode")).distinct()
    return own.join(F.broadcast(stopped), "mode", "left_anti")


def with_parent(versions: DataFrame, key: str = "id", parent: str = "parent_id", shown: str = "version") -> DataFrame:
    p = versions.select(F.col(key).alias("__p"), F.col(shown).alias(f"parent_{shown}"))
    return versions.join(p, F.col(parent) == F.col("__p"), "left").drop("__p")


def conditional_max(df: DataFrame, keys: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """One column per kind with its greatest value: a pivot with known columns."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(k.lower()) for k in kinds])


def state_counts(df: DataFrame, keys: list[str], states: list[str], state: str = "state") -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(state) == s).alias(s.lower()) for s in states])


def lease_recovery(items: DataFrame, as_of: str, most_attempts: int) -> DataFrame:
    """Per run: items whose lease ran out, and those of them that may not be tried again."""
    late = (F.col("state") == "LEASED") & (F.col("lease_until") < F.lit(as_of).cast("timestamp"))
    return items.where(late).groupBy("run_id").agg(F.count(F.lit(1)).alias("recovered"), F.count_if(F.col("attempts") >= most_attempts).alias("terminal"))


def selected_totals(stats: DataFrame, modes: list[str], sums: list[str]) -> DataFrame:
    return stats.where(F.col("mode").isin(*modes)).agg(*[F.sum(c).alias(c) for c in sums])


def json_merged(base: Column, changes: Column, without: list[str] = ()) -> Column:
    """JSON object with the keys of both (those of ``changes`` win), minus some keys; values as texts."""
    m = "map<string,string>"
    merged = F.map_filter(F.from_json(base, m), lambda k, v: ~F.array_contains(F.map_keys(F.from_json(changes, m)), k))
    both = F.map_concat(merged, F.from_json(changes, m))
    kept = F.map_filter(both, lambda k, v: ~k.isin(*without)) if without else both
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def collated(df: DataFrame, by: str, locale: str = "ko") -> DataFrame:
    """Rows numbered in the collation order of a locale, ties by code points."""
    return numbered(df, [F.asc(F.collate(F.col(by), locale)), F.asc(by)])
