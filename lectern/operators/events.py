"""Events of jobs and runs: classification, feeds, active operations, failures, cooldowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import json_text

#: Stage by the beginning of an event type; the first that fits decides.
STAGES = [
    ("^(RUN_SCORING|SCORE_|JUDGE_)", "SCORING"),
    ("^(DOCUMENT_|PIPELINE_)", "PARSING"),
    ("^(CHUNKING_|TABLE_OF_CONTENTS_)", "CHUNKING"),
    ("^(GEMINI_EMBEDDING_|EMBEDDING_)", "EMBEDDING"),
    ("^QUESTION_DIRECTION_", "DIRECTION"),
    ("^(QUESTION_RETRIEVAL_|RETRIEVAL_)", "RETRIEVAL"),
    ("^(QUESTION_GENERATION_|GENERATION_)", "QUESTION_GENERATION"),
    ("^RUN_", "BENCHMARK"),
    ("^JOB_", "QUEUE"),
]
#: State by the end of an event type; the first that fits decides.
STATES = [
    ("^JOB_RELEASED_ON_SHUTDOWN$", "RETRY_WAIT"),
    ("(FAILED|FAILURE|TERMINAL_FAILED|ERROR)$", "FAILED"),
    ("(CANCELLED|STOPPED)$", "CANCELLED"),
    ("PAUSED$", "PAUSED"),
    ("(RETRY|RETRIED|RETRY_SCHEDULED)$", "RETRY_WAIT"),
    ("(COMPLETED|SUCCEEDED|PERSISTED|VERIFIED|ALIGNED|EXTRACTED|RENDERED)$", "SUCCEEDED"),
    ("(STARTED|CLAIMED|REQUESTED|RECEIVED)$", "RUNNING"),
    ("(ENQUEUED|QUEUED|CREATED)$", "PENDING"),
]


def _first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(c.rlike(rules[0][0]), rules[0][1])
    for pattern, value in rules[1:]:
        out = out.when(c.rlike(pattern), value)
    return out


def event_stage(kind: Column) -> Column:
    return _first_match(kind, STAGES).otherwise(F.when(kind.isNotNull(), "SYSTEM"))


def event_state(kind: Column, payload: Column | None = None) -> Column:
    """State by the type's name; else the payload's own state, if it is a text; else INFO."""
    own = json_text(payload, "state") if payload is not None else F.lit(None).cast("string")
    return _first_match(kind, STATES).otherwise(F.when(kind.isNotNull(), F.coalesce(own, F.lit("INFO"))))


def event_label(kind: Column) -> Column:
    return F.initcap(F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))


def event_summary(kind: Column, payload: Column, label: Column) -> Column:
    """The payload's message, else the type in words, behind the aggregate's label if there is one."""
    message = F.trim(json_text(payload, "message"))
    detail = F.coalesce(F.nullif(message, F.lit("")), event_label(kind))
    return F.when(F.coalesce(label, F.lit("")) == "", detail).otherwise(F.concat(label, F.lit(" · "), detail))


def after_cursor(events: DataFrame, cursor: int, limit: int = 200, own: DataFrame | None = None) -> DataFrame:
    """Events after a cursor in cursor order; ``own`` (aggregate ids) narrows them."""
    out = events.where(F.col("event_id") > cursor)
    if own is not None:
        out = out.join(own.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
    return out.orderBy("event_id").limit(limit)


def latest_per_job(events: DataFrame, job: str = "job_id", skip: str = r"JOB\_%") -> DataFrame:
    """Latest event of each job, queue bookkeeping left out. The pattern's underscore is literal."""
    own = events.where(~F.col("event_type").like(skip))
    return own.groupBy(job).agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.max_by("ts", "event_id").alias("ts"))


def active_operations(jobs: DataFrame, runs: DataFrame, key: str = "aggregate_id") -> DataFrame:
    """Jobs first, then runs that no job stands for, newest first."""
    both = jobs.withColumn("priority", F.lit(0)).unionByName(runs.withColumn("priority", F.lit(1)))
    w = Window.partitionBy(key).orderBy("priority", F.desc("at"), "id")
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn").orderBy(F.desc("at"), "id")


def stale_leases(jobs: DataFrame, as_of: str) -> DataFrame:
    """Leased jobs whose lease has no end or ended before ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    return jobs.withColumn("stale", (F.col("state") == "LEASED") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)))


def queue_counters(jobs: DataFrame, as_of: str) -> DataFrame:
    j = stale_leases(jobs, as_of)
    return j.agg(
        F.count_if(F.col("state") == "QUEUED").alias("queued"), F.count_if(F.col("state") == "LEASED").alias("leased"),
        F.count_if("stale").alias("stale"), F.count_if(F.col("state") == "FAILED").alias("failed"),
    )


def failure_feed(branches: dict[str, DataFrame]) -> DataFrame:
    """Failures of several tables (id, code, message, at) as one feed, tagged by their stage."""
    parts = [df.select("id", "code", "message", "at").withColumn("stage", F.lit(s)) for s, df in branches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failures_by_stage(feed: DataFrame) -> DataFrame:
    """Count and latest failure per canonical stage and code, with the code counts as a map."""
    g = feed.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("latest"))
    return g.groupBy("stage").agg(
        F.sum("n").alias("failures"), F.max("latest").alias("latest"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("by_code"),
    )


def once_only(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Events to append: first of their key in the batch, and not there yet."""
    w = Window.partitionBy(*keys).orderBy("event_id")
    first = incoming.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return first.join(existing.select(*keys), keys, "left_anti")


def fan_out(provider_events: DataFrame, lanes: DataFrame) -> DataFrame:
    """A provider's event for every run that has a lane with it."""
    return provider_events.join(lanes.select("provider_key", "run_id").distinct(), "provider_key")


#: Waits in ms after daily and other limits, the longest that is believed, and the
#: rank of limits.
DAY_WAIT, WAIT, LONGEST_WAIT = 900_000, 120_000, 604_800_000
DIMENSIONS = ["UNKNOWN", "RPM", "TPM", "RPD"]


def cooldown_ms(explicit: Column, dimension: Column) -> Column:
    """Given wait, else one by the exhausted dimension; never beyond the cap."""
    own = F.when((explicit > 0) & ~F.isnan(explicit.cast("double")), F.least(explicit.cast("long"), F.lit(LONGEST_WAIT)))
    return F.coalesce(own, F.when(dimension == "RPD", DAY_WAIT).otherwise(WAIT)).cast("long")


def rate_dimension(text: Column) -> Column:
    """The exhausted limit that a provider's text speaks of."""
    minute = text.rlike(r"(?i)per[\s._/-]*minute|\bminutely\b")
    return (
        F.when(text.rlike(r"(?i)\brpd\b|per[\s._/-]*day|\bdaily\b"), "RPD")
        .when(minute & text.rlike(r"(?i)\btpm\b|tokens?"), "TPM")
        .when(text.rlike(r"(?i)\brpm\b") | (minute & text.rlike("(?i)requests?")), "RPM")
        .otherwise("UNKNOWN")
    )


def header_wait_ms(header: Column, now: Column) -> Column:
    """Wait of a retry-after header, in seconds or as a date."""
    date = F.coalesce(F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(header))
    wait = F.when(header.rlike(r"^\d+$"), F.coalesce(header.try_cast("decimal(20,0)").cast("double") * 1000, F.lit(float(LONGEST_WAIT)))).otherwise(
        F.when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_millis(date) - F.unix_millis(now)).cast("double")))
    )
    return F.when(wait.isNotNull(), F.least(wait, F.lit(float(LONGEST_WAIT)))).cast("long")


_ERROR = "struct<error:struct<details:array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string,quotaMetric:string,description:string>>>>>>"


def quota_error(body: Column) -> Column:
    """struct<wait_ms, dimension, scope> of a provider's JSON error: its longest retry delay, and
    the first of the quota violations with the highest rank."""
    details = F.coalesce(F.from_json(body, _ERROR)["error"]["details"], F.array().cast("array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string,quotaMetric:string,description:string>>>>"))
    delays = F.transform(
        F.filter(details, lambda d: d["@type"].endswith("google.rpc.RetryInfo") & d["retryDelay"].rlike(r"^\d+(\.\d{1,9})?s$")),
        lambda d: F.least(F.ceil(F.regexp_replace(d["retryDelay"], "s$", "").cast("double") * 1000), F.lit(LONGEST_WAIT)).cast("long"),
    )
    quotas = F.flatten(F.transform(F.filter(details, lambda d: d["@type"].endswith("google.rpc.QuotaFailure") & d["violations"].isNotNull()), lambda d: d["violations"]))
    texts = F.transform(quotas, lambda v: F.filter(F.array(v["quotaId"], v["quotaMetric"], v["description"]), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
    said = F.transform(F.filter(texts, lambda x: F.size(x) > 0), lambda x: F.struct(rate_dimension(F.array_join(x, " ")).alias("dimension"), x[0].alias("scope")))
    rank = lambda d: F.array_position(F.array(*map(F.lit, DIMENSIONS)), d)
    best = F.array_max(F.transform(said, lambda x: rank(x["dimension"])))
    first = F.get(F.filter(said, lambda x: rank(x["dimension"]) == best), F.lit(0))
    return F.struct(F.array_max(delays).alias("wait_ms"), F.coalesce(first["dimension"], F.lit("UNKNOWN")).alias("dimension"), first["scope"].alias("scope"))


#: What of a retrieved chunk may be shown.
CHUNK_KEYS = ["chunkId", "rank", "page", "unit", "source", "similarity", "semanticRank", "anchorChunkId"]


def shown_payload(aggregate: Column, kind: Column, payload: Column) -> Column:
    """Payload (JSON) that may leave the engine: of a generation's finished retrieval only what is listed here."""
    names = ("ordinal", "attempt", "queryText", "chunkCount", "queryVector", "retrievalConfig", "chunks", "selectedChunks", "selectedChunkIds")
    p = F.from_json(payload, ", ".join(f"{k} variant" for k in names))
    array_of = lambda c: F.when(F.schema_of_variant(c).startswith("ARRAY"), F.try_variant_get(c, "$", "array<variant>"))
    text_of = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    none = F.array().cast("array<variant>")
    raw = F.coalesce(array_of(p["chunks"]), array_of(p["selectedChunks"]), none)
    own = F.filter(raw, lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT") & text_of(F.try_variant_get(c, "$.chunkId", "variant")).isNotNull(), F.lit(False)))
    chunks = F.transform(own, lambda c: F.struct(*[F.try_variant_get(c, f"$.{k}", "variant").alias(k) for k in CHUNK_KEYS]))
    given = F.transform(F.filter(F.coalesce(array_of(p["selectedChunkIds"]), none), lambda v: text_of(v).isNotNull()), lambda v: v.cast("string"))
    ids = F.array_distinct(F.concat(given, F.transform(own, lambda c: F.try_variant_get(c, "$.chunkId", "string"))))
    number = F.schema_of_variant(p["chunkCount"]).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    count = F.when(number, p["chunkCount"].cast("string").try_cast("double")).otherwise(F.size(ids).cast("double"))
    whole = F.when(count == F.floor(count), F.to_json(F.struct(count.cast("long").alias("n")))).otherwise(F.to_json(F.struct(count.alias("n"))))
    shown = F.to_json(
        F.struct(
            p["ordinal"].alias("ordinal"), p["attempt"].alias("attempt"), p["queryText"].alias("queryText"), F.try_parse_json(F.regexp_extract(whole, r":(.*)\}", 1)).alias("chunkCount"),
            ids.alias("selectedChunkIds"), chunks.alias("chunks"), p["queryVector"].alias("queryVector"), p["retrievalConfig"].alias("retrievalConfig"),
        )
    )
    return F.when((aggregate == "generation") & (kind == "QUESTION_RETRIEVAL_COMPLETED"), shown).otherwise(payload)


def classified_failures(failures: DataFrame, dimension: DataFrame, code: str = "code") -> DataFrame:
    """Failures with class, whether to retry, and advice; codes not listed are UNKNOWN."""
    out = failures.join(dimension, code, "left")
    return out.withColumns({"failure_class": F.coalesce("failure_class", F.lit("UNKNOWN")), "retryable": F.coalesce("retryable", F.lit(False))})


def later_cursor(a: Column, b: Column) -> Column:
    return F.greatest(a.cast("bigint"), b.cast("bigint"))
