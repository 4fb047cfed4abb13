"""Composite pipelines, as functions of tables. Answers of models and judges arrive as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.canonical import jsonb_sha256
from lectern.functions.scalars import lines_normalised
from lectern.functions.text_udfs import bigram_embedding, nfc
from lectern.operators import alignment, analytics, datasets, details, documents, events, integrity, lookups, relational, retrieval, scoring
from lectern.streaming.feed import described


def process_documents(pages: DataFrame, doc: str, page: str, max_tokens: int = 400, dims: int = 64, layout: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages to documents, chunks with vectors, contents, and the alignment of both.

    ``layout`` holds the parsed elements (doc, document_page, category, text, center_x); the
    printed pages in its footers place entries of the contents, headings the others.
    """
    whole = documents.assemble_pages(pages, doc, page)
    chunks = relational.settled(documents.chunk_documents(whole, doc, "html", max_tokens))
    embedded = chunks.withColumn("embedding", bigram_embedding(dims)(F.col("content")))
    toc = relational.settled(documents.extract_toc(whole, doc))
    if layout is None:
        places = toc.select(doc, F.col("printed_page"), F.lit(0).alias("document_page")).limit(0)
    else:
        places = relational.settled(documents.printed_pages(layout, doc).select(doc, "printed_page", "document_page"))
    mappings = alignment.align_revisions(toc, chunks, places, doc)
    return {"documents": whole, "chunks": embedded, "toc": alignment.mapping_summary(toc, mappings, doc), "mappings": mappings}


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 12, window: int = 1) -> DataFrame:
    """Top k with neighbours, one ordered list of evidence per query."""
    hits = retrieval.vector_top_k(queries, chunks, k)
    near = retrieval.with_neighbours(hits, chunks, window)
    return near.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("selection_order", "chunk_id"))), lambda x: x.chunk_id).alias("chunk_ids")
    )


def generated_questions(answers: DataFrame, retrieved: DataFrame, raw: str = "raw") -> DataFrame:
    """Generated questions with their problems: broken rules, and citations outside the evidence."""
    kind = F.col("question_type") if "question_type" in answers.columns else None
    q = answers.withColumn("problems", integrity.question_problems(F.col(raw), kind)).join(retrieved, "query_id", "left")
    foreign = F.array_except("cited", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    return q.withColumn("problems", F.concat("problems", F.when(F.size(foreign) > 0, F.array(F.lit("CITES_OUTSIDE"))).otherwise(F.array().cast("array<string>"))))


def create_run(questions: DataFrame, models: DataFrame, modes: DataFrame, retrievals: DataFrame) -> DataFrame:
    """The item matrix; questions without retrieval lineage get no items of the modes that need it."""
    matrix = datasets.run_matrix(questions, models, modes)
    has = retrievals.select("question_id").distinct().withColumn("has", F.lit(True))
    out = matrix.join(has, "question_id", "left")
    return out.withColumn("state", F.when((F.col("mode") == "NONE") | F.col("has"), "PENDING").otherwise("REJECTED")).drop("has")


def execute_items(items: DataFrame, snapshots: DataFrame, answers: DataFrame) -> DataFrame:
    """Items (item_id, question_id, mode, question, options) with prompt and answer; evidence (an
    array of texts) is made once per question and mode and joined back."""
    ready = retrieval.computed_once(items, ["question_id", "mode"], snapshots)
    prompt = retrieval.answer_prompt(F.col("mode"), F.col("question"), F.col("options"), F.col("evidence"))
    return ready.withColumn("prompt", prompt).join(answers, "item_id", "left").withColumn("normalized_text", lines_normalised(nfc(F.col("answer"))))


def score_run(responses: DataFrame, judged: DataFrame, prices: DataFrame, calls: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores of all required metrics, completeness, and costs.

    With the judge's ``calls`` (see terminal_metrics) also ``state``: per response how many
    metrics it needs, has, and will not get any more, and whether it is done.
    """
    need = responses.withColumn("required", scoring.required_metrics(F.col("profile_metrics"), F.col("question_type")))
    parsed = scoring.parse_judge(relational.spread(judged)).where("reject is null").select("response_id", F.explode("scores").alias("s")).select("response_id", "s.metric_key", "s.value")
    present = responses.select("response_id", F.lit("response_present").alias("metric_key"), scoring.response_present(F.col("text")).cast("double").alias("value"))
    scores = parsed.select("response_id", "metric_key", "value").unionByName(present)
    out = {
        "scores": scores,
        "pairs": details.required_pairs(need, scores, F.col("required")),
        "costs": scoring.response_costs(responses, prices),
    }
    if calls is not None:
        lost = scoring.terminal_metrics(calls).withColumn("lost", F.lit(True))
        have = scores.where("value is not null").select("response_id", "metric_key").distinct().withColumn("have", F.lit(True))
        each = need.select("response_id", F.explode("required").alias("metric_key")).join(have, ["response_id", "metric_key"], "left").join(lost, ["response_id", "metric_key"], "left")
        state = each.groupBy("response_id").agg(F.count(F.lit(1)).alias("required"), F.count("have").alias("scored"), F.count_if(F.col("have").isNull() & F.col("lost").isNotNull()).alias("terminal"))
        out["state"] = state.withColumn("done", F.col("scored") + F.col("terminal") == F.col("required"))
    return out


def result_analytics(base: DataFrame, weight: Column, metric: str = "accuracy") -> DataFrame:
    return analytics.tagged_rows(base, weight, metric)


def result_details(items: DataFrame, responses: DataFrame, keys: list[str], scores: DataFrame | None = None) -> DataFrame:
    """Execution, sums and the representative failure by model and mode; with scores (keys, metric_key, value) also ``metrics``, the means by metric."""
    stats = details.execution_stats(items, keys)
    sums = details.response_sums(responses, keys)
    failed = items.where(F.col("state").isin(*details.FAILED))
    worst = details.representative_failure(details.failure_groups(failed, keys, "code", "message", "at", "id"), keys)
    out = stats.join(sums, keys, "left").join(worst, keys, "left")
    if scores is None:
        return out
    means = details.capability_means(scores, [*keys, "metric_key"])
    listed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("metric_key", "mean", "n"))).alias("metrics"))  # a few metrics
    return out.join(listed, keys, "left")


def publish(rows: DataFrame, versions: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Frozen versions: content hash, size, and the number after those that exist in ``versions`` (key, version)."""
    last = versions.groupBy(key).agg(F.max("version").alias("__last"))
    out = datasets.content_hash(rows, key, fields, order).join(last, key, "left")
    return out.withColumn("version", F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def audited_page(questions: DataFrame, revisions: DataFrame, evidence: DataFrame, query: str | None, facets: dict[str, str | None], page: int = 1, size: int = 20) -> DataFrame:
    """A page of real approved questions that fit the search, with their evidence and the total."""
    live = relational.real_approved(questions, revisions)
    found = datasets.audit_list(live, query, [F.col("text"), F.col("purpose")], facets)
    return datasets.with_evidence(relational.page_with_total(found, [F.asc("question_id")], page, size), evidence)


#: Stages of the overview, in order, and the stages of operations that count to each.
OVERVIEW = {
    "UPLOAD": ["UPLOAD"], "PARSE": ["PARSING"], "CHUNK": ["CHUNKING"], "EMBED": ["EMBEDDING"], "GENERATE": ["DIRECTION", "RETRIEVAL", "QUESTION_GENERATION"],
    "REVIEW": ["REVIEW"], "FREEZE": ["FREEZE"], "EXECUTE": ["BENCHMARK"], "SCORE": ["SCORING"],
}


def control_room_snapshot(jobs: DataFrame, items: DataFrame, log: DataFrame, operations: DataFrame, failures: DataFrame, ready: DataFrame, as_of: str, recent: int = 100, work: tuple[DataFrame, DataFrame] | None = None, scores: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The control room at one moment.

    jobs, items: state, lease_expires_at; log: event_id, event_type, payload; operations: stage,
    state; failures: stage; ready: stage, n (stages of the overview). Gives the system's row,
    the overview by stage, and the latest events, described, oldest first. Besides, where they
    are given: ``active``, the operations of ``work`` (jobs and runs: aggregate_id, id, stage,
    at), jobs first, the newest 50; ``failures``, the newest 20 of failures that have id, code,
    message and at; ``scoreboard`` of ``scores`` (scores and eligible responses), 200 rows.
    """
    now = F.lit(as_of).cast("timestamp")
    leased = F.col("state") == "LEASED"
    alive = F.coalesce(F.col("lease_expires_at") > now, F.lit(False))
    queue = jobs.agg(
        F.count_if(F.col("state") == "PENDING").alias("pending"), F.count_if(F.col("state") == "RETRY_WAIT").alias("retry_wait"), F.count_if(leased).alias("leased"),
        F.count_if(leased & alive).alias("a"), F.count_if(leased & ~alive).alias("s"),
    )
    lanes = items.agg(F.count_if(leased & alive).alias("a2"), F.count_if(leased & ~alive).alias("s2"))
    cursor = log.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("event_cursor"))
    worker = F.when(F.col("stale_leases") > 0, "STALE").when(F.col("active_leases") > 0, "HEALTHY").otherwise("IDLE")
    system = queue.crossJoin(lanes).crossJoin(cursor).select(  # one row each
        "event_cursor", "pending", "retry_wait", "leased", (F.col("a") + F.col("a2")).alias("active_leases"), (F.col("s") + F.col("s2")).alias("stale_leases")
    ).withColumn("worker", worker)
    top = F.create_map(*[F.lit(x) for k, vs in OVERVIEW.items() for v in vs for x in (v, k)])
    counted = lambda df, name: df.withColumn("key", F.try_element_at(top, "stage")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias(name))
    stages = log.sparkSession.createDataFrame(list(enumerate(OVERVIEW)), "position int, key string")
    overview = (
        stages.join(counted(operations.where("state <> 'STALE'"), "active"), "key", "left")
        .join(counted(failures, "failed"), "key", "left")
        .join(ready.select(F.col("stage").alias("key"), F.col("n").alias("ready")), "key", "left")
        .fillna(0, ["active", "failed", "ready"])
    )
    out = {"system": system, "stages": overview, "events": described(relational.last_then_ascending(log, "event_id", recent))}
    if work is not None:
        out["active"] = events.active_operations(*work).limit(50)
    if {"id", "code", "message", "at"} <= set(failures.columns):
        latest = failures.select("stage", "id", F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.lit("UNKNOWN")).alias("code"), "message", "at")
        out["failures"] = latest.orderBy(F.desc("at"), F.desc("id")).limit(20)
    if scores is not None:
        out["scoreboard"] = details.scoreboard(*scores, limit=200)
    return out


def run_details(items: DataFrame, responses: DataFrame, scores: DataFrame, receipts: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Progress by ``keys``, the required and scored metrics of every response, and retrievals with what their roots hold."""
    return {
        "progress": details.run_progress(items, keys),
        "pairs": details.required_pairs(responses, scores, F.col("required")),
        "retrievals": relational.resolve_receipts(receipts, "id", "shared_from", ["context", "config_hash"]),
    }


def generation_activity(items: DataFrame, attempts: DataFrame, key: str) -> dict[str, DataFrame]:
    """Summary of a generation's items, the state counts of their calls, and what a resume would take up: items not completed, with their last attempt."""
    last = relational.latest_per_key(attempts, ["item_id"], [F.desc("attempt"), F.desc("id")]).select("item_id", "attempt", F.col("state").alias("last_state"))
    return {
        "summary": details.item_summary(items, key),
        "calls": lookups.state_counts(attempts, ["item_id"], ["REQUESTED", "FAILED", "PERSISTED"]),
        "resumable": items.where("state <> 'COMPLETED'").join(last, "item_id", "left"),
    }


#: What an item is marked with when its job has lost the lease, and the old failures that may be tried again.
ORPHANED, CUT_OFF = "GENERATION_ITEM_LEASE_ORPHANED", ("PARSE", "%finishReason=MAX\\_TOKENS%")


def resume_plan(batches: DataFrame, items: DataFrame, jobs: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """What resuming generation batches would do.

    batches: batch_id, requested; items: batch_id, ordinal, state, retryable, error_code,
    error_message, job_id, job_attempt; jobs: job_id, batch_id, state, attempts,
    lease_expires_at. Ordinals that are missing come in as PENDING, with the task that their
    place in the cycle gives. Running items whose job has no lease are failures to retry, as are
    answers cut off by their length. ``batches`` says for each batch: active (a job is at work),
    complete, no-retryable, or resumed; ``items`` holds every item's state before and after.
    """
    now = F.lit(as_of).cast("timestamp")
    alive = jobs.where((F.col("state") == "LEASED") & (F.col("lease_expires_at") > now))
    wanted = datasets.expanded_items(batches.select("batch_id", "requested")).select("batch_id", "ordinal")
    held = wanted.join(items, ["batch_id", "ordinal"], "full")  # items beyond the request stay
    leases = alive.select("job_id", F.col("attempts").alias("job_attempt"), F.lit(True).alias("leased"))
    at = held.join(leases, ["job_id", "job_attempt"], "left").withColumn("before", F.coalesce("state", F.lit("MISSING")))
    orphan = (F.col("state") == "RUNNING") & F.col("leased").isNull()
    cut_off = (F.col("state") == "FAILED") & ~F.col("retryable") & (F.col("error_code") == CUT_OFF[0]) & F.col("error_message").like(CUT_OFF[1])
    again = F.coalesce(orphan | cut_off, F.lit(False))
    at = at.withColumns({
        "now": F.when(orphan, "FAILED").otherwise(F.coalesce("state", F.lit("PENDING"))), "retry": again | F.coalesce("retryable", F.lit(False)),
        "code": F.when(orphan, ORPHANED).otherwise(F.col("error_code")), "task": datasets.task_of(F.col("ordinal")),
    })
    failed = F.col("now") == "FAILED"
    counts = at.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("now") == "COMPLETED").alias("completed"), F.count_if(F.col("now") == "PENDING").alias("pending"),
        F.count_if(failed & F.col("retry")).alias("retryable_failed"), F.count_if(failed & ~F.col("retry")).alias("terminal_failed"),
        F.array_sort(F.collect_list(F.when(failed & ~F.col("retry"), F.struct("ordinal", "code")))).alias("errors"),
    )
    working = alive.select("batch_id").distinct().withColumn("active", F.lit(True))
    made = jobs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("jobs"))
    out = counts.join(working, "batch_id", "left").join(made, "batch_id", "left")
    outcome = F.when(F.col("active"), "active").when((F.col("total") > 0) & (F.col("completed") == F.col("total")), "complete").when(F.col("pending") + F.col("retryable_failed") == 0, "no-retryable").otherwise("resumed")
    out = out.select("batch_id", outcome.alias("outcome"), "total", "completed", (F.col("pending") + F.col("retryable_failed")).alias("pending"), "terminal_failed", "errors", (F.coalesce("jobs", F.lit(0)) + 1).alias("sequence"))
    resumed = out.where("outcome = 'resumed'").select("batch_id", F.lit(True).alias("resumed"))
    after = F.when(~F.coalesce("resumed", F.lit(False)), F.col("before")).when(failed & F.col("retry"), "PENDING").otherwise(F.col("now"))
    items_after = at.join(resumed, "batch_id", "left").select("batch_id", "ordinal", "task", "before", after.alias("after"), F.when(after == "FAILED", F.col("code")).alias("error_code"))
    return {"batches": out, "items": items_after}


def compatible_sources(sources: DataFrame, active: DataFrame, sha: str = "sha256") -> DataFrame:
    """For every content the source to take up again: made under verified snapshots of the active
    profiles (kind, content_hash), not deleted ones first, then the newest."""
    hashes = active.groupBy().pivot("kind", ["document_parse", "embedding_rag"]).agg(F.first("content_hash"))
    fits = sources.where((F.col("parse_provenance") == integrity.VERIFIED) & (F.col("embed_provenance") == integrity.VERIFIED)).join(
        hashes, (F.col("parse_hash") == F.col("document_parse")) & (F.col("embed_hash") == F.col("embedding_rag"))  # one row
    )
    return relational.latest_per_key(fits, [sha], [F.desc(F.col("deleted_at").isNull()), F.desc("created_at"), F.desc("id")]).drop("document_parse", "embedding_rag")


def activated_profiles(profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """Profiles (id, kind, config JSON) with their canonical hash and whether they are the active one of their kind."""
    last = relational.latest_per_key(activations, ["kind"], [F.desc("activated_at"), F.desc("profile_id")]).select("kind", F.col("profile_id").alias("active_id"))
    out = profiles.withColumn("content_hash", jsonb_sha256(F.col("config"))).join(last, "kind", "left")
    return out.withColumn("active", F.coalesce(F.col("id") == F.col("active_id"), F.lit(False))).drop("active_id")
