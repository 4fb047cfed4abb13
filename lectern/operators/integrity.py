"""Validity predicates and integrity checks: each check returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import json_schema, schemas
from lectern.functions.canonical import jsonb_sha256
from lectern.functions.scalars import is_sha256

#: Fixed values: (state, command, next state) of runs, documents and questions.
RUN_COMMANDS = [
    ("DRAFT", "QUEUE", "QUEUED"), ("QUEUED", "START", "RUNNING"), ("RUNNING", "PAUSE", "PAUSING"), ("PAUSING", "FINISH_PAUSE", "PAUSED"),
    ("PAUSED", "RESUME", "RUNNING"), ("RUNNING", "STOP", "STOPPING"), ("PAUSING", "STOP", "STOPPING"), ("PAUSED", "STOP", "STOPPED"),
    ("STOPPING", "FINISH_STOP", "STOPPED"), ("STOPPED", "RESUME", "RUNNING"), ("RUNNING", "BEGIN_SCORING", "SCORING"), ("SCORING", "PAUSE", "PAUSING"),
    ("SCORING", "STOP", "STOPPING"), ("SCORING", "CANCEL", "CANCELLING"), ("SCORING", "COMPLETE", "COMPLETED"), ("QUEUED", "CANCEL", "CANCELLING"),
    ("RUNNING", "CANCEL", "CANCELLING"), ("PAUSED", "CANCEL", "CANCELLING"), ("PAUSING", "CANCEL", "CANCELLING"), ("STOPPING", "CANCEL", "CANCELLING"),
    ("STOPPED", "CANCEL", "CANCELLING"), ("CANCELLING", "FINISH_CANCEL", "CANCELLED"), ("QUEUED", "FAIL", "FAILED"), ("RUNNING", "FAIL", "FAILED"), ("SCORING", "FAIL", "FAILED"),
]
DOCUMENT_COMMANDS = [
    ("UPLOADED", "PARSE", "PARSING"), ("PARSING", "PARSE_COMPLETE", "PARSED"), ("PARSED", "APPROVE_HTML", "HTML_REVIEWED"), ("HTML_REVIEWED", "CHUNK", "CHUNKING"),
    ("CHUNKING", "CHUNK_COMPLETE", "CHUNKED"), ("CHUNKED", "EMBED", "EMBEDDING"), ("EMBEDDING", "EMBED_COMPLETE", "READY"),
    ("PARSING", "FAIL", "FAILED"), ("CHUNKING", "FAIL", "FAILED"), ("EMBEDDING", "FAIL", "FAILED"),
]
QUESTION_COMMANDS = [
    ("DRAFT", "SUBMIT", "IN_REVIEW"), ("DRAFT", "APPROVE", "APPROVED"), ("DRAFT", "EDIT_AND_APPROVE", "APPROVED"), ("DRAFT", "HOLD", "HELD"),
    ("IN_REVIEW", "APPROVE", "APPROVED"), ("IN_REVIEW", "EDIT_AND_APPROVE", "APPROVED"), ("IN_REVIEW", "HOLD", "HELD"), ("HELD", "REOPEN", "IN_REVIEW"),
    ("DRAFT", "DELETE", "DELETED"), ("IN_REVIEW", "DELETE", "DELETED"), ("HELD", "DELETE", "DELETED"),
]
#: Legal changes of a judge's call.
JUDGE_TRANSITIONS = [("REQUESTED", "RESPONSE_RECEIVED"), ("REQUESTED", "FAILED"), ("RESPONSE_RECEIVED", "PARSED"), ("RESPONSE_RECEIVED", "FAILED"), ("PARSED", "PERSISTED"), ("PARSED", "FAILED")]
#: A document that failed may go back to the stage it failed in.
RUN_TRANSITIONS = sorted({(a, b) for a, _, b in RUN_COMMANDS})
QUESTION_TRANSITIONS = sorted({(a, b) for a, _, b in QUESTION_COMMANDS})
DOCUMENT_TRANSITIONS = sorted({(a, b) for a, _, b in DOCUMENT_COMMANDS} | {("FAILED", a) for a, _, b in DOCUMENT_COMMANDS if b == "FAILED"})


def next_states(df: DataFrame, commands: list[tuple[str, str, str]], state: str = "state", command: str = "command", failed_stage: str | None = None) -> DataFrame:
    """df with next_state: where the command leads, NULL if it is not allowed.

    With ``failed_stage`` a RETRY leads from FAILED back to the stage in that column.
    """
    table = F.create_map(*[F.lit(x) for a, c, b in commands for x in (f"{a}:{c}", b)])
    to = F.try_element_at(table, F.concat_ws(":", F.col(state), F.col(command)))
    if failed_stage:
        to = F.when((F.col(state) == "FAILED") & (F.col(command) == "RETRY") & F.col(failed_stage).isNotNull(), F.col(failed_stage)).otherwise(to)
    return df.withColumn("next_state", to)


def nonempty_unique(a: Column) -> Column:
    """Array with at least one text, none blank or NULL, none twice."""
    return F.coalesce((F.size(a) > 0) & (F.size(F.array_distinct(a)) == F.size(a)) & ~F.exists(a, lambda x: x.isNull() | (F.trim(x) == "")), F.lit(False))


def weights_valid(weights: Column) -> Column:
    """JSON object whose values are all numbers of 0 or more."""
    m = F.from_json(weights, "map<string,string>")
    number = lambda v: F.coalesce(v.rlike(r"^(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), F.lit(False))
    return F.coalesce(F.trim(weights).startswith("{") & F.forall(F.map_values(m), number), F.lit(False))


#: Metrics without a judge, marks of unknown judges, and the provenance that counts.
ALGORITHMIC = ["exact_match", "response_present"]
UNRECORDED = ["legacy-environment-default-unrecorded", "legacy-provider-unrecorded"]
VERIFIED = "AT_CREATION_VERIFIED"


def judge_resolved(provider: Column, model: Column) -> Column:
    """Both names absent, or both given, not blank and not one of the marks for unknown."""
    named = F.coalesce((F.trim(provider) != "") & (F.trim(model) != "") & ~provider.isin(*UNRECORDED) & ~model.isin(*UNRECORDED), F.lit(False))
    return (provider.isNull() & model.isNull()) | named


def profile_usable(metrics: Column, provider: Column, model: Column) -> Column:
    """Score profile that may be used: metrics as a JSON array, with a known judge if one of them needs it."""
    v = F.try_parse_json(metrics)
    names = F.from_json(metrics, "array<string>")
    judged = F.exists(names, lambda m: ~F.coalesce(m.isin(*ALGORITHMIC), F.lit(True)))
    is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    return judge_resolved(provider, model) & is_array & (~F.coalesce(judged, F.lit(False)) | provider.isNotNull())


def run_profile_usable(snapshot: Column, provenance: Column) -> Column:
    """A run's profile snapshot (JSON) may be scored by."""
    part = lambda k: F.get_json_object(snapshot, f"$.{k}")
    return F.coalesce(provenance == VERIFIED, F.lit(False)) & profile_usable(part("metrics"), part("judgeProvider"), part("judgeModel"))


def config_valid(config: Column, fields: dict[str, tuple[float, float]]) -> Column:
    """JSON object with exactly these keys, each a number in its range."""
    m = F.from_json(config, "map<string,string>")
    exact = F.array_sort(F.json_object_keys(config)) == F.array(*[F.lit(k) for k in sorted(fields)])
    ok = exact
    for k, (low, high) in fields.items():
        ok = ok & F.coalesce(F.try_element_at(m, F.lit(k)).try_cast("double").between(low, high), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def illegal_transitions(log: DataFrame, key: str, state: str, order: list[str], legal: list[tuple[str, str]] = RUN_TRANSITIONS) -> DataFrame:
    """Rows of a state log whose change from the row before is not allowed."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("before", F.lag(state).over(w)).where("before is not null")
    pairs = log.sparkSession.createDataFrame(legal, "before string, __to string")
    return steps.join(F.broadcast(pairs), (steps["before"] == pairs["before"]) & (steps[state] == pairs["__to"]), "left_anti")


def judge_scores_differ(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """(call_id, metric_key, side) resolved without a score, or scored without being resolved."""
    resolved = calls.select("call_id", F.explode("resolved").alias("metric_key")).distinct()
    stored = scores.select("call_id", "metric_key").distinct()
    both = resolved.withColumn("r", F.lit(1)).join(stored.withColumn("s", F.lit(1)), ["call_id", "metric_key"], "full")
    return both.where("r is null or s is null").select("call_id", "metric_key", F.when(F.col("s").isNull(), "no_score").otherwise("not_resolved").alias("side"))


def revision_mismatches(child: DataFrame, parent: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Child rows that differ from their parent in a column, NULL counting as a value."""
    p = parent.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return child.join(p, key).where(~same).drop(*[f"__{c}" for c in columns])


def ordinal_gaps(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Keys whose ordinals are not 1..n."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("low"), F.max(ordinal).alias("high"), F.count_distinct(ordinal).alias("k"))
    return g.where("low <> 1 or high <> n or k <> n")


#: Rules of a generated question that are told apart; a path below one of them counts for it.
QUESTION_RULES = [
    "questionText", "answerText", "acceptedAnswers", "designSummary", "evidenceSummary", "evidenceChunkIds", "benchmarkDesign.benchmarkType", "benchmarkDesign.taskType",
    "benchmarkDesign.targetConcept", "benchmarkDesign.prerequisiteConcepts", "benchmarkDesign.prerequisiteRelations", "benchmarkDesign.requiredReasoningSteps",
    "benchmarkDesign.failureSignals", "answerOptions",
]


def question_issues(raw: Column) -> Column:
    """Paths of a generated question's JSON that break its schema, down to list elements; [""] if it is no JSON."""
    return json_schema.problems(raw, schemas.QUESTION)


def options_fit(raw: Column, question_type: Column) -> Column:
    """Whether the number of options is that of the type; a missing list counts as empty."""
    own = json_schema.elements(json_schema.part(json_schema.parsed(raw), "answerOptions"))
    n = F.coalesce(F.size(own), F.lit(0))
    return F.when(question_type == schemas.WITH_OPTIONS, n == schemas.OPTIONS).otherwise(n <= 0)


def question_problems(raw: Column, question_type: Column | None = None) -> Column:
    """The rules (QUESTION_RULES) that a generated question's JSON breaks, types included; empty if it is valid.

    What is no object breaks every required rule. With ``question_type`` the number of options
    is checked too (answerOptions).
    """
    needed = [r for r in QUESTION_RULES if r not in ("acceptedAnswers", "designSummary", "evidenceSummary", "answerOptions")]
    #: rule -> the paths whose break is a break of the rule, besides those below it
    above = F.create_map(*[x for r in QUESTION_RULES for x in (F.lit(r), F.array(*[F.lit(p) for p in ("", "benchmarkDesign") if r in needed and (not p or r.startswith(p + "."))]).cast("array<string>"))])
    rules = F.array(*map(F.lit, QUESTION_RULES))
    hit = lambda issues, rule: F.exists(issues, lambda p: (p == rule) | p.startswith(F.concat(rule, F.lit("."))) | p.startswith(F.concat(rule, F.lit("["))) | F.array_contains(F.element_at(above, rule), p))
    broken = json_schema.let(question_issues(raw), lambda issues: F.filter(rules, lambda rule: hit(issues, rule)))
    if question_type is None:
        return broken
    return F.when(options_fit(raw, question_type), broken).otherwise(F.array_distinct(F.concat(broken, F.array(F.lit("answerOptions")))))


def config_issues(raw: Column, expected: Column | None = None) -> Column:
    """Paths of a research configuration's JSON that break the schema of its kind, or ``kind`` if another was expected."""
    if expected is None:
        return json_schema.problems(raw, schemas.CONFIG)

    def other(value: Column) -> Column:
        return json_schema.must(F.coalesce(json_schema.as_text(json_schema.part(value, "kind")) == expected, F.lit(True)), F.lit("kind"))

    def check(value: Column) -> Column:
        return json_schema.let(schemas.CONFIG(value, None), lambda issues: F.when(F.size(issues) == 0, other(value)).otherwise(issues))

    return json_schema.let(json_schema.parsed(raw), lambda v: F.when(v.isNull(), F.array(F.lit(""))).otherwise(check(v)))


def pin_problem(expected: Column, provenance: Column, profile_id: Column, content_hash: Column, definition: Column) -> Column:
    """Why a pinned configuration may not be used, NULL if it may: the first of unverified, profile_id,
    content_hash, definition_schema, definition_kind and definition_hash that fails.
    """
    told = json_schema.as_text(json_schema.part(json_schema.parsed(definition), "kind"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~sure(provenance == VERIFIED), "unverified")
        .when(~sure(profile_id.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z")), "profile_id")
        .when(~sure(is_sha256(content_hash)), "content_hash")
        .when(F.size(F.coalesce(config_issues(definition), F.array(F.lit("")))) > 0, "definition_schema")
        .when(~sure(told == expected), "definition_kind")
        .when(~sure(jsonb_sha256(definition) == content_hash), "definition_hash")
    )


def design_normalised(scores: Column) -> Column:
    """The benchmark design inside a question's quality scores (JSON), made fit to show; NULL if there is none.

    A missing text is NULL at the top and a dash inside lists; lists keep only texts, and what
    is no object counts as an empty one.
    """
    d = F.try_variant_get(F.try_parse_json(scores), "$.benchmarkDesign", "variant")
    none = F.array().cast("array<variant>")
    at = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant")
    items = lambda v: F.when(F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)).otherwise(none)
    text = lambda v: F.nullif(F.when(F.schema_of_variant(v) == "STRING", v.cast("string")), F.lit(""))
    shown = lambda v: F.coalesce(text(v), F.lit("—"))
    texts = lambda v: F.transform(F.filter(items(v), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    rows = lambda k, *names: F.transform(items(at(d, k)), lambda x: F.struct(*[shown(at(x, n)).alias(n) for n in names], texts(at(x, "evidenceChunkIds")).alias("evidenceChunkIds"))).alias(k)
    design = F.struct(
        *[text(at(d, k)).alias(k) for k in ("benchmarkType", "taskType", "targetConcept")],
        rows("prerequisiteConcepts", "concept", "role"), rows("prerequisiteRelations", "fromConcept", "toConcept", "relationType", "explanation"),
        *[texts(at(d, k)).alias(k) for k in ("requiredReasoningSteps", "failureSignals")],
    )
    return F.when(F.schema_of_variant(d).rlike("^OBJECT<.+>$"), design)


def soft_deleted(states: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Current state after appending changes (delete, cancel, retry) as new state rows."""
    w = Window.partitionBy(key).orderBy(F.desc("changed_at"), F.desc("seq"))
    return states.unionByName(changes).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def unusable_runs(runs: DataFrame) -> DataFrame:
    """Runs (id, state, snapshot, provenance) that can't be scored by their profile: new state and why."""
    part = lambda k: F.get_json_object("snapshot", f"$.{k}")
    provider, model = part("judgeProvider"), part("judgeModel")
    return runs.where(~run_profile_usable(F.col("snapshot"), F.col("provenance"))).select(
        "id", F.col("state").alias("previous_state"), F.when(F.col("state") == "SCORING", "FAILED").otherwise(F.col("state")).alias("state"),
        F.col("provenance").alias("snapshot_provenance"), judge_resolved(provider, model).alias("judge_resolved"), profile_usable(part("metrics"), provider, model).alias("definition_usable"),
    )
