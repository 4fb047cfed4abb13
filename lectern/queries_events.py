"""Registered queries: events, feeds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import register
from lectern.operators import events as ev
from lectern.session import new_shared_path, ship
from lectern.sources.tables import read_table as t
from lectern.streaming import cursor, feed

#: Event types of the table, mapped to names of the domain.
NAMES = {"click": "RUN_ITEM_COMPLETED", "view": "JOB_HEARTBEAT", "purchase": "DOCUMENT_PARSE_FAILED", "signup": "QUESTION_CREATED"}


def events(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("event_type")), F.lit("PROVIDER_COOLDOWN"))
    return e.select("event_id", "ts", F.col("user_id").alias("aggregate_id"), (F.col("user_id") % 100).alias("job_id"), kind.alias("event_type"), "value", "props")


EVENTS = """ev AS (SELECT event_id, ts, user_id AS aggregate_id, user_id % 100 AS job_id, CASE event_type WHEN 'click' THEN 'RUN_ITEM_COMPLETED' WHEN 'view' THEN 'JOB_HEARTBEAT' WHEN 'purchase' THEN 'DOCUMENT_PARSE_FAILED'
  WHEN 'signup' THEN 'QUESTION_CREATED' ELSE 'PROVIDER_COOLDOWN' END AS event_type, value, props FROM events)"""


#: Types as the engine writes them, dealt to the events in turn.
KINDS = [
    "RUN_SCORING_STARTED", "SCORE_PERSISTED", "JUDGE_CALL_FAILED", "DOCUMENT_PAGE_PARSE_STARTED", "PIPELINE_RETRY_SCHEDULED", "CHUNKING_COMPLETED",
    "TABLE_OF_CONTENTS_EXTRACTED", "TABLE_OF_CONTENTS_ALIGNED", "GEMINI_EMBEDDING_REQUESTED", "EMBEDDING_COMPLETED", "QUESTION_DIRECTION_RECEIVED", "QUESTION_RETRIEVAL_COMPLETED",
    "RETRIEVAL_ERROR", "QUESTION_GENERATION_CREATED", "GENERATION_STOPPED", "RUN_PAUSED", "RUN_ITEM_RETRIED", "RUN_CANCELLED", "JOB_RELEASED_ON_SHUTDOWN", "JOB_CLAIMED", "JOB_ENQUEUED",
    "JOB_HEARTBEAT", "PROVIDER_COOLDOWN_EXTENDED", "RUN_TERMINAL_FAILED", "SOURCE_VERIFIED", "RUN_SCORING_FAILURE", "DOCUMENT_RENDERED", "MODEL_CREATED",
]
_KINDS_SQL = ", ".join(f"'{k}'" for k in KINDS)


@register(rf"""WITH k AS (SELECT event_id, ([{_KINDS_SQL}])[event_id % {len(KINDS)} + 1] AS kind, CASE event_id % 5 WHEN 0 THEN 'DRAINING' END AS own, CASE event_id % 5 WHEN 2 THEN 'page done' END AS message,
  CASE event_id % 3 WHEN 0 THEN 'Book 1' WHEN 1 THEN '' END AS name FROM events),
w AS (SELECT *, array_to_string(list_transform(string_split(lower(kind), '_'), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS label FROM k)
SELECT event_id, CASE WHEN starts_with(kind, 'RUN_SCORING') OR starts_with(kind, 'SCORE_') OR starts_with(kind, 'JUDGE_') THEN 'SCORING'
  WHEN starts_with(kind, 'DOCUMENT_') OR starts_with(kind, 'PIPELINE_') THEN 'PARSING' WHEN starts_with(kind, 'CHUNKING_') OR starts_with(kind, 'TABLE_OF_CONTENTS_') THEN 'CHUNKING'
  WHEN starts_with(kind, 'GEMINI_EMBEDDING_') OR starts_with(kind, 'EMBEDDING_') THEN 'EMBEDDING' WHEN starts_with(kind, 'QUESTION_DIRECTION_') THEN 'DIRECTION'
  WHEN starts_with(kind, 'QUESTION_RETRIEVAL_') OR starts_with(kind, 'RETRIEVAL_') THEN 'RETRIEVAL' WHEN starts_with(kind, 'QUESTION_GENERATION_') OR starts_with(kind, 'GENERATION_') THEN 'QUESTION_GENERATION'
  WHEN starts_with(kind, 'RUN_') THEN 'BENCHMARK' WHEN starts_with(kind, 'JOB_') THEN 'QUEUE' ELSE 'SYSTEM' END AS stage,
CASE WHEN kind = 'JOB_RELEASED_ON_SHUTDOWN' THEN 'RETRY_WAIT' WHEN regexp_matches(kind, '(FAILED|FAILURE|ERROR)$') THEN 'FAILED' WHEN regexp_matches(kind, '(CANCELLED|STOPPED)$') THEN 'CANCELLED'
  WHEN suffix(kind, 'PAUSED') THEN 'PAUSED' WHEN regexp_matches(kind, '(RETRY|RETRIED|RETRY_SCHEDULED)$') THEN 'RETRY_WAIT'
  WHEN regexp_matches(kind, '(COMPLETED|SUCCEEDED|PERSISTED|VERIFIED|ALIGNED|EXTRACTED|RENDERED)$') THEN 'SUCCEEDED' WHEN regexp_matches(kind, '(STARTED|CLAIMED|REQUESTED|RECEIVED)$') THEN 'RUNNING'
  WHEN regexp_matches(kind, '(ENQUEUED|QUEUED|CREATED)$') THEN 'PENDING' ELSE coalesce(own, 'INFO') END AS state,
label, CASE WHEN coalesce(name, '') = '' THEN coalesce(message, label) ELSE name || ' · ' || coalesce(message, label) END AS summary FROM w""")
def described_events(spark, sf_dir):
    k = F.col("event_id")
    payload = F.when(k % 5 == 0, '{"state":"DRAINING"}').when(k % 5 == 1, '{"state":7}').when(k % 5 == 2, '{"message":"  page done "}').when(k % 5 == 3, '{"message":" "}').otherwise("{}")
    e = t(spark, sf_dir, "events").select(
        "event_id", F.get(F.array(*map(F.lit, KINDS)), (k % len(KINDS)).cast("int")).alias("event_type"), payload.alias("payload"), F.when(k % 3 == 0, "Book 1").when(k % 3 == 1, "").alias("aggregate_label")
    )
    return feed.described(e).select("event_id", "stage", "state", "label", "summary")


@register(f"WITH {EVENTS} SELECT job_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(ts, event_id) AS ts FROM ev WHERE event_type NOT LIKE 'JOB\\_%' ESCAPE '\\' GROUP BY 1")
def latest_per_job(spark, sf_dir):
    return ev.latest_per_job(events(spark, sf_dir))


@register(f"WITH {EVENTS} SELECT event_id, aggregate_id, event_type FROM ev WHERE event_id > 300 AND aggregate_id % 3 = 0 ORDER BY event_id LIMIT 200")
def after_cursor(spark, sf_dir):
    e = events(spark, sf_dir)
    return ev.after_cursor(e, 300, 200, e.where("aggregate_id % 3 = 0")).select("event_id", "aggregate_id", "event_type")


@register("SELECT max(event_id) AS cursor FROM events")
def latest_cursor(spark, sf_dir):
    return t(spark, sf_dir, "events").agg(F.max(ev.later_cursor(F.col("event_id"), F.lit("0"))).alias("cursor"))


@register(f"""WITH {EVENTS}, b AS (SELECT aggregate_id, event_id AS id, ts AS seen, 0 AS priority FROM ev WHERE event_type = 'DOCUMENT_PARSE_FAILED' UNION ALL SELECT aggregate_id, event_id, ts, 1 FROM ev WHERE event_type = 'RUN_ITEM_COMPLETED')
SELECT aggregate_id, id, priority FROM b QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY priority, seen DESC, id) = 1""")
def active_operations(spark, sf_dir):
    e = events(spark, sf_dir)
    pick = lambda k: e.where(F.col("event_type") == k).select("aggregate_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return ev.active_operations(pick("DOCUMENT_PARSE_FAILED"), pick("RUN_ITEM_COMPLETED")).select("aggregate_id", "id", "priority")


@register("""SELECT count(*) FILTER (s = 'QUEUED') AS queued, count(*) FILTER (s = 'LEASED') AS leased, count(*) FILTER (s = 'LEASED' AND (o_orderkey % 5 = 0 OR o_orderdate < TIMESTAMP '1995-06-01')) AS stale, count(*) FILTER (s = 'FAILED') AS failed
FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'QUEUED' WHEN 'O' THEN 'LEASED' ELSE 'FAILED' END AS s FROM orders)""")
def queue_counters(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    j = o.select(F.when(s == "P", "QUEUED").when(s == "O", "LEASED").otherwise("FAILED").alias("state"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("lease_expires_at"))
    return ev.queue_counters(j, "1995-06-01 00:00:00")


@register(f"""WITH {EVENTS}, f AS (SELECT 'document' AS stage, event_id AS id, event_type AS code, ts AS seen FROM ev WHERE value > 50 UNION ALL SELECT 'order', o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT stage, code, count(*) AS n, max(seen) AS latest FROM f GROUP BY ALL)
SELECT stage, CAST(sum(n) AS BIGINT) AS failures, max(latest) AS latest, string_agg(code || '=' || CAST(n AS VARCHAR), ';' ORDER BY code) AS by_code FROM g GROUP BY 1""")
def failures_by_stage(spark, sf_dir):
    a = events(spark, sf_dir).where("value > 50").select(F.col("event_id").alias("id"), F.col("event_type").alias("code"), F.col("props").alias("message"), F.col("ts").alias("at"))
    b = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"), F.lit("").alias("message"), F.col("o_orderdate").alias("at"))
    g = ev.failures_by_stage(ev.failure_feed({"document": a, "order": b}))
    return g.withColumn("by_code", F.array_join(F.transform(F.map_entries("by_code"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ";"))


@register(f"WITH {EVENTS} SELECT aggregate_id, event_type, min(event_id) AS event_id FROM ev WHERE event_id > 500 AND (aggregate_id, event_type) NOT IN (SELECT (aggregate_id, event_type) FROM ev WHERE event_id <= 500) GROUP BY 1, 2")
def once_only(spark, sf_dir):
    e = events(spark, sf_dir)
    return ev.once_only(e.where("event_id <= 500"), e.where("event_id > 500"), ["aggregate_id", "event_type"]).select("aggregate_id", "event_type", "event_id")


FAN_OUT = """WITH {events}, l AS (SELECT DISTINCT o_orderpriority AS provider_key, o_custkey % 30 AS run_id FROM orders)
SELECT event_id, run_id FROM ev JOIN l ON l.provider_key = CASE WHEN event_id % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END WHERE event_type = '{kind}'"""


@register(FAN_OUT.format(events=EVENTS, kind="QUESTION_CREATED"))
def fan_out(spark, sf_dir):
    return _fan_out(spark, sf_dir, "QUESTION_CREATED")


@register(FAN_OUT.format(events=EVENTS, kind="PROVIDER_COOLDOWN"))
def fan_out_all(spark, sf_dir):
    return _fan_out(spark, sf_dir, "PROVIDER_COOLDOWN")


def _fan_out(spark, sf_dir, kind):
    e = events(spark, sf_dir).where(F.col("event_type") == kind).withColumn("provider_key", F.when(F.col("event_id") % 2 == 0, "1-URGENT").otherwise("5-LOW"))
    lanes = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("provider_key"), (F.col("o_custkey") % 30).alias("run_id"))
    return ev.fan_out(e, lanes).select("event_id", "run_id")


@register("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'RPD' WHEN 1 THEN 'TPM' WHEN 2 THEN 'RPM' WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN 'RPD' ELSE 'UNKNOWN' END AS dimension,
CASE event_id % 6 WHEN 1 THEN 'q' || CAST(event_id AS VARCHAR) WHEN 4 THEN 'requests per day' WHEN 3 THEN 'tokens' WHEN 0 THEN 'daily' WHEN 2 THEN 'requests per minute' END AS scope,
CAST(CASE event_id % 6 WHEN 0 THEN 900000 WHEN 1 THEN least(604800000, 1000 * greatest(event_id, 7)) WHEN 2 THEN 1500 WHEN 3 THEN 120000 WHEN 4 THEN 604800000 ELSE CASE WHEN event_id % 4 = 1 THEN 30000 ELSE 120000 END END AS BIGINT) AS wait_ms FROM events""")
def cooldowns(spark, sf_dir):
    k = F.col("event_id")
    violation = lambda *x: F.concat(F.lit('{"@type":"type.googleapis.com/google.rpc.QuotaFailure","violations":['), *x, F.lit("]}"))
    retry = lambda x: F.concat(F.lit('{"@type":"type.googleapis.com/google.rpc.RetryInfo","retryDelay":"'), x, F.lit('"}'))
    details = (
        F.when(k % 6 == 0, violation(F.lit('{"description":"daily"}')))
        .when(k % 6 == 1, F.concat(retry(F.lit("7s")), F.lit(","), violation(F.lit('{"quotaId":"x","description":"requests"},{"quotaId":"q'), k.cast("string"), F.lit('","quotaMetric":"tokens per minute"}'))))
        .when(k % 6 == 2, F.concat(retry(F.lit("1.4999s")), F.lit(","), retry(F.lit("0.2s")), F.lit(","), violation(F.lit('{"quotaId":" ","description":"requests per minute"}'))))
        .when(k % 6 == 3, violation(F.lit('{"description":"tokens"},{"quotaId":""}')))
        .when(k % 6 == 4, F.concat(violation(F.lit('{"description":"requests per minute"}')), F.lit(","), violation(F.lit('{"description":"requests per day"}')), F.lit(","), retry(F.lit("99999999s"))))
        .otherwise('{"@type":"other","retryDelay":"5s"}')
    )
    header = F.when(k % 6 == 1, k.cast("string")).when((k % 6 == 5) & (k % 4 == 1), "Thu, 01 Jan 2026 00:00:30 GMT")
    body = F.when((k % 6 == 5) & (k % 4 == 3), "overloaded").otherwise(F.concat(F.lit('{"error":{"details":['), details, F.lit("]}}")))
    e = t(spark, sf_dir, "events").select("event_id", header.alias("header"), ev.quota_error(body).alias("quota"))
    wait = F.greatest(ev.header_wait_ms(F.col("header"), F.to_timestamp(F.lit("2026-01-01 00:00:00+00:00"))), F.col("quota.wait_ms"))
    return e.select("event_id", F.col("quota.dimension").alias("dimension"), F.col("quota.scope").alias("scope"), ev.cooldown_ms(wait, F.col("quota.dimension")).alias("wait_ms"))


@register(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[REDACTED] failed' WHEN 1 THEN 'Authorization [REDACTED], code 4' WHEN 2 THEN 'API-Key [REDACTED] next' ELSE left(repeat('long ', 200), 500) END AS text FROM events""")
def redacted_errors(spark, sf_dir):
    from lectern.functions.scalars import redacted

    k = F.col("event_id")
    raw = F.when(k % 4 == 0, "sk-1234 failed").when(k % 4 == 1, 'Authorization": Bearer abc.def, code 4').when(k % 4 == 2, "API-Key=abc next").otherwise("long " * 200)
    return t(spark, sf_dir, "events").select("event_id", redacted(raw, F.lit("sk-1234")).alias("text"))


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"chunks":[],"secret":1}' WHEN event_id % 3 = 1 THEN '{"queryText":"q","chunkCount":2,"selectedChunkIds":["b","a"],"chunks":[{"chunkId":"a","rank":1,"page":null,"similarity":0.5}]}'
ELSE '{"ordinal":' || CAST(event_id AS VARCHAR) || ',"chunkCount":9,"selectedChunkIds":["c"],"chunks":[{"chunkId":"c","anchorChunkId":"d"}],"retrievalConfig":{"k":1}}' END AS payload FROM events""")
def shown_payloads(spark, sf_dir):
    k = F.col("event_id")
    raw = (
        F.when(k % 3 == 0, '{"chunks":[],"secret":1}')
        .when(k % 3 == 1, '{"secret":1,"queryText":"q","selectedChunkIds":["b",5,"b"],"chunks":[{"chunkId":"a","rank":1,"page":null,"similarity":0.5,"content":"text"},{"chunkId":7},"x"]}')
        .otherwise(F.concat(F.lit('{"ordinal":'), k.cast("string"), F.lit(',"chunkCount":9,"selectedChunks":[{"chunkId":"c","anchorChunkId":"d","html":"<p>"}],"retrievalConfig":{"k":1}}')))
    )
    shown = ev.shown_payload(F.lit("generation"), F.when(k % 3 == 0, "QUESTION_CREATED").otherwise("QUESTION_RETRIEVAL_COMPLETED"), raw)
    return t(spark, sf_dir, "events").select("event_id", shown.alias("payload"))


@register("""SELECT event_id, coalesce(d.failure_class, 'UNKNOWN') AS failure_class, coalesce(d.retryable, false) AS retryable FROM events LEFT JOIN (VALUES ('click', 'TRANSIENT', true), ('view', 'INPUT', false)) d(code, failure_class, retryable) ON d.code = event_type""")
def classified_failures(spark, sf_dir):
    dim = spark.createDataFrame([("click", "TRANSIENT", True), ("view", "INPUT", False)], "code string, failure_class string, retryable boolean")
    e = t(spark, sf_dir, "events").withColumnRenamed("event_type", "code")
    return ev.classified_failures(e, dim).select("event_id", "failure_class", "retryable")


@register("SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT props->>'k' AS k FROM events) GROUP BY 1")
def json_keys(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _stream(spark, sf_dir):
    """The events table as a stream of one file."""
    schema = t(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@register("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def streamed_latest_state(spark, sf_dir):
    return feed.drain(feed.latest_state(_stream(spark, sf_dir), "user_id"), "streamed_latest_state", "complete")


@register("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_windows(spark, sf_dir):
    w = feed.windowed_counts(_stream(spark, sf_dir))
    return feed.drain(w, "streamed_windows", "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("""SELECT event_id, 'user ' || CAST(user_id AS VARCHAR) AS label, event_type FROM (SELECT * FROM events WHERE event_id > 500 AND (user_id % 40 = 7)) ORDER BY event_id""")
def cursor_feed(spark, sf_dir):
    """A client's feed from cursor 500 on: the events of an aggregate and its jobs, read through the cursor source and named by a stream-static join."""
    ship(spark)
    spark.dataSource.register(cursor.EventCursor)
    log = t(spark, sf_dir, "events")
    jobs = log.where("user_id % 40 = 7").select(F.lit(7).cast("long").alias("aggregate_id"), F.col("user_id").cast("long").alias("job_id")).distinct()
    own = cursor.members(7, jobs)
    stream = spark.readStream.format("event_cursor").schema(log.select("event_id", "user_id", "event_type").schema)
    stream = stream.options(path=f"{sf_dir}/events.parquet", after="20", last_event_id="500", aggregate="user_id", aggregates=own, catch_up="true").load()
    names = log.select("user_id").distinct().select(F.col("user_id").alias("aggregate_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("label"))
    named = feed.resolved(stream.withColumnRenamed("user_id", "aggregate_id"), names).select("event_id", "label", "event_type")
    path = new_shared_path(spark, "feed")
    q = named.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/at").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(named.schema).parquet(f"{path}/rows")
