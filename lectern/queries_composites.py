"""Registered queries: composites of the engine, and operators that only composites use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.catalog import register
from lectern.functions.text_udfs import bigram_coverage, bigram_embedding
from lectern.operators import analytics, datasets, details, integrity, retrieval, scoring
from lectern.plans import pipelines
from lectern.queries_analytics import HITS, _responses, _vectors, doubles
from lectern.queries_events import EVENTS, _stream, events
from lectern.session import ship
from lectern.sources import sinks, tables
from lectern.sources.tables import read_table as t
from lectern.streaming import feed

RUN = """items AS (SELECT o_orderkey AS id, o_custkey % 5 AS m, o_orderkey % 100 AS q, o_orderstatus AS mode FROM orders),
last AS (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3 DESC, l_shipdate DESC, l_linenumber DESC) = 1)"""


def _run(spark, sf_dir):
    """Items, models, questions, responses and scores of a run."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    items = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("run_model_id"), (F.col("o_orderkey") % 100).alias("question_id"), F.col("o_orderstatus").alias("mode"))
    models = spark.range(5).select("id", F.concat(F.lit("M0"), (F.col("id") + 1).cast("string")).alias("blind_id"))
    questions = spark.range(100).select("id", F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("purpose"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    responses = li.select(F.col("l_orderkey").alias("run_item_id"), key.alias("id"), (F.col("l_linenumber") % 3).alias("attempt"), F.col("l_shipdate").alias("created_at"), (F.col("l_returnflag") == "R").alias("ignored_after_cancel"))
    scores = li.select(key.alias("response_id"), F.lit("accuracy").alias("metric_key"), (F.col("l_discount") * 10).cast("decimal(10,6)").alias("value"))
    return items, models, questions, responses, scores


@register(f"""WITH {RUN} SELECT 'M0' || CAST(m + 1 AS VARCHAR) AS blind_id, mode, 'p' || CAST(q % 4 AS VARCHAR) AS purpose, count(*) AS n, CAST(sum(CAST(s.l_discount * 10 AS DECIMAL(10,6))) AS DOUBLE) AS total
FROM items JOIN last ON last.l_orderkey = id JOIN lineitem s ON s.l_orderkey = last.l_orderkey AND s.l_linenumber = last.l_linenumber GROUP BY ALL""")
def score_base(spark, sf_dir):
    b = analytics.score_base(*_run(spark, sf_dir))
    return b.groupBy("blind_id", "mode", "purpose").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))


@register("SELECT conv_id % 5 AS run_model_id, role, count(*) AS responses, CAST(sum(turn * 100) AS DOUBLE) / count(*) AS avg_latency_ms, CAST(sum(length(text) % 97) AS DOUBLE) AS cost FROM conversations GROUP BY ALL")
def model_stats(spark, sf_dir):
    return doubles(analytics.model_stats(_responses(spark, sf_dir), ["run_model_id", "role"]))


@register("SELECT o_custkey AS response_id, string_agg('m' || CAST(o_orderkey AS VARCHAR) || '=' || CAST(o_orderkey % 9 AS VARCHAR) || ':' || o_orderstatus, ';' ORDER BY 'm' || CAST(o_orderkey AS VARCHAR)) AS scores FROM orders GROUP BY 1")
def score_maps(spark, sf_dir):
    k = F.col("o_orderkey")
    s = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("response_id"), F.concat(F.lit("m"), k.cast("string")).alias("metric_key"), (k % 9).alias("value"), F.col("o_orderstatus").alias("label"))
    m = datasets.score_maps(s, "response_id")
    one = lambda e: F.concat(e.key, F.lit("="), e.value.value.cast("string"), F.lit(":"), e.value.label)
    return m.select("response_id", F.array_join(F.transform(F.map_entries("scores"), one), ";").alias("scores"))


@register("SELECT l_returnflag AS metric_key, l_linestatus AS mode, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def capability_means(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric_key"), F.col("l_linestatus").alias("mode"), F.col("l_quantity").cast("double").alias("value"))
    return details.capability_means(s, ["metric_key", "mode"]).withColumn("mean", F.round("mean", 6))


@register("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicks' ELSE event_type END AS label, CASE event_type WHEN 'click' THEN 'judge' ELSE 'custom' END AS category,
CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'a,b' END AS resolved, CASE event_id % 2 WHEN 0 THEN 'b' ELSE '' END AS missing FROM events""")
def metric_names(spark, sf_dir):
    names = spark.createDataFrame([("click", "Clicks", "judge")], "metric_key string, label string, category string")
    e = scoring.with_metric_names(t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric_key")), names)
    asked = F.array(F.lit("a"), F.lit("b"))
    resolved, missing = scoring.metric_matches(asked, F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("b"), F.lit("a"))))
    return e.select("event_id", "label", "category", F.array_join(resolved, ",").alias("resolved"), F.array_join(missing, ",").alias("missing"))


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'z' ELSE 'y,z' END AS outside FROM events WHERE event_id % 3 <> 1")
def scope_violations(spark, sf_dir):
    k, a = F.col("event_id"), lambda *x: F.array(*map(F.lit, x))
    cited = F.when(k % 3 == 0, a("a", "z")).when(k % 3 == 1, a("b")).otherwise(a("y", "z", "a"))
    return retrieval.scope_violations(t(spark, sf_dir, "events").select("event_id", a("a", "b").alias("allowed"), cited.alias("cited"))).select("event_id", F.array_join("foreign", ",").alias("outside"))


RETRIEVED = f"""WITH {HITS}, allc AS (SELECT query_id, chunk_id, semantic_rank * 1000.0 AS o, false AS near, semantic_rank FROM top
  UNION ALL SELECT t.query_id, e.vec_id, t.semantic_rank * 1000.0 - (t.ordinal - e.vec_id), true, t.semantic_rank FROM top t JOIN embeddings e ON e.label = t.file AND e.vec_id BETWEEN greatest(1, t.ordinal - 1) AND t.ordinal - 1),
once AS (SELECT * FROM allc QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY near, o, semantic_rank) = 1)"""


@register(f"{RETRIEVED} SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY o, chunk_id) AS chunk_ids FROM once GROUP BY 1")
def retrieved_evidence(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return pipelines.retrieve(q, c).select("query_id", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


@register("SELECT item_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'CITES_OUTSIDE' ELSE 'questionText' END AS problems FROM benchmark")
def generated_questions(spark, sf_dir):
    k, a = F.col("item_id"), lambda *x: F.array(*map(F.lit, x))
    ids = a("aaaaaaaa-aaaa-4aaa-8aaa-aaaaaaaaaaaa")
    design = F.struct(
        F.lit("PREREQUISITE_RELATIONSHIP").alias("benchmarkType"), F.lit("cross_unit_transfer").alias("taskType"), F.lit("motion").alias("targetConcept"),
        F.array(F.struct(F.lit("force").alias("concept"), F.lit("cause of it").alias("role"), ids.alias("evidenceChunkIds"))).alias("prerequisiteConcepts"),
        F.array(F.struct(F.lit("force").alias("fromConcept"), F.lit("motion").alias("toConcept"), F.lit("REQUIRES").alias("relationType"), F.lit("because").alias("explanation"), ids.alias("evidenceChunkIds"))).alias("prerequisiteRelations"),
        a("one step", "another").alias("requiredReasoningSteps"), a("guessing").alias("failureSignals"),
    )
    raw = F.to_json(F.struct(F.when(k % 3 == 2, "no").otherwise(F.col("text")).alias("questionText"), F.lit("y").alias("answerText"), ids.alias("evidenceChunkIds"), design.alias("benchmarkDesign")))
    b = t(spark, sf_dir, "benchmark")
    answers = b.select("item_id", k.alias("query_id"), raw.alias("raw"), F.when(k % 3 == 1, a("c1", "c9")).otherwise(a("c1")).alias("cited"), F.lit("서술형").alias("question_type"))
    return pipelines.generated_questions(answers, b.select(k.alias("query_id"), a("c1", "c2").alias("chunk_ids"))).select("item_id", F.array_join("problems", ",").alias("problems"))


@register("""WITH m AS (SELECT r_name AS model_id, 'M0' || CAST(r_regionkey + 1 AS VARCHAR) AS blind_id FROM region), d AS (SELECT unnest(['NONE', 'VECTOR', 'PIKE']) AS mode)
SELECT item_id AS question_id, model_id, blind_id, mode, CASE WHEN mode = 'NONE' OR item_id % 2 = 0 THEN 'PENDING' ELSE 'REJECTED' END AS state FROM benchmark CROSS JOIN m CROSS JOIN d""")
def created_run(spark, sf_dir):
    m = t(spark, sf_dir, "region").select(F.col("r_name").alias("model_id"), F.col("r_regionkey").alias("position"))
    modes = spark.range(1).select(F.explode(F.array(F.lit("NONE"), F.lit("VECTOR"), F.lit("PIKE"))).alias("mode"))
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    return pipelines.create_run(q, m, modes, q.where("question_id % 2 = 0")).drop("position")


@register("""SELECT item_id, mode, '교과서 검색 근거는 제공되지 않습니다. 모델 자체 지식만 사용해 답하십시오.' || chr(10) || chr(10) || '[질문]' || chr(10) || text AS prompt, 'yes' AS normalized_text FROM (SELECT *, 'NONE' AS mode FROM benchmark)
UNION ALL SELECT item_id + 1000000, 'VECTOR', '단순 벡터 검색으로 찾은 교과서 근거만 사용하십시오.' || chr(10) || chr(10) || 'e' || CAST(item_id AS VARCHAR) || chr(10) || chr(10) || '[질문]' || chr(10) || text, NULL FROM benchmark""")
def executed_items(spark, sf_dir):
    ship(spark)
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.array().cast("array<string>").alias("options"))
    items = b.select(F.col("question_id").alias("item_id"), "*", F.lit("NONE").alias("mode")).unionByName(b.select((F.col("question_id") + 1_000_000).alias("item_id"), "*", F.lit("VECTOR").alias("mode")))
    snapshots = b.select("question_id", F.lit("VECTOR").alias("mode"), F.array(F.concat(F.lit("e"), F.col("question_id").cast("string"))).alias("evidence"))
    answers = b.select(F.col("question_id").alias("item_id"), F.lit("  yes\r\n").alias("answer"))
    return pipelines.execute_items(items, snapshots, answers).select("item_id", "mode", "prompt", "normalized_text")


@register("""SELECT p_partkey AS response_id, 3 AS required, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS scored, CAST(p_size * 3000.0 / 1e6 AS DOUBLE) AS cost_native FROM part""")
def scored_run(spark, sf_dir):
    k = F.col("p_partkey")
    r = t(spark, sf_dir, "part").select(
        k.alias("response_id"), F.array(F.lit("exact_match"), F.lit("accuracy"), F.lit("faithfulness")).alias("profile_metrics"), F.lit("SHORT_ANSWER").alias("question_type"), F.col("p_name").alias("text"),
        F.lit("m-1").alias("model_id"), (F.col("p_size") * 1000).cast("double").alias("input_tokens"), (F.col("p_size") * 500).cast("double").alias("output_tokens"),
    )
    one = lambda m: f'{{"metricKey":"{m}","value":"0.5"}}'
    k = F.col("response_id")
    raw = F.when(k % 3 == 0, f'ok {{"scores":[{one("accuracy")},{one("faithfulness")}]}}').when(k % 3 == 1, f'{{"scores":[{one("accuracy")},{one("other")}]}}').otherwise("no answer")
    prices = spark.createDataFrame([(1, "m-%", "2024-01-01", 2.0, 2.0, None), (2, "%", "2023-01-01", 9.0, 9.0, None)], "price_id int, model_pattern string, valid_from string, price_in double, price_out double, rate double")
    out = pipelines.score_run(r, r.select("response_id", raw.alias("raw")), prices)
    return out["pairs"].join(out["costs"].select("response_id", "cost_native"), "response_id").select("response_id", F.col("required").cast("int").alias("required"), F.col("scored").cast("int").alias("scored"), "cost_native")


@register("""WITH i AS (SELECT o_orderkey AS id, o_custkey % 5 AS model, o_orderstatus AS mode, o_orderpriority AS code, 'order ' || CAST(o_orderkey AS VARCHAR) AS message, o_orderdate AS seen,
  CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' WHEN o_orderkey % 7 = 0 THEN 'TERMINAL_FAILED' ELSE 'SUCCEEDED' END AS state, CAST(o_totalprice AS DECIMAL(18,2)) AS cost FROM orders),
g AS (SELECT model, mode, code AS error_code, count(*) AS failures, arg_max(message, (seen, id)) AS message, max(seen) AS latest FROM i WHERE state <> 'SUCCEEDED' GROUP BY ALL),
w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY model, mode ORDER BY failures DESC, latest DESC, error_code) = 1),
e AS (SELECT model, mode, count(*) AS total, count(*) FILTER (state = 'SUCCEEDED') AS succeeded, count(*) FILTER (state <> 'SUCCEEDED') AS failed, count(*) AS responses, CAST(sum(cost) AS DOUBLE) AS cost FROM i GROUP BY ALL)
SELECT e.*, error_code, failures, message FROM e LEFT JOIN w USING (model, mode)""")
def result_details(spark, sf_dir):
    k = F.col("o_orderkey")
    i = t(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 5).alias("model"), F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("code"), F.concat(F.lit("order "), k.cast("string")).alias("message"), F.col("o_orderdate").alias("at"),
        F.when(k % 3 == 0, "FAILED").when(k % 7 == 0, "TERMINAL_FAILED").otherwise("SUCCEEDED").alias("state"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(1.0).alias("latency_ms"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"),
    )
    return doubles(pipelines.result_details(i, i, ["model", "mode"]).select("model", "mode", "total", "succeeded", "failed", "responses", "cost", "error_code", "failures", "message"))


@register("""WITH live AS (SELECT * FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 3), found AS (SELECT item_id AS question_id FROM live WHERE text ILIKE '%th%' AND item_id % 2 = 0)
SELECT (SELECT count(*) FROM found) AS total, p.question_id, coalesce((SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_returnflag) FROM lineitem WHERE l_orderkey = p.question_id), '') AS evidence
FROM (SELECT 1) one LEFT JOIN (SELECT * FROM found ORDER BY question_id LIMIT 20) p ON true""")
def audited_page(spark, sf_dir):
    k = F.col("item_id")
    b = t(spark, sf_dir, "benchmark").select(k.alias("id"), k.alias("question_id"), "text", F.when(k % 2 == 0, "exam").otherwise("drill").alias("purpose"), F.when(k % 5 != 0, "APPROVED").otherwise("DRAFT").alias("status"), F.lit(None).alias("deleted_at"))
    revisions = t(spark, sf_dir, "benchmark").select(k.alias("question_id"), F.when(k % 7 == 3, "sample").otherwise("real").alias("provider"), F.lit("m").alias("model_id"))
    evidence = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("quote"))
    out = pipelines.audited_page(b, revisions, evidence, "th", {"purpose": "exam"})
    return out.select("total", "question_id", F.array_join(F.transform("evidence", lambda e: e.chunk_id.cast("string")), ",").alias("evidence"))


@register(f"""WITH {EVENTS}, j AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'LEASED' ELSE 'RETRY_WAIT' END AS state, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS until FROM orders),
s AS (SELECT 'system' AS part, (SELECT max(event_id) FROM events) AS a, count(*) FILTER (state = 'PENDING') AS b, count(*) FILTER (state = 'LEASED' AND until > TIMESTAMP '1995-06-01') AS c, count(*) FILTER (state = 'LEASED' AND (until IS NULL OR until <= TIMESTAMP '1995-06-01')) AS d FROM j),
o AS (SELECT (['PARSING', 'CHUNKING', 'DIRECTION', 'RETRIEVAL', 'SCORING', 'QUEUE'])[event_id % 6 + 1] AS stage, CASE event_id % 4 WHEN 0 THEN 'STALE' ELSE 'RUNNING' END AS state FROM events),
k AS (SELECT *, CASE stage WHEN 'PARSING' THEN 'PARSE' WHEN 'CHUNKING' THEN 'CHUNK' WHEN 'DIRECTION' THEN 'GENERATE' WHEN 'RETRIEVAL' THEN 'GENERATE' WHEN 'SCORING' THEN 'SCORE' END AS key FROM o),
st AS (SELECT v.key, v.i, count(k.key) FILTER (k.state <> 'STALE') AS active, count(k.key) AS failed FROM (VALUES (0, 'UPLOAD'), (1, 'PARSE'), (2, 'CHUNK'), (3, 'EMBED'), (4, 'GENERATE'), (5, 'REVIEW'), (6, 'FREEZE'), (7, 'EXECUTE'), (8, 'SCORE')) v(i, key) LEFT JOIN k USING (key) GROUP BY ALL)
SELECT part, a, b, c, d, CASE WHEN d > 0 THEN 'STALE' WHEN c > 0 THEN 'HEALTHY' ELSE 'IDLE' END AS name FROM s
UNION ALL SELECT 'stage', i, active, failed, CASE key WHEN 'REVIEW' THEN 11 ELSE 0 END, key FROM st
UNION ALL SELECT 'event', event_id, 0, 0, 0, CASE event_type WHEN 'RUN_ITEM_COMPLETED' THEN 'BENCHMARK SUCCEEDED' WHEN 'DOCUMENT_PARSE_FAILED' THEN 'PARSING FAILED' WHEN 'QUESTION_CREATED' THEN 'SYSTEM PENDING' WHEN 'JOB_HEARTBEAT' THEN 'QUEUE INFO' ELSE 'SYSTEM INFO' END FROM (SELECT * FROM ev ORDER BY event_id DESC LIMIT 100)""")
def control_room_snapshot(spark, sf_dir):
    s, k = F.col("o_orderstatus"), F.col("event_id")
    jobs = t(spark, sf_dir, "orders").select(F.when(s == "P", "PENDING").when(s == "O", "LEASED").otherwise("RETRY_WAIT").alias("state"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("lease_expires_at"))
    log = events(spark, sf_dir)
    operations = log.select(F.get(F.array(*map(F.lit, ["PARSING", "CHUNKING", "DIRECTION", "RETRIEVAL", "SCORING", "QUEUE"])), (k % 6).cast("int")).alias("stage"), F.when(k % 4 == 0, "STALE").otherwise("RUNNING").alias("state"))
    ready = spark.createDataFrame([("REVIEW", 11)], "stage string, n long")
    out = pipelines.control_room_snapshot(jobs, jobs.limit(0), log.select("event_id", "event_type"), operations, operations, ready, "1995-06-01 00:00:00")
    part = lambda name, df, *c: df.select(F.lit(name).alias("part"), *[F.lit(x).cast("long").alias(n) if isinstance(x, int) else F.col(x).cast("long").alias(n) for n, x in zip("abcd", c[:4])], c[4].alias("name"))
    rows = part("system", out["system"], "event_cursor", "pending", "active_leases", "stale_leases", F.col("worker"))
    rows = rows.unionByName(part("stage", out["stages"], "position", "active", "failed", "ready", F.col("key")))
    return rows.unionByName(part("event", out["events"], "event_id", 0, 0, 0, F.concat_ws(" ", "stage", "state")))


@register("""WITH p AS (SELECT o_custkey % 7 AS lane, count(*) AS total FROM orders GROUP BY 1), r AS (SELECT o_orderkey, o_custkey % 7 AS lane, 2 AS required, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS scored FROM orders),
x AS (SELECT c_custkey % 7 AS lane, count(*) AS receipts FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey - c_custkey % 4 IN (SELECT c_custkey FROM customer) GROUP BY 1)
SELECT lane, total, required, scored, coalesce(receipts, 0) AS receipts FROM p JOIN (SELECT lane, CAST(sum(required) AS BIGINT) AS required, CAST(sum(scored) AS BIGINT) AS scored FROM r GROUP BY 1) USING (lane) LEFT JOIN x USING (lane)""")
def run_details(spark, sf_dir):
    o, k, c = t(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("c_custkey")
    items = o.select((F.col("o_custkey") % 7).alias("lane"), F.lit("SUCCEEDED").alias("state"), F.lit("NONE").alias("mode"))
    responses = o.select(k.alias("response_id"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("required"))
    scores = o.where("o_orderkey % 2 = 0").select(k.alias("response_id"), F.lit("a").alias("metric_key"), F.lit(1.0).alias("value"))
    receipts = t(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 4 != 0, c - c % 4).alias("shared_from"), F.when(c % 4 == 0, F.col("c_name")).alias("context"), F.lit("h").alias("config_hash"))
    out = pipelines.run_details(items, responses, scores, receipts, ["lane"])
    lanes = o.select(k.alias("response_id"), (F.col("o_custkey") % 7).alias("lane"))
    pairs = out["pairs"].join(lanes, "response_id").groupBy("lane").agg(F.sum("required").alias("required"), F.sum("scored").alias("scored"))
    told = out["retrievals"].where("shared_from is not null and context is not null").groupBy((F.col("id") % 7).alias("lane")).agg(F.count(F.lit(1)).alias("receipts"))
    return out["progress"].select("lane", "total").join(pairs, "lane").join(told, "lane", "left").fillna(0, ["receipts"])


@register("""WITH a AS (SELECT l_orderkey AS item_id, l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 'FAILED' WHEN 'N' THEN 'PERSISTED' ELSE 'REQUESTED' END AS state FROM lineitem)
SELECT o_orderkey AS item_id, l.attempt, l.state AS last_state, c.failed FROM orders JOIN (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt DESC) = 1) l ON l.item_id = o_orderkey
JOIN (SELECT item_id, count(*) FILTER (state = 'FAILED') AS failed FROM a GROUP BY 1) c ON c.item_id = o_orderkey WHERE o_orderstatus <> 'F'""")
def generation_activity(spark, sf_dir):
    """Of attempts with the same number the one that stands first in the table counts."""
    flag = F.col("l_returnflag")
    lines = t(spark, sf_dir, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index")
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("file_path", "row_index")))
    attempts = lines.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("attempt"), (-F.col("place")).alias("id"), F.when(flag == "A", "FAILED").when(flag == "N", "PERSISTED").otherwise("REQUESTED").alias("state"))
    items = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit(1).alias("batch"), F.col("o_orderkey").alias("ordinal"), F.lit(None).cast("string").alias("error"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("state"))
    out = pipelines.generation_activity(items, attempts, "batch")
    return out["resumable"].where("attempt is not null").join(out["calls"].select("item_id", "failed"), "item_id").select("item_id", "attempt", "last_state", "failed")


@register("""SELECT o_custkey % 40 AS sha256, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0
QUALIFY row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY (o_orderkey % 2 = 0) DESC, o_orderdate DESC, o_orderkey DESC) = 1""")
def compatible_sources(spark, sf_dir):
    k = F.col("o_orderkey")
    s = t(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 40).alias("sha256"), F.when(k % 2 != 0, F.lit("2024")).alias("deleted_at"), F.col("o_orderdate").alias("created_at"), F.lit("AT_CREATION_VERIFIED").alias("parse_provenance"),
        F.when(k % 3 == 0, "AT_CREATION_VERIFIED").otherwise("LEGACY_BACKFILL_UNVERIFIED").alias("embed_provenance"), F.col("o_orderstatus").alias("parse_hash"), F.lit("e").alias("embed_hash"),
    )
    active = spark.createDataFrame([("document_parse", "O"), ("embedding_rag", "e")], "kind string, content_hash string")
    return pipelines.compatible_sources(s, active).select("sha256", "id")


@register("""SELECT n_nationkey AS id, sha256('{"a": 1, "bb": ' || CAST(n_nationkey AS VARCHAR) || '}') AS content_hash, n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey) AS active FROM nation""")
def activated_profiles(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("kind"), F.concat(F.lit('{"bb":'), F.col("n_nationkey").cast("string"), F.lit(',"a":1}')).alias("config"))
    return pipelines.activated_profiles(n, n.select("kind", F.col("id").alias("profile_id"), F.col("id").alias("activated_at"))).select("id", "content_hash", "active")


@register("""SELECT o_custkey, sha256('[' || string_agg('{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || '}', ',' ORDER BY o_orderkey) || ']') AS content_hash, CAST(o_custkey % 3 + 1 AS INT) AS version FROM orders GROUP BY o_custkey""")
def published_versions(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    made = o.where("o_custkey % 3 > 0").select("o_custkey", (F.col("o_custkey") % 3).cast("int").alias("version")).distinct()
    return pipelines.publish(o, made, "o_custkey", ["o_orderkey"], "o_orderkey").select("o_custkey", "content_hash", F.col("version").cast("int").alias("version"))


@register()
def processed_documents(spark, sf_dir):
    """Pages to chunks with vectors, contents and their mapping; held against the parts by tests."""
    ship(spark)
    p = t(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("book"), (F.col("page_id") % 5 + 1).cast("int").alias("page"), F.regexp_replace(F.regexp_replace("html", "<ul>", '<ul class="toc">'), "</li>", " 12</li>\n").alias("html"))
    out = pipelines.process_documents(p, "book", "page", 60)
    chunks = out["chunks"].groupBy("book").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("embedding")).alias("numbers"))
    return chunks.join(out["toc"].groupBy("book").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("mapping_status") == "MAPPED").alias("mapped")), "book", "left")


@register()
def placed_contents(spark, sf_dir):
    """Contents placed by the printed pages of the footers, ten more than the documents' own: book, entry, chunk, relation, confidence."""
    ship(spark)
    n = (F.col("page_id") % 8 + 1).cast("int")
    numbered = F.concat(F.lit(" "), (n + 10).cast("string"), F.lit("</li>\n"))
    p = t(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 8).cast("long").alias("book"), n.alias("page"), F.replace(F.regexp_replace("html", "<ul>", '<ul class="toc">'), F.lit("</li>"), numbered).alias("html"))
    layout = p.select("book", F.col("page").alias("document_page"), F.lit("Footer").alias("category"), F.concat(F.lit("Book "), (F.col("page") + 10).cast("string")).alias("text"), F.lit(0.9).alias("center_x"))
    return pipelines.process_documents(p, "book", "page", 60, layout=layout)["mappings"]


@register()
def text_coverage(spark, sf_dir):
    """Share of a text's own bigrams in itself and the length of its stand-in vector."""
    ship(spark)
    d = t(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", bigram_coverage(F.col("text"), F.col("text")).alias("own"), F.size(bigram_embedding(16)(F.col("text"))).alias("dims"))


_CELL = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@register(f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || repeat(',', 9) || CASE WHEN turn % 2 = 0 THEN {_CELL.format("r")} ELSE '' END || repeat(',', 29) || {_CELL.format("x")} || repeat(',', 9) || {_CELL.format("('{' || chr(34) || 't' || chr(34) || ':' || CAST(turn AS VARCHAR) || '}')")} || repeat(',', 4) AS line FROM c""".replace("\\\\", "\\"))
def export_lines(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_item_id"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("state"), F.col("text").alias("normalized_text"), F.struct(F.col("turn").alias("t")).alias("scores")
    )
    return sinks.csv_lines(sinks.export_columns(c))


@register("SELECT count(*) FILTER (l_returnflag <> 'R') AS eligible, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS open FROM lineitem")
def eligible_counts(spark, sf_dir):
    """Two counts of the same kept rows."""
    r = t(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("ignored_after_cancel"), "l_linestatus")
    kept = tables.snapshot(tables.eligible_responses(r))
    return kept.agg(F.count(F.lit(1)).alias("eligible")).crossJoin(kept.agg(F.count_if(F.col("l_linestatus") == "O").alias("open")))  # one row each


@register("""WITH f AS (SELECT doc_id, strlen(text) AS bytes, CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' END AS mime FROM documents ), a AS (SELECT sum(bytes) AS b, count(*) AS n FROM f)
SELECT doc_id, mime IS NOT NULL AND bytes <= 4000 AND b <= 64000000 AND n <= 1000000 AS accepted FROM f, a""")
def lab_files(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.when(F.col("doc_id") % 3 == 0, "application/pdf").alias("mime"))
    return tables.lab_files(d, 4000, 64_000_000, 1_000_000).select("doc_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"prerequisiteConcepts":[],"prerequisiteRelations":[],"requiredReasoningSteps":[],"failureSignals":[]}'
WHEN 2 THEN '{"taskType":"t","targetConcept":"' || event_type || '","prerequisiteConcepts":[{"concept":"c","role":"—","evidenceChunkIds":["x"]},{"concept":"—","role":"—","evidenceChunkIds":[]}],"prerequisiteRelations":[],"requiredReasoningSteps":["a"],"failureSignals":[]}' END AS design FROM events""")
def shown_designs(spark, sf_dir):
    k = F.col("event_id")
    raw = (
        F.when(k % 4 == 0, "{}").when(k % 4 == 1, '{"benchmarkDesign":{"targetConcept":"","failureSignals":"x"}}')
        .when(k % 4 == 2, F.concat(F.lit('{"benchmarkDesign":{"benchmarkType":7,"taskType":"t","targetConcept":"'), F.col("event_type"), F.lit('","prerequisiteConcepts":[{"concept":"c","role":null,"evidenceChunkIds":["x",1]},5],"requiredReasoningSteps":["a",2]}}')))
        .otherwise('{"benchmarkDesign":[1]}')
    )
    return t(spark, sf_dir, "events").select("event_id", F.to_json(integrity.design_normalised(raw)).alias("design"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS begun, count(*) AS n FROM s GROUP BY user_id, session""")
def streamed_sessions(spark, sf_dir):
    w = feed.drain(feed.session_counts(_stream(spark, sf_dir), "user_id", late="3650 days"), "streamed_sessions", "complete")
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("begun"), "n")


@register("""WITH b AS (SELECT c_custkey AS batch_id, c_custkey % 7 + 1 AS requested FROM customer),
i AS (SELECT o_custkey AS batch_id, o_orderkey % 9 + 1 AS ordinal, min(o_orderkey) AS k FROM orders GROUP BY ALL),
s AS (SELECT batch_id, ordinal, k, (['COMPLETED', 'RUNNING', 'FAILED', 'FAILED', 'PENDING'])[k % 5 + 1] AS state, k % 5 = 2 AND k % 2 = 0 AS retryable,
  CASE WHEN k % 5 IN (2, 3) THEN CASE WHEN k % 3 = 0 THEN 'PARSE' ELSE 'OTHER' END END AS code, CASE WHEN k % 4 < 2 THEN 'finishReason=MAX_TOKENS.' ELSE 'finishReason=MAX TOKENS' END AS message FROM i),
w AS (SELECT batch_id, unnest(range(1, requested + 1)) AS ordinal FROM b),
h AS (SELECT batch_id, ordinal, coalesce(state, 'MISSING') AS before, CASE WHEN state = 'RUNNING' AND NOT (k % 3 = 1 AND batch_id % 11 = 0) THEN 'FAILED' ELSE coalesce(state, 'PENDING') END AS now,
  coalesce(state = 'RUNNING' AND NOT (k % 3 = 1 AND batch_id % 11 = 0), false) AS orphan, coalesce(retryable, false) OR coalesce(state = 'FAILED' AND NOT retryable AND code = 'PARSE' AND contains(message, 'finishReason=MAX_TOKENS'), false) AS retry, code
  FROM w FULL JOIN s USING (batch_id, ordinal)),
c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (now = 'COMPLETED') AS done, count(*) FILTER (now = 'PENDING' OR now = 'FAILED' AND (retry OR orphan)) AS open FROM h GROUP BY 1),
o AS (SELECT batch_id, CASE WHEN batch_id % 11 = 0 AND EXISTS (SELECT 1 FROM i WHERE i.batch_id = c.batch_id AND i.k % 3 = 1) THEN 'active' WHEN done = total THEN 'complete' WHEN open = 0 THEN 'no-retryable' ELSE 'resumed' END AS outcome FROM c)
SELECT batch_id, CAST(ordinal AS BIGINT) AS ordinal, outcome, before, CASE WHEN outcome <> 'resumed' THEN before WHEN now = 'FAILED' AND (retry OR orphan) THEN 'PENDING' ELSE now END AS after,
  (['dependency_application', 'missing_prerequisite_diagnosis', 'cross_unit_transfer', 'relation_direction_discrimination', 'prerequisite_chain_completion'])[(ordinal - 1) % 5 + 1] AS task FROM h JOIN o USING (batch_id)""")
def resume_plans(spark, sf_dir):
    """Batches with ordinals missing at both ends, items whose jobs lost their leases, and failures of both kinds."""
    batches = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch_id"), (F.col("c_custkey") % 7 + 1).alias("requested"))
    i = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch_id"), (F.col("o_orderkey") % 9 + 1).alias("ordinal")).agg(F.min("o_orderkey").alias("k"))
    k = F.col("k")
    state = F.get(F.array(*map(F.lit, ["COMPLETED", "RUNNING", "FAILED", "FAILED", "PENDING"])), (k % 5).cast("int"))
    items = i.select(
        "batch_id", "ordinal", state.alias("state"), ((k % 5 == 2) & (k % 2 == 0)).alias("retryable"), F.when((k % 5).isin(2, 3), F.when(k % 3 == 0, "PARSE").otherwise("OTHER")).alias("error_code"),
        F.when(k % 4 < 2, "finishReason=MAX_TOKENS.").otherwise("finishReason=MAX TOKENS").alias("error_message"), k.alias("job_id"), F.lit(1).alias("job_attempt"),
    )
    jobs = i.where("k % 3 = 1").select(k.alias("job_id"), "batch_id", F.lit("LEASED").alias("state"), F.lit(1).alias("attempts"), F.when(F.col("batch_id") % 11 == 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("timestamp").alias("lease_expires_at"))
    out = pipelines.resume_plan(batches, items, jobs, "2024-01-01 12:00:00")
    return out["items"].join(out["batches"].select("batch_id", "outcome"), "batch_id").select("batch_id", F.col("ordinal").cast("long").alias("ordinal"), "outcome", "before", "after", "task")


@register("""WITH n AS (SELECT p_partkey AS response_id, unnest(['response_present', 'accuracy', 'faithfulness']) AS metric_key, p_partkey % 3 AS k, p_partkey % 4 AS g FROM part),
x AS (SELECT response_id, metric_key = 'response_present' OR (metric_key = 'accuracy' AND k < 2) OR (metric_key = 'faithfulness' AND k = 0) AS have, metric_key IN ('accuracy', 'faithfulness') AND g = 1 AS lost FROM n)
SELECT response_id, count(*) AS required, count(*) FILTER (have) AS scored, count(*) FILTER (NOT have AND lost) AS terminal, count(*) FILTER (have OR lost) = count(*) AS done FROM x GROUP BY 1""")
def scoring_states(spark, sf_dir):
    """Responses whose judge answered, gave up after three charged failures, or may still answer."""
    r = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("response_id"), F.array(F.lit("accuracy"), F.lit("faithfulness")).alias("profile_metrics"), F.lit("SHORT_ANSWER").alias("question_type"), F.col("p_name").alias("text"),
        F.lit("m-1").alias("model_id"), F.lit(1.0).alias("input_tokens"), F.lit(1.0).alias("output_tokens"))
    k = F.col("response_id")
    one = lambda m: f'{{"metricKey":"{m}","value":0.5}}'
    raw = F.when(k % 3 == 0, f'{{"scores":[{one("accuracy")},{one("faithfulness")}]}}').when(k % 3 == 1, f'{{"scores":[{one("accuracy")}]}}').otherwise("none")
    # one charged failure too few, enough of them, one of them free of charge, and a last call that went well
    attempt = F.explode(F.sequence(F.lit(1), F.when(k % 4 == 0, 2).otherwise(3)))
    calls = r.select("response_id", attempt.alias("attempt")).select(
        "response_id", F.lit("judge").alias("logical_key"), F.when((k % 4 == 3) & (F.col("attempt") == 3), "PERSISTED").otherwise("FAILED").alias("state"),
        F.when((k % 4 == 2) & (F.col("attempt") == 2), "RATE_LIMIT").alias("error_code"), F.array(F.lit("accuracy"), F.lit("faithfulness")).alias("metrics"), "attempt", F.lit("2024-01-01").alias("created_at"), F.col("attempt").alias("id"),
    )
    prices = spark.createDataFrame([(1, "%", "2024-01-01", 2.0, 2.0, None)], "price_id int, model_pattern string, valid_from string, price_in double, price_out double, rate double")
    return pipelines.score_run(r, r.select("response_id", raw.alias("raw")), prices, calls)["state"]


@register("""WITH s AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS run_id, o_orderstatus AS blind_id, o_orderpriority AS metric_key, CAST(o_orderkey % 11 AS DOUBLE) AS value FROM orders),
b AS (SELECT run_id, blind_id, metric_key, avg(value) AS mean, count(*) AS scored FROM s GROUP BY ALL), e AS (SELECT run_id, blind_id, count(*) AS eligible FROM s GROUP BY ALL),
j AS (SELECT user_id AS a, event_id AS id, ts AS seen, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS p FROM events), a AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY a ORDER BY p, seen DESC, id) = 1)
SELECT 'active' AS part, CAST(id AS VARCHAR) AS id, CASE p WHEN 0 THEN 'PARSING' ELSE 'BENCHMARK' END AS name, CAST(0 AS DOUBLE) AS value, 0 AS n FROM (SELECT * FROM a ORDER BY seen DESC, id LIMIT 50)
UNION ALL SELECT 'failure', CAST(event_id AS VARCHAR), CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' ELSE event_type END, 0, 0 FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)
UNION ALL SELECT 'score', run_id || blind_id, metric_key, round(mean, 9), eligible FROM (SELECT * FROM b JOIN e USING (run_id, blind_id) ORDER BY run_id, blind_id, metric_key LIMIT 200)""")
def control_room_lists(spark, sf_dir):
    """The control room's lists: active operations, latest failures, scoreboard."""
    e, o = t(spark, sf_dir, "events"), t(spark, sf_dir, "orders")
    operation = e.select(F.col("user_id").alias("aggregate_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "PARSING").otherwise("BENCHMARK").alias("stage"))
    work = operation.where("stage = 'PARSING'"), operation.where("stage = 'BENCHMARK'")
    failures = e.select(F.lit("PARSING").alias("stage"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_type")).alias("code"), F.lit("m").alias("message"), F.col("ts").alias("at"))
    s = o.select((F.col("o_custkey") % 5).cast("string").alias("run_id"), F.col("o_orderstatus").alias("blind_id"), F.col("o_orderpriority").alias("metric_key"), (F.col("o_orderkey") % 11).cast("double").alias("value"))
    jobs = o.select(F.lit("PENDING").alias("state"), F.col("o_orderdate").alias("lease_expires_at"))
    ready = spark.createDataFrame([("REVIEW", 1)], "stage string, n long")
    out = pipelines.control_room_snapshot(jobs, jobs.limit(0), events(spark, sf_dir).select("event_id", "event_type"), operation.select("stage", F.lit("RUNNING").alias("state")), failures, ready, "1995-06-01 00:00:00", work=work, scores=(s, s))
    row = lambda part, df, key, name, value, n: df.select(F.lit(part).alias("part"), key.cast("string").alias("id"), F.col(name).alias("name"), value.alias("value"), n.cast("long").alias("n"))
    zero = F.lit(0.0)
    rows = row("active", out["active"], F.col("id"), "stage", zero, F.lit(0)).unionByName(row("failure", out["failures"], F.col("id"), "code", zero, F.lit(0)))
    return rows.unionByName(row("score", out["scoreboard"], F.concat("run_id", "blind_id"), "metric_key", F.round("mean", 9), F.col("eligible")))


@register("""SELECT o_custkey % 5 AS model, o_orderstatus AS mode, string_agg(metric || '=' || CAST(n AS VARCHAR) || ':' || CAST(CAST(round(mean * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY metric) AS metrics
FROM (SELECT o_custkey % 5 AS o_custkey, o_orderstatus, o_orderpriority AS metric, count(*) AS n, avg(o_orderkey % 7) AS mean FROM orders GROUP BY ALL) GROUP BY 1, 2""")
def result_metrics(spark, sf_dir):
    """Result details with the means by metric beside them."""
    o = t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("model"), F.col("o_orderstatus").alias("mode"), F.lit("C").alias("code"), F.lit("m").alias("message"), F.col("o_orderdate").alias("at"), F.lit("SUCCEEDED").alias("state"),
        F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(1.0).alias("latency_ms"), F.lit(1.0).alias("cost"), F.col("o_orderpriority").alias("metric_key"), (F.col("o_orderkey") % 7).cast("double").alias("value"),
    )
    told = lambda m: F.concat(m.metric_key, F.lit("="), m.n.cast("string"), F.lit(":"), F.round(m["mean"] * 1000).cast("long").cast("string"))
    out = pipelines.result_details(o, o, ["model", "mode"], o.select("model", "mode", "metric_key", "value"))
    return out.select("model", "mode", F.array_join(F.transform("metrics", told), ",").alias("metrics"))
