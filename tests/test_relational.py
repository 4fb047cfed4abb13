"""Relational helpers, integrity checks, events, sinks and streams on literal inputs."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars

from lectern.operators import datasets, events, integrity
from lectern.operators import relational as rel
from lectern.sources import sinks, tables
from lectern.streaming import feed


def test_latest_attempt_ignores_cancelled(spark):
    r = spark.createDataFrame(
        [("i", "a", 1, 1, False), ("i", "b", 2, 1, True), ("i", "c", 1, 2, False), ("j", "d", 1, 1, True)], "run_item_id string, id string, attempt int, created_at int, ignored_after_cancel boolean"
    )
    assert [(x.run_item_id, x.id) for x in rel.latest_attempt(r).collect()] == [("i", "c")]


def test_paging(spark, rows):
    d = spark.range(1, 8)
    assert rows(rel.page_with_total(d, [F.asc("id")], 2, 3), "id") == [(7, 4), (7, 5), (7, 6)]
    assert rows(rel.page_with_total(d, [F.asc("id")], 9, 3)) == [(7, None)]
    assert [b for b in map(len, sinks.keyset_batches(d, ["id"], 3))] == [3, 3, 1]


def test_pointers(spark, rows):
    d = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "k int, p int")
    got = {r.k: (r.root, r.state) for r in rel.follow_pointers(d, "k", "p").collect()}
    assert got == {1: (1, "ROOT"), 2: (1, "RESOLVED"), 3: (1, "RESOLVED"), 4: (None, "CYCLE"), 5: (None, "CYCLE"), 6: (None, "DANGLING")}


def test_pointers_of_long_chains_and_incomplete_roots(spark):
    n = 70_000  # more hops than 2**16
    chain = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    last = rel.follow_pointers(chain, "k", "p").where(F.col("k") == n - 1).first()
    assert (last.root, last.hops, last.state) == (0, n - 1, "RESOLVED")
    d = spark.createDataFrame([(1, None, "x", "h"), (2, 1, None, None), (3, None, "x", None), (4, 3, None, None), (5, 4, None, None), (6, 6, "x", "h"), (7, 6, "x", "h")], "k int, p int, body string, digest string")
    got = {r.k: (r.root, r.state) for r in rel.follow_pointers(d, "k", "p", payload=["body", "digest"]).collect()}
    assert got == {1: (1, "ROOT"), 2: (1, "RESOLVED"), 3: (None, "INCOMPLETE"), 4: (None, "INCOMPLETE"), 5: (None, "INCOMPLETE"), 6: (None, "CYCLE"), 7: (None, "CYCLE")}


def test_ancestors_of_deep_trees(spark):
    d = spark.createDataFrame([(k, k - 1 if k else None) for k in range(12)], "k int, p int")
    got = {tuple(r) for r in rel.ancestors(d, "k", "p").collect()}
    assert got == {(k, a, k - a) for k in range(12) for a in range(k)}
    with pytest.raises(ValueError):
        rel.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "k int, p int"), "k", "p").count()


def test_parent_by_level(spark, rows):
    d = spark.createDataFrame([("g", 1, 1), ("g", 2, 2), ("g", 3, 3), ("g", 4, 2), ("g", 5, 1)], "g string, ordinal int, level int")
    assert rows(rel.parent_by_level(d, "g").select("ordinal", "parent_ordinal"), "ordinal") == [(1, None), (2, 1), (3, 2), (4, 1), (5, None)]
    deep = spark.createDataFrame([("g", k, k) for k in range(1, 10)] + [("g", 10, 3)], "g string, ordinal int, level int")
    assert rows(rel.parent_by_level(deep, "g").select("ordinal", "parent_ordinal"), "ordinal") == [(k, k - 1 or None) for k in range(1, 10)] + [(10, 2)]
    assert rel.parent_by_level(deep.where("ordinal = 1"), "g").first().parent_ordinal is None


def test_natural_key_of_long_numbers(spark):
    names = ["Q-10", "Q-2", "Q-9999999999999", "Q-10000000000000", "Q-002", "R"]
    d = spark.createDataFrame([(x,) for x in names], "n string")
    assert [r.n for r in d.orderBy(scalars.natural_key(F.col("n")), F.desc("n")).collect()] == ["Q-2", "Q-002", "Q-10", "Q-9999999999999", "Q-10000000000000", "R"]


def test_later_deadline_wins(spark, rows):
    d = spark.createDataFrame([("p", 5, "x"), ("p", 9, "y"), ("p", 7, "z")], "k string, until int, why string")
    assert rows(rel.later_deadline_wins(d, "k", "until", ["why"])) == [("p", 9, "y", 3)]


def test_densify(spark):
    d = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "p string, m string, n int")
    assert rel.densify(d, [["p"], ["m"]], {"n": 0}).agg(F.sum("n"), F.count("*")).first()[:] == (3, 4)


def test_weights_and_configs(spark):
    d = spark.createDataFrame([('{"a":1,"b":0.5}',), ('{"a":-1}',), ('{"a":"x"}',), ("[1]",), (None,)], "w string")
    assert [r[0] for r in d.select(integrity.weights_valid(F.col("w"))).collect()] == [True, False, False, False, False]
    c = spark.createDataFrame([('{"k":12}',), ('{"k":0}',), ('{"k":1,"x":1}',), ("{}",)], "c string")
    assert [r[0] for r in c.select(integrity.config_valid(F.col("c"), {"k": (1, 50)})).collect()] == [True, False, False, False]


def test_event_names(spark):
    d = spark.createDataFrame(
        [("DOCUMENT_PAGE_PARSE_STARTED", '{"pageNumber":7}', "book.pdf"), ("RUN_SCORING_FAILURE", "{}", None), ("JOB_RELEASED_ON_SHUTDOWN", '{"state":"PENDING"}', ""), ("PROVIDER_NOTE", '{"state":"BLOCKED","message":" wait "}', "run 1"), ("PROVIDER_NOTE", '{"state":1,"message":" "}', None), ("RUN_ITEM_TERMINAL_FAILED", None, None), (None, None, None)],
        "event_type string, payload string, aggregate_label string",
    )
    got = [(r.stage, r.state, r.label, r.summary) for r in feed.described(d).collect()]
    assert got == [
        ("PARSING", "RUNNING", "Document Page Parse Started", "book.pdf · Document Page Parse Started"), ("SCORING", "FAILED", "Run Scoring Failure", "Run Scoring Failure"),
        ("QUEUE", "RETRY_WAIT", "Job Released On Shutdown", "Job Released On Shutdown"), ("SYSTEM", "BLOCKED", "Provider Note", "run 1 · wait"), ("SYSTEM", "INFO", "Provider Note", "Provider Note"),
        ("BENCHMARK", "FAILED", "Run Item Terminal Failed", "Run Item Terminal Failed"), (None, None, None, None),
    ]
    assert feed.described(d.select("event_type")).where("state = 'INFO'").count() == 2


def test_provider_limits(spark):
    texts = {"Requests per day": "RPD", "daily": "RPD", "GenerateTokensPerMinute": "TPM", "tpm per-minute": "TPM", "tokens": "UNKNOWN", "rpm": "RPM", "requests per_minute": "RPM", "rate limit": "UNKNOWN", "a token": "UNKNOWN"}
    d = spark.createDataFrame([(x,) for x in texts], "m string")
    assert {r.m: r.d for r in d.select("m", events.rate_dimension(F.col("m")).alias("d")).collect()} == texts
    body = '{"error":{"details":[{"@type":"x/google.rpc.RetryInfo","retryDelay":"12.0001s"},{"@type":"x/google.rpc.RetryInfo","retryDelay":"soon"},{"@type":"x/google.rpc.QuotaFailure","violations":[{"quotaId":"m","description":"requests per minute"},{"quotaMetric":"d","description":"per day"},{"quotaId":"e","description":"daily"}]}]}}'
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00+00:00"))
    rows = [(body, "30", 30_000), ("oops", "Thu, 01 Jan 2026 00:02:00 GMT", 120_000), ("{}", "Wed, 31 Dec 2025 00:00:00 GMT", 0), ('{"error":{"details":5}}', "99999999999999999999999999", 604_800_000), (None, "later", None), (None, None, None)]
    d = spark.createDataFrame(rows, "body string, header string, wait long")
    got = d.select(events.quota_error(F.col("body")).alias("q"), events.header_wait_ms(F.col("header"), now).alias("w"), "wait").collect()
    assert tuple(got[0].q) == (12_001, "RPD", "d") and all(tuple(r.q) == (None, "UNKNOWN", None) for r in got[1:])
    assert [r.w for r in got] == [r.wait for r in got]
    waits = spark.createDataFrame([(5_000, "RPD"), (None, "RPD"), (None, "TPM"), (0, "RPM"), (10**12, "RPM")], "w long, d string")
    assert [r[0] for r in waits.select(events.cooldown_ms(F.col("w"), F.col("d"))).collect()] == [5_000, 900_000, 120_000, 120_000, 604_800_000]


def test_secrets_are_blotted_out(spark):
    raw = ['{"authorization": "Bearer abc", "x": 1}', "api_key=k1 and API-KEY: k2", "key S3CRET here S3CRET", "x" * 900]
    d = spark.createDataFrame([(x,) for x in raw], "t string")
    got = [r[0] for r in d.select(scalars.redacted(F.col("t"), F.lit("S3CRET"))).collect()]
    assert got == ['{"authorization [REDACTED]", "x": 1}', "api_key [REDACTED] and API-KEY [REDACTED]", "key [REDACTED] here [REDACTED]", "x" * 500]
    assert d.select(scalars.redacted(F.col("t"), F.lit(""))).collect()[2][0] == raw[2]


def test_shown_payload(spark):
    raw = '{"chunks":[{"chunkId":"a","rank":1,"page":2,"unit":"u","source":"s","similarity":0.5,"semanticRank":1,"anchorChunkId":"b","content":"no"},{"rank":1}],"selectedChunkIds":["z","a",1],"prompt":"no","attempt":2}'
    d = spark.createDataFrame([("generation", "QUESTION_RETRIEVAL_COMPLETED", raw), ("source", "QUESTION_RETRIEVAL_COMPLETED", raw), ("generation", "QUESTION_CREATED", raw), ("generation", "QUESTION_RETRIEVAL_COMPLETED", '{"chunkCount":1.5,"chunks":"x"}')], "a string, k string, p string")
    got = [json.loads(r[0]) for r in d.select(events.shown_payload(F.col("a"), F.col("k"), F.col("p"))).collect()]
    assert got[0] == {"attempt": 2, "chunkCount": 2, "selectedChunkIds": ["z", "a"], "chunks": [{"chunkId": "a", "rank": 1, "page": 2, "unit": "u", "source": "s", "similarity": 0.5, "semanticRank": 1, "anchorChunkId": "b"}]}
    assert got[1] == got[2] == json.loads(raw) and got[3] == {"chunkCount": 1.5, "selectedChunkIds": [], "chunks": []}


def test_judge_calls_and_failed_documents(spark, rows):
    log = spark.createDataFrame([("c", 1, "REQUESTED"), ("c", 2, "RESPONSE_RECEIVED"), ("c", 3, "PERSISTED"), ("c", 4, "FAILED")], "call string, at int, state string")
    assert rows(integrity.illegal_transitions(log, "call", "state", ["at"], integrity.JUDGE_TRANSITIONS).select("before", "state"), "before") == [("PERSISTED", "FAILED"), ("RESPONSE_RECEIVED", "PERSISTED")]
    assert ("FAILED", "CHUNKING") in integrity.DOCUMENT_TRANSITIONS and ("FAILED", "READY") not in integrity.DOCUMENT_TRANSITIONS


def test_hash_depends_on_order_and_fields(spark):
    d = spark.createDataFrame([("v", 1, "a"), ("v", 2, "b")], "v string, ordinal int, question_id string")
    a = datasets.content_hash(d, "v", ["ordinal", "question_id"], "ordinal").first().content_hash
    b = datasets.content_hash(d, "v", ["question_id", "ordinal"], "ordinal").first().content_hash
    assert a != b and len(a) == 64


def test_files_blobs_and_csv(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"plain")
    got = {r.path[-5:]: (r.mime, r.accepted) for r in tables.uploaded_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", True), "b.txt": (None, None)}
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, body string")
    assert sinks.write_blobs(d, "body", str(tmp_path / "blobs")) == 1
    assert sinks.blob_store(spark, str(tmp_path / "blobs")).read().count() == 1
    sinks.write_csv(d.withColumn("j", F.struct("id")), str(tmp_path / "csv"))
    sinks.write_json(d, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    cells = spark.createDataFrame([('say "hi"', 1, "a,b"), (None, 2, "x\r\ny"), ("plain", 3, "")], "a string, b int, c string")
    assert [r.line for r in cells.transform(sinks.csv_lines).collect()] == ['"say ""hi""",1,"a,b"', ',2,"x\r\ny"', "plain,3,"]


def test_export_parts_make_one_file(spark, tmp_path):
    d = spark.range(1000).select(F.col("id").cast("string").alias("run_item_id"), F.struct("id").alias("scores"), F.lit(1).alias("unknown"))
    sinks.csv_parts(sinks.export_columns(d), ["run_item_id"], str(tmp_path / "x"), rows_per_part=300)
    parts = sorted((tmp_path / "x" / "rows").glob("part-*"))
    raw = b"".join(f.read_bytes() for f in [*(tmp_path / "x" / "header").glob("part-*"), *parts])
    assert len(parts) == 4 and raw.startswith(b"\xef\xbb\xbfrun_item_id,") and raw.endswith(b"\r\n") and b"\n" not in raw.replace(b"\r\n", b"")
    got = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert list(got[0]) == sinks.EXPORT_COLUMNS and len(got[0]) == 52
    assert [r["run_item_id"] for r in got] == sorted(map(str, range(1000))) and json.loads(got[7]["scores"]) == {"id": int(got[7]["run_item_id"])}


def test_numbering_of_a_whole_table(spark, rows):
    d = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    got = rel.numbered(d, [F.desc("k")]).collect()
    assert sorted((r.position, r.k) for r in got) == [(n + 1, 499 - n) for n in range(500)]


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    e = spark.createDataFrame([(1, "A"), (2, "B")], "event_id int, event_type string")
    e.coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = []
    for extra in (None, [(3, "C")]):
        if extra:
            spark.createDataFrame(extra, e.schema).write.mode("append").parquet(str(tmp_path / "log"))
        s = feed.event_stream(spark, str(tmp_path / "log"), e.schema)
        q = feed.follow(s, str(tmp_path / "ck"), lambda b, _: seen.append(sorted(r.event_id for r in b.collect())), every="0 seconds")
        q.processAllAvailable()
        q.stop()
    assert seen == [[1, 2], [3]]


def test_pointer_chains_of_the_whole_table(spark, tmp_path):
    from lectern import catalog

    n = 2600
    spark.range(1, n + 1).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    want = {}
    for k in range(1, n + 1):
        here, hops = k, 0
        while here <= n and here % 50 != 1:
            here, hops = here - 1 if here % 50 else 10_000_000, hops + 1
        want[k] = (None, "DANGLING") if here > n else (here, "RESOLVED" if hops else "ROOT"), hops
    got = {r.c_custkey: ((r.root, r.state), r.hops) for r in catalog.queries()["pointer_chains_all"](spark, str(tmp_path)).collect()}
    assert got == want
    bare = {k: ((None, "INCOMPLETE"), hops) if v[0] and v[0] % 200 == 1 else (v, hops) for k, (v, hops) in want.items()}
    got = {r.c_custkey: ((r.root, r.state), r.hops) for r in catalog.queries()["pointer_chains"](spark, str(tmp_path)).collect()}
    assert got == bare


def test_registered_bootstrap_uses_the_default_samples(spark, monkeypatch):
    from lectern import catalog
    from lectern.operators import statistics

    seen = []
    monkeypatch.setattr(statistics, "paired_bootstrap", lambda *a, **k: seen.append(k))
    catalog.queries()["paired_bootstrap"](spark, "/root/testdata/sf0.001")
    assert seen == [{"row_id": "doc_id"}]


def test_whole_table_queries_are_registered_with_sql():
    from lectern import catalog

    assert {"item_summary_all", "preceding_rows_all", "fan_out_all"} <= set(catalog.oracle_sql())
