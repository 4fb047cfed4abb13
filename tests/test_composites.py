"""Composites against their parts and against plain versions."""

from pyspark.sql import functions as F

from lectern import catalog
from lectern.operators import alignment, documents, integrity
from lectern.plans import pipelines

SF = "/root/testdata/sf0.001"


def test_processed_documents_equal_their_parts(spark):
    pages = spark.createDataFrame(
        [("b", 1, '<h1>Heat</h1><div class="toc">Warm things 2<br>Cold things 3</div><p>About heat.</p>'), ("b", 2, "<h2>Warm things</h2><p>Fire.</p>"), ("b", 3, "<h2>Cold things</h2><p>Ice. Snow.</p>"), ("c", 1, "<p>bare</p>")],
        "book string, page int, html string",
    )
    out = pipelines.process_documents(pages, "book", "page", 60, 8)
    whole = documents.assemble_pages(pages, "book", "page")
    chunks = documents.chunk_documents(whole, "book", "html", 60)
    assert sorted(map(tuple, out["chunks"].drop("embedding").collect())) == sorted(map(tuple, chunks.collect()))
    assert {len(r.embedding) for r in out["chunks"].collect()} == {8}
    toc = documents.extract_toc(whole, "book")
    none = toc.select("book", "printed_page", F.lit(0).alias("document_page")).limit(0)
    assert sorted(map(tuple, out["mappings"].collect())) == sorted(map(tuple, alignment.align_revisions(toc, chunks, none, "book").collect()))
    assert {(r.title, r.mapping_status) for r in out["toc"].collect()} == {("Heat", "MAPPED"), ("Warm things", "MAPPED"), ("Cold things", "MAPPED")}


def test_control_room_states(spark):
    jobs = spark.createDataFrame([("LEASED", "2026-01-02 00:00:00"), ("LEASED", None), ("PENDING", None)], "state string, at string").select("state", F.col("at").cast("timestamp").alias("lease_expires_at"))
    log = spark.createDataFrame([(k, "RUN_STARTED") for k in range(1, 6)], "event_id long, event_type string")
    none = spark.createDataFrame([], "stage string, state string, n long")
    for rows, worker in ((jobs, "STALE"), (jobs.limit(1), "HEALTHY"), (jobs.limit(0), "IDLE")):
        out = pipelines.control_room_snapshot(rows, jobs.limit(0), log, none, none, none, "2026-01-01 00:00:00", recent=3)
        assert out["system"].first().worker == worker and out["system"].first().event_cursor == 5
    assert [(r.event_id, r.stage, r.state) for r in out["events"].collect()] == [(3, "BENCHMARK", "RUNNING"), (4, "BENCHMARK", "RUNNING"), (5, "BENCHMARK", "RUNNING")]
    assert [r.active + r.failed + r.ready for r in out["stages"].collect()] == [0] * 9


def test_profiles_and_runs(spark):
    rows = [
        (1, "SCORING", '{"metrics":["accuracy"],"judgeProvider":"p","judgeModel":"m"}', integrity.VERIFIED), (2, "SCORING", '{"metrics":["accuracy"],"judgeProvider":"p","judgeModel":"m"}', "LEGACY_BACKFILL_UNVERIFIED"),
        (3, "RUNNING", '{"metrics":["accuracy"],"judgeProvider":"legacy-provider-unrecorded","judgeModel":"m"}', integrity.VERIFIED), (4, "RUNNING", '{"metrics":["exact_match"]}', integrity.VERIFIED),
        (5, "RUNNING", '{"metrics":["accuracy"]}', integrity.VERIFIED), (6, "RUNNING", '{"judgeProvider":"p","judgeModel":" "}', integrity.VERIFIED), (7, "RUNNING", "{}", integrity.VERIFIED),
    ]
    d = spark.createDataFrame(rows, "id int, state string, snapshot string, provenance string")
    got = {r.id: (r.previous_state, r.state, r.judge_resolved, r.definition_usable) for r in integrity.unusable_runs(d).collect()}
    assert got == {2: ("SCORING", "FAILED", True, True), 3: ("RUNNING", "RUNNING", False, False), 5: ("RUNNING", "RUNNING", True, False), 6: ("RUNNING", "RUNNING", False, False), 7: ("RUNNING", "RUNNING", True, False)}


def test_text_coverage_is_whole(spark):
    assert {(r.own, r.dims) for r in catalog.queries()["text_coverage"](spark, SF).where("own > 0").collect()} == {(1.0, 16)}


def test_views_and_session(spark):
    from lectern.session import build_session
    from lectern.sources.tables import register_views

    register_views(spark, SF, ["nation", "region"])
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25
    assert build_session(master="local[4]", shuffle_partitions=4).sparkContext is spark.sparkContext


def test_every_operator_is_called():
    """No public function of the engine is left without a query, a test or another function that uses it."""
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1]
    code = {p: p.read_text() for d in ("lectern", "tests") for p in (root / d).rglob("*.py") if "llm" not in p.parts}
    unused = []
    for path, text in code.items():
        for name in re.findall(r"^def ([a-z]\w*)\(", text, re.M) if "lectern" in path.parts else ():
            if path.name.startswith("queries_") or sum(len(re.findall(rf"\b{name}\b", x)) for x in code.values()) > 1:
                continue
            unused.append(f"{path.name}: {name}")
    assert unused == []


def test_generation_activity_takes_the_first_of_equal_attempts(spark, tmp_path):
    """of rows with the same number the first in the table counts, though Spark reads the largest file first."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "lineitem.parquet").mkdir()
    for name, flag, copies in (("a", "A", 1), ("b", "N", 500)):
        rows = {"l_orderkey": list(range(40)) * copies, "l_linenumber": pa.array([7] * 40 * copies, pa.int32()), "l_returnflag": [flag] * 40 * copies}
        pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet" / f"{name}.parquet")
    spark.range(40).selectExpr("id as o_orderkey", "'O' as o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()["generation_activity"](spark, str(tmp_path)).collect()
    assert {(r.last_state, r.failed) for r in got} == {("FAILED", 1)} and len(got) == 40


def test_drained_streams_pass_no_rows_through_the_driver(spark, tmp_path):
    """the result of a stream is in the shared folder, not in the driver's memory sink."""
    from lectern.streaming import feed

    for n in range(3):
        spark.range(n * 10, n * 10 + 10).selectExpr("id as event_id", "id % 4 as user_id", "'k' as event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = feed.event_stream(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema, files_per_trigger=1)
    last = feed.drain(feed.latest_state(stream, "user_id"), "f1_states", "complete")
    assert sorted((r.user_id, r.event_id) for r in last.collect()) == [(0, 28), (1, 29), (2, 26), (3, 27)]
    every = feed.drain(stream, "f1_rows")
    assert sorted(r.event_id for r in every.collect()) == list(range(30))
    assert all("lectern-f1_" in f for df in (last, every) for f in df.inputFiles()) and last.inputFiles() and every.inputFiles()


def test_a_bigram_is_hashed_once(monkeypatch):
    """Every occurrence was hashed."""
    import hashlib

    from lectern.functions import text_udfs

    calls = []
    monkeypatch.setattr(text_udfs.hashlib, "sha256", lambda b, f=hashlib.sha256: calls.append(b) or f(b))
    v = text_udfs.bigram_vector("\u4e01 \u4e02" * 1000, 16)
    assert len(calls) <= 2 and abs(sum(x * x for x in v) - 1) < 1e-12
    assert text_udfs.bigrams("A b\u3000c\n") == ["ab", "bc"]
