"""Analytics, details, statistics and scoring on literal inputs."""

import hashlib
import json
import math

import numpy as np

from pyspark.sql import functions as F

from lectern.functions import canonical, scalars
from lectern.functions.text_udfs import bigram_vector, nfc
from lectern.operators import analytics, datasets, details, integrity, retrieval, scoring, statistics
from lectern.session import ship

SCORES = "blind_id string, mode string, purpose string, question_id string, metric_key string, value decimal(10,6)"


def base(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f double").select(
        F.col("a").alias("blind_id"), F.col("b").alias("mode"), F.col("c").alias("purpose"), F.col("d").alias("question_id"), F.col("e").alias("metric_key"), F.col("f").cast("decimal(10,6)").alias("value")
    )


def composite(spark, scores, weights):
    b = base(spark, [("M01", "NONE", "p", f"Q-{k}", m, v) for k, (m, v) in enumerate(scores)])
    w = scalars.metric_weight(F.lit(weights), F.col("metric_key"))
    r = analytics.composites(analytics.metric_means(b), w).where("overall = 1").first()
    return None if r.composite is None else float(r.composite), r.n


def test_composites(spark):
    assert composite(spark, [("accuracy", 0.8), ("accuracy", 0.4), ("response_present", 1.0), ("other", 0.6)], "{}") == (0.6, 3)
    weights = '{"accuracy":3,"faithfulness":1,"response_present":0,"excluded":0}'
    assert composite(spark, [("accuracy", 1.0), ("accuracy", None), ("accuracy", 1.0), ("faithfulness", 0.0)], weights) == (0.75, 3)
    assert composite(spark, [("response_present", 1.0)], "{}") == (None, 0)
    assert composite(spark, [("accuracy", 1.0), ("faithfulness", 0.4)], '{"accuracy":0}') == (0.4, 1)
    assert composite(spark, [("accuracy", 1.0), ("faithfulness", 0.4)], '{"accuracy":"x"}') == (0.4, 1)
    assert composite(spark, [("exact_match", 1.0), ("accuracy", 0.5)], "{}") == (0.5, 1)


def test_histogram_bins(spark):
    d = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.4, 0.8, 1.0, math.nan, math.inf, None)], "v double")
    assert [r[0] for r in d.select(scalars.histogram_bin(F.col("v"))).collect()] == [0, 0, 2, 4, 4, None, None, None]


def test_empty_scores_stay_empty(spark):
    b = spark.createDataFrame([], SCORES)
    assert analytics.metric_means(b).where("overall = 0").count() == 0
    assert analytics.tagged_rows(b, F.lit(1.0), "accuracy").where("scope is not null").count() == 0


def test_null_score_has_no_cell(spark):
    b = base(spark, [("M01", "NONE", "p", "Q-1", "accuracy", None)])
    assert [(r.total, r.question_id, r.value) for r in analytics.heatmap(b, "accuracy").collect()] == [(1, "Q-1", None)]
    assert [(r.total, r.question_id) for r in analytics.heatmap(b, "accuracy", page=2, size=1).collect()] == [(1, None)]


def test_mcnemar_and_bootstrap(spark):
    p = spark.createDataFrame([("g", a, b) for a, b in zip([1, 1, 0, 1], [0, 1, 1, 0])], "g string, a int, b int")
    r = statistics.mcnemar_counts(p, ["g"]).first()
    assert (r.a_only, r.b_only, r.n, r.p_value) == (2, 1, 3, 1.0)
    for k, n in ((0, 0), (0, 5), (2, 9), (7, 14), (30, 100), (480, 1000)):
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        got = spark.range(1).select(statistics.mcnemar_p(F.lit(k), F.lit(n))).first()[0]
        assert abs(got - want) <= 1e-9 * max(want, 1e-300), (k, n)
    q = spark.createDataFrame([("g", a, b) for a, b in zip([1, 1, 0, 1], [0, 1, 0, 0])], "g string, a int, b int")
    s = statistics.paired_bootstrap(q, "g", samples=500).first()
    assert s.difference == 0.5 and s.low <= 0.5 <= s.high and s.n == 4


def test_resample_weights():
    cases = statistics.poisson_cases()
    assert sum(cases) == 1 << 16 == sum(k * n for k, n in enumerate(cases))
    ids = np.arange(2000)
    w = statistics.resample_weights(ids, 0, 800, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1
    assert (statistics.resample_weights(ids[5:9], 400, 80, 7) == w[5:9, 400:480]).all()
    assert (statistics.resample_weights(ids, 0, 800, 8) != w).mean() > 0.5


def test_bootstrap_of_continuous_differences(spark, monkeypatch):
    """Groups are dealt to several tasks, and the interval is that of resampling with replacement."""
    ship(spark)
    monkeypatch.setattr(statistics, "ROWS", 700)
    rng = np.random.default_rng(3)
    d = rng.gamma(2.0, 1.0, 6000) - 1.5
    rows = [("big", i, float(x), 0.0) for i, x in enumerate(d[:5000])] + [(None, 10_000 + i, 0.0, float(x)) for i, x in enumerate(d[5000:])] + [("one", -5, 3.0, 1.0), ("big", 99, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double")
    got = {r.g: r for r in statistics.paired_bootstrap(df.repartition(7), "g", samples=2000, row_id="id").collect()}
    again = {r.g: r for r in statistics.paired_bootstrap(df.repartition(2), "g", samples=2000, row_id="id").collect()}
    for g, x in (("big", d[:5000]), (None, -d[5000:])):
        means = np.sort([rng.choice(x, len(x)).mean() for _ in range(2000)])
        r, width = got[g], x.std() / len(x) ** 0.5
        assert r.n == len(x) and abs(r.difference - x.mean()) < 1e-9
        assert abs(r.low - means[50]) < 0.25 * width and abs(r.high - means[1950]) < 0.25 * width
        assert abs(r.low - again[g].low) < 1e-9 and abs(r.high - again[g].high) < 1e-9
    assert got["one"].low == got["one"].high == 2.0 and got["one"].n == 1
    assert statistics.paired_bootstrap(df.limit(0), "g", samples=8, row_id="id").count() == 0


def test_tail_of_large_counts():
    k, n = np.array([0, 3, 500_000, 499_000, 40]), np.array([60, 3, 1_000_000, 1_000_000, 200])
    got = statistics.half_beta(np.maximum(n - k, 1).astype(float), k + 1.0)
    assert abs(got[0] - 2.0**-60) < 1e-9 * 2.0**-60 and abs(got[2] - 0.5 - 0.5 * math.exp(math.lgamma(1e6 + 1) - 2 * math.lgamma(5e5 + 1) - 1e6 * math.log(2))) < 1e-6
    assert abs(got[3] - 0.5 * math.erfc(999.5 / 500 / math.sqrt(2))) < 1e-4 and abs(got[4] / (sum(math.comb(200, i) for i in range(41)) / 2**200) - 1) < 1e-9


def test_answer_imbalance(spark):
    a = spark.createDataFrame([("d", "A")] * 80 + [("d", "B")] * 20, "d string, answer string")
    assert statistics.answer_imbalance(a, "d", "answer", list("ABCD")).first().imbalanced


def test_required_metrics_and_normalisation(spark):
    d = spark.createDataFrame([(["exact_match", "accuracy"], "  정답은   물의 순환입니다。\r\n")], "m array<string>, t string")
    r = d.select(scoring.required_metrics(F.col("m"), F.lit("SHORT")).alias("m"), scalars.answer_normalised(nfc(F.col("t"))).alias("t")).first()
    assert r.m == ["response_present", "accuracy"] and r.t == "정답은 물의 순환입니다"
    more = d.select(scoring.required_metrics(F.col("m"), F.lit("PREREQUISITE_RELATIONSHIP")).alias("m")).first().m
    assert len(more) == 8 and more[:2] == ["response_present", "accuracy"]


def test_cost_and_conversion(spark):
    d = spark.range(1).select(
        scalars.token_cost(F.lit(1_000_000), F.lit(500_000), F.lit(2), F.lit(8)).alias("c"), scalars.token_cost(F.lit(None).cast("int"), F.lit(1), F.lit(2), F.lit(8)).alias("n"),
        scalars.converted(F.lit(6.0), F.lit(0.0)).alias("z"),
    ).first()
    assert (d.c, d.n, d.z) == (6, None, None)


def test_judge_answers(spark):
    raw = [
        'x {"scores":[{"metricKey":"a","value":"0.5","label":" ","rationale":" why ","evidence":[" c ",{"quote":" q "},{"claim":5},null,[]]}]} y', "nothing", '{"scores":[{"metricKey":"a","value":" "}]}', '{"scores":[{"metricKey":"a","value":0.1},{"metricKey":"a","value":1}]}',
        '{"scores":[{"metricKey":"a","value":true}]}', '{"scores":[{"metricKey":7,"value":1}]}', '{"scores":{}}', '{"scores":[{"metricKey":"a","value":1.2},{"metricKey":"a","value":1}]}', '{"scores":[]}', "} {", '{"scores":[{"metricKey":"","value":1e0}]}',
    ]
    got = scoring.parse_judge(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()
    assert [r.reject for r in got] == [None, "NOT_JSON", "VALUE_OUT_OF_RANGE", "DUPLICATE_METRIC", "VALUE_OUT_OF_RANGE", "NO_METRIC", "NOT_JSON", "VALUE_OUT_OF_RANGE", None, "NOT_JSON", None]
    first = got[0].scores[0]
    assert (first.value, first.label, first.rationale) == (0.5, "SCORED", "why")
    assert [tuple(e) for e in first.evidence] == [("c", None, None), (None, "q", None)]
    assert got[8].scores == [] and got[10].scores[0].metric_key == ""


def test_item_summary(spark):
    i = spark.createDataFrame([("b", 3, "RUNNING", None), ("b", 2, "FAILED", "e2"), ("b", 1, "COMPLETED", None), ("b", 4, "PENDING", None)], "b string, ordinal int, state string, error string")
    r = details.item_summary(i, "b").first()
    assert (r.pending, r.running, r.completed, r.failed, r.errors, r.all_completed) == (1, 1, 1, 1, ["e2"], False)


def test_modes_and_citation_order(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    r = spark.range(1).select(
        retrieval.parse_modes(a("PIKE", "NONE", "PIKE", "VECTOR")).alias("m"), retrieval.parse_modes(none).alias("e"), retrieval.parse_modes(a("LEGACY")).alias("u"),
        retrieval.cited_first(a("1", "2", "3"), a("3", "3"), a("2")).alias("o"), retrieval.public_query(F.lit(" 무엇? "), a(" 빛 ", "산소")).alias("q"),
    ).first()
    assert (r.m, r.e, r.u, r.o) == (["NONE", "VECTOR", "PIKE"], None, None, ["3", "2", "1"])
    assert r.q == "질문: 무엇?\n선택지:\n1. 빛\n2. 산소"
    p = spark.range(1).select(
        retrieval.public_query(F.lit("무엇?"), a(" ", "빛")).alias("blank"), retrieval.public_query(F.lit("무엇?"), none).alias("bare"), retrieval.answer_prompt(F.lit("NONE"), F.lit("무엇?"), none, a("x")).alias("none"),
        retrieval.answer_prompt(F.lit("VECTOR"), F.lit("무엇?"), a("가", " "), a("x", "y")).alias("vector"), retrieval.answer_prompt(F.lit("PIKE"), F.lit("무엇?"), none, none).alias("empty"),
    ).first()
    assert (p.blank, p.bare) == ("질문: 무엇?\n선택지:\n1. 빛", "질문: 무엇?")
    assert p.none == retrieval.NO_SEARCH + "\n\n[질문]\n무엇?"
    assert p.vector == retrieval.TITLES["VECTOR"] + "만 사용하십시오.\n\nx\n\ny\n\n[질문]\n무엇?\n\n선택지:\n1. 가\n2.  "
    assert p.empty == retrieval.TITLES["PIKE"] + "를 찾지 못했습니다. 근거 부족을 명시하십시오.\n\n[질문]\n무엇?"


def test_zero_vectors_rank_last_and_neighbours_precede(spark):
    chunks = spark.createDataFrame([(k, "f", k, [float(k), 1.0] if k != 2 else [0.0, 0.0]) for k in range(1, 6)], "chunk_id int, file string, ordinal int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    hits = retrieval.vector_top_k(q, chunks, 5)
    assert [r.chunk_id for r in hits.orderBy("semantic_rank").collect()] == [5, 4, 3, 1, 2]
    top = hits.where("semantic_rank <= 2")
    near = retrieval.with_neighbours(top, chunks, 1)
    assert [(r.chunk_id, r.is_neighbour) for r in near.orderBy("selection_order").collect()] == [(5, False), (3, True), (4, False)]


def jsonb_text(value):
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {jsonb_text(value[k])}" for k in sorted(value, key=lambda k: (len(k.encode()), k.encode()))) + "}"
    return "[" + ", ".join(map(jsonb_text, value)) + "]" if isinstance(value, list) else json.dumps(value, ensure_ascii=False)


def test_canonical_json(spark):
    values = [
        {"bb": 1, "a": [True, None], "ab": {"z": "가"}}, {}, [], "x", 0.5, None, {"é": 1, "zz": 2, "b": 3, "": 4}, {"a": {"b": {"c": [{"d": [[]]}]}}}, {"s": 'q"\\\n\t\b\f\r\x01\x1f/\u007f😀'}, [12345678901234567890, -7, 1.25e-3], {"k\"1": "\\u001f"},
    ]
    texts = [json.dumps(v, ensure_ascii=bool(k % 2)) for k, v in enumerate(values)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, "{", "1 2", None, "[1e3, 2.0, 1E+2]"])], "k int, x string").orderBy("k")
    got = df.select(canonical.jsonb_canonical(F.col("x")), canonical.sorted_canonical(F.col("x")), canonical.jsonb_sha256(F.col("x"))).collect()
    assert [r[0] for r in got[:-4]] == [jsonb_text(v) for v in values]
    assert [r[1] for r in got[:-4]] == [json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in values]
    assert [r[0] for r in got[-4:]] == [None, None, None, "[1000, 2, 100]"]
    assert got[0][2] == hashlib.sha256(jsonb_text(values[0]).encode()).hexdigest()


def test_pins(spark):
    from tests.test_schemas import GENERATION, RAG

    good, ids = jsonb_text(RAG), "30000000-0000-0000-0000-000000000001"
    sha = hashlib.sha256(good.encode()).hexdigest()
    rows = [
        ("embedding_rag", "AT_CREATION_VERIFIED", ids, sha, json.dumps(RAG), None), ("embedding_rag", "LEGACY_BACKFILL_UNVERIFIED", ids, sha, good, "unverified"), ("embedding_rag", None, ids, sha, good, "unverified"),
        ("embedding_rag", "AT_CREATION_VERIFIED", "7", sha, good, "profile_id"), ("embedding_rag", "AT_CREATION_VERIFIED", ids, sha[1:], good, "content_hash"), ("embedding_rag", "AT_CREATION_VERIFIED", ids, sha, good + "x", "definition_schema"),
        ("embedding_rag", "AT_CREATION_VERIFIED", ids, sha, None, "definition_schema"), ("embedding_rag", "AT_CREATION_VERIFIED", ids, sha, jsonb_text(GENERATION), "definition_kind"),
        ("embedding_rag", "AT_CREATION_VERIFIED", ids, sha, good.replace("3072", "3071"), "definition_hash"),
    ]
    df = spark.createDataFrame(rows, "expected string, provenance string, id string, hash string, definition string, want string")
    got = df.withColumn("got", integrity.pin_problem(*[F.col(c) for c in df.columns[:5]])).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_numbers_inside_names(spark):
    names = ["10장 2절", "2장 10절", "2장 9절", "Q-2", "Q-10", "가2", "가10", "a007b2", "a7b10", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(scalars.natural_key(F.col("n")), "n").collect()]
    at = {n: k for k, n in enumerate(got)}
    assert at["2장 9절"] < at["2장 10절"] < at["10장 2절"] and at["Q-2"] < at["Q-10"] and at["가2"] < at["가10"] and at["a007b2"] < at["a7b10"]


def test_embedding():
    assert abs(sum(x * x for x in bigram_vector("some text", 32)) - 1) < 1e-9
    assert bigram_vector("", 4) == [0.0] * 4


def test_run_matrix_and_blind_ids(spark):
    m = spark.createDataFrame([("x", 2), ("y", 1)], "model_id string, position int")
    out = datasets.run_matrix(spark.range(2), m, spark.createDataFrame([("NONE",), ("PIKE",)], "mode string"))
    assert out.count() == 8 and {(r.model_id, r.blind_id) for r in out.collect()} == {("y", "M01"), ("x", "M02")}


def test_more_queries_than_a_block_are_ranked_in_blocks(spark, monkeypatch):
    rows = [(k, f"f{k % 3}", k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, file string, ordinal int, embedding array<double>")
    q = chunks.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, retrieval.vector_top_k(q, chunks, 4).collect()))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 15)
    assert sorted(map(tuple, retrieval.vector_top_k(q, chunks, 4).collect())) == want
    assert len(want) == 160


def plain_top_k(queries, chunks, k):
    def distance(a, b):
        if a is None or b is None or len(a) != len(b) or any(x is None for x in [*a, *b]):
            return None
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(1 - sum(x * y for x, y in zip(a, b)) / norms, 9) if norms else None

    out = []
    for q, v in queries:
        ranked = sorted(((d is None, d or 0.0, f is not None, f or "", o, c) for c, f, o, e in chunks for d in [distance(v, e)]))[:k]
        out += [(q, c, n + 1, None if none else d) for n, (none, d, _, _, _, c) in enumerate(ranked)]
    return sorted(out)


def test_vector_ranking_of_copies_nulls_and_other_sizes(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 40)
    monkeypatch.setattr(retrieval, "SLACK", 1)
    rng = np.random.default_rng(2)
    some = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(30)]
    chunks = [(i, ["b", "a", None, "é"][i % 4], i * 7 % 211, some[i % 30] if i % 3 else some[0]) for i in range(200)]
    chunks += [(500, "a", 1, None), (501, "a", 2, []), (502, "a", 3, [1.0, 2.0]), (503, "a", 4, [1.0, None, 2.0, 0.0]), (504, "a", 5, [0.0] * 4)]
    queries = [(1, some[0]), (2, some[5]), (3, [0.0] * 4), (4, None), (5, [2.0, 1.0]), (6, [5.0])]
    c = spark.createDataFrame(chunks, "chunk_id long, file string, ordinal int, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = retrieval.vector_top_k(q, c, 9)
    key = lambda x: [(a, n, d if d is None else abs(d)) for a, _, n, d in x]  # noqa: E731  equal rows of file and ordinal may swap
    have = sorted((r.query_id, r.chunk_id, r.semantic_rank, r.distance) for r in got.collect())
    want = plain_top_k(queries, chunks, 9)
    assert sorted(key(have), key=str) == sorted(key(want), key=str) and {x[:2] for x in have} == {x[:2] for x in want}
    assert retrieval.vector_top_k(q, c.limit(0), 9).count() == 0 == retrieval.vector_top_k(q.limit(0), c, 9).count()


def test_registered_vector_queries_take_every_hundredth_id():
    from lectern import catalog

    for name in ("vector_top_k", "vector_neighbours"):
        assert "q.vec_id % 100 = 0" in catalog.oracle_sql()[name]


def test_judge_answers_are_parsed_once_or_twice(spark):
    """a filter on ``reject`` repeated the parsing for every use of every column."""
    from lectern.operators import scoring

    kept = scoring.parse_judge(spark.createDataFrame([('{"scores":[{"metricKey":"a","value":"0.5"}]}',)], "raw string")).where("reject is null").selectExpr("scores[0].value as v")
    assert kept.first().v == 0.5
    assert kept._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 2


def test_a_search_holds_few_candidates_and_runs_once(spark, monkeypatch):
    """candidates grew with the queries of a pass, and neighbours searched twice."""
    from lectern import catalog
    from lectern.operators import retrieval
    from lectern.queries_analytics import _vectors

    whole = sorted(map(tuple, retrieval.vector_top_k(*_vectors(spark, "/root/testdata/sf0.01"), k=2).collect()))
    monkeypatch.setattr(retrieval, "CANDIDATES", 8)
    several = retrieval.vector_top_k(*_vectors(spark, "/root/testdata/sf0.01"), k=2)
    assert sorted(map(tuple, several.collect())) == whole and "block=1" in "".join(several.inputFiles())
    monkeypatch.undo()
    near = catalog.queries()["vector_neighbours"](spark, "/root/testdata/sf0.01")
    assert "MapInArrow" not in near._jdf.queryExecution().executedPlan().toString()
