"""Registered queries: result analytics, details, statistics, scoring, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.catalog import register
from lectern.functions.scalars import exact_mean, half_up6, metric_weight, percent_done
from lectern.operators import analytics, details, retrieval, scoring, statistics
from lectern.operators.relational import latest_per_key
from lectern.session import ship
from lectern.sources.tables import read_table as t

WEIGHTS = '{"accuracy":2,"faithfulness":1}'

BASE = """base AS (
  SELECT c_mktsegment AS blind_id, l_linestatus AS mode, o_orderpriority AS purpose, 'Q-' || CAST(o_orderkey % 500 AS VARCHAR) AS question_id,
         CASE l_returnflag WHEN 'A' THEN 'accuracy' WHEN 'N' THEN 'faithfulness' ELSE 'response_present' END AS metric_key,
         CAST(round(l_discount * 10, 1) AS DECIMAL(10,6)) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
MEAN = "CAST(floor(CAST(sum(value) AS DOUBLE) / count(value) * 1e6 + 0.5) / 1e6 AS DECIMAL(12,6))"
MEANS = f""", means AS (
  SELECT NULL AS scope, blind_id, mode, metric_key, {MEAN} AS mean, count(value) AS n FROM base GROUP BY ALL
  UNION ALL SELECT purpose AS scope, blind_id, mode, metric_key, {MEAN} AS mean, count(value) AS n FROM base GROUP BY ALL)"""
W = "CASE metric_key WHEN 'accuracy' THEN 2 WHEN 'response_present' THEN 0 ELSE 1 END"
COMPOSITES = f""", weighted AS (SELECT *, CAST({W} AS DECIMAL(12,6)) AS w FROM means), composites AS (
  SELECT scope, blind_id, mode, CAST(floor(CAST(sum(mean * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS DECIMAL(12,6)) AS composite,
         CAST(sum(n) AS BIGINT) AS n FROM weighted WHERE w > 0 GROUP BY ALL)"""
BIN = "least(4, CAST(floor(greatest(0, CAST(value AS DOUBLE)) * 5) AS INT))"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("l_returnflag") == "A", "accuracy").when(F.col("l_returnflag") == "N", "faithfulness").otherwise("response_present")
    return (
        t(spark, sf_dir, "lineitem")
        .join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("blind_id"), F.col("l_linestatus").alias("mode"), F.col("o_orderpriority").alias("purpose"),
            F.concat(F.lit("Q-"), (F.col("o_orderkey") % 500).cast("string")).alias("question_id"), metric.alias("metric_key"),
            F.round(F.col("l_discount") * 10, 1).cast("decimal(10,6)").alias("value"),
        )
    )


def weight():
    return metric_weight(F.lit(WEIGHTS), F.col("metric_key"))


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for plain comparison."""
    return df.select(*[F.col(n).cast("double").alias(n) if k.startswith("decimal") else F.col(n) for n, k in df.dtypes])


@register(f"""WITH {BASE}{MEANS}{COMPOSITES}, dist AS (
  SELECT scope, blind_id, mode, b AS bin, count(*) AS n FROM (
    SELECT NULL AS scope, blind_id, mode, {BIN} AS b FROM base WHERE metric_key = 'accuracy'
    UNION ALL SELECT purpose, blind_id, mode, {BIN} FROM base WHERE metric_key = 'accuracy') GROUP BY ALL),
grid AS (SELECT DISTINCT scope, blind_id, mode FROM dist)
SELECT 'METRIC' AS kind, scope, blind_id, mode, metric_key AS key, CAST(mean AS DOUBLE) AS value, n FROM means
UNION ALL SELECT 'MODEL', scope, blind_id, mode, 'composite', CAST(composite AS DOUBLE), n FROM composites
UNION ALL SELECT 'PURPOSE', purpose, blind_id, mode, 'accuracy', CAST({MEAN} AS DOUBLE), count(value) FROM base WHERE metric_key = 'accuracy' GROUP BY purpose, blind_id, mode
UNION ALL SELECT 'DISTRIBUTION', g.scope, g.blind_id, g.mode, 'bin' || CAST(k.k AS VARCHAR), NULL, coalesce(d.n, 0)
  FROM grid g CROSS JOIN range(5) k(k) LEFT JOIN dist d ON d.scope IS NOT DISTINCT FROM g.scope AND d.blind_id = g.blind_id AND d.mode = g.mode AND d.bin = k.k""")
def result_analytics(spark, sf_dir):
    return doubles(analytics.in_display_order(analytics.tagged_rows(base(spark, sf_dir), weight(), "accuracy")))


@register(f"WITH {BASE}{MEANS} SELECT scope, blind_id, mode, metric_key, CAST(mean AS DOUBLE) AS mean, n FROM means")
def metric_means(spark, sf_dir):
    return doubles(analytics.metric_means(base(spark, sf_dir)).drop("overall"))


@register(f"WITH {BASE}{MEANS}{COMPOSITES} SELECT scope, blind_id, mode, CAST(composite AS DOUBLE) AS composite, n FROM composites")
def weighted_composites(spark, sf_dir):
    return doubles(analytics.composites(analytics.metric_means(base(spark, sf_dir)), weight()).drop("overall"))


@register(f"""WITH {BASE} SELECT blind_id, mode, {", ".join(f"count(*) FILTER ({BIN} = {k}) AS bin{k}" for k in range(5))}, purpose AS scope
FROM base WHERE metric_key = 'accuracy' GROUP BY GROUPING SETS ((blind_id, mode, purpose), (blind_id, mode))""")
def score_distribution(spark, sf_dir):
    return analytics.distribution(base(spark, sf_dir), "accuracy").drop("overall")


@register(f"WITH {BASE} SELECT blind_id, mode, purpose, CAST({MEAN} AS DOUBLE) AS mean, count(value) AS n FROM base WHERE metric_key = 'accuracy' GROUP BY ALL")
def purpose_means(spark, sf_dir):
    return doubles(analytics.purpose_means(base(spark, sf_dir)))


@register(f"""WITH {BASE}{MEANS} SELECT scope, metric_key, string_agg(blind_id || '::' || mode || '=' || CAST(mean AS VARCHAR), ';' ORDER BY blind_id || '::' || mode) AS by_series
FROM means GROUP BY ALL""")
def series_maps(spark, sf_dir):
    m = analytics.series_maps(analytics.metric_means(base(spark, sf_dir)))
    text = F.transform(F.map_entries("by_series"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return m.select("scope", "metric_key", F.array_join(text, ";").alias("by_series"))


@register("""WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority WHEN o_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS purpose FROM orders),
r AS (SELECT c_mktsegment AS blind_id, o_orderstatus AS mode, purpose, count(*) AS responses,
  CAST(floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS DOUBLE) AS avg_latency_ms FROM o JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT p.purpose, b.blind_id, m.mode, coalesce(r.responses, 0) AS responses, avg_latency_ms
FROM (SELECT DISTINCT purpose FROM r) p CROSS JOIN (SELECT DISTINCT blind_id FROM r) b CROSS JOIN (SELECT DISTINCT mode FROM r) m
LEFT JOIN r ON r.purpose = p.purpose AND r.blind_id = b.blind_id AND r.mode = m.mode""")
def dense_model_stats(spark, sf_dir):
    """Orders in progress have two purposes only, which leaves holes."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    purpose = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).when(F.col("o_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW")
    r = o.groupBy(F.col("c_mktsegment").alias("blind_id"), F.col("o_orderstatus").alias("mode"), purpose.alias("purpose")).agg(
        F.count(F.lit(1)).alias("responses"), half_up6(exact_mean(F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("avg_latency_ms")
    )
    return analytics.dense_model_stats(r)


HEAT = """, asked AS (SELECT DISTINCT question_id FROM base), page AS (SELECT question_id FROM asked ORDER BY question_id LIMIT 25 OFFSET {offset}),
cells AS (SELECT question_id, blind_id, mode, CAST({mean} AS DOUBLE) AS value FROM base WHERE metric_key = 'accuracy' AND question_id IN (SELECT question_id FROM page) GROUP BY ALL)
SELECT (SELECT count(*) FROM asked) AS total, p.question_id, c.blind_id, c.mode, c.value FROM (SELECT 1) one LEFT JOIN page p ON true LEFT JOIN cells c ON c.question_id = p.question_id"""


@register(f"WITH {BASE}" + HEAT.format(offset=25, mean=MEAN))
def heatmap_page(spark, sf_dir):
    return doubles(analytics.heatmap(base(spark, sf_dir), "accuracy", page=2, size=25))


@register(f"WITH {BASE}" + HEAT.format(offset=2500, mean=MEAN))
def heatmap_past_end(spark, sf_dir):
    return doubles(analytics.heatmap(base(spark, sf_dir), "accuracy", page=101, size=25))


@register(f"""WITH {BASE}{MEANS}{COMPOSITES} SELECT blind_id, mode, CAST(composite AS DOUBLE) AS composite, CAST(composite * 100 AS DOUBLE) AS percent,
CAST(row_number() OVER (ORDER BY composite DESC NULLS LAST, blind_id, mode) AS INT) AS rank FROM composites WHERE scope IS NULL AND mode = 'O'""")
def ranked_series(spark, sf_dir):
    c = analytics.composites(analytics.metric_means(base(spark, sf_dir)), weight()).where("overall = 1")
    return doubles(analytics.ranked_series(c, modes=["O"]))


def _items(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    state = F.when(F.col("o_orderstatus") == "O", "SUCCEEDED").when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "TERMINAL_FAILED").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("RUNNING")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("blind_id"), (F.col("o_orderkey") % 2).alias("lane"), state.alias("state"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("code"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"),
        F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("mode"),
    )


ITEMS = """items AS (SELECT o_orderkey AS id, c_mktsegment AS blind_id, o_orderkey % 2 AS lane,
  CASE WHEN o_orderstatus = 'O' THEN 'SUCCEEDED' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'TERMINAL_FAILED' WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'RUNNING' END AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS code, 'order ' || CAST(o_orderkey AS VARCHAR) AS message, o_orderdate AS seen, o_orderpriority AS mode
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
GROUPS = """, groups AS (SELECT blind_id, lane, coalesce(nullif(trim(code), ''), 'UNKNOWN') AS error_code, arg_max(message, (seen, id)) AS message, count(*) AS failures, max(seen) AS latest
  FROM items WHERE state IN ('FAILED', 'TERMINAL_FAILED') GROUP BY 1, 2, 3)"""


@register(f"""WITH {ITEMS} SELECT blind_id, lane, count(*) AS total, count(*) FILTER (state = 'SUCCEEDED') AS succeeded,
count(*) FILTER (state IN ('FAILED', 'TERMINAL_FAILED')) AS failed FROM items GROUP BY ALL""")
def execution_stats(spark, sf_dir):
    return details.execution_stats(_items(spark, sf_dir), ["blind_id", "lane"])


@register(f"WITH {ITEMS}{GROUPS} SELECT * FROM groups")
def failure_groups(spark, sf_dir):
    failed = _items(spark, sf_dir).where(F.col("state").isin(*details.FAILED))
    return details.failure_groups(failed, ["blind_id", "lane"], "code", "message", "at", "id")


@register(f"WITH {ITEMS}{GROUPS} SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY blind_id, lane ORDER BY failures DESC, latest DESC, error_code) = 1")
def representative_failure(spark, sf_dir):
    return details.representative_failure(failure_groups(spark, sf_dir), ["blind_id", "lane"])


@register(f"""WITH {ITEMS} SELECT blind_id, count(*) AS total, count(*) FILTER (state <> 'RUNNING') AS finished,
string_agg(DISTINCT state, ',' ORDER BY state) AS states, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes,
CAST(floor(count(*) FILTER (state <> 'RUNNING') * 100.0 / count(*) + 0.5) AS INT) AS percent FROM items GROUP BY ALL""")
def run_progress(spark, sf_dir):
    p = details.run_progress(_items(spark, sf_dir), ["blind_id"])
    return p.withColumn("percent", percent_done(F.col("finished"), F.col("total")))


ITEM_SUMMARY = f"""WITH {ITEMS} SELECT {{key}}, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'FAILED') AS failed,
count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'COMPLETED') AS completed,
coalesce(string_agg(message, ',' ORDER BY id) FILTER (state = 'FAILED'), '') AS errors, false AS all_completed FROM items GROUP BY ALL"""


@register(ITEM_SUMMARY.format(key="mode"))
def item_summary(spark, sf_dir):
    return _item_summary(_items(spark, sf_dir), "mode")


@register(ITEM_SUMMARY.format(key="blind_id"))
def item_summary_all(spark, sf_dir):
    return _item_summary(_items(spark, sf_dir), "blind_id")


def _item_summary(items, key):
    i = items.withColumnsRenamed({"id": "ordinal", "message": "error"})
    return details.item_summary(i, key).withColumn("errors", F.array_join("errors", ","))


def _responses(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_item_id"), (F.col("conv_id") % 5).alias("run_model_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), "role", "turn",
        F.length("text").cast("long").alias("input_tokens"), F.when(F.col("turn") % 3 != 2, F.octet_length("text").cast("long")).alias("output_tokens"),
        (F.col("turn") * 100).alias("latency_ms"), (F.length("text") % 97).cast("decimal(10,2)").alias("cost"),
    )


RESP = """resp AS (SELECT conv_id AS run_item_id, conv_id % 5 AS run_model_id, conv_id * 1000 + turn AS response_id, role, turn, length(text) AS input_tokens,
  CASE WHEN turn % 3 <> 2 THEN strlen(text) END AS output_tokens, turn * 100 AS latency_ms, CAST(length(text) % 97 AS DECIMAL(10,2)) AS cost FROM conversations)"""


@register("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def latest_response(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return latest_per_key(c, ["conv_id", "role"], [F.desc("turn")]).select("conv_id", "role", "turn", "text")


@register(f"""WITH {RESP} SELECT run_model_id, role, count(*) AS responses, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
CAST(sum(latency_ms) AS DOUBLE) / count(*) AS avg_latency_ms, CAST(sum(cost) AS DOUBLE) AS cost FROM resp GROUP BY ALL""")
def response_sums(spark, sf_dir):
    return doubles(details.response_sums(_responses(spark, sf_dir), ["run_model_id", "role"]))


@register(f"""WITH {RESP}, models AS (SELECT i AS run_model_id FROM range(7) r(i)), it AS (SELECT DISTINCT run_item_id, run_model_id, CASE WHEN run_item_id % 4 = 0 THEN 'TERMINAL_FAILED' ELSE 'FAILED' END AS state FROM resp)
SELECT m.run_model_id, count(it.run_item_id) AS items, count(*) FILTER (it.state = 'TERMINAL_FAILED') AS failed, count(r.response_id) AS responses,
CAST(sum(r.input_tokens) + sum(r.output_tokens) AS BIGINT) AS tokens
FROM models m LEFT JOIN it ON it.run_model_id = m.run_model_id LEFT JOIN resp r ON r.run_item_id = it.run_item_id GROUP BY ALL""")
def dashboard_models(spark, sf_dir):
    r = _responses(spark, sf_dir)
    items = r.select("run_item_id", "run_model_id").distinct().withColumn("state", F.when(F.col("run_item_id") % 4 == 0, "TERMINAL_FAILED").otherwise("FAILED"))
    return details.dashboard_models(spark.range(7).withColumnRenamed("id", "run_model_id"), items, r.drop("run_model_id"))


@register(f"""WITH {BASE}, s AS (SELECT purpose AS run_id, * EXCLUDE purpose FROM base), e AS (SELECT run_id, blind_id, count(*) AS eligible FROM s GROUP BY ALL),
r AS (SELECT run_id, blind_id, metric_key, CAST(floor(CAST(sum(value) AS DOUBLE) / count(value) * 1e6 + 0.5) / 1e6 AS DOUBLE) AS mean, count(value) AS scored FROM s GROUP BY ALL)
SELECT r.*, eligible, count(*) OVER () AS total_rows FROM r JOIN e USING (run_id, blind_id) ORDER BY run_id, blind_id, metric_key LIMIT 40""")
def scoreboard(spark, sf_dir):
    s = base(spark, sf_dir).withColumnRenamed("purpose", "run_id")
    b = details.scoreboard(s, s, limit=40)
    return b.withColumn("mean", half_up6(F.col("mean").cast("double") + 1e-13).cast("double"))


@register("""WITH need AS (SELECT o_orderkey AS response_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['response_present', 'A', 'N'] ELSE ['response_present', 'A'] END) AS metric_key FROM orders),
have AS (SELECT DISTINCT l_orderkey AS response_id, l_returnflag AS metric_key FROM lineitem WHERE l_discount > 0.02)
SELECT response_id, count(DISTINCT metric_key) AS required, count(DISTINCT CASE WHEN h.response_id IS NOT NULL THEN metric_key END) AS scored
FROM need LEFT JOIN have h USING (response_id, metric_key) GROUP BY response_id""")
def required_pairs(spark, sf_dir):
    r = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("response_id"))
    profile = F.when(F.col("response_id") % 2 == 0, F.array(F.lit("A"), F.lit("exact_match"), F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("A")))
    s = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_returnflag").alias("metric_key"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("value"))
    return details.required_pairs(r, s, scoring.required_metrics(profile, F.lit("SHORT_ANSWER")))


@register("""WITH c AS (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1), d AS (SELECT * FROM (VALUES (0, 'click'), (1, 'view'), (2, 'nothing'), (3, 'purchase')) v(position, stage))
SELECT stage, position, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (stage)""")
def stage_counts(spark, sf_dir):
    c = t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return details.stage_counts(c, ["click", "view", "nothing", "purchase"])


@register(f"""WITH {BASE}, m AS (SELECT metric_key, blind_id, mode, CAST(sum(value) AS DOUBLE) / count(value) AS mean, count(value) AS n FROM base GROUP BY ALL)
SELECT metric_key, blind_id, mode, n, CAST(rank AS INT) AS rank, n < 600 AS small_sample FROM (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY round(mean, 8) DESC, blind_id, mode) AS rank FROM m) WHERE rank <= 3""")
def evidence_report(spark, sf_dir):
    return details.evidence_report(base(spark, sf_dir), top=3, small=600).select("metric_key", "blind_id", "mode", "n", "rank", "small_sample")


@register("""WITH c AS (SELECT doc_id % 9 AS grp, count(*) FILTER (quality = 1 AND toxic = 0) AS a_only, count(*) FILTER (quality = 0 AND toxic = 1) AS b_only FROM labels GROUP BY 1),
d AS (SELECT *, a_only + b_only AS n, least(a_only, b_only) AS k FROM c)
SELECT grp, a_only, b_only, n, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 9) AS p_value FROM d""")
def mcnemar(spark, sf_dir):
    ship(spark)
    p = t(spark, sf_dir, "labels").select((F.col("doc_id") % 9).alias("grp"), F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return statistics.mcnemar_counts(p, ["grp"]).withColumn("p_value", F.round("p_value", 9))


def _mixed_sql(x: str) -> str:
    """The finaliser of the resamples' hash, on 64-bit numbers without sign."""
    all_ = "CAST(18446744073709551616 AS UHUGEINT)"
    times = lambda v, c: f"CAST((CAST({v} AS UHUGEINT) * CAST({c} AS UHUGEINT)) % {all_} AS UBIGINT)"
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {times('xor(y, y >> 27)', 0x94D049BB133111EB)} AS z FROM (SELECT {times('xor(x, x >> 30)', 0xBF58476D1CE4E5B9)} AS y FROM (SELECT CAST(({x}) % {all_} AS UBIGINT) AS x))))"


_GOLDEN = f"CAST({0x9E3779B97F4A7C15} AS UHUGEINT)"
_WEIGHT_SQL = "CASE " + " ".join(f"WHEN u < {sum(statistics.poisson_cases()[: k + 1])} THEN {k}" for k in range(len(statistics.poisson_cases()))) + " END"


@register(f"""WITH p AS (SELECT lang, doc_id, CAST(quality AS DOUBLE) - toxic AS d FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
o AS (SELECT lang, d, {_mixed_sql(f"CAST(doc_id AS UHUGEINT) * {_GOLDEN} + CAST(42 AS UHUGEINT)")} AS own FROM p),
h AS (SELECT lang, d, turn, {_mixed_sql(f"CAST(own AS UHUGEINT) + CAST(turn AS UHUGEINT) * {_GOLDEN}")} AS drawn FROM o CROSS JOIN range(0, 2500) t(turn)),
w AS (SELECT lang, d, 4 * turn + k AS sample, CAST((drawn >> (16 * k)) & 65535 AS INTEGER) AS u FROM h CROSS JOIN range(0, 4) s(k)),
m AS (SELECT lang, sample, sum(d * {_WEIGHT_SQL}) / sum({_WEIGHT_SQL}) AS mean FROM w GROUP BY ALL HAVING sum({_WEIGHT_SQL}) > 0),
r AS (SELECT lang, list(mean ORDER BY mean) AS means FROM m GROUP BY 1)
SELECT lang, avg(d) AS difference, any_value(means[1 + CAST(floor(len(means) * (1 - 0.95) / 2) AS INTEGER)]) AS low, any_value(means[1 + CAST(floor(len(means) * (1 - (1 - 0.95) / 2)) AS INTEGER)]) AS high, count(*) AS n
FROM p JOIN r USING (lang) GROUP BY 1""")
def paired_bootstrap(spark, sf_dir):
    ship(spark)
    p = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return statistics.paired_bootstrap(p.select("lang", "doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b")), "lang", row_id="doc_id")


@register("""SELECT o_custkey % 50 AS grp, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P",
abs(count(*) FILTER (o_orderstatus = 'F') - count(*) / 3.0) > greatest(2.0, count(*) / 3.0 * 0.2) OR abs(count(*) FILTER (o_orderstatus = 'O') - count(*) / 3.0) > greatest(2.0, count(*) / 3.0 * 0.2)
OR abs(count(*) FILTER (o_orderstatus = 'P') - count(*) / 3.0) > greatest(2.0, count(*) / 3.0 * 0.2) AS imbalanced FROM orders GROUP BY 1""")
def answer_imbalance(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("grp"), "o_orderstatus")
    return statistics.answer_imbalance(o, "grp", "o_orderstatus", ["F", "O", "P"])


@register("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'NOT_JSON' WHEN event_id % 19 = 0 THEN 'NO_METRIC' WHEN event_id % 11 = 0 OR event_id % 13 > 10 THEN 'VALUE_OUT_OF_RANGE' WHEN event_id % 7 = 0 THEN 'DUPLICATE_METRIC' END AS reject,
CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END END AS n, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'CORRECT' ELSE 'SCORED' END AS label,
CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'why' ELSE '채점 모델이 설명을 생략했습니다.' END AS rationale,
CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 2 THEN 'claim=c1;quote=q,chunkId=k1' WHEN event_id % 4 = 3 THEN 'claim=c2' ELSE '' END AS evidence FROM events""")
def judge_answers(spark, sf_dir):
    k = F.col("event_id")
    value = F.when(k % 11 == 0, '" "').when(k % 2 == 0, F.concat(F.lit('"'), (k % 13 / 10).cast("string"), F.lit('"'))).otherwise((k % 13 / 10).cast("string"))
    more = F.when(k % 4 == 0, ',"label":" CORRECT "').when(k % 4 == 1, ',"label":5,"rationale":"why "').when(k % 4 == 2, ',"rationale":" ","evidence":[" c1 ",{"quote":"q","chunkId":"k1","claim":7},{},3,""]').otherwise(',"evidence":[{"claim":"c2","other":1},["x"]]')
    one = lambda v: F.concat(F.lit('{"metricKey":'), F.when(k % 19 == 0, F.lit("1")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))), F.lit(',"value":'), v, more, F.lit("}"))
    twice = F.when(k % 7 == 0, F.concat(F.lit(","), one(F.lit("0.5")))).otherwise("")
    raw = F.concat(F.lit('Here: {"scores":['), one(value), twice, F.when(k % 17 == 0, "").otherwise("]} done"))
    p = scoring.parse_judge(t(spark, sf_dir, "events").select("event_id", raw.alias("raw")))
    told = lambda e: F.concat_ws(",", *[F.concat(F.lit(f"{x}="), e[x]) for x in ("claim", "quote", "chunkId")])
    first = F.get("scores", F.lit(0))
    return p.select(
        "event_id", "reject", F.when(F.coalesce(F.col("reject"), F.lit("")) != "NOT_JSON", F.size("scores")).alias("n"), first["label"].alias("label"), first["rationale"].alias("rationale"), F.array_join(F.transform(first["evidence"], told), ";").alias("evidence")
    )


@register("""WITH c AS (SELECT user_id % 200 AS response_id, event_type AS logical_key, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS state,
  CASE WHEN event_id % 5 = 0 THEN 'RATE_LIMIT' WHEN event_id % 5 = 1 THEN NULL ELSE 'TIMEOUT' END AS error_code FROM events),
k AS (SELECT response_id, logical_key, arg_max(state, id) AS last, count(*) FILTER (state = 'FAILED' AND coalesce(error_code, '') <> 'RATE_LIMIT') AS charged FROM c GROUP BY ALL)
SELECT DISTINCT response_id, unnest([logical_key, 'shared']) AS metric_key FROM k WHERE last = 'FAILED' AND charged >= 3""")
def terminal_metrics(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(
        (F.col("user_id") % 200).alias("response_id"), F.col("event_type").alias("logical_key"), F.when(F.col("event_id") % 3 == 0, "COMPLETED").otherwise("FAILED").alias("state"),
        F.when(F.col("event_id") % 5 == 0, "RATE_LIMIT").when(F.col("event_id") % 5 != 1, "TIMEOUT").alias("error_code"), F.array(F.col("event_type"), F.lit("shared")).alias("metrics"),
        F.lit(1).alias("attempt"), F.lit(0).alias("created_at"), F.col("event_id").alias("id"),
    )
    return scoring.terminal_metrics(e)


PRICES = [(1, "%STEEL", "2024-01-01", 2.0, 8.0, 1300.0), (2, "%", "2023-01-01", 1.0, 3.0, 0.0), (3, "%BRASS", "2025-01-01", 4.0, 4.0, 1400.0), (4, "STANDARD%", "2024-06-01", 5.0, 1.0, None)]


@register("""WITH prices AS (SELECT * FROM (VALUES (1, '%STEEL', '2024-01-01', 2.0, 8.0, 1300.0), (2, '%', '2023-01-01', 1.0, 3.0, 0.0), (3, '%BRASS', '2025-01-01', 4.0, 4.0, 1400.0), (4, 'STANDARD%', '2024-06-01', 5.0, 1.0, NULL))
  v(price_id, model_pattern, valid_from, price_in, price_out, rate)),
j AS (SELECT p_partkey AS response_id, p_type AS model_id, p_size * 1000 AS i, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 500 END AS o, prices.* FROM part LEFT JOIN prices ON p_type LIKE model_pattern
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY valid_from DESC NULLS LAST, price_id DESC NULLS LAST) = 1)
SELECT response_id, model_id, price_id, CAST((i * price_in + o * price_out) / 1e6 AS DOUBLE) AS cost_native, CAST(CASE WHEN rate <> 0 THEN (i * price_in + o * price_out) / 1e6 * rate END AS DOUBLE) AS cost_krw FROM j""")
def response_costs(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "price_id int, model_pattern string, valid_from string, price_in double, price_out double, rate double")
    r = t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("response_id"), F.col("p_type").alias("model_id"), (F.col("p_size") * 1000).cast("double").alias("input_tokens"),
        F.when(F.col("p_partkey") % 9 != 0, (F.col("p_size") * 500).cast("double")).alias("output_tokens"),
    )
    return scoring.response_costs(r, prices).select("response_id", "model_id", "price_id", "cost_native", "cost_krw")


@register("""SELECT o_custkey % 20 AS run_id, count(DISTINCT (l_orderkey, l_returnflag)) AS expected, count(DISTINCT CASE WHEN l_tax > 0.01 THEN (l_orderkey, l_returnflag) END) AS stored,
count(DISTINCT (l_orderkey, l_returnflag)) = count(DISTINCT CASE WHEN l_tax > 0.01 THEN (l_orderkey, l_returnflag) END) AS complete FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def score_completeness(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = j.select((F.col("o_custkey") % 20).alias("run_id"), F.col("l_orderkey").alias("response_id"), F.col("l_returnflag").alias("metric_key"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("value"))
    return scoring.incomplete_runs(p, "run_id")


def _vectors(spark, sf_dir):
    """Every hundredth vector as a query, against all of them."""
    e = t(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("file"), F.col("vec_id").cast("int").alias("ordinal"), "embedding")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), chunks


HITS = """hits AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label AS file, CAST(c.vec_id AS INT) AS ordinal,
  round(1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))), 9) AS distance
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, file, ordinal) AS INT) AS semantic_rank FROM hits QUALIFY semantic_rank <= 12)"""
TOP_K = f"WITH {HITS} SELECT query_id, chunk_id, file, ordinal, semantic_rank, abs(round(distance, 6)) AS distance FROM top"
NEIGHBOURS = f"""WITH {HITS}, allc AS (SELECT query_id, file, ordinal, chunk_id, semantic_rank * 1000.0 AS o, false AS near, semantic_rank FROM top
  UNION ALL SELECT t.query_id, t.file, CAST(e.vec_id AS INT), e.vec_id, t.semantic_rank * 1000.0 - (t.ordinal - e.vec_id), true, t.semantic_rank FROM top t JOIN embeddings e ON e.label = t.file AND e.vec_id BETWEEN greatest(1, t.ordinal - 20) AND t.ordinal - 1)
SELECT query_id, chunk_id, file, ordinal, near AS is_neighbour, CAST(o AS DOUBLE) AS selection_order FROM allc QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY near, o, semantic_rank) = 1"""


@register(TOP_K)
def vector_top_k(spark, sf_dir):
    out = retrieval.vector_top_k(*_vectors(spark, sf_dir))
    return out.select("query_id", "chunk_id", "file", "ordinal", "semantic_rank", F.abs(F.round("distance", 6)).alias("distance"))


@register(NEIGHBOURS)
def vector_neighbours(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    out = retrieval.with_neighbours(retrieval.vector_top_k(q, c), c, window=20)
    return out.select("query_id", "chunk_id", "file", "ordinal", "is_neighbour", F.col("selection_order").cast("double").alias("selection_order"))


@register("SELECT label, count(*) FILTER (CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN 'old' ELSE 'new' END IS DISTINCT FROM 'new') AS mismatches, count(*) AS chunks FROM embeddings GROUP BY 1")
def space_mismatches(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").withColumn("space", F.when(F.col("vec_id") % 9 == 0, None).when(F.col("vec_id") % 4 == 0, "old").otherwise("new"))
    return retrieval.space_mismatches(e, "label", "space", "new")


@register("""SELECT vec_id, CAST(len(embedding) AS INT) AS dims, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm,
sha256('[' || (['0', '0.25', '0.5', '0.75', '1', '1.25', '1.5'])[vec_id % 7 + 1] || ',-2,' || CAST(vec_id AS VARCHAR) || ']') AS sha256 FROM embeddings""")
def vector_audit(spark, sf_dir):
    a = retrieval.vector_audit(F.col("embedding"))
    plain = retrieval.vector_audit(F.array(F.col("vec_id") % 7 / 4, F.lit(-2.0), F.col("vec_id").cast("double")))
    return t(spark, sf_dir, "embeddings").select("vec_id", a.dims.alias("dims"), F.round(a.norm, 5).alias("norm"), plain.sha256.alias("sha256"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NONE,PIKE' WHEN 1 THEN 'VECTOR' WHEN 2 THEN NULL ELSE 'NONE,VECTOR,PIKE' END AS modes,
CASE event_id % 3 WHEN 0 THEN '3,2,1' WHEN 1 THEN '2,1,3' ELSE '1,2,3' END AS cited_order,
'질문: ' || event_type || CASE WHEN event_id % 5 = 0 THEN '' ELSE chr(10) || '선택지:' || chr(10) || '1. 빛' || chr(10) || '2. 산소' END AS query,
CASE event_id % 4 WHEN 0 THEN '교과서 검색 근거는 제공되지 않습니다. 모델 자체 지식만 사용해 답하십시오.' ELSE CASE event_id % 4 WHEN 1 THEN '단순 벡터 검색으로 찾은 교과서 근거' WHEN 2 THEN 'Pike-inspired 생성 그래프 스냅샷에서 재사용·재정렬한 교과서 근거' ELSE '문항에 연결된 기존 교과서 근거' END
  || CASE WHEN event_id % 3 = 0 THEN '를 찾지 못했습니다. 근거 부족을 명시하십시오.' ELSE '만 사용하십시오.' || chr(10) || chr(10) || '[근거 1 · p.7]' || chr(10) || 'A' || chr(10) || chr(10) || '[근거 2]' || chr(10) || 'B' END END
  || chr(10) || chr(10) || '[질문]' || chr(10) || event_type || CASE WHEN event_id % 5 = 0 THEN '' ELSE chr(10) || chr(10) || '선택지:' || chr(10) || '1.  빛 ' || chr(10) || '2.  ' || chr(10) || '3. 산소' END AS prompt FROM events""")
def retrieval_prompts(spark, sf_dir):
    k, lit, none = F.col("event_id"), lambda *x: F.array(*map(F.lit, x)), F.array().cast("array<string>")
    modes = F.when(k % 4 == 0, lit("PIKE", "NONE", "PIKE")).when(k % 4 == 1, lit("VECTOR")).when(k % 4 == 2, lit("LEGACY")).otherwise(lit("PIKE", "VECTOR", "NONE"))
    concepts = F.when(k % 3 == 0, lit("3", "3", "9")).when(k % 3 == 1, lit("2")).otherwise(none)
    relations = F.when(k % 3 == 0, lit("2")).otherwise(none)
    options = F.when(k % 5 != 0, lit(" 빛 ", " ", "산소"))
    chunks = F.array(F.struct(F.lit(7).alias("page"), F.lit("A").alias("text")), F.struct(F.lit(None).cast("int").alias("page"), F.lit("B").alias("text")))
    evidence = F.when(k % 3 != 0, F.array(retrieval.rendered_evidence(chunks)))
    mode = F.when(k % 4 == 0, "NONE").when(k % 4 == 1, "VECTOR").when(k % 4 == 2, "PIKE").otherwise("LEGACY")
    return t(spark, sf_dir, "events").select(
        "event_id", F.array_join(retrieval.parse_modes(modes), ",").alias("modes"), F.array_join(retrieval.cited_first(lit("1", "2", "3"), concepts, relations), ",").alias("cited_order"),
        retrieval.public_query(F.col("event_type"), options).alias("query"), retrieval.answer_prompt(mode, F.col("event_type"), options, evidence).alias("prompt"),
    )
