"""Registered queries: relational shapes, integrity, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import register
from lectern.functions import canonical, scalars
from lectern.operators import datasets, integrity, lookups, scoring
from lectern.operators import relational as rel
from lectern.session import new_shared_path, ship
from lectern.sources import sinks
from lectern.sources.tables import read_table as t
from lectern.sources.versions import VersionedTable, pinned


@register("""SELECT (SELECT count(*) FROM customer) AS total, c_custkey, c_name FROM (SELECT 1) one LEFT JOIN
(SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40) p ON true""")
def offset_page(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rel.page_with_total(c, [F.desc("c_acctbal"), F.asc("c_custkey")], page=3, size=20).drop("c_acctbal")


@register("""SELECT o_orderpriority, o_orderkey FROM (SELECT coalesce(nullif(o_orderpriority, '5-LOW'), '0') AS o_orderpriority, o_orderkey FROM orders)
WHERE (o_orderpriority, o_orderkey) > ('2-HIGH', 700) ORDER BY 1, 2 LIMIT 51""")
def keyset_page(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_orderkey")
    page = rel.keyset_page(o, ["o_orderpriority", "o_orderkey"], ("2-HIGH", 700), 50, {"o_orderpriority": "0"})
    return page.withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("0")))


@register("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def last_then_ascending(spark, sf_dir):
    return rel.last_then_ascending(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 100)


@register("SELECT p_partkey FROM part WHERE p_name ILIKE '%an%e%' OR p_brand ILIKE '%an%e%' OR p_type ILIKE '%an%e%'")
def text_search(spark, sf_dir):
    return rel.text_search(t(spark, sf_dir, "part"), "an%e", [F.col("p_name"), F.col("p_brand"), F.col("p_type")]).select("p_partkey")


@register("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND props->>'k' ILIKE '%1%'")
def facet_filters(spark, sf_dir):
    e = rel.optional_filters(t(spark, sf_dir, "events"), event_type=["click", "view"], user_id=None, props="  ")
    return rel.text_search(e, "1", [F.get_json_object("props", "$.k")]).select("event_id")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("""SELECT c_nationkey, count(o_orderkey) AS orders, count(DISTINCT o_orderkey) AS distinct_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def left_join_counts(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return (
        t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey")
        .agg(F.count("o_orderkey").alias("orders"), F.count_distinct("o_orderkey").alias("distinct_orders"))
    )


@register("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN
(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 OR l_shipdate < TIMESTAMP '1993-01-01')""")
def approved_only(spark, sf_dir):
    q = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", "APPROVED").alias("status"), F.lit(None).alias("deleted_at"))
    li = t(spark, sf_dir, "lineitem")
    r = li.select(
        F.col("l_orderkey").alias("question_id"), F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), "sample").otherwise("real").alias("provider"),
        F.when(F.col("l_shipdate") < "1993-01-01", "mock-1").otherwise("m").alias("model_id"),
    )
    return rel.real_approved(q, r).select("id")


PRECEDING = "SELECT h.vec_id AS anchor, CAST(e.vec_id AS INT) AS ordinal, e.label AS grp FROM embeddings h JOIN embeddings e ON e.label = h.label AND e.vec_id BETWEEN greatest(1, h.vec_id - {n}) AND h.vec_id - 1"


@register(PRECEDING.format(n=1))
def preceding_rows(spark, sf_dir):
    """With the default window of one row."""
    return _preceding_rows(spark, sf_dir, 1)


@register(PRECEDING.format(n=15))
def preceding_rows_all(spark, sf_dir):
    return _preceding_rows(spark, sf_dir, 15)


def _preceding_rows(spark, sf_dir, window):
    e = t(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").cast("int").alias("ordinal"))
    return rel.preceding_neighbours(e.withColumn("anchor", F.col("ordinal").cast("long")), e, "grp", "ordinal", window).select("anchor", "ordinal", "grp")


SPANS = "spans AS (SELECT label AS grp, vec_id AS start, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS stop FROM embeddings WHERE vec_id % 7 = 0)"


@register(f"WITH {SPANS} SELECT s.grp, s.start, e.vec_id FROM spans s JOIN embeddings e ON e.label = s.grp AND e.vec_id >= s.start AND (s.stop IS NULL OR e.vec_id < s.stop)")
def span_join(spark, sf_dir):
    from pyspark.sql import Window

    e = t(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), "vec_id")
    s = e.where("vec_id % 7 = 0").select("grp", F.col("vec_id").alias("start"), F.lead("vec_id").over(Window.partitionBy("grp").orderBy("vec_id")).alias("stop"))
    return rel.span_join(s, e, "grp", "start", "stop", "vec_id").select("grp", "start", "vec_id")


@register("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_name END, r.name) AS name FROM customer LEFT JOIN
(SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name FROM customer) r ON r.k = CASE WHEN c_custkey % 4 <> 0 THEN c_custkey - c_custkey % 4 END""")
def resolved_receipts(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, F.col("c_name")).alias("name"), F.when(k % 4 != 0, k - k % 4).alias("root"))
    return rel.resolve_receipts(c, "c_custkey", "root", ["name"]).select("c_custkey", "name")


_CHAIN_SQL = """WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 1 THEN NULL WHEN c_custkey % 50 = 0 THEN 10000000 ELSE c_custkey - 1 END AS p, {whole} AS whole FROM customer),
w AS (SELECT k, k AS node, p, whole, 0 AS hops FROM c UNION ALL SELECT w.k, c.k, c.p, c.whole, w.hops + 1 FROM w JOIN c ON c.k = w.p WHERE w.hops <= (SELECT count(*) FROM c)),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY hops DESC) = 1)
SELECT k AS c_custkey, CASE WHEN p IS NULL AND whole THEN node END AS root, CAST(hops + (p IS NOT NULL)::INT AS BIGINT) AS hops,
  CASE WHEN hops > (SELECT count(*) FROM c) THEN 'CYCLE' WHEN p IS NOT NULL THEN 'DANGLING' WHEN NOT whole THEN 'INCOMPLETE' WHEN hops = 0 THEN 'ROOT' ELSE 'RESOLVED' END AS state FROM e"""


@register(_CHAIN_SQL.format(whole="c_custkey % 200 <> 1"))
def pointer_chains(spark, sf_dir):
    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.when(k % 50 == 1, None).when(k % 50 == 0, F.lit(10_000_000)).otherwise(k - 1).alias("p"), F.when(k % 200 != 1, F.col("c_custkey")).alias("payload"))
    return rel.follow_pointers(rows, "c_custkey", "p", payload=["payload"])


@register(_CHAIN_SQL.format(whole="true"))
def pointer_chains_all(spark, sf_dir):
    """The same, whatever the roots hold."""
    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.when(k % 50 == 1, None).when(k % 50 == 0, F.lit(10_000_000)).otherwise(k - 1).alias("p"))
    return rel.follow_pointers(rows, "c_custkey", "p")


TREE = "tree AS (SELECT p_partkey AS k, CASE WHEN p_partkey >= 8 THEN p_partkey // 8 END AS p FROM part)"


@register(f"WITH RECURSIVE {TREE}, a AS (SELECT k, p AS ancestor, 1 AS distance FROM tree WHERE p IS NOT NULL UNION ALL SELECT a.k, tree.p, a.distance + 1 FROM a JOIN tree ON tree.k = a.ancestor WHERE tree.p IS NOT NULL) SELECT * FROM a")
def ancestor_closure(spark, sf_dir):
    k = F.col("p_partkey")
    n = t(spark, sf_dir, "part").select(k.alias("k"), F.when(k >= 8, F.floor(k / 8)).alias("p"))
    return rel.ancestors(n, "k", "p")


@register("""WITH e AS (SELECT p_brand AS grp, p_partkey AS ordinal, p_size % 4 + 1 AS level FROM part)
SELECT a.grp, a.ordinal, a.level, max(b.ordinal) AS parent_ordinal FROM e a LEFT JOIN e b ON b.grp = a.grp AND b.ordinal < a.ordinal AND b.level < a.level GROUP BY ALL""")
def parent_entries(spark, sf_dir):
    e = t(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("ordinal"), (F.col("p_size") % 4 + 1).alias("level"))
    return rel.parent_by_level(e, "grp")


@register("""WITH c AS (SELECT user_id AS grp, event_id AS ordinal, CASE WHEN event_id % 5 = 0 THEN 'c' || CAST(event_id % 3 AS VARCHAR) END AS chapter, CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(event_id % 7 AS VARCHAR) END AS unit FROM events),
a AS (SELECT grp, ordinal, last_value(chapter IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS chapter, unit FROM c),
b AS (SELECT *, CASE WHEN chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY grp ORDER BY ordinal) THEN 1 ELSE 0 END AS ch FROM a),
r AS (SELECT *, sum(ch) OVER (PARTITION BY grp ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT grp, ordinal, chapter, last_value(unit IGNORE NULLS) OVER (PARTITION BY grp, run ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS unit FROM r""")
def carried_headings(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string"))).alias("chapter"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string"))).alias("unit"),
    )
    return rel.carry_forward(e, "grp").select("grp", "ordinal", "chapter", "unit")


@register("""WITH c AS (SELECT user_id AS grp, event_id AS ordinal, event_type AS chapter, CAST(NULL AS VARCHAR) AS unit FROM events)
SELECT grp, ordinal FROM c QUALIFY chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY grp ORDER BY ordinal)""")
def heading_starts(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("chapter"), F.lit(None).cast("string").alias("unit"))
    return rel.heading_starts(e, "grp").select("grp", "ordinal")


@register("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def insert_new(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return rel.insert_new(o.where("o_orderstatus = 'F'").select("k"), o.where("o_orderstatus = 'O'").select("k"), ["k"])


@register("""SELECT event_type AS provider, max(ts) AS blocked_until, arg_max(user_id, (ts, user_id)) AS user_id, count(*) AS hit_count FROM events GROUP BY 1""")
def cooldown_upsert(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("ts").alias("blocked_until"), "user_id")
    return rel.later_deadline_wins(e, "provider", "blocked_until", ["user_id"])


@register("""SELECT 1 AS version, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, count(DISTINCT event_type) AS kinds FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 2, count(*), CAST(sum(user_id) AS BIGINT), count(DISTINCT event_type) FROM events""")
def pinned_versions(spark, sf_dir):
    """Two queries on a pinned version agree while a writer appends; a batch that is sent again changes nothing."""
    e = t(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    table = VersionedTable(spark, new_shared_path(spark, "events"))
    table.append(e.where("event_id % 2 = 0"), batch="even")
    before = pinned({"events": table})["events"]
    table.append(e.where("event_id % 2 = 1"), batch="odd")
    table.append(e.where("event_id % 2 = 1"), batch="odd")
    counts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users")).crossJoin(df.agg(F.count_distinct("event_type").alias("kinds")))  # noqa: E731  two queries, one row each
    return counts(before).withColumn("version", F.lit(1)).unionByName(counts(table.read()).withColumn("version", F.lit(table.latest())))


@register("""SELECT event_type AS provider, max(ts) AS blocked_until, arg_max(user_id, (ts, user_id)) AS user_id, count(*) AS hit_count FROM events GROUP BY 1""")
def upserted_cooldowns(spark, sf_dir):
    """The state after the log came in four batches, two of them twice."""
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("ts").alias("blocked_until"), "user_id", (F.col("event_id") % 4).alias("batch"))
    table = VersionedTable(spark, new_shared_path(spark, "cooldowns"))
    for b in (0, 1, 1, 2, 3, 0):
        log = e.where(F.col("batch") == b).drop("batch")
        table.update(lambda state, log=log: rel.merged_deadlines(state, log, "provider", "blocked_until", ["user_id"]), batch=f"log-{b}")
    return table.read()


@register("SELECT substr(sha256(text), 1, 2) AS prefix, count(DISTINCT text) AS blobs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, 0 AS again FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def stored_blobs(spark, sf_dir):
    """Texts sent in two overlapping batches, and all of them once more, which writes none."""
    d = t(spark, sf_dir, "documents")
    path = new_shared_path(spark, "blobs")
    sinks.write_blobs(d.where("doc_id % 3 <> 0"), "text", path)
    sinks.write_blobs(d.where("doc_id % 3 <> 1"), "text", path)
    again = sinks.write_blobs(d, "text", path)
    held = sinks.blob_store(spark, path).read()
    return held.groupBy("prefix").agg(F.count(F.lit(1)).alias("blobs"), F.sum("bytes").alias("bytes")).withColumn("again", F.lit(again))


@register("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS ordinal FROM orders WHERE o_orderkey % 3 <> 0")
def renumbered(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return rel.renumbered(o, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "ordinal")


@register("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT k, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_differences(spark, sf_dir):
    k = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return rel.set_differences(k.where("l_returnflag = 'A'").select("k").distinct(), k.where("l_returnflag = 'R'").select("k").distinct())


@register("SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_canonical FROM documents")
def canonical_blobs(spark, sf_dir):
    return rel.canonical_blobs(t(spark, sf_dir, "documents").select("doc_id", "text"), "text", [F.asc("doc_id")]).drop("text")


@register("SELECT sha256(text) AS sha256, count(DISTINCT text) AS contents FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1")
def hash_collisions(spark, sf_dir):
    return rel.hash_collisions(t(spark, sf_dir, "documents"), "text")


@register("""SELECT o_custkey % 12 AS lane, o_orderkey AS id, CAST(position AS INT) AS position FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderpriority <> '1-URGENT') WHERE position <= 3 + o_custkey % 12""")
def claim_order(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).alias("lane"), F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_orderpriority").alias("provider_key"))
    lanes = spark.range(12).select(F.col("id").alias("lane"), (F.col("id") + 3).alias("free"))
    blocked = spark.range(1).select(F.lit("1-URGENT").alias("provider_key"))
    return rel.claim_order(o, lanes, blocked, "lane", [F.asc("o_orderdate"), F.asc("id")]).select("lane", "id", "position")


@register("SELECT DISTINCT p_brand AS provider_key FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 48")
def missing_providers(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumnRenamed("p_brand", "provider_key")
    return rel.missing_providers(p, p.where("p_size > 48"))


@register("SELECT o_custkey, CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) AS next_number FROM orders GROUP BY 1")
def next_number(spark, sf_dir):
    return rel.next_number(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@register("""SELECT o_custkey, o_orderkey + 1 AS revision, 'DRAFT' AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def copied_forward(spark, sf_dir):
    r = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("status"))
    return rel.copy_forward(r, "o_custkey", {"status": F.lit("DRAFT")})


# -- integrity ------------------------------------------------------------------------------


@register("""SELECT p_partkey, p_size % 3 = 1 AS unique_ok, p_size % 4 <> 0 AS weights_ok, p_size % 5 < 2 AS config_ok, p_size % 2 = 0 AS hash_ok FROM part""")
def profile_checks(spark, sf_dir):
    s = F.col("p_size")
    metrics = F.when(s % 3 == 0, F.array(F.lit("a"), F.lit("a"))).when(s % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit(" ")))
    weights = F.when(s % 4 == 0, '{"a":-1}').when(s % 4 == 1, '{"a":1,"b":0.5}').otherwise("{}")
    config = F.when(s % 5 == 0, '{"top":3,"window":1}').when(s % 5 == 1, '{"window":0,"top":12}').when(s % 5 == 2, '{"top":3}').when(s % 5 == 3, '{"top":99,"window":1}').otherwise('{"top":3,"window":1,"x":1}')
    digest = F.when(s % 2 == 0, F.sha2(F.col("p_name"), 256)).otherwise(F.col("p_name"))
    return t(spark, sf_dir, "part").select(
        "p_partkey", integrity.nonempty_unique(metrics).alias("unique_ok"), integrity.weights_valid(weights).alias("weights_ok"),
        integrity.config_valid(config, {"top": (1, 50), "window": (0, 3)}).alias("config_ok"), scalars.is_sha256(digest).alias("hash_ok"),
    )


RUN_STATES = ["DRAFT", "QUEUED", "RUNNING", "PAUSING", "PAUSED", "STOPPING", "STOPPED", "SCORING", "CANCELLING", "CANCELLED", "COMPLETED", "FAILED"]
_STATES_SQL = "[" + ", ".join(f"'{x}'" for x in RUN_STATES) + "]"
_LEGAL_SQL = """('DRAFT','QUEUED'),('QUEUED','RUNNING'),('RUNNING','PAUSING'),('PAUSING','PAUSED'),('PAUSED','RUNNING'),('RUNNING','STOPPING'),('PAUSING','STOPPING'),('PAUSED','STOPPED'),('STOPPING','STOPPED'),('STOPPED','RUNNING'),('RUNNING','SCORING'),('SCORING','PAUSING'),('SCORING','STOPPING'),('SCORING','CANCELLING'),('SCORING','COMPLETED'),('QUEUED','CANCELLING'),('RUNNING','CANCELLING'),('PAUSED','CANCELLING'),('PAUSING','CANCELLING'),('STOPPING','CANCELLING'),('STOPPED','CANCELLING'),('CANCELLING','CANCELLED'),('QUEUED','FAILED'),('RUNNING','FAILED'),('SCORING','FAILED')"""


@register(f"""WITH s AS (SELECT user_id, event_id, ({_STATES_SQL})[event_id % 12 + 1] AS state FROM events), w AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
SELECT user_id, event_id, state, before FROM w WHERE before IS NOT NULL AND (before, state) NOT IN (SELECT (a, b) FROM (VALUES {_LEGAL_SQL}) v(a, b))""")
def illegal_transitions(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.get(F.array(*map(F.lit, RUN_STATES)), (F.col("event_id") % 12).cast("int")).alias("state"))
    return integrity.illegal_transitions(e, "user_id", "state", ["event_id"])


MACHINES_SQL = """VALUES ('run','DRAFT','QUEUE','QUEUED'),('run','QUEUED','START','RUNNING'),('run','RUNNING','PAUSE','PAUSING'),('run','PAUSING','FINISH_PAUSE','PAUSED'),('run','PAUSED','RESUME','RUNNING'),('run','RUNNING','STOP','STOPPING'),('run','PAUSING','STOP','STOPPING'),('run','PAUSED','STOP','STOPPED'),('run','STOPPING','FINISH_STOP','STOPPED'),('run','STOPPED','RESUME','RUNNING'),('run','RUNNING','BEGIN_SCORING','SCORING'),('run','SCORING','PAUSE','PAUSING'),('run','SCORING','STOP','STOPPING'),('run','SCORING','CANCEL','CANCELLING'),('run','SCORING','COMPLETE','COMPLETED'),('run','QUEUED','CANCEL','CANCELLING'),('run','RUNNING','CANCEL','CANCELLING'),('run','PAUSED','CANCEL','CANCELLING'),('run','PAUSING','CANCEL','CANCELLING'),('run','STOPPING','CANCEL','CANCELLING'),('run','STOPPED','CANCEL','CANCELLING'),('run','CANCELLING','FINISH_CANCEL','CANCELLED'),('run','QUEUED','FAIL','FAILED'),('run','RUNNING','FAIL','FAILED'),('run','SCORING','FAIL','FAILED'),
('document','UPLOADED','PARSE','PARSING'),('document','PARSING','PARSE_COMPLETE','PARSED'),('document','PARSED','APPROVE_HTML','HTML_REVIEWED'),('document','HTML_REVIEWED','CHUNK','CHUNKING'),('document','CHUNKING','CHUNK_COMPLETE','CHUNKED'),('document','CHUNKED','EMBED','EMBEDDING'),('document','EMBEDDING','EMBED_COMPLETE','READY'),('document','PARSING','FAIL','FAILED'),('document','CHUNKING','FAIL','FAILED'),('document','EMBEDDING','FAIL','FAILED'),
('question','DRAFT','SUBMIT','IN_REVIEW'),('question','DRAFT','APPROVE','APPROVED'),('question','DRAFT','EDIT_AND_APPROVE','APPROVED'),('question','DRAFT','HOLD','HELD'),('question','IN_REVIEW','APPROVE','APPROVED'),('question','IN_REVIEW','EDIT_AND_APPROVE','APPROVED'),('question','IN_REVIEW','HOLD','HELD'),('question','HELD','REOPEN','IN_REVIEW'),('question','DRAFT','DELETE','DELETED'),('question','IN_REVIEW','DELETE','DELETED'),('question','HELD','DELETE','DELETED')"""
MACHINES = {"run": integrity.RUN_COMMANDS, "document": integrity.DOCUMENT_COMMANDS, "question": integrity.QUESTION_COMMANDS}


@register(f"""WITH v AS (SELECT * FROM ({MACHINES_SQL}) v(machine, state, command, next_state)), s AS (SELECT machine, state FROM v UNION SELECT machine, next_state FROM v), c AS (SELECT DISTINCT machine, command FROM v UNION SELECT 'document', 'RETRY')
SELECT n_nationkey, s.machine, s.state, c.command, CASE WHEN s.machine = 'document' AND s.state = 'FAILED' AND c.command = 'RETRY' AND n_nationkey % 2 = 0 THEN 'CHUNKING' ELSE v.next_state END AS next_state
FROM nation CROSS JOIN s JOIN c ON c.machine = s.machine LEFT JOIN v ON v.machine = s.machine AND v.state = s.state AND v.command = c.command""")
def state_machines(spark, sf_dir):
    """Every state with every command of its machine, once for every nation."""
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "CHUNKING").alias("stage"))
    parts = []
    for name, rows in MACHINES.items():
        states, commands = sorted({x for a, _, b in rows for x in (a, b)}), sorted({c for _, c, _ in rows} | ({"RETRY"} if name == "document" else set()))
        each = n.select("n_nationkey", "stage", F.lit(name).alias("machine"), F.explode(F.array(*map(F.lit, states))).alias("state")).select("*", F.explode(F.array(*map(F.lit, commands))).alias("command"))
        parts.append(integrity.next_states(each, rows, failed_stage="stage" if name == "document" else None).drop("stage"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("""WITH r AS (SELECT DISTINCT l_orderkey AS call_id, l_returnflag AS metric_key FROM lineitem WHERE l_linestatus = 'O'), s AS (SELECT DISTINCT l_orderkey AS call_id, l_returnflag AS metric_key FROM lineitem WHERE l_quantity > 20)
SELECT *, 'no_score' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'not_resolved' FROM (SELECT * FROM s EXCEPT SELECT * FROM r)""")
def judge_scores_differ(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    calls = li.where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.collect_set("l_returnflag").alias("resolved"))
    return integrity.judge_scores_differ(calls, li.where("l_quantity > 20").select(F.col("l_orderkey").alias("call_id"), F.col("l_returnflag").alias("metric_key")))


@register("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE (CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'x' ELSE c_mktsegment END) IS DISTINCT FROM c_mktsegment")
def revision_mismatches(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("pin"))
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").join(c.withColumnRenamed("pin", "own"), "c_custkey")
    child = o.select("c_custkey", "o_orderkey", F.when(k % 10 == 0, None).when(k % 11 == 0, "x").otherwise(F.col("own")).alias("pin"))
    return integrity.revision_mismatches(child, c, "c_custkey", ["pin"]).select("o_orderkey")


@register("SELECT conv_id, count(*) AS n, min(turn + 1) AS low, max(turn + 1) AS high, count(DISTINCT turn) AS k FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1) GROUP BY 1 HAVING min(turn + 1) <> 1 OR max(turn + 1) <> count(*)")
def ordinal_gaps(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").where("not (conv_id % 5 = 0 and turn = 1)").withColumn("ordinal", F.col("turn") + 1)
    return integrity.ordinal_gaps(c, "conv_id", "ordinal")


@register("""SELECT item_id, CASE item_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'answerOptions' WHEN 2 THEN 'benchmarkDesign.prerequisiteRelations' WHEN 3 THEN 'questionText' WHEN 4 THEN 'evidenceChunkIds' WHEN 5 THEN 'benchmarkDesign.prerequisiteRelations'
WHEN 6 THEN 'benchmarkDesign.taskType,benchmarkDesign.requiredReasoningSteps' ELSE 'questionText,answerText,evidenceChunkIds,benchmarkDesign.benchmarkType,benchmarkDesign.taskType,benchmarkDesign.targetConcept,benchmarkDesign.prerequisiteConcepts,benchmarkDesign.prerequisiteRelations,benchmarkDesign.requiredReasoningSteps,benchmarkDesign.failureSignals' END AS problems FROM benchmark""")
def question_checks(spark, sf_dir):
    k = F.col("item_id")
    texts = lambda *x: F.array(*map(F.lit, x))
    ids = texts("aaaaaaaa-aaaa-4aaa-8aaa-aaaaaaaaaaaa")
    relation = F.struct(
        F.lit("force").alias("fromConcept"), F.when(k % 8 == 2, "other").otherwise("motion").alias("toConcept"), F.when(k % 8 == 5, "SUPPORTS").otherwise("BUILDS_ON").alias("relationType"), F.lit("because").alias("explanation"), ids.alias("evidenceChunkIds")
    )
    design = F.struct(
        F.lit("PREREQUISITE_RELATIONSHIP").alias("benchmarkType"), F.when(k % 8 == 6, "other").otherwise("cross_unit_transfer").alias("taskType"), F.lit("motion").alias("targetConcept"),
        F.array(F.struct(F.lit("force").alias("concept"), F.lit("cause of it").alias("role"), ids.alias("evidenceChunkIds"))).alias("prerequisiteConcepts"), F.array(relation).alias("prerequisiteRelations"),
        F.when(k % 8 == 6, texts("one step")).otherwise(texts("one step", "another")).alias("requiredReasoningSteps"), texts("guessing").alias("failureSignals"),
    )
    raw = F.to_json(F.struct(
        F.when(k % 8 == 3, "abcd").otherwise(F.col("text")).alias("questionText"), F.lit("y").alias("answerText"), F.when(k % 8 == 1, texts("x", "y")).otherwise(texts()).alias("answerOptions"),
        F.when(k % 8 == 4, texts("chunk-1")).otherwise(ids).alias("evidenceChunkIds"), design.alias("benchmarkDesign"),
    ))
    whole = F.when(k % 8 == 7, "no JSON").otherwise(F.concat(F.lit(" "), raw, F.lit("\n")))
    return t(spark, sf_dir, "benchmark").select("item_id", F.array_join(integrity.question_problems(whole, F.when(k % 8 == 1, "객관식").otherwise("서술형")), ",").alias("problems"))


#: A valid configuration of document parsing, and what is put in its place to break it: (part of the text, its stand-in).
_CONFIG = (
    '{"schemaVersion":1,"kind":"document_parse","version":"parse-v1","title":"Parsing","description":"keeps tables and figures whole","applyScope":"documents that are added from now on",'
    '"reprocessingImpact":"older documents stay as they are","settings":{"provider":"upstage","model":"document-parse","mode":"auto","ocr":"force","outputFormat":"html",'
    '"base64Encoding":["table","figure","chart","equation"],"rasterization":{"format":"png","lossless":true,"dpi":300},"pagesPerBatch":10,"pageConcurrency":4,"requestTimeoutMs":120000}}'
)
_CONFIG_CHANGES = [
    ("", ""), ('"schemaVersion":1', '"schemaVersion":"1"'), ('"schemaVersion":1', '"schemaVersion":1.0'), ("parse-v1", "Parse V1"), ("keeps tables and figures whole", "          too short           "),
    ('"mode":"auto"', '"mode":null'), ('"table"', '"chart"'), ('"equation"]', '"equation","table"]'), ('"dpi":300', '"dpi":149'), ('"dpi":300', '"dpi":300.5'), ('"dpi":300', '"dpi":300,"jpegQuality":90'),
    ('"format":"png","lossless":true', '"format":"jpeg","lossless":false'), ('"format":"png","lossless":true', '"format":"jpeg","lossless":false,"jpegQuality":60'), ('"pagesPerBatch":10', '"pagesPerBatch":"10"'),
    ('"pagesPerBatch":10,', ""), ('"pageConcurrency":4', '"pageConcurrency":4,"apiKey":"x"'), ('{"schema', '[{"schema'), ('"lossless":true', '"lossless":"true"'), ('"document-parse"', '"document parse"'), ('"document-parse"', "7"),
]
_CHANGES_SQL = "[" + ", ".join("{'a': '%s', 'b': '%s'}" % x for x in _CONFIG_CHANGES) + "]"
_TRIMMED_SQL = "length(trim((j->>'$.{0}'))) BETWEEN {1} AND {2} AND json_type(j, '$.{0}') = 'VARCHAR'"
_WHOLE_SQL = "json_type(j, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST((j->>'$.{0}') AS DOUBLE) BETWEEN {1} AND {2} AND CAST((j->>'$.{0}') AS DOUBLE) = floor(CAST((j->>'$.{0}') AS DOUBLE))"
_CONFIG_SQL = " AND ".join([
    "json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = ['applyScope', 'description', 'kind', 'reprocessingImpact', 'schemaVersion', 'settings', 'title', 'version'] AND (j->>'$.kind') = 'document_parse'",
    _WHOLE_SQL.format("schemaVersion", 1, 1), _TRIMMED_SQL.format("version", 3, 100), "regexp_matches((j->>'$.version'), '^[a-z0-9][a-z0-9._-]*$')", _TRIMMED_SQL.format("title", 2, 120),
    *[_TRIMMED_SQL.format(k, 20, 1000) for k in ("description", "applyScope", "reprocessingImpact")],
    "list_sort(json_keys(j, '$.settings')) = ['base64Encoding', 'mode', 'model', 'ocr', 'outputFormat', 'pageConcurrency', 'pagesPerBatch', 'provider', 'rasterization', 'requestTimeoutMs']",
    "(j->>'$.settings.provider') = 'upstage' AND (j->>'$.settings.mode') IN ('standard', 'enhanced', 'auto') AND (j->>'$.settings.ocr') IN ('auto', 'force') AND (j->>'$.settings.outputFormat') IN ('html', 'markdown', 'both')",
    _TRIMMED_SQL.format("settings.model", 1, 200), "regexp_matches((j->>'$.settings.model'), '^[^ ]+$')", "list_sort(CAST((j->'$.settings.base64Encoding') AS VARCHAR[])) = ['chart', 'equation', 'figure', 'table']",
    _WHOLE_SQL.format("settings.rasterization.dpi", 150, 600), _WHOLE_SQL.format("settings.pagesPerBatch", 1, 100), _WHOLE_SQL.format("settings.pageConcurrency", 1, 20), _WHOLE_SQL.format("settings.requestTimeoutMs", 1000, 600000),
    "CASE (j->>'$.settings.rasterization.format') WHEN 'png' THEN list_sort(json_keys(j, '$.settings.rasterization')) = ['dpi', 'format', 'lossless'] AND (j->'$.settings.rasterization.lossless') = CAST('true' AS JSON)"
    " WHEN 'jpeg' THEN list_sort(json_keys(j, '$.settings.rasterization')) = ['dpi', 'format', 'jpegQuality', 'lossless'] AND (j->'$.settings.rasterization.lossless') = CAST('false' AS JSON) AND "
    + _WHOLE_SQL.format("settings.rasterization.jpegQuality", 60, 100) + " ELSE false END",
])


@register(f"""WITH c AS (SELECT p_partkey, replace('{_CONFIG}', x.a, x.b) AS raw FROM (SELECT p_partkey, ({_CHANGES_SQL})[p_partkey % {len(_CONFIG_CHANGES)} + 1] AS x FROM part)),
k AS (SELECT p_partkey, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM c)
SELECT p_partkey, coalesce({_CONFIG_SQL}, false) AS valid FROM k""")
def config_checks(spark, sf_dir):
    change = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _CONFIG_CHANGES]), (F.col("p_partkey") % len(_CONFIG_CHANGES)).cast("int"))
    raw = F.replace(F.lit(_CONFIG), change["a"], change["b"])
    raw = F.when(change["a"] == "", F.lit(_CONFIG)).otherwise(raw)
    return rel.spread(t(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", (F.size(integrity.config_issues(raw, F.lit("document_parse"))) == 0).alias("valid"))


#: Wrong types and sizes inside a question, and the paths that they break.
_TYPED = [
    ('"questionText":"What moves?"', '"questionText":12345', "questionText"), ('"answerText":"all"', '"answerText":true', "answerText"), ('"acceptedAnswers":["all"]', '"acceptedAnswers":[1,"x",null]', "acceptedAnswers[0],acceptedAnswers[2]"),
    ('"acceptedAnswers":["all"]', '"acceptedAnswers":null', "acceptedAnswers"), ('"acceptedAnswers":["all"],', "", ""), ('"designSummary":"s"', '"designSummary":[]', "designSummary"),
    ('"role":"cause of it"', '"role":"why"', "benchmarkDesign.prerequisiteConcepts[0].role"), ('"relationType":"APPLIES"', '"relationType":"applies"', "benchmarkDesign.prerequisiteRelations[0].relationType"),
    ('"toConcept":"motion"', '"toConcept":"rest"', "benchmarkDesign.prerequisiteRelations"), ('["guessing"]', '["ab",{}]', "benchmarkDesign.failureSignals[0],benchmarkDesign.failureSignals[1]"),
    ('["one step","another"]', '["one step"]', "benchmarkDesign.requiredReasoningSteps"), ('"questionText":"What moves?"', '"questionText":"😀😀."', ""), ('{"questionText"', '{{"questionText"', ""), ("", "", ""),
]
_ID = "11111111-1111-4111-8111-111111111111"
_TYPED_QUESTION = (
    '{"questionText":"What moves?","answerText":"all","acceptedAnswers":["all"],"designSummary":"s","evidenceChunkIds":["%s"],"benchmarkDesign":{"benchmarkType":"PREREQUISITE_RELATIONSHIP","taskType":"cross_unit_transfer",'
    '"targetConcept":"motion","prerequisiteConcepts":[{"concept":"force","role":"cause of it","evidenceChunkIds":["%s"]}],"prerequisiteRelations":[{"fromConcept":"force","toConcept":"motion","relationType":"APPLIES","explanation":"because",'
    '"evidenceChunkIds":["%s"]}],"requiredReasoningSteps":["one step","another"],"failureSignals":["guessing"]}}' % (_ID, _ID, _ID)
)


@register(f"""SELECT event_id, ([{", ".join(f"'{x}'" for _, _, x in _TYPED)}])[event_id % {len(_TYPED)} + 1] AS issues, event_id % {len(_TYPED)} = 12 AS unreadable FROM events""")
def question_issues(spark, sf_dir):
    change = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in _TYPED]), (F.col("event_id") % len(_TYPED)).cast("int"))
    raw = F.when(change["a"] == "", F.lit(_TYPED_QUESTION)).otherwise(F.replace(F.lit(_TYPED_QUESTION), change["a"], change["b"]))
    found = rel.spread(t(spark, sf_dir, "events").select("event_id")).select("event_id", integrity.question_issues(raw).alias("found"))
    return found.select("event_id", F.array_join("found", ",").alias("issues"), F.array_contains("found", "").alias("unreadable"))


@register("""SELECT p_partkey, p_size % 7 NOT IN (2, 3, 4, 5, 6) AS definition_ok, p_size % 7 NOT IN (2, 3, 4, 5, 6) AND p_size % 2 = 0 AS run_ok FROM part""")
def usable_profiles(spark, sf_dir):
    s = F.col("p_size")
    metrics = F.when(s % 7 == 0, '["exact_match","response_present"]').when(s % 7 == 6, '{"a":1}').otherwise('["accuracy"]')
    provider = F.when(s % 7 == 1, "gemini").when(s % 7 == 3, "  ").when(s % 7 == 4, "legacy-provider-unrecorded").when(s % 7 == 5, "gemini").when(s % 7 == 6, "gemini")
    model = F.when(s % 7 == 1, "pro").when(s % 7 == 3, "pro").when(s % 7 == 4, "pro").when(s % 7 == 6, "pro")
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    snapshot = F.concat(F.lit('{"metrics":'), metrics, F.lit(',"judgeProvider":'), quoted(provider), F.lit(',"judgeModel":'), quoted(model), F.lit("}"))
    provenance = F.when(s % 2 == 0, integrity.VERIFIED).otherwise("LEGACY_BACKFILL_UNVERIFIED")
    return t(spark, sf_dir, "part").select("p_partkey", integrity.profile_usable(metrics, provider, model).alias("definition_ok"), integrity.run_profile_usable(snapshot, provenance).alias("run_ok"))


@register("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'SCORING' ELSE 'RUNNING' END AS previous_state, CASE o_orderstatus WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS state,
CASE WHEN o_orderkey % 3 = 0 THEN 'AT_CREATION_VERIFIED' ELSE 'LEGACY_BACKFILL_UNVERIFIED' END AS snapshot_provenance, o_orderkey % 2 = 0 AS judge_resolved, o_orderkey % 2 = 0 AS definition_usable
FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)""")
def unusable_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    snapshot = F.when(k % 2 == 0, '{"metrics":["accuracy"],"judgeProvider":"gemini","judgeModel":"pro"}').otherwise('{"metrics":["accuracy"],"judgeProvider":"gemini"}')
    runs = t(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "O", "SCORING").otherwise("RUNNING").alias("state"), snapshot.alias("snapshot"), F.when(k % 3 == 0, integrity.VERIFIED).otherwise("LEGACY_BACKFILL_UNVERIFIED").alias("provenance")
    )
    return integrity.unusable_runs(runs)


@register("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'DELETED' ELSE 'READY' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def soft_deleted(spark, sf_dir):
    s = t(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.lit("READY").alias("status"), F.lit(0).alias("changed_at"), F.lit(0).alias("seq"))
    gone = s.where("user_id % 3 = 0").withColumns({"status": F.lit("DELETED"), "changed_at": F.lit(1)})
    return integrity.soft_deleted(s, gone, "user_id").select("user_id", "status")


# -- datasets -------------------------------------------------------------------------------


@register("""SELECT o_custkey, sha256('[' || string_agg('{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']') AS content_hash, CAST(count(*) AS INT) AS questions FROM orders GROUP BY 1""")
def published_hash(spark, sf_dir):
    return datasets.content_hash(t(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"], "o_orderkey")


@register("""SELECT o_custkey % 10 AS version, 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT o_custkey % 10, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def facet_distributions(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("version", F.col("o_custkey") % 10)
    return datasets.distributions(o.select("version", "o_orderstatus", "o_orderpriority"), "version", ["o_orderstatus", "o_orderpriority"])


@register("""SELECT o_orderkey AS question_id, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_returnflag), '') AS evidence
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1""")
def ordered_evidence(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("quote"))
    q = datasets.with_evidence(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id")), e)
    return q.select("question_id", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x.ordinal.cast("string"), x.chunk_id.cast("string"), x.quote)), ";").alias("evidence"))


@register("""WITH m AS (SELECT r_name AS model_id, 'M0' || CAST(r_regionkey + 1 AS VARCHAR) AS blind_id FROM region), d AS (SELECT unnest(['NONE', 'VECTOR', 'PIKE']) AS mode)
SELECT item_id AS question_id, model_id, blind_id, mode FROM benchmark CROSS JOIN m CROSS JOIN d""")
def run_matrix(spark, sf_dir):
    m = t(spark, sf_dir, "region").select(F.col("r_name").alias("model_id"), F.col("r_regionkey").alias("position"))
    modes = spark.range(1).select(F.explode(F.array(F.lit("NONE"), F.lit("VECTOR"), F.lit("PIKE"))).alias("mode"))
    return datasets.run_matrix(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id")), m, modes).drop("position")


@register("""SELECT p_partkey, CAST(i AS INT) AS ordinal, (['dependency_application', 'missing_prerequisite_diagnosis', 'cross_unit_transfer', 'relation_direction_discrimination', 'prerequisite_chain_completion'])[(i - 1) % 5 + 1] AS task,
(['u1', 'u2', 'u3'])[(i - 1) % 3 + 1] || ',' || (['u1', 'u2', 'u3'])[i % 3 + 1] AS units FROM part, LATERAL (SELECT unnest(range(1, p_size % 8 + 1)) AS i)""")
def expanded_items(spark, sf_dir):
    b = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("requested"))
    i = datasets.expanded_items(b)
    units = F.array(F.lit("u1"), F.lit("u2"), F.lit("u3"))
    return i.select("p_partkey", "ordinal", datasets.task_of(F.col("ordinal")).alias("task"), F.array_join(datasets.cycled(units, F.col("ordinal"), True), ",").alias("units"))


@register("""SELECT o_orderkey, NOT coalesce((o_orderstatus = 'O') AND (o_orderpriority = '5-LOW'), false) AS reprocess_required, o_orderkey % 4 <> o_custkey % 4 AS revision_drift FROM orders""")
def source_flags(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("parse_hash"), F.lit("O").alias("active_parse_hash"), F.col("o_orderpriority").alias("embed_hash"), F.lit("5-LOW").alias("active_embed_hash"),
        (F.col("o_orderkey") % 4).alias("revision"), (F.col("o_custkey") % 4).alias("current_revision"),
    )
    return datasets.flags(o).select("o_orderkey", "reprocess_required", "revision_drift")


@register("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'own' END, c_mktsegment) AS pin FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def backfilled(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "own").alias("pin"))
    return datasets.backfilled(o, t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("pin")), "c_custkey", "pin").select("o_orderkey", "pin")


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new,b,new' ELSE 'b' END AS models FROM orders")
def rewritten_models(spark, sf_dir):
    models = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("old"), F.lit("b"), F.lit("old"))).otherwise(F.array(F.lit("b")))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(datasets.rewritten(models, F.lit("old"), lambda x: F.lit("new")), ",").alias("models"))


# -- scalar functions -----------------------------------------------------------------------


@register("""SELECT doc_id, sha256(text) AS sha256, CAST(ceil(length(text) / 3) AS BIGINT) AS tokens, strlen(text) AS bytes, left(text, 40) AS preview,
sha256('run:' || CAST(doc_id AS VARCHAR) || ':1:PIKE') AS snapshot_key FROM documents""")
def text_fingerprints(spark, sf_dir):
    text = F.col("text")
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text, 256).alias("sha256"), scalars.estimated_tokens(text).alias("tokens"), F.octet_length(text).cast("long").alias("bytes"), F.left(text, F.lit(40)).alias("preview"),
        scalars.shared_snapshot_key(F.lit("run"), F.col("doc_id").cast("string"), F.lit(1), F.lit("PIKE")).alias("snapshot_key"),
    )


_SPACE_SQL = r"[\s\x{B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: What is put around texts, by turn: white space of several kinds, closing marks, and letters that are composed.
_AROUND = ["", "\u3000", "\u00a0. .", "!?\n\t", "e\u0301\u2003", "\u1100\u1161。"]


@register(rf"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE text END || ([{", ".join(f"'{x}'" for x in _AROUND)}])[turn % 6 + 1] AS text FROM conversations)
SELECT conv_id, turn, lower(trim(regexp_replace(trim(regexp_replace(nfc_normalize(text), '{_SPACE_SQL}', ' ', 'g')), '[.!?。]+$', ''))) AS answer,
  CAST(length(trim(regexp_replace(trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g')), '[.!?。]+$', ''))) > 0 AS INTEGER) AS present FROM c""")
def normalised_answers(spark, sf_dir):
    ship(spark)
    own = F.concat(F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.col("text")), F.get(F.array(*map(F.lit, _AROUND)), F.col("turn") % 6))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.answer_normalised(own).alias("answer"), scoring.response_present(own).alias("present"))


@register("SELECT event_id, least(30000, 2000 * CAST(2 ** (event_id % 6) AS BIGINT)) AS wait_ms FROM events")
def backoff(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", scalars.backoff_ms(F.col("event_id") % 6 + 1).alias("wait_ms"))


@register("SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(p_brand, '^\\D*'), CAST(regexp_extract(p_brand, '(\\d+)\\D*$', 1) AS BIGINT), p_partkey) AS position FROM part".replace("\\\\", "\\"))
def natural_order(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return rel.numbered(p, [scalars.natural_key(F.col("p_brand")), F.col("p_partkey")]).select("p_partkey", "position")


@register("""SELECT event_id, sha256('{"k": ' || (props->>'k') || '}') AS jsonb_sha256, '{"k":' || (props->>'k') || '}' AS sorted FROM events""")
def canonical_json(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", canonical.jsonb_sha256(F.col("props")).alias("jsonb_sha256"), canonical.sorted_canonical(F.col("props")).alias("sorted"))


# -- lookups --------------------------------------------------------------------------------


@register("SELECT l.l_orderkey AS question_id, l.l_linenumber AS revision, count(*) AS n FROM lineitem l JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') r USING (l_orderkey, l_linenumber) GROUP BY ALL")
def pinned_revisions(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("revision"), "l_returnflag")
    r = li.where("l_returnflag = 'A'").select("question_id", "revision").distinct()
    return lookups.pinned_revisions(li.drop("l_returnflag"), r).groupBy("question_id", "revision").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT event_id, n_name FROM events LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = props->>'k'")
def join_by_json_key(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return lookups.join_by_json_key(t(spark, sf_dir, "events"), n, "props", "$.k", "n_nationkey").select("event_id", "n_name")


@register("""SELECT event_id, CASE event_type WHEN 'click' THEN c_name WHEN 'view' THEN s_name END AS target_name FROM events
LEFT JOIN customer ON event_type = 'click' AND c_custkey = user_id LEFT JOIN supplier ON event_type = 'view' AND s_suppkey = user_id""")
def polymorphic_targets(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("resolved_type"), F.col("user_id").alias("resolved_id"))
    targets = {"click": (t(spark, sf_dir, "customer"), "c_custkey", "c_name"), "view": (t(spark, sf_dir, "supplier"), "s_suppkey", "s_name")}
    return lookups.resolve_polymorphic(e, targets).select("event_id", "target_name")


@register("""SELECT DISTINCT o_custkey AS run_id, o_orderpriority AS provider_key FROM orders UNION SELECT o_custkey, 'gemini' FROM orders WHERE o_custkey % 3 = 0 UNION SELECT o_custkey, 'judge' FROM orders WHERE o_custkey % 2 = 0""")
def needed_providers(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("provider_key"))
    k = F.col("run_id")
    modes = F.when(k % 3 == 0, F.array(F.lit("NONE"), F.lit("VECTOR"))).otherwise(F.array(F.lit("NONE")))
    runs = o.select("run_id").distinct().select("run_id", modes.alias("retrieval_modes"), F.when(k % 2 == 0, "judge").alias("judge_provider"))
    return lookups.needed_providers(o, runs)


@register("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 2 <> 0")
def not_blocked(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("provider_key"), F.when(F.col("o_orderkey") % 2 == 0, "VECTOR").otherwise("NONE").alias("mode"))
    blocked = spark.range(2).select(F.when(F.col("id") == 0, "gemini").otherwise("1-URGENT").alias("provider_key"))
    return lookups.not_blocked(o, blocked).select("o_orderkey")


@register("SELECT a.p_partkey AS id, a.p_brand AS version, b.p_brand AS parent_version FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - 3")
def parent_versions(spark, sf_dir):
    v = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 3).alias("parent_id"), F.col("p_brand").alias("version"))
    return lookups.with_parent(v).select("id", "version", "parent_version")


@register("""SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")
def conditional_max(spark, sf_dir):
    return lookups.conditional_max(t(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["click", "view"])


@register("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def state_counts(spark, sf_dir):
    return lookups.state_counts(t(spark, sf_dir, "events"), ["user_id"], ["click", "purchase"], "event_type")


@register("SELECT o_custkey AS run_id, count(*) AS recovered, count(*) FILTER (o_orderkey % 6 >= 4) AS terminal FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def lease_recovery(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    i = o.select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "LEASED").otherwise("DONE").alias("state"), F.col("o_orderdate").alias("lease_until"), (F.col("o_orderkey") % 6).alias("attempts"))
    return lookups.lease_recovery(i, "1996-01-01 00:00:00", 4)


@register("SELECT CAST(sum(turn) AS BIGINT) AS turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'system')")
def selected_totals(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select(F.col("role").alias("mode"), "turn", F.length("text").alias("chars"))
    return lookups.selected_totals(c, ["user", "system"], ["turn", "chars"])


@register("""SELECT event_id, '{"a":"2","k":"' || (props->>'k') || '"}' AS merged, event_id % 2 = 0 AS covered FROM events""")
def json_merged(spark, sf_dir):
    base = F.concat(F.lit('{"a":1,"gone":true,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    need = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("VECTOR"))).otherwise(F.array(F.lit("X")))
    covered = lookups.is_subset(need, F.array(F.lit("NONE"), F.lit("VECTOR")))
    return t(spark, sf_dir, "events").select("event_id", lookups.json_merged(base, F.lit('{"a":2}'), ["gone"]).alias("merged"), covered.alias("covered"))


@register(r"""SELECT event_id, sha256('{"b": "' || event_type || '", "aa": [1, {"x": null, "yy": ' || CAST(user_id AS VARCHAR) || '}], "zz": {"é": true, "key": "a\"\n"}}') AS nested FROM events""")
def canonical_nested(spark, sf_dir):
    """Keys by length and bytes at every level, escapes kept."""
    raw = F.concat(F.lit(r'{"zz":{"key":"a\"\n","é":true},"aa":[1.0,{"yy":'), F.col("user_id").cast("string"), F.lit(',"x":null}], "b":"'), F.col("event_type"), F.lit('"}'))
    return t(spark, sf_dir, "events").select("event_id", canonical.jsonb_sha256(raw).alias("nested"))


@register("""SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 12, p_partkey % 30, p_partkey) AS position FROM part""")
def numbered_names(spark, sf_dir):
    """Chapters and sections by their numbers: 2장 10절 before 10장 2절."""
    k = F.col("p_partkey")
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat((k % 12 + 1).cast("string"), F.lit("장 "), (k % 30 + 1).cast("string"), F.lit("절")).alias("name"))
    return rel.numbered(p, [scalars.natural_key(F.col("name")), F.col("p_partkey")]).select("p_partkey", "position")


@register("SELECT n_name, row_number() OVER (ORDER BY n_name) AS position FROM nation")
def collated_names(spark, sf_dir):
    return lookups.collated(t(spark, sf_dir, "nation").select("n_name"), "n_name")
