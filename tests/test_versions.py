"""Versioned tables, blob stores and pointer chains."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import relational as rel
from lectern.sources import sinks
from lectern.sources.versions import VersionConflict, VersionedTable, pinned


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_stay_on_their_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert t.append(a) == 1
    held = pinned({"t": t})["t"]
    assert t.append(spark.createDataFrame([(3, "z")], a.schema)) == 2
    assert rows_of(held) == [(1, "x"), (2, None)] == rows_of(t.read(1)) and t.read().count() == 3
    assert t.replace(a.where("k = 1")) == 3 and rows_of(t.read()) == [(1, "x")] and t.read(2).count() == 3


def test_repeated_batches_and_known_keys_change_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert t.insert_new(a, ["k"]) == 1 and t.read().count() == 2
    assert t.insert_new(a, ["k"]) == 1
    assert t.insert_new(a.union(a.selectExpr("k + 1", "v")), ["k"], batch="b") == 2 == t.insert_new(a, ["k"], batch="b")
    assert t.holds("b") and not t.holds("c") and rows_of(t.read()) in ([(1, "x"), (2, "y"), (3, "y")],)
    log = spark.createDataFrame([("p", 5, "a"), ("p", 9, "b"), ("q", 1, "c")], "k string, until int, why string")
    s = VersionedTable(spark, str(tmp_path / "s"))
    for _ in range(2):
        s.update(lambda state: rel.merged_deadlines(state, log, "k", "until", ["why"]), batch="1")
    s.update(lambda state: rel.merged_deadlines(state, log.where("until < 9"), "k", "until", ["why"]), batch="2")
    assert rows_of(s.read()) == [("p", 9, "b", 3), ("q", 1, "c", 2)] and s.latest() == 2


def test_one_of_two_writers_wins(spark, tmp_path):
    a, b = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    df = spark.range(3)
    a.append(df)

    def late(held):
        b.append(df)  # another writer, while this one is at work
        return held

    with pytest.raises(VersionConflict):
        a.update(late)
    assert a.latest() == 2 and a.read().count() == 6


def test_empty_tables(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.append(spark.createDataFrame([], "k int, v string")) == 1 and t.read().columns == ["k", "v"] and t.read().count() == 0
    assert t.append(spark.createDataFrame([(1, "x")], "k int, v string")) == 2 and t.read().count() == 1


def test_second_write_stores_no_blob(spark, tmp_path):
    d = spark.createDataFrame([(k, f"text {k % 40}") for k in range(100)] + [(200, None)], "k int, body string")
    path = str(tmp_path / "blobs")
    assert [sinks.write_blobs(x, "body", path) for x in (d.where("k < 20"), d, d, d.limit(0))] == [20, 20, 0, 0]
    held = sinks.blob_store(spark, path).read()
    assert held.count() == 40 and held.where(F.sha2(F.col("content").cast("binary"), 256) != F.col("sha256")).count() == 0 and sinks.blob_store(spark, path).latest() == 2
    assert held.where("prefix <> substring(sha256, 1, 2)").count() == 0


def test_same_hash_of_other_bytes_is_refused(spark, tmp_path):
    path = str(tmp_path / "blobs")
    d = spark.createDataFrame([("a",)], "body string")
    sinks.write_blobs(d, "body", path)
    store = sinks.blob_store(spark, path)
    store.replace(store.read().withColumn("bytes", F.lit(7).cast("long")))  # as if its content were another
    with pytest.raises(ValueError):
        sinks.write_blobs(d, "body", path)


def test_long_chains_cycles_and_ends(spark):
    rows = [(k, k - 1 if k % 300 else None, "x") for k in range(600)] + [(1000 + k, 1000 + (k + 1) % 7, "x") for k in range(7)] + [(2000, 1003, "x"), (3000, 4000, "x"), (3001, 3000, "x"), (5000, None, None), (5001, 5000, "x"), (6000, 6000, "x")]
    df = spark.createDataFrame(rows, "k long, p long, v string")
    got = {r.k: (r.root, r.hops if r.state != "CYCLE" else None, r.state) for r in rel.follow_pointers(df, "k", "p", payload=["v"]).collect()}
    want = {k: (k // 300 * 300, k % 300, "RESOLVED" if k % 300 else "ROOT") for k in range(600)}
    want |= {1000 + k: (None, None, "CYCLE") for k in range(7)} | {2000: (None, None, "CYCLE"), 6000: (None, None, "CYCLE"), 3000: (None, 1, "DANGLING"), 3001: (None, 2, "DANGLING"), 5000: (None, 0, "INCOMPLETE"), 5001: (None, 1, "INCOMPLETE")}
    assert got == want
