"""The cursor source: streamed equals batch; restarts lose and repeat nothing."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.events import after_cursor
from lectern.session import ship
from lectern.streaming import cursor

SCHEMA = "event_id long, aggregate_id long, kind string"


@pytest.fixture()
def log(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(cursor.EventCursor)
    path = str(tmp_path / "log")

    def write(low, high):
        rows = [(k, k % 7, f"E{k % 3}") for k in range(low, high)]
        spark.createDataFrame(rows[::-1], SCHEMA).repartition(2).write.mode("append").parquet(path)

    return path, write


def follow(spark, path, checkpoint, sink, **options):
    stream = spark.readStream.format("event_cursor").schema(SCHEMA).options(path=path, **options).load()
    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink.append([tuple(r) for r in df.orderBy("event_id").collect()])).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [r for batch in sink for r in batch]


def test_reads_are_bounded_and_in_order(spark, log, tmp_path):
    path, write = log
    write(1, 31)
    sink = []
    got = follow(spark, path, str(tmp_path / "c"), sink, limit=8)
    assert [r[0] for r in got] == list(range(1, 31)) and max(map(len, sink)) <= 8


def test_restart_goes_on_behind_the_last_event(spark, log, tmp_path):
    path, write = log
    write(1, 15)
    first, second = [], []
    follow(spark, path, str(tmp_path / "c"), first, limit=5)
    write(15, 40)
    follow(spark, path, str(tmp_path / "c"), second, limit=5, after=3)  # the checkpoint holds, not the option
    ids = [r[0] for batch in first + second for r in batch]
    assert ids == list(range(1, 40))


def test_new_reader_starts_at_the_larger_cursor_with_its_jobs(spark, log, tmp_path):
    path, write = log
    write(1, 60)
    jobs = spark.createDataFrame([(2, 5), (2, 5), (3, 6)], "aggregate_id long, job_id long")
    own = cursor.members(2, jobs)
    assert own == "2,5"
    got = follow(spark, path, str(tmp_path / "c"), [], after=10, last_event_id=20, aggregates=own)
    events = spark.read.parquet(path)
    batch = after_cursor(events, 20, own=spark.createDataFrame([(2,), (5,)], "aggregate_id long"))
    assert got == [tuple(r) for r in batch.select("event_id", "aggregate_id", "kind").orderBy("event_id").collect()] == [(k, k % 7, f"E{k % 3}") for k in range(21, 60) if k % 7 in (2, 5)]
    assert [r.event_id for r in after_cursor(events, 20, limit=3).collect()] == [21, 22, 23]


def test_nothing_behind_the_cursor(spark, log, tmp_path):
    path, write = log
    write(1, 5)
    assert follow(spark, path, str(tmp_path / "c"), [], after=99) == []


def test_a_replayed_read_is_the_same(log):
    path, write = log
    write(1, 30)
    reader = cursor._Reader({"path": path, "limit": "10"}, ["event_id", "kind"])
    rows, end = reader.read({"after": 4})
    rows = list(rows)
    write(30, 50)
    assert list(reader.readBetweenOffsets({"after": 4}, end)) == rows and end == {"after": 14} and reader.read({"after": 49})[1] == {"after": 49}


def test_catching_up_takes_one_micro_batch(spark, log, tmp_path):
    """executors read all that is behind the cursor at once; a restart goes on behind it."""
    path, write = log
    write(1, 60)
    first, second = [], []
    options = {"limit": 5, "after": 10, "catch_up": "true", "aggregates": "2,5"}
    got = follow(spark, path, str(tmp_path / "c"), first, **options)
    assert [r[0] for r in got] == [k for k in range(11, 60) if k % 7 in (2, 5)] and len([b for b in first if b]) == 1
    write(60, 90)
    follow(spark, path, str(tmp_path / "c"), second, **options)
    assert [r[0] for b in second for r in b] == [k for k in range(60, 90) if k % 7 in (2, 5)]
    reader = cursor._CatchUp({"path": path, "limit": "4"}, ["event_id", "kind"])
    parts = [b for p in reader.partitions({"after": 0}, reader.latestOffset()) for b in reader.read(p)]
    assert max(b.num_rows for b in parts) <= 4 and sorted(k for b in parts for k in b.column("event_id").to_pylist()) == list(range(1, 90))
    assert follow(spark, path, str(tmp_path / "d"), [], **(options | {"after": 99})) == []
