"""Streaming sinks: replays, crashes between write and commit, gaps in batch ids."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.session import removed
from ledgerloom.streaming import ingest as I


def observations(spark, *rows):
    d = dt.date(2024, 1, 1)
    data = [(i, d + dt.timedelta(days=n), float(v), "ok", dt.datetime(2024, 2, 1) + dt.timedelta(hours=h)) for i, n, v, h in rows]
    return spark.createDataFrame(data, I.OBSERVATION)


def log(spark, path):
    return sorted(((r.indicator_id, r.observation_date.day, r.value, r.is_revised) for r in spark.read.parquet(path).collect()), key=lambda r: r[:3])


def test_observations_survive_replays(spark, tmp_path):
    path, sink = f"{tmp_path}/log", I.observation_sink(f"{tmp_path}/log")
    one = observations(spark, ("a", 0, 1, 0), ("a", 1, 2, 0))
    two = observations(spark, ("a", 0, 1, 5), ("a", 1, 3, 5), ("b", 0, 9, 5))
    sink(one, 0)
    first = log(spark, path)
    sink(one, 0)
    assert log(spark, path) == first == [("a", 1, 1.0, None), ("a", 2, 2.0, None)]
    sink(two, 4)
    both = log(spark, path)
    assert both == [("a", 1, 1.0, None), ("a", 2, 2.0, None), ("a", 2, 3.0, True), ("b", 1, 9.0, None)]
    sink(two, 4)  # written, not committed, handled again
    assert log(spark, path) == both
    removed(spark, f"{path}/batch=4")  # crashed before the write
    sink(two, 4)
    assert log(spark, path) == both
    latest = I.latest_observations(spark.read.parquet(path)).collect()
    assert sorted((r.indicator_id, r.value) for r in latest) == [("a", 1.0), ("a", 3.0), ("b", 9.0)]


def test_upserts_survive_replays(spark, tmp_path):
    path = f"{tmp_path}/t"
    sink = I.upsert_sink(path, ["k"], "at", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    table = lambda: sorted(tuple(r) for r in I.upserted(spark, path).select("k", "at", "v").collect())
    assert I.upserted(spark, path) is None
    sink(rows(*[(k, 1, "a") for k in range(20)]), 0)
    sink(rows((3, 2, "b"), (3, 3, "c"), (4, 0, "old"), (5, 1, "same"), (99, 1, "new")), 7)
    want = sorted([(k, 1, "a") for k in range(20) if k not in (3, 5)] + [(3, 3, "c"), (5, 1, "same"), (99, 1, "new")])
    assert table() == want
    sink(rows((3, 2, "b"), (3, 3, "c"), (4, 0, "old"), (5, 1, "same"), (99, 1, "new")), 7)
    assert table() == want
    # rows written, pointer not: the old table still counts, and the replay ends the batch
    sink(rows((3, 9, "z")), 8)
    removed(spark, f"{path}/current/batch=8")
    assert table() == want
    sink(rows((3, 9, "z")), 8)
    assert table() == sorted([r for r in want if r[0] != 3] + [(3, 9, "z")])
    touched = spark.read.parquet(f"{path}/rows/__version=8").select("__bucket").distinct().count()
    assert touched == 1


def test_sinks_of_a_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    observations(spark, ("a", 0, 1, 0), ("b", 0, 2, 0)).write.json(src)
    stream = I.landed(spark, src, I.OBSERVATION, files=1)
    I.into_batches(stream, I.observation_sink(f"{tmp_path}/log"), f"{tmp_path}/state").awaitTermination()
    assert len(log(spark, f"{tmp_path}/log")) == 2
    assert spark.read.parquet(f"{tmp_path}/log").where(F.col("value") == 2).count() == 1
