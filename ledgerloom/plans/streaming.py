"""Streaming queries: the events table as a stream of files, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import scoring as S
from ledgerloom.plans.series import DAILY_SQL, daily
from ledgerloom.session import ready, table, work_path
from ledgerloom.streaming import collect as L
from ledgerloom.streaming import ingest as I


def _run(spark, stream, label):
    """A stream written to the shared folder to its end, then read."""
    path, schema = work_path(spark, label), stream.schema
    q = stream.writeStream.format("parquet").option("checkpointLocation", path + "-state").option("path", path)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


def _events(spark, sf_dir):
    """The table's folder as a stream of its one file."""
    ready(spark)
    schema = table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True)
    e = r.parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def stream_dedupe(spark, sf_dir):
    """Each event twice in the stream, once in the result."""
    e = _events(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _run(spark, I.without_repeats(e, ["event_id"], "ts"), "stream-dedupe").select("event_id")


def stream_windows(spark, sf_dir):
    """Daily counts of events; a window is emitted when the watermark passes its end."""
    w = _run(spark, I.event_windows(_events(spark, sf_dir)), "stream-windows")
    return w.select("event_type", F.to_date("window.start").alias("day"), "n", "cents")


def stream_hysteresis(spark, sf_dir):
    """Hysteresis of a stream of daily scores: the same rows as the batch operator."""
    d = daily(spark, sf_dir)
    s = d.select(F.col("event_type").alias("ticker"), "day", (F.col("cents") % 101).cast("double").alias("score"), (F.dayofmonth("day") % 2 == 0).alias("held"), (F.col("cents") % 17 == 0).alias("gate"))
    path = work_path(spark, "stream-scores")
    s.write.parquet(path)
    stream = spark.readStream.schema(s.schema).parquet(path)
    got = _run(spark, I.hysteresis_stream(stream), "stream-signals")
    return got.exceptAll(S.hysteresis(s)).unionByName(S.hysteresis(s).exceptAll(got)).agg(F.count("*").alias("differences"))


def _items(spark, sf_dir):
    """Orders as items of their customers' feeds."""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").cast("string").alias("item_id"), F.to_date("o_orderdate").alias("at"))
    seen = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(
        F.col("o_custkey").cast("string").alias("source_id"), F.when(F.col("o_custkey") % 3 > 0, F.col("k").cast("string")).when(F.col("o_custkey") % 2 == 0, "gone").alias("last_seen_id"),
        (F.col("o_custkey") % 4).cast("int").alias("failures"), F.lit(None).cast("timestamp").alias("next_retry_at"), (F.col("o_custkey") % 5 == 0).alias("backfill_completed"),
    )
    return items, seen


def newer_items(spark, sf_dir):
    return L.newer_than_last(*_items(spark, sf_dir)).select("source_id", "item_id")


def backfill_items(spark, sf_dir):
    return L.backfill(*_items(spark, sf_dir), F.lit("1997-01-01").cast("date")).select("source_id", "item_id")


def checkpoints_advanced(spark, sf_dir):
    items, seen = _items(spark, sf_dir)
    failed = seen.where("source_id % 7 = 0").select("source_id")
    out = L.advanced(seen, items.where("source_id % 2 = 0"), failed, F.lit("2024-01-01 00:00:00").cast("timestamp"), filled=True)
    return out.withColumn("wait", F.unix_seconds("next_retry_at") - 1704067200).drop("next_retry_at")


_ITEMS = """WITH i AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate::DATE AS d FROM orders), s AS (SELECT c, min(k) AS k FROM i GROUP BY 1), a AS (SELECT c, d AS after FROM i JOIN s USING (c, k) WHERE c % 3 > 0)"""

QUERIES = {
    "newer_items": (newer_items, _ITEMS + " SELECT c::VARCHAR AS source_id, k::VARCHAR AS item_id FROM i LEFT JOIN a USING (c) WHERE after IS NULL OR d > after"),
    "backfill_items": (backfill_items, "SELECT o_custkey::VARCHAR AS source_id, o_orderkey::VARCHAR AS item_id FROM orders WHERE o_custkey % 5 > 0 AND o_orderdate::DATE >= DATE '1997-01-01'"),
    "checkpoints_advanced": (checkpoints_advanced, _ITEMS + """, b AS (SELECT c, arg_max(k::VARCHAR, (d, k::VARCHAR)) AS best FROM i GROUP BY 1)
SELECT c::VARCHAR AS source_id, CASE WHEN c % 7 > 0 AND c % 2 = 0 THEN best WHEN c % 3 > 0 THEN s.k::VARCHAR WHEN c % 2 = 0 THEN 'gone' END AS last_seen_id,
 (CASE WHEN c % 7 = 0 THEN c % 4 + 1 WHEN c % 2 = 0 THEN 0 ELSE c % 4 END)::INTEGER AS failures, c % 5 = 0 OR (c % 7 > 0 AND c % 2 = 0) AS backfill_completed, CASE WHEN c % 7 = 0 THEN (60 * 2 ** (c % 4))::BIGINT END AS wait FROM s JOIN b USING (c)"""),
    "stream_dedupe": (stream_dedupe, "SELECT event_id FROM events"),
    "stream_windows": (stream_windows, f"WITH {DAILY_SQL} SELECT event_type, day, volume AS n, cents FROM daily WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"),
    "stream_hysteresis": (stream_hysteresis, "SELECT 0::BIGINT AS differences"),
}
