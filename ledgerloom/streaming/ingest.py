"""Incremental ingest with Structured Streaming.

Landed files are the stream. Exact repeats within the watermark are dropped; a revision (same key,
other value) is never late: it is appended with is_revised, and the latest fetched wins on reading.
A batch run and a streamed run over the same files give the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.catalog import idempotent_append, keep_first
from ledgerloom.operators.scoring import Hysteresis, fold_signal

OBSERVATION = "indicator_id string, observation_date date, value double, status string, fetched_at timestamp"


def landed(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json", files: int = 100) -> DataFrame:
    """New files of a folder; the schema is declared, never inferred."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def without_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """Rows that repeat in all keys within the delay are dropped; state is bounded by it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def into_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, now: bool = True):
    """Run handle for each micro-batch; the checkpoint makes a restart go on where it stopped. A batch may
    be handled twice after a failure, so handle must be idempotent: give it one of the sinks below."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if now else w).start()


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is under path, or nothing before the first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def observation_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Appends what differs from the latest of its key; a batch that is handled again gives the same rows again.

    Each batch has a folder of its own. What a batch is compared with are the folders of the batches before it, never
    its own: after a crash, or when it is replayed, its folder is written anew from the same comparison.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = _rows(batch.sparkSession, path, OBSERVATION + ", is_revised boolean, batch bigint")
        known = log.where(F.col("batch") < batch_id).drop("batch")
        keys = ["indicator_id", "observation_date"]
        new = keep_first(batch, keys, [F.col("fetched_at").desc()])
        out = idempotent_append(known, new, keys, ["value", "status"], "fetched_at")
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def latest_observations(log: DataFrame) -> DataFrame:
    return keep_first(log, ["indicator_id", "observation_date"], [F.col("fetched_at").desc()])


def upsert_sink(path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Keeps a table of the latest row of each key (by `order`; of equal ones the newer batch's), read by `upserted`.

    Rows are dealt to buckets by their key. A batch writes new versions of just the buckets that it has rows of, and then, last of
    all, which version of every bucket counts. A crash before that leaves the old table; a batch that is handled again starts from the
    pointer before it and gives the same table. Batch ids may have gaps. `buckets` bounds what one batch rewrites: choose it so that a
    bucket is some hundred megabytes.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = keep_first(batch, keys, [F.col(order).desc()]).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        versions = _versions(spark, path, batch_id)
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most `buckets`
        both = new.withColumn("__age", F.lit(0))
        old = _bucket_rows(spark, path, {b: versions[b] for b in touched if b in versions})
        if old is not None:
            both = both.unionByName(old.withColumn("__age", F.lit(1)))
        rows = keep_first(both, keys, [F.col(order).desc(), F.col("__age")]).drop("__age")
        rows.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/rows/__version={batch_id}")
        now = sorted((versions | dict.fromkeys(touched, batch_id)).items())
        pointer = spark.createDataFrame(now, "bucket int, version bigint").coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{path}/current/batch={batch_id}")

    return handle


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket after the last complete batch (before a given one)."""
    pointers = _rows(spark, f"{path}/current", "bucket int, version bigint, batch bigint")
    if before is not None:
        pointers = pointers.where(F.col("batch") < before)
    last = pointers.agg(F.max("batch").alias("batch"))
    return {r.bucket: r.version for r in pointers.join(F.broadcast(last), "batch").collect()}


def _bucket_rows(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    paths = [f"{path}/rows/__version={v}/__bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.option("basePath", f"{path}/rows").parquet(*paths).drop("__version")


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that `upsert_sink` keeps; None before its first batch."""
    rows = _bucket_rows(spark, path, _versions(spark, path))
    return None if rows is None else rows.drop("__bucket")


SIGNALS = "ticker string, day date, signal string, since date"


def hysteresis_stream(scores: DataFrame, config: Hysteresis = Hysteresis()) -> DataFrame:
    """The signal of each ticker after each of its days, state kept by key; scores as for the batch operator."""

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None)
        rows = pd.concat(list(pdfs)).sort_values("day")
        out = []
        for r in rows.itertuples():
            now = fold_signal(now, r.day, r.score, bool(r.held), bool(r.gate), config)
            out.append((key[0], r.day, *now))
        state.update(now)
        yield pd.DataFrame(out, columns=["ticker", "day", "signal", "since"])

    return scores.groupBy("ticker").applyInPandasWithState(step, SIGNALS, "signal string, since date", "append", "NoTimeout")


def event_windows(stream: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and totals of events by type and window, each emitted once, when the watermark passes it."""
    e = stream.withWatermark("ts", delay)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
