"""Collecting from many sources: what is new of each, its checkpoint, and runs in which one source's failure stops no other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.catalog import backoff_seconds

CHECKPOINT = "source_id string, last_seen_id string, failures int, next_retry_at timestamp, backfill_completed boolean"


def due(checkpoints: DataFrame, now: Column) -> DataFrame:
    """Sources that may be asked: those that wait for no retry."""
    return checkpoints.where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))


def newer_than_last(items: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Items (source_id, item_id, at) later than the item last seen of their source; all of a source that has seen none, or
    whose last one is not among its items."""
    last = checkpoints.where("last_seen_id IS NOT NULL").select("source_id", F.col("last_seen_id").alias("item_id"))
    seen = items.join(last, ["source_id", "item_id"]).groupBy("source_id").agg(F.max("at").alias("_after"))
    return items.join(seen, "source_id", "left").where(F.col("_after").isNull() | (F.col("at") > F.col("_after"))).drop("_after")


def backfill(items: DataFrame, checkpoints: DataFrame, since: Column) -> DataFrame:
    """Items since a day of sources whose backfill is still to come."""
    open_ = checkpoints.where(~F.coalesce(F.col("backfill_completed"), F.lit(False))).select("source_id")
    return items.join(open_, "source_id", "left_semi").where(F.col("at") >= since)


def advanced(checkpoints: DataFrame, collected: DataFrame, failed: DataFrame, now: Column, filled: bool = False) -> DataFrame:
    """Checkpoints after a run: of a source that was asked, the latest item (ties by id) and no failures; of one that failed,
    one failure more and a retry after 60 seconds, doubled with each; a source that is new gets a row."""
    best = collected.groupBy("source_id").agg(F.max(F.struct("at", "item_id")).alias("_best"))
    bad = failed.select("source_id").distinct().withColumn("_bad", F.lit(True))
    every = checkpoints.select("source_id").unionByName(best.select("source_id")).unionByName(bad.select("source_id")).distinct()
    j = every.join(checkpoints, "source_id", "left").join(best, "source_id", "left").join(bad, "source_id", "left")
    is_bad, count = F.coalesce("_bad", F.lit(False)), F.coalesce("failures", F.lit(0))
    asked = ~is_bad & F.col("_best").isNotNull()
    failures = F.when(is_bad, count + 1).when(asked, 0).otherwise(count)
    retry = F.when(is_bad, F.timestamp_seconds(F.unix_seconds(now) + backoff_seconds(failures))).when(~asked, F.col("next_retry_at"))
    done = F.coalesce("backfill_completed", F.lit(False))
    return j.select(
        "source_id", F.when(asked, F.col("_best.item_id")).otherwise(F.col("last_seen_id")).alias("last_seen_id"), failures.cast("int").alias("failures"),
        retry.alias("next_retry_at"), (F.when(asked, True).otherwise(done) if filled else done).alias("backfill_completed"),
    )


@dataclass(frozen=True)
class Run:
    source_id: str
    n: int
    error: str | None = None


def run_sources(sources: list[str], collect: Callable[[str], int], done: Callable[[Run], None] | None = None) -> list[Run]:
    """collect(source) for each; it writes what it found and returns how much. An error is that source's result, not the
    end of the run; `done` is told after each, to store its checkpoint before the next."""
    out = []
    for s in sources:
        try:
            r = Run(s, collect(s))
        except Exception as e:  # whatever a source does wrong is its own result
            r = Run(s, 0, f"{type(e).__name__}: {e}")
        if done:
            done(r)
        out.append(r)
    return out
