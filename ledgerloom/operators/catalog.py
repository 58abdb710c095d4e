"""The document catalogue: duplicates, upserts, versions, health, work plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def superseded(df: DataFrame, keys: list[str], published: str, tie: str) -> DataFrame:
    """Adds superseded: true for all but the latest version of a key."""
    w = W.partitionBy(*keys).orderBy(F.col(published).desc(), F.col(tie).desc())
    return df.withColumn("superseded", F.row_number().over(w) > 1)


def cascade_duplicates(new: DataFrame, known: DataFrame, id_col: str, tests: list[list[str]]) -> DataFrame:
    """(id, duplicate_of, rule): for each new row the known row that the first test finds. A test is a list of
    null-safe equal columns, but its first column must not be null.

    Rows and tests are unpivoted to hashed keys, so that all tests cost one join, whatever their
    number; the known side is first brought to one row a key.
    """

    def keyed(df: DataFrame, as_: str) -> DataFrame:
        keys = [
            F.struct(F.lit(i).alias("rule"), F.when(F.col(t[0]).isNotNull(), F.sha2(F.to_json(F.struct(*t)).cast("binary"), 256)).alias("key"))
            for i, t in enumerate(tests)
        ]
        out = df.select(F.col(id_col).alias(as_), F.explode(F.array(*keys)).alias("k"))
        return out.where("k.key IS NOT NULL").select(as_, F.col("k.rule").alias("rule"), F.col("k.key").alias("key"))

    one = keyed(known, "old").groupBy("rule", "key").agg(F.min("old").alias("old"))
    hits = keyed(new, "id").join(one, ["rule", "key"]).groupBy("id").agg(F.min(F.struct("rule", "old")).alias("b"))
    return new.select(F.col(id_col).alias("id")).join(hits, "id", "left").select("id", F.col("b.old").alias("duplicate_of"), F.col("b.rule").alias("rule"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys; the table is written anew."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def diff_plan(present: DataFrame, known: DataFrame, key: str, print_: str) -> DataFrame:
    """(key, action): add, update, keep or remove, by fingerprints."""
    p, k = present.select(key, F.col(print_).alias("_p")), known.select(F.col(key).alias("_key"), F.col(print_).alias("_k"))
    j = p.join(k, F.col(key) == F.col("_key"), "full_outer")
    action = F.when(F.col("_key").isNull(), "add").when(F.col(key).isNull(), "remove").when(F.col("_p").eqNullSafe(F.col("_k")), "keep").otherwise("update")
    return j.select(F.coalesce(key, "_key").alias(key), action.alias("action"))


def idempotent_append(log: DataFrame, new: DataFrame, keys: list[str], values: list[str], fetched: str) -> DataFrame:
    """Rows of new that differ from the latest of their key in the log, with is_revised: null for a first one,
    else whether the first of `values` changed."""
    latest = keep_first(log, keys, [F.col(fetched).desc()]).select(*keys, *[F.col(v).alias(f"_l_{v}") for v in values], F.lit(True).alias("_known"))
    j = new.join(latest, keys, "left")
    same = F.coalesce(F.col("_known"), F.lit(False))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_l_{v}"))
    revised = F.when(F.col("_known").isNotNull(), ~F.col(values[0]).eqNullSafe(F.col(f"_l_{values[0]}")))
    return j.where(~same).withColumn("is_revised", revised).drop("_known", *[f"_l_{v}" for v in values])


def health(docs: DataFrame, by: str) -> DataFrame:
    return docs.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("capture_mode") != "full").alias("stubs"),
        F.count_if(F.col("readable_ratio") < 0.95).alias("corrupt"),
        F.count_if("truncated").alias("truncated"),
        F.max("collected_at").alias("latest"),
    )


def gate_failures(counts: Column, limits: dict[str, float]) -> Column:
    """array<string>: measures over their limit. counts: a struct."""
    over = [F.when(counts[k] > v, F.lit(f"{k} > {v:g}")) for k, v in limits.items()]
    return F.array_compact(F.array(*over))


def refetch_reason(stub: Column, corrupt: Column, truncated: Column) -> Column:
    return F.when(stub, "stub").when(corrupt, "corrupt").when(truncated, "truncated")


def dedupe_plan(copies: DataFrame) -> DataFrame:
    """copies (id, path, analysed, body_hash, indexed, published) with keep and protected.

    A group with different analysed bodies is left alone. Else the analysed copy stays, then the
    one that the catalogue points to, then the newest.
    """
    w = W.partitionBy("id").orderBy(F.col("analysed").desc(), F.col("indexed").desc(), F.col("published").desc_nulls_last(), "path")
    g = W.partitionBy("id")
    bodies = F.size(F.collect_set(F.when(F.col("analysed"), F.col("body_hash"))).over(g))
    c = copies.withColumn("protected", bodies > 1)
    return c.withColumn("keep", F.col("protected") | (F.row_number().over(w) == 1))


def apply_dedupe(documents: DataFrame, plan: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that stay, catalog with the path that stays) after a plan of `dedupe_plan` (id, path, keep)."""
    lost = plan.where(~F.col("keep")).select("path")
    kept = plan.where("keep").groupBy("id").agg(F.min("path").alias("_path"))
    moved = catalog.join(lost.withColumn("_lost", F.lit(True)), "path", "left").join(kept, "id", "left")
    path = F.when(F.col("_lost"), F.coalesce("_path", "path")).otherwise(F.col("path"))
    return documents.join(lost, "path", "left_anti"), moved.withColumn("path", path).drop("_lost", "_path")


def without_held(candidates: DataFrame, positions: DataFrame, name: str = "symbol_or_company") -> DataFrame:
    """Candidates that are no position's symbol or name, whatever the case."""
    held = positions.select(F.explode(F.array(F.lower("symbol"), F.lower("name"))).alias("_held")).where("_held IS NOT NULL").distinct()
    return candidates.join(held, F.lower(name) == F.col("_held"), "left_anti")


def previous_listed(filings: DataFrame, key: str, pos: str, period: str, out: str) -> DataFrame:
    """Adds the position of the first filing in list order whose period is before a filing's own.

    The listed filings of a key are few and lie beside each other in its array."""
    listed = filings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(period).alias("d")))).alias("_all"))
    first = F.get(F.filter("_all", lambda x: x["d"] < F.col(period)), F.lit(0))["p"]
    return filings.join(listed, key).withColumn(out, first).drop("_all")


def replaced_sections(log: DataFrame, new: DataFrame, keys: list[str], at: str, unit: str = "minute") -> DataFrame:
    """A log of sections with those of new in place of those of the same key and minute (or day); others are kept."""
    same = [*keys, "_slot"]
    slot = F.date_trunc(unit, at)
    latest = keep_first(new.withColumn("_slot", slot), same, [F.col(at).desc()])
    return upsert(log.withColumn("_slot", slot), latest, same).drop("_slot")


def take_until_seen(items: DataFrame, keys: list[str], pos: str, seen: Column) -> DataFrame:
    """Newest-first rows before the first one already seen."""
    w = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("_s", F.max(seen.cast("int")).over(w)).where("_s = 0").drop("_s")


def backoff_seconds(failures: Column, base: int = 60) -> Column:
    return F.when(failures > 0, F.lit(base) * F.pow(F.lit(2.0), failures - 1)).otherwise(0.0).cast("bigint")


def within_budget(costs: DataFrame, ts: str, cost: str, daily: int, monthly: int, zone: str = "Asia/Seoul") -> DataFrame:
    """Adds day_spent, month_spent (before each row, by local days and months) and allowed."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    c = costs.withColumn("_day", F.to_date(local)).withColumn("_month", F.trunc(F.to_date(local), "month"))

    def before(value: str, part: str, order: str) -> Column:
        return F.coalesce(F.sum(value).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    # a month is 31 sums of days; only a day's own rows are put in order
    days = c.groupBy("_month", "_day").agg(F.sum(cost).alias("_sum"))
    days = days.select(F.col("_day").alias("_of"), before("_sum", "_month", "_day").alias("_earlier"))
    c = c.withColumn("day_spent", before(cost, "_day", ts)).join(days, F.col("_day") == F.col("_of"))
    c = c.withColumn("month_spent", F.col("_earlier") + F.col("day_spent")).drop("_of", "_earlier")
    return c.withColumn("allowed", (F.col("day_spent") < daily) & (F.col("month_spent") < monthly)).drop("_day", "_month")


def pack(items: DataFrame, keys: list[str], order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """Adds batch: items in order, a new batch when the next would pass either limit.

    State feeds back, so the items of a key pass one task in order (keys are meant to be sources, not the corpus); they stream
    through it, and nothing is held but the batch's counts."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, batch, count, total = None, 0, 0, 0
        for b in batches:
            ids = list(zip(*[b.column(names.index(k)).to_pylist() for k in keys], strict=True))
            out = []
            for at, n in zip(ids, b.column(names.index(size)).to_pylist(), strict=True):
                n = int(n or 0)
                if at != key:
                    key, batch, count, total = at, 0, 0, 0
                if count + 1 > most_items or (total + n > most_size and count):
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*names, "batch"])

    schema = StructType([*items.schema.fields, StructField("batch", IntegerType())])
    return items.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
