"""Institutional holdings: positions, changes between filings, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.portfolio import totals_weight
from ledgerloom.session import tasks_for

#: Values of filings before this day are in thousands of dollars.
DOLLAR_SINCE = "2023-01-03"


def value_unit(filing_date: Column) -> Column:
    return F.when(filing_date < F.lit(DOLLAR_SINCE).cast("date"), F.lit(1000)).otherwise(F.lit(1))


def aggregate_positions(rows: DataFrame, keys: list[str], sums: list[str], single: dict[str, Column] | None = None) -> DataFrame:
    """One row per position: sums, the number of rows, and columns that keep their value only if all
    rows agree (single: column -> what it becomes otherwise).

    Positions have few rows, so rows are dealt first: sorting each input split to sum it saves little and holds the split."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.count("*").alias("row_count")]
    for c, mixed in (single or {}).items():
        text = F.coalesce(F.to_json(F.struct(c)), F.lit(""))
        same = F.min(text) == F.max(text)
        aggs.append(F.when(same, F.first(c)).otherwise(mixed).alias(c))
    return rows.repartition(tasks_for(rows), *keys).groupBy(*keys).agg(*aggs)


def holding_changes(previous: DataFrame, current: DataFrame, keys: list[str], owner: list[str] = ()) -> DataFrame:
    """Positions of two filings side by side. Keys are null-safe: a null put_call is a position of
    its own and meets itself. Weights are of the current total of each owner."""
    p, c = previous.alias("p"), current.alias("c")
    cond = None
    for k in [*owner, *keys]:
        e = F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
        cond = e if cond is None else cond & e
    both = p.join(c, cond, "full_outer")
    here, before = F.col("c.shares"), F.col("p.shares")
    change = (
        F.when(F.col("p.row_count").isNull(), "new")
        .when(F.col("c.row_count").isNull(), "sold_out")
        .when(here > before, "increased")
        .when(here < before, "decreased")
        .otherwise("held")
    )
    out = both.select(
        *[F.coalesce(F.col(f"c.{k}"), F.col(f"p.{k}")).alias(k) for k in [*owner, *keys]],
        change.alias("change_type"),
        before.alias("previous_shares"),
        here.alias("current_shares"),
        F.coalesce(F.col("c.value"), F.col("p.value")).alias("value"),
        F.col("c.value").alias("_now"),
        F.when(before != 0, (here - before) / before * 100.0).alias("shares_change_pct"),
    )
    out = totals_weight(out, "_now", list(owner), "weight_pct")
    return out.withColumn("weight_pct", F.col("weight_pct") * 100.0).drop("_now")


def concentration(positions: DataFrame, owner: list[str], value: str, top: int = 5) -> DataFrame:
    """Percent of the total in the `top` largest positions; 0 where the total is 0."""
    rank = F.row_number().over(W.partitionBy(*owner).orderBy(F.col(value).desc()))
    r = positions.withColumn("_r", rank).groupBy(*owner)
    share = F.try_divide(F.sum(F.when(F.col("_r") <= top, F.col(value))) * 100.0, F.sum(value))
    return r.agg(F.coalesce(share, F.lit(0.0)).alias("concentration_pct"))


def top_positions(positions: DataFrame, owner: list[str], value: str, n: int, ties: list[str]) -> DataFrame:
    w = W.partitionBy(*owner).orderBy(F.col(value).desc(), *ties)
    return positions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
