"""Portfolio values, weights, guardrails and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def position_metrics(positions: DataFrame, prices: DataFrame, rates: DataFrame) -> DataFrame:
    """positions (symbol, quantity, average_cost, currency) with market value, return and weight.

    A missing price gives nulls; a missing rate counts as 1. Prices and rates are joined on their
    keys; Spark broadcasts them where statistics show that they are small.
    """
    p = positions.join(prices, "symbol", "left").join(rates, "currency", "left")
    value = F.col("quantity") * F.col("price") * F.coalesce(F.col("rate"), F.lit(1.0))
    p = p.withColumn("market_value", value)
    gain = F.when(F.col("average_cost") != 0, (F.col("price") - F.col("average_cost")) / F.col("average_cost"))
    return totals_weight(p.withColumn("return_pct", gain * 100.0), "market_value", [])


def totals_weight(positions: DataFrame, value: str, owner: list[str], out: str = "weight") -> DataFrame:
    """Weight within an owner (or of all), by a pre-aggregated total instead of a window over all its rows."""
    total = positions.groupBy(*owner).agg(F.sum(value).alias("_total"))
    # without owners the total is one row
    both = positions.join(total, owner) if owner else positions.join(F.broadcast(total))
    return both.withColumn(out, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def sector_weights(positions: DataFrame, sector: str, value: str) -> DataFrame:
    s = positions.groupBy(sector).agg(F.sum(value).alias("sector_value"))
    return totals_weight(s, "sector_value", [], "sector_weight")


def guardrails(
    positions: DataFrame, max_position: float, max_sector: float, shorts: bool = False, options: bool = False
) -> DataFrame:
    """(symbol, rule): one row per broken rule of positions (symbol, sector, quantity, asset_type,
    weight, sector_weight)."""
    rules = F.array(
        F.when(F.col("weight") > max_position, "max_single_position_weight"),
        F.when(F.col("sector_weight") > max_sector, "max_sector_weight"),
        F.when((F.col("quantity") < 0) & F.lit(not shorts), "short_selling_allowed"),
        F.when(F.lower("asset_type").contains("option") & F.lit(not options), "options_allowed"),
    )
    return positions.select("symbol", F.explode(F.array_compact(rules)).alias("rule"))


RATINGS = ("sell", "reduce", "hold", "buy", "strong_buy")


def capped_rating(suggested: Column, cap: Column) -> Column:
    """The lower of two ratings; a null cap does not bind."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(RATINGS) for x in (r, i)])
    return F.when(F.try_element_at(order, suggested) > F.try_element_at(order, cap), cap).otherwise(suggested)


def low_confidence(strength: Column, rating: Column, least: int = 70) -> Column:
    """struct(rating, status): a weak signal has no rating and is pending."""
    weak = strength < least
    return F.struct(
        F.when(~weak, rating).alias("rating"), F.when(weak, "pending").otherwise("complete").alias("status")
    )


def rank_allocation(held: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, kind, confidence, rank): holdings before candidates on ties, then by name. Only candidates
    of tier 'candidate' take part."""
    rows = held.select("name", F.lit("held").alias("kind"), "confidence", F.lit(0).alias("_o")).unionByName(
        candidates.where("tier = 'candidate'").select("name", F.lit("new").alias("kind"), "confidence", F.lit(1).alias("_o"))
    )
    # how many stand before each confidence and kind: as few rows as there are confidences
    level = rows.groupBy("confidence", "_o").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.orderBy(F.col("confidence").desc(), "_o").rowsBetween(W.unboundedPreceding, 0))
    level = level.select(F.col("confidence").alias("_c"), F.col("_o").alias("_k"), (upto - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("confidence", "_o").orderBy("name"))
    placed = rows.withColumn("_i", inside).join(level, F.col("confidence").eqNullSafe(F.col("_c")) & (F.col("_o") == F.col("_k")))
    return placed.select("name", "kind", "confidence", (F.col("_before") + F.col("_i")).cast("int").alias("rank"))


def vote(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Rating from claims of medium or high confidence: more bullish buys, more bearish reduces."""
    strong = F.col("confidence").isin("medium", "high")
    c = claims.groupBy(*keys).agg(
        F.count_if(strong & (F.col("direction") == "bullish")).alias("bullish"),
        F.count_if(strong & (F.col("direction") == "bearish")).alias("bearish"),
    )
    rating = F.when(F.col("bullish") > F.col("bearish"), "buy").when(F.col("bearish") > F.col("bullish"), "reduce")
    return c.withColumn("rating", rating.otherwise("hold"))
