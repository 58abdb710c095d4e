"""Fundamental and indicator analysis over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.series import Series


def wide(points: DataFrame, keys: list[str], concept: str, value: str, concepts: list[str]) -> DataFrame:
    """One column per concept; the list is given, so no pass is spent on finding it."""
    return points.groupBy(*keys).pivot(concept, concepts).agg(F.first(value))


def margins(points: DataFrame, symbol: str, day: str, top: str, bottom: str) -> DataFrame:
    """top / bottom of the same day where the latter is not 0."""
    return points.where((F.col(bottom) != 0) & F.col(top).isNotNull()).withColumn("margin", F.col(top) / F.col(bottom))


def margin_trend(df: DataFrame, keys: list[str], day: str, margin: str) -> DataFrame:
    """Slope a quarter, trend, mean, population deviation and the warning threshold below it."""
    i = (F.row_number().over(W.partitionBy(*keys).orderBy(day)) - 1).cast("double")
    g = df.withColumn("_i", i).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(margin), F.col("_i")).alias("slope"), F.avg(margin).alias("mean"),
        F.stddev_pop(margin).alias("deviation"), F.max_by(margin, day).alias("latest"),
    )
    trend = F.when(F.col("slope") > 0.0005, "improving").when(F.col("slope") < -0.0005, "worsening").otherwise("flat")
    return g.where("n >= 2").withColumn("trend", trend).withColumn("warning", F.col("mean") - F.col("deviation"))


def scenario(cap: Column, revenue: Column, income: Column, growth: Column, multiple: float = 10.0, years: float = 2.0, derate: float = 1.0) -> Column:
    """What a market value of `multiple` times asks of revenue and income, and whether growth so far would do."""
    ps = F.try_divide(cap, revenue)
    pe = F.when(income > 0, cap / income)
    need = F.when(ps != 0, cap * multiple / (ps * derate))
    cagr = F.when((need != 0) & (revenue != 0) & (need / revenue > 0), F.pow(need / revenue, F.lit(1.0 / years)) - 1)
    return F.struct(
        ps.alias("ps"), pe.alias("pe"), need.alias("required_revenue"), F.when(pe != 0, cap * multiple / (pe * derate)).alias("required_income"),
        cagr.alias("required_cagr"), (growth >= cagr).alias("feasible"),
    )


def survival(ocf: Column, capex: Column, cash: Column) -> Column:
    """Free cash flow and, where it is negative, the quarters that cash lasts."""
    fcf = ocf - F.abs(capex)
    runway = F.when((fcf < 0) & (cash != 0), cash / (F.abs(fcf) / 4))
    verdict = (
        F.when(ocf.isNull(), "unknown").when(capex.isNull() & (ocf >= 0), "positive_without_capex").when(capex.isNull(), "negative_without_capex")
        .when(fcf >= 0, "self_funded").when(runway.isNull(), "needs_funding").otherwise("runway")
    )
    return F.struct(fcf.alias("fcf"), runway.alias("runway_quarters"), verdict.alias("verdict"))


def candidate_tier(scores: list[Column], excluded: Column, candidate: int = 80, watch: int = 65) -> Column:
    """struct(total, tier): the sum of the parts decides, a hard exclusion overrides."""
    total = sum(scores[1:], scores[0])
    tier = F.when(excluded, "excluded").when(total >= candidate, "candidate").when(total >= watch, "watchlist").otherwise("excluded")
    return F.struct(total.alias("total"), tier.alias("tier"))


def hard_gates(subjects: DataFrame, triggers: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """(key, gates, blocked): defined gates that were triggered; a trigger without a definition is none."""
    hit = triggers.join(definitions.select("gate"), "gate", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("gate")).alias("gates"))
    j = subjects.join(hit, key, "left")
    return j.withColumn("gates", F.coalesce("gates", F.array().cast("array<string>"))).withColumn("blocked", F.size("gates") > 0)


def model_cost(prices: DataFrame, usage: DataFrame) -> DataFrame:
    """usage (model, input, output, batch) with its cost in dollars; a model without a price has none."""
    j = usage.join(prices, "model", "left")
    cost = (F.col("input") * F.col("input_price") + F.col("output") * F.col("output_price")) / 1e6
    return j.withColumn("cost", F.when(F.col("batch"), cost * 0.5).otherwise(cost))


def fx_rates(to_usd: DataFrame, target: str) -> DataFrame:
    """(currency, rate) into the target, crossed by the dollar; a currency that is missing counts as 1 where it is used."""
    t = to_usd.where(F.col("currency") == target).select(F.col("usd").alias("_t"))
    return to_usd.join(F.broadcast(t)).select("currency", F.try_divide(F.col("usd"), F.col("_t")).alias("rate"))


def curve_signal(df: DataFrame, s: Series, value: str, day: str) -> DataFrame:
    """Inversion within 12 months, what has been recovered since the trough, and whether fast."""
    t = s.trough(value, 365)
    d = df.withColumn("_t", t)
    inverted = F.col("_t.v") < 0
    back = F.when(inverted, (F.col(value) - F.col("_t.v")) * 100)
    fast = F.coalesce((back >= 75) & (F.datediff(F.col(day), F.col("_t.at")) <= 95), F.lit(False))
    return d.withColumn("inverted", inverted).withColumn("recovered_bps", back).withColumn("rapid", fast).drop("_t")


def positioning(rows: DataFrame, keys: list[str], day: str, long: str, short: str, oi: str) -> DataFrame:
    """Net position in percent of open interest, its change over four reports and its five-year percentile."""
    from ledgerloom.operators.series import with_percentile

    s = Series(tuple(keys), day)
    d = rows.where(F.col(oi) > 0).withColumn("net_pct", (F.col(long) - F.col(short)) / F.col(oi) * 100.0)
    d = d.withColumn("change_4", s.change("net_pct", 4))
    return with_percentile(d, s, "net_pct", 5 * 365, "percentile_5y")


def median_across(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.median(v).alias(f"median_{v}") for v in values], F.count("*").alias("companies"))


def snapshot_table(log: DataFrame, indicators: list[str], times: list, indicator: str = "indicator", at: str = "at", value: str = "value") -> DataFrame:
    """Configured indicators as rows, the wanted times as columns, empty where nothing was recorded."""
    spark = log.sparkSession
    rows = spark.createDataFrame([(x,) for x in indicators], f"{indicator} string")
    p = log.where(F.col(at).isin(*times)).groupBy(indicator).pivot(at, times).agg(F.first(value))
    return rows.join(p, indicator, "left")


def require_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows, or an error if any has a key that is not configured: the whole batch is refused."""
    j = rows.join(known.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    ok = F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("unknown id: "), F.col(key))).cast("boolean")).otherwise(F.lit(True))
    return j.where(ok).drop("_k")
