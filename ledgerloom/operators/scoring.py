"""Scores: linear maps, weighted means that leave out what is missing, categories, confidence,
regimes, valuation, hysteresis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import bounded


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def linear_map(x: Column, bad: float, good: float) -> Column:
    """bad -> 0, good -> 100, clamped, one decimal; 50 where the two are equal."""
    if bad == good:
        return F.when(x.isNotNull(), F.lit(50.0))
    return F.round(clamp((x - bad) / (good - bad) * 100.0), 1)


# Scores of a trend told in words.
TRENDS = {"개선": 85.0, "횡보": 50.0, "악화": 15.0}


def normalize_metric(kind: Column, value: Column, bad: Column, good: Column, trend: Column) -> Column:
    """0 to 100 by the kind of the metric; null if it cannot be told."""
    mapped = F.when(bad == good, 50.0).otherwise(F.round(clamp(F.try_divide(value - bad, good - bad) * 100.0), 1))
    percent = F.when(value.between(-1.0, 1.0), value * 100.0).otherwise(value)
    told = F.try_element_at(F.create_map(*[F.lit(x) for kv in TRENDS.items() for x in kv]), trend)
    return (
        F.when(kind == "qualitative_trend", told)
        .when(value.isNull(), None)
        .when(kind.isin("growth_rate_pct", "inverse_growth_rate_pct", "inverse_months"), mapped)
        .when(kind == "percent_passthrough", F.round(clamp(percent), 1))
        .when(kind == "boolean", F.when(value >= 1.0, 100.0).otherwise(0.0))
    )


def weighted(lines: DataFrame, keys: list[str], weight: str, part: str) -> DataFrame:
    """(keys, score, coverage): mean of what is there, weights renormalised; null where nothing is."""
    there = F.when(F.col(part).isNotNull(), F.col(weight))
    return lines.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(weight) * F.col(part)), F.sum(there)).alias("score"),
        F.coalesce(F.try_divide(F.sum(there), F.sum(weight)), F.lit(0.0)).alias("coverage"),
    )


def weighted_row(parts: list[tuple[float, Column]]) -> tuple[Column, Column]:
    """The same over columns of one row: (score, coverage)."""
    there = sum((F.when(p.isNotNull(), w).otherwise(0.0) for w, p in parts), F.lit(0.0))
    total = sum((F.coalesce(p * w, F.lit(0.0)) for w, p in parts), F.lit(0.0))
    return F.try_divide(total, F.nullif(there, F.lit(0.0))), there / sum(w for w, _ in parts)


def category_scores(features: DataFrame, specs: DataFrame, as_of: Column) -> DataFrame:
    """(ticker, category, score, coverage, missing) of features (ticker, metric, value, trend, source_tier,
    fact_type, published_at, max_age_days) under specs (category, metric, kind, bad, good).

    Every ticker meets every metric of the specs, so what is missing shows; social sources, rumours
    and stale features count as missing. The specs are a small table of configuration.
    """
    tickers = features.select("ticker").distinct()
    wanted = tickers.join(bounded(specs, 10_000, "specs of metrics"))
    f = features.select("ticker", "metric", "value", "trend", "source_tier", "fact_type", "published_at", "max_age_days")
    j = wanted.join(f, ["ticker", "metric"], "left")
    stale = F.coalesce(F.datediff(as_of, F.to_date("published_at")) > F.col("max_age_days"), F.lit(False))
    ok = F.col("source_tier").isNotNull() & (F.col("source_tier") != "social") & ~F.coalesce(F.col("fact_type") == "rumor", F.lit(False)) & ~stale
    part = F.when(ok, normalize_metric(F.col("kind"), F.col("value"), F.col("bad"), F.col("good"), F.col("trend")))
    j = j.withColumn("part", part)
    return j.groupBy("ticker", "category").agg(
        F.avg("part").alias("score"),
        F.avg(F.col("part").isNotNull().cast("double")).alias("coverage"),
        F.array_sort(F.collect_list(F.when(F.col("part").isNull(), F.col("metric")))).alias("missing"),
    )


def confidence(coverage: Column, tiers: Column, missing: Column, penalty: float = 0.02, places: int = 3) -> Column:
    """Half coverage, half the tiers of the sources (array), less a capped penalty for what is missing."""
    n = F.size(tiers)
    high = F.size(F.filter(tiers, lambda t: t.isin("official", "industry")))
    broker = F.size(F.filter(tiers, lambda t: t == "broker"))
    tier = F.when(n > 0, (high + 0.6 * broker) / n).otherwise(0.5)
    value = clamp(0.5 * coverage + 0.5 * tier - F.least(F.lit(0.20), penalty * missing), 0.0, 1.0)
    return F.when((coverage <= 0) & (n == 0), 0.0).otherwise(F.round(value, places))


def level(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, "low").when(x >= high, "high").otherwise("medium")


def valuation_score(price: Column, bear: Column, base: Column, bull: Column) -> Column:
    """100 at the bear case or below, 50 at the base case, 0 at the bull case or above."""
    low, high = F.coalesce(bear, base * 0.5), F.coalesce(bull, base * 1.5)
    below = F.when(base == low, 75.0).otherwise(F.round(50.0 + F.try_divide(base - price, base - low) * 50.0, 1))
    above = F.when(high == base, 25.0).otherwise(F.round(50.0 - F.try_divide(price - base, high - base) * 50.0, 1))
    out = F.when(price <= low, 100.0).when(price >= high, 0.0).when(price <= base, below).otherwise(above)
    return F.when(price.isNotNull() & base.isNotNull(), out)


def earnings_revision(eps_1m: Column, eps_3m: Column, up: Column, down: Column, surprise: Column) -> tuple[Column, Column]:
    return weighted_row(
        [(0.40, linear_map(eps_1m, -10.0, 10.0)), (0.25, linear_map(eps_3m, -15.0, 15.0)), (0.20, F.try_divide(up * 100.0, up + down)), (0.15, linear_map(surprise, -20.0, 20.0))]
    )


def price_score(close: Column, ma200: Column, rs20: Column, below_high: Column) -> Column:
    parts = F.array_compact(
        F.array(F.when(ma200 > 0, linear_map((close - ma200) / ma200 * 100.0, -20.0, 20.0)), linear_map(rs20, -15.0, 15.0), linear_map(below_high, -50.0, 0.0))
    )
    return F.when(F.size(parts) > 0, F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts), 1))


def price_reaction(direction: Column, move: Column, threshold: float = 2.0) -> Column:
    return (
        F.when(direction == "neutral", "neutral")
        .when((direction == "bullish") & (move >= threshold), "positive_news_price_up")
        .when((direction == "bullish") & (move <= -threshold), "positive_news_price_down")
        .when(direction == "bullish", "neutral")
        .when(move <= -threshold, "negative_news_price_down")
        .otherwise("negative_news_price_flat_or_up")
    )


# regime

# Weights of indicators in the three scores; the days after which data of a frequency are stale.
COOLING = {
    "credit_spread_hy_oas": 0.20, "chicago_fed_anfci": 0.15, "eps_revision_breadth": 0.15, "market_breadth": 0.15,
    "vix_term_structure": 0.10, "employment_cooling": 0.10, "yield_curve_10y3m": 0.10, "leverage_positioning": 0.05,
}
OVERHEATING = {
    "leverage_positioning": 0.25, "market_breadth": 0.20, "vix_term_structure": 0.15, "credit_spread_hy_oas": 0.10,
    "eps_revision_breadth": 0.10, "ai_hyperscaler_capex_efficiency": 0.20,
}
AI_CYCLE = {
    "revenue_growth": 0.25, "capex_growth": 0.15, "capex_efficiency": 0.20, "semiconductor_demand": 0.25, "eps_revision": 0.15,
}
STALE_DAYS = {"daily": 5, "weekly": 10, "monthly": 45, "quarterly": 120}


def _num(d: Column, key: str) -> Column:
    return F.try_element_at(d, F.lit(key)).try_cast("double")


def _flag(d: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(d, F.lit(key)).try_cast("boolean"), F.lit(False))


def cooling_part(indicator: Column, value: Column, d: Column) -> Column:
    """An indicator's part in the cooling score. d: map of details."""
    credit = F.coalesce(_num(d, "percentile_10y"), F.lit(0.0))
    anfci = F.coalesce(_num(d, "percentile_5y"), F.lit(0.0))
    anfci = F.when(_flag(d, "tightening_signal"), F.greatest(anfci, F.lit(75.0))).otherwise(anfci)
    anfci = F.when(_flag(d, "easing_signal"), F.least(anfci, F.lit(25.0))).otherwise(anfci)
    rules = {
        "credit_spread_hy_oas": F.least(F.lit(100.0), F.when(_flag(d, "cooling_signal"), F.greatest(credit, F.lit(80.0))).otherwise(credit)),
        "chicago_fed_anfci": clamp(anfci),
        "yield_curve_10y3m": F.when(_flag(d, "rapid_normalization_signal"), 80.0).when(_flag(d, "inverted_in_last_12m"), 20.0).otherwise(10.0),
        "employment_cooling": F.when(_flag(d, "cooling_signal"), 90.0).when(_flag(d, "sahm_approaching_signal"), 60.0).otherwise(15.0),
        "vix_term_structure": clamp((value - 0.7) / 0.6 * 100.0),
        "market_breadth": clamp(100.0 - value),
        "leverage_positioning": F.when(_flag(d, "deleveraging_signal"), 70.0).otherwise(15.0),
    }
    return _by(indicator, rules)


def overheating_part(indicator: Column, d: Column) -> Column:
    vix = F.coalesce(F.greatest(F.lit(0.0), 40.0 - _num(d, "vix_5y_percentile")), F.lit(0.0))
    rules = {
        "leverage_positioning": _num(d, "instruments_percentile_avg"),
        "market_breadth": F.when(_flag(d, "narrow_leadership_signal"), 80.0).otherwise(20.0),
        "vix_term_structure": F.when(_flag(d, "contango_calm_signal"), 85.0).when(_num(d, "vix_5y_percentile").isNull(), 0.0).otherwise(vix),
        "credit_spread_hy_oas": clamp(100.0 - _num(d, "percentile_10y") * 5.0),
    }
    return _by(indicator, rules)


def _by(key: Column, rules: dict[str, Column]) -> Column:
    out = None
    for name, value in rules.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def weights_of(column: Column, weights: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), column)


def market_regime(cooling: Column, hot: Column, coverage: Column, credit: Column, breadth: Column, employment: Column, backwardation: Column) -> Column:
    """The first rule that holds; scores from 69 to 70 fit neither cooling nor stress."""
    n = credit.cast("int") + backwardation.cast("int") + breadth.cast("int")
    return (
        F.when((coverage < 0.5) | cooling.isNull() | hot.isNull(), "INDETERMINATE")
        .when((cooling >= 70) & (n >= 2), "STRESS")
        .when((hot >= 65) & (cooling >= 50) & credit & breadth, "LATE_CYCLE_DIVERGENCE")
        .when((hot >= 70) & (cooling < 55), "OVERHEATED")
        .when(cooling.between(55, 69) & (credit | employment), "COOLING")
        .when((cooling < 40) & (hot < 65) & ~breadth, "HEALTHY_RISK_ON")
        .otherwise("NEUTRAL")
    )


def ai_regime(score: Column, coverage: Column) -> Column:
    return F.when((coverage < 0.5) | score.isNull(), "INDETERMINATE").when(score >= 70, "AI_EXPANSION").otherwise("NEUTRAL")


def data_confidence(obs: DataFrame, keys: list[str], indicators: int = 10, penalty: float = 10.0) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok") * 100.0 / indicators
    stale = F.count_if((F.col("status") == "ok") & F.col("is_stale")) * penalty
    return obs.groupBy(*keys).agg(clamp(ok - stale).alias("data_confidence"))


def signal_status(today: DataFrame, key: str, day: str, fired: str) -> DataFrame:
    """watch, confirmed (fired on the day before exactly), resolved or normal. A missed day starts anew."""
    before = today.select(F.col(key).alias("_k"), F.date_add(day, 1).alias("_d"), F.col(fired).alias("_f"))
    j = today.join(before, (F.col(key) == F.col("_k")) & (F.col(day) == F.col("_d")), "left")
    was = F.coalesce("_f", F.lit(False))
    status = F.when(F.col(fired) & was, "confirmed").when(F.col(fired), "watch").when(was, "resolved").otherwise("normal")
    return j.withColumn("status", status).drop("_k", "_d", "_f")


def score_changes(current: DataFrame, snapshots: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Adds change_<n>d to current (ticker, day, score): score less that of the last snapshot (ticker, day, score) at or
    before n days earlier, to one place; null without one.

    One pass: snapshots and the days asked for lie in one sorted run of a ticker."""
    asked = current.select("ticker", "day", F.explode(F.array(*[F.lit(n) for n in days])).alias("_n"))
    asked = asked.select("ticker", F.date_sub("day", F.col("_n")).alias("_at"), F.col("day").alias("_day"), "_n", F.lit(None).cast("double").alias("_score"), F.lit(1).alias("_asks"))
    held = snapshots.where("score IS NOT NULL").select("ticker", F.col("day").alias("_at"), F.lit(None).cast("date").alias("_day"), F.lit(None).cast("int").alias("_n"), F.col("score").cast("double").alias("_score"), F.lit(0).alias("_asks"))
    run = W.partitionBy("ticker").orderBy("_at", "_asks").rowsBetween(W.unboundedPreceding, 0)
    found = held.unionByName(asked).withColumn("_was", F.last("_score", True).over(run)).where("_asks = 1")
    wide = found.groupBy("ticker", "_day").agg(*[F.max(F.when(F.col("_n") == n, F.col("_was"))).alias(f"_was{n}") for n in days])
    out = current.join(wide.withColumnRenamed("_day", "day"), ["ticker", "day"], "left")
    return out.withColumns({f"change_{n}d": F.round(F.col("score") - F.col(f"_was{n}"), 1) for n in days}).drop(*[f"_was{n}" for n in days])


def top_signals(signals: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The n most severe of the watched and confirmed signals of each key, with their rank."""
    w = W.partitionBy(*keys).orderBy(F.col("severity").desc(), "indicator")
    live = signals.where(F.col("status").isin("watch", "confirmed"))
    return live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# Special categories and what is missing where one has no score.
SPECIAL = {
    "earnings_outlook": "earnings_revision_inputs", "normalized_valuation": "valuation_scenarios",
    "price_supply_demand": "price_metrics", "macro_liquidity": "macro_liquidity_score",
}


def stock_scores(categories: DataFrame, special: DataFrame, weights: dict[str, float], tiers: DataFrame, gates: DataFrame, penalty: float = 0.02) -> DataFrame:
    """(ticker, total, coverage, confidence, gate, thesis, missing): a whole score of each ticker in one plan.

    categories: (ticker, category, score, coverage, missing) of `category_scores`; special: (ticker, and a column of each of
    SPECIAL's scores or null); tiers: (ticker, source_tier) of the features that contributed; gates: (ticker, gate_id) that fired.
    Only categories with a weight count; the total is weighted over those with a score, whose share of all weight is the coverage."""
    named = [c for c in SPECIAL if c in weights]
    each = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).cast("double").alias("score"), F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0).alias("coverage"),
                 F.when(F.col(c).isNull(), F.array(F.lit(SPECIAL[c]))).otherwise(F.array().cast("array<string>")).alias("missing"))
        for c in named
    ])
    rows = categories.where(~F.col("category").isin(*SPECIAL)).select("ticker", "category", "score", "coverage", "missing")
    if named:
        rows = rows.unionByName(special.select("ticker", F.explode(each).alias("x")).select("ticker", "x.*"))
    rows = rows.withColumn("weight", weights_of(F.col("category"), weights))
    has = F.when(F.col("score").isNotNull(), F.col("weight")).otherwise(0.0)
    one = rows.groupBy("ticker").agg(
        F.round(F.try_divide(F.sum(has * F.coalesce("score", F.lit(0.0))), F.sum(has)), 1).alias("total"),
        F.coalesce(F.round(F.try_divide(F.sum(has), F.sum("weight")), 3), F.lit(0.0)).alias("coverage"),
        F.array_sort(F.flatten(F.collect_list("missing"))).alias("missing"),
    )
    seen = tiers.groupBy("ticker").agg(F.collect_list("source_tier").alias("_tiers"))  # a feature each
    fired = gates.select("ticker").distinct().withColumn("gate", F.lit(True))
    out = one.join(seen, "ticker", "left").join(fired, "ticker", "left").withColumn("gate", F.coalesce("gate", F.lit(False)))
    sure = confidence(F.col("coverage"), F.coalesce("_tiers", F.array().cast("array<string>")), F.size("missing"), penalty)
    return out.withColumns({"confidence": sure, "thesis": F.when(F.col("gate"), "impaired").otherwise("maintained")}).drop("_tiers")


def buy_allowed(total: Column, sure: Column, rises: Column, thesis: Column, gate: Column, seconds: Column, signal: Column, least_total: float, least_sure: float, least_rises: int, least_seconds: int) -> Column:
    """All conditions of a new purchase; an unknown total is none."""
    ok = (total >= least_total) & (sure >= least_sure) & (rises >= least_rises) & ~thesis.isin("impaired", "invalidated") & ~gate
    return F.coalesce(ok & (seconds >= least_seconds) & signal.isin("strong_buy_candidate", "accumulate_candidate"), F.lit(False))


def sell_review(total: Column, thesis: Column, gate: Column, cuts: Column, signal: Column) -> Column:
    """Any reason to review a position: a total below 50, a broken thesis, a gate, two quarters of cuts, or the signal."""
    parts = (total < 50, thesis.isin("impaired", "invalidated"), gate, cuts >= 2, signal.isin("reduce_review", "sell_review"))
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])


# hysteresis


@dataclass(frozen=True)
class Hysteresis:
    entry: float = 70.0
    maintain: float = 60.0
    reduce: float = 45.0
    sell: float = 35.0
    cooldown: int = 5


def implied_signal(score, held: bool, c: Hysteresis) -> str | None:
    """What a score says by itself; thresholds of a holding differ from those of an entry."""
    if score is None or score != score:
        return None
    if not held:
        return ("strong_buy_candidate" if score >= 80 else "accumulate_candidate") if score >= c.entry else "hold_watch"
    for least, signal in ((c.entry, "strong_buy_candidate"), (c.reduce, "hold_watch"), (c.sell, "reduce_review")):
        if score >= least:
            return signal
    return "sell_review"


def fold_signal(state: tuple, day, score, held: bool, gate: bool, c: Hysteresis) -> tuple:
    """(signal, since) after one day. A gate overrides the cool-down and lets no buy through."""
    signal, since = state
    implied = implied_signal(score, held, c)
    if gate:
        if implied in ("strong_buy_candidate", "accumulate_candidate"):
            implied = "hold_watch" if held else None
        return implied, day
    if signal is None:
        return implied, day
    if implied == signal or (day - since).days < c.cooldown:
        return signal, since
    return implied, day


def hysteresis(scores: DataFrame, c: Hysteresis = Hysteresis()) -> DataFrame:
    """(ticker, day, signal, since) of scores (ticker, day, score, held, gate): state feeds back, so each
    ticker's days are folded in order; a ticker has one row a day."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        state, out = (None, None), []
        for r in pdf.itertuples():
            state = fold_signal(state, r.day, r.score, bool(r.held), bool(r.gate), c)
            out.append(state)
        return pd.DataFrame({"ticker": pdf["ticker"], "day": pdf["day"], "signal": [s for s, _ in out], "since": [d for _, d in out]})

    return scores.groupBy("ticker").applyInPandas(fold, "ticker string, day date, signal string, since date")


# evaluation


def buckets(score: Column, edges: list[float]) -> Column:
    """Half-open buckets [a, b); the last holds its end."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        upper = score <= b if i == len(edges) - 2 else score < b
        cond, name = (score >= a) & upper, f"{a:g}-{b:g}"
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def brier(score: Column, outcome: Column) -> Column:
    return F.avg(F.pow(score / 100.0 - outcome.cast("double"), 2.0))


def champion_challenger(records: DataFrame, model: str, excess: str, champion: str, challenger: str, least: int = 20, gap: float = 1.0) -> DataFrame:
    """One row: sample size (the smaller), means and the verdict."""
    m = F.col(model)
    r = records.agg(
        F.least(F.count_if(m == champion), F.count_if(m == challenger)).alias("n"),
        F.avg(F.when(m == champion, F.col(excess))).alias("champion"),
        F.avg(F.when(m == challenger, F.col(excess))).alias("challenger"),
    )
    d = F.col("challenger") - F.col("champion")
    verdict = F.when(F.col("n") < least, "insufficient").when(d >= gap, "challenger").when(d <= -gap, "champion").otherwise("tie")
    return r.withColumn("verdict", verdict)
