"""Scoring, regime and evaluation queries: daily event series as indicators, orders as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import scoring as S
from ledgerloom.plans.series import BARS, DAILY_SQL, daily
from ledgerloom.session import table


def _r(c, n=6):
    return F.round(c, n)


def linear_maps(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    return p.select("p_partkey", S.linear_map(F.col("x"), 5.0, 45.0).alias("up"), S.linear_map(F.col("x"), 45.0, 5.0).alias("down"), S.linear_map(F.col("x"), 1.0, 1.0).alias("flat"))


def weighted_renorm(spark, sf_dir):
    """Daily parts of event types under fixed weights; days without a type renormalise."""
    w = F.try_element_at(F.create_map(*[F.lit(x) for kv in {"click": 0.4, "error": 0.3, "purchase": 0.2, "view": 0.1}.items() for x in kv]), F.col("event_type"))
    d = daily(spark, sf_dir).withColumn("w", w).where("w IS NOT NULL")
    d = d.withColumn("part", F.when(F.col("volume") > 60, S.clamp(F.col("cents") / 10000.0)))
    s = S.weighted(d, ["day"], "w", "part")
    return s.select("day", _r("score").alias("score"), _r("coverage").alias("coverage"))


def category_score(spark, sf_dir):
    """Customers' orders as features: the last of each priority."""
    o = table(spark, sf_dir, "orders")
    w = F.struct("o_orderdate", "o_orderkey")
    f = o.groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("metric")).agg(
        F.max_by(F.round(F.col("o_totalprice") / 5000).cast("double"), w).alias("value"), F.max("o_orderdate").alias("published_at"), F.max_by("o_orderstatus", w).alias("s")
    )
    f = f.select("ticker", "metric", "value", F.lit(None).cast("string").alias("trend"), F.when(F.col("s") == "P", "social").otherwise("official").alias("source_tier"),
        F.lit("fact").alias("fact_type"), "published_at", F.lit(700).alias("max_age_days"))
    specs = spark.createDataFrame([("growth", "1-URGENT", "growth_rate_pct", 0.0, 100.0), ("growth", "2-HIGH", "inverse_months", 90.0, 10.0), ("share", "3-MEDIUM", "percent_passthrough", None, None), ("share", "5-LOW", "boolean", None, None)],
        "category string, metric string, kind string, bad double, good double")
    c = S.category_scores(f, specs, F.lit("2001-01-01").cast("date"))
    return c.select("ticker", "category", _r("score", 4).alias("score"), "coverage", F.array_join("missing", ",").alias("missing"))


def confidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "official").when(F.col("o_orderstatus") == "P", "broker").otherwise("media").alias("tier"))
    g = o.groupBy("o_custkey").agg(F.collect_list("tier").alias("tiers"), F.count("*").alias("n"))
    c = S.confidence(F.least(F.col("n") / 16.0, F.lit(1.0)), F.col("tiers"), F.pmod("o_custkey", F.lit(13)), places=6)
    g = g.select("o_custkey", c.alias("confidence"))
    return g.withColumn("level", S.level(F.col("confidence"), 0.5, 0.75))


def valuation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bear = F.when(F.col("p_size") % 3 > 0, F.lit(920.0))
    bull = F.when(F.col("p_size") % 4 > 0, F.lit(1100.0))
    return p.select("p_partkey", S.valuation_score(F.col("p_retailprice"), bear, F.lit(1000.0), bull).alias("score"))


def earnings_revision(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = F.col("p_size").cast("double")
    s, c = S.earnings_revision(F.when(x > 10, x - 25), F.when(x > 20, x - 30), F.when(x % 2 == 0, x), F.when(x % 2 == 0, 50 - x), F.when(x > 40, x / 5))
    return p.select("p_partkey", _r(s, 4).alias("score"), _r(c).alias("coverage"))


def price_reactions(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("move", BARS.period_return("cents", 1)).where("move IS NOT NULL")
    side = F.when(F.dayofmonth("day") % 3 == 0, "bullish").when(F.dayofmonth("day") % 3 == 1, "bearish").otherwise("neutral")
    return d.select("event_type", "day", S.price_reaction(side, F.col("move")).alias("pattern"))


def price_scores(spark, sf_dir):
    d = daily(spark, sf_dir).select("event_type", "day", "cents", BARS.moving_average("cents", 10).alias("ma"), BARS.period_return("cents", 5).alias("ret"), BARS.below_high("top", "cents", 252).alias("bh"))
    return d.select("event_type", "day", S.price_score(F.col("cents"), F.col("ma"), F.col("ret"), F.col("bh")).alias("score"))


_IND = ["credit_spread_hy_oas", "chicago_fed_anfci", "market_breadth", "vix_term_structure", "leverage_positioning"]
_TYPES = ["click", "error", "purchase", "signup", "view"]


def _observations(spark, sf_dir):
    """One indicator per event type in order of name; details derived from the day's figures."""
    d = daily(spark, sf_dir)
    i = F.element_at(F.array(*[F.lit(x) for x in _IND]), (F.row_number().over(_by_day()) ).cast("int"))
    v = (F.col("cents") % 1000) / 10.0
    details = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("percentile_10y", "percentile_5y", "cooling_signal", "tightening_signal", "deleveraging_signal", "vix_5y_percentile", "narrow_leadership_signal", "instruments_percentile_avg", "backwardation_signal")]),
        F.array(v.cast("string"), v.cast("string"), (v > 70).cast("string"), (v > 60).cast("string"), (v > 50).cast("string"), v.cast("string"), (v > 55).cast("string"), v.cast("string"), (v > 80).cast("string")),
    )
    return d.select("day", i.alias("indicator"), v.alias("value"), details.alias("d"))


def _by_day():
    from pyspark.sql import Window as W

    return W.partitionBy("day").orderBy("event_type")


def regime_scores(spark, sf_dir):
    """Cooling and overheating of each day and the regime they make."""
    o = _observations(spark, sf_dir)
    parts = o.select("day", "indicator", "d",
        S.weights_of(F.col("indicator"), S.COOLING).alias("wc"), S.cooling_part(F.col("indicator"), F.col("value"), F.col("d")).alias("c"),
        S.weights_of(F.col("indicator"), S.OVERHEATING).alias("wh"), S.overheating_part(F.col("indicator"), F.col("d")).alias("h"))
    flag = lambda i, k: F.bool_or((F.col("indicator") == i) & S._flag(F.col("d"), k))
    g = parts.groupBy("day").agg(
        _r(F.try_divide(F.sum(F.col("wc") * F.col("c")), F.sum(F.when(F.col("c").isNotNull(), F.col("wc")))), 1).alias("cooling"),
        _r(F.try_divide(F.sum(F.col("wh") * F.col("h")), F.sum(F.when(F.col("h").isNotNull(), F.col("wh")))), 1).alias("overheating"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("wc"))).alias("cc"), F.sum(F.when(F.col("h").isNotNull(), F.col("wh"))).alias("ch"),
        flag("credit_spread_hy_oas", "cooling_signal").alias("credit"), flag("market_breadth", "cooling_signal").alias("breadth"), flag("vix_term_structure", "backwardation_signal").alias("back"),
    )
    cov = _r((F.col("cc") + F.col("ch")) / 2, 3)
    return g.select("day", "cooling", "overheating", cov.alias("coverage"),
        S.market_regime(F.col("cooling"), F.col("overheating"), cov, F.col("credit"), F.col("breadth"), F.lit(False), F.col("back")).alias("regime"))


def signal_persistence(spark, sf_dir):
    d = daily(spark, sf_dir).select("event_type", "day", (F.col("cents") % 3 > 0).alias("fired"))
    return S.signal_status(d, "event_type", "day", "fired")


def new_releases(spark, sf_dir):
    """Days whose figure differs from the day before's."""
    d = daily(spark, sf_dir)
    return d.select("event_type", "day", (F.col("volume") > BARS.back("volume", 1)).alias("up")).where("up")


def data_confidence(spark, sf_dir):
    d = daily(spark, sf_dir).select("day", F.when(F.col("volume") > 50, "ok").otherwise("unavailable").alias("status"), (F.col("cents") % 5 == 0).alias("is_stale"))
    return S.data_confidence(d, ["day"])


def _records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.pmod(k * 7, F.lit(101)).cast("double").alias("score"), (F.pmod(k * 13, F.lit(41)) - 20).alias("excess"),
        F.when(F.col("o_orderstatus") == "F", "m1").otherwise("m2").alias("model"), F.substring("o_orderpriority", 1, 1).alias("conf"), F.pmod(k * 5, F.lit(101)).cast("double").alias("prior"))


_REC = "r AS (SELECT o_orderkey, (o_orderkey * 7 % 101)::DOUBLE AS score, o_orderkey * 13 % 41 - 20 AS excess, CASE WHEN o_orderstatus = 'F' THEN 'm1' ELSE 'm2' END AS model, o_orderpriority[1] AS conf, (o_orderkey * 5 % 101)::DOUBLE AS prior FROM orders)"


def bucket_excess(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("bucket", S.buckets(F.col("score"), [0, 35, 45, 60, 70, 80, 100]))
    return r.groupBy("bucket").agg(F.count("*").alias("n"), _r(F.avg("excess")).alias("excess"))


def increase_vs_decrease(spark, sf_dir):
    r = _records(spark, sf_dir)
    up = F.col("score") > F.col("prior")
    return r.agg(_r(F.avg(F.when(up, F.col("excess")))).alias("increased"), _r(F.avg(F.when(~up, F.col("excess")))).alias("others"))


def calibration(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("conf").agg(_r(F.avg((F.col("excess") > 0).cast("double"))).alias("hit_rate"))


def brier_score(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("model").agg(_r(S.brier(F.col("score"), F.col("excess") > 0)).alias("brier"))


def champion_challenger(spark, sf_dir):
    c = S.champion_challenger(_records(spark, sf_dir), "model", "excess", "m1", "m2")
    return c.select("n", _r("champion").alias("champion"), _r("challenger").alias("challenger"), "verdict")


def hysteresis(spark, sf_dir):
    d = daily(spark, sf_dir)
    s = d.select(F.col("event_type").alias("ticker"), "day", (F.col("cents") % 101).cast("double").alias("score"), (F.dayofmonth("day") % 2 == 0).alias("held"), (F.col("cents") % 17 == 0).alias("gate"))
    return S.hysteresis(s)


QUERIES = {
    "linear_maps": (linear_maps, "SELECT p_partkey, round(greatest(0, least(100, (p_size - 5.0::DOUBLE) / 40 * 100)), 1) AS up, round(greatest(0, least(100, (p_size - 45.0::DOUBLE) / -40 * 100)), 1) AS down, 50.0::DOUBLE AS flat FROM part"),
    "weighted_renorm": (weighted_renorm, f"""WITH {DAILY_SQL}, w AS (SELECT day, CASE event_type WHEN 'click' THEN 0.4 WHEN 'error' THEN 0.3 WHEN 'purchase' THEN 0.2 WHEN 'view' THEN 0.1 END::DOUBLE AS w, CASE WHEN volume > 60 THEN greatest(0, least(100, cents / 10000)) END AS part FROM daily)
SELECT day, round(sum(w * part) / sum(CASE WHEN part IS NOT NULL THEN w END), 6) AS score, round(coalesce(sum(CASE WHEN part IS NOT NULL THEN w END) / sum(w), 0), 6) AS coverage FROM w WHERE w IS NOT NULL GROUP BY 1"""),
    "category_score": (category_score, """WITH f AS (SELECT o_custkey AS ticker, o_orderpriority AS metric, round(o_totalprice / 5000) AS value, o_orderstatus AS s, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
sp(category, metric) AS (VALUES ('growth', '1-URGENT'), ('growth', '2-HIGH'), ('share', '3-MEDIUM'), ('share', '5-LOW')),
j AS (SELECT t.ticker, sp.category, sp.metric, CASE WHEN f.s <> 'P' AND DATE '2001-01-01' - f.o_orderdate::DATE <= 700 THEN CASE sp.metric
 WHEN '1-URGENT' THEN round(greatest(0, least(100, value)), 1) WHEN '2-HIGH' THEN round(greatest(0, least(100, (value - 90) / -80 * 100)), 1)
 WHEN '3-MEDIUM' THEN round(greatest(0, least(100, CASE WHEN value BETWEEN -1 AND 1 THEN value * 100 ELSE value END)), 1) ELSE CASE WHEN value >= 1 THEN 100 ELSE 0 END END END AS part
 FROM (SELECT DISTINCT ticker FROM f) t CROSS JOIN sp LEFT JOIN f ON f.ticker = t.ticker AND f.metric = sp.metric)
SELECT ticker, category, round(avg(part), 4) AS score, avg((part IS NOT NULL)::INT) AS coverage, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (part IS NULL), '') AS missing FROM j GROUP BY 1, 2"""),
    "confidence": (confidence, """WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hi, count(*) FILTER (o_orderstatus = 'P') AS br FROM orders GROUP BY 1),
c AS (SELECT o_custkey, round(greatest(0, least(1, 0.5::DOUBLE * least(n / 16, 1) + 0.5::DOUBLE * (hi + 0.6::DOUBLE * br) / n - least(0.2::DOUBLE, 0.02::DOUBLE * (o_custkey % 13)))), 6) AS confidence FROM g)
SELECT *, CASE WHEN confidence < 0.5 THEN 'low' WHEN confidence >= 0.75 THEN 'high' ELSE 'medium' END AS level FROM c"""),
    "valuation": (valuation, """WITH p AS (SELECT p_partkey, p_retailprice AS x, CASE WHEN p_size % 3 > 0 THEN 920.0 ELSE 500.0 END::DOUBLE AS lo, CASE WHEN p_size % 4 > 0 THEN 1100.0 ELSE 1500.0 END::DOUBLE AS hi FROM part)
SELECT p_partkey, CASE WHEN x <= lo THEN 100 WHEN x >= hi THEN 0 WHEN x <= 1000 THEN round(50 + (1000 - x) / (1000 - lo) * 50, 1) ELSE round(50 - (x - 1000) / (hi - 1000) * 50, 1) END::DOUBLE AS score FROM p"""),
    "earnings_revision": (earnings_revision, """WITH x AS (SELECT p_partkey, p_size::DOUBLE AS x FROM part), p AS (SELECT p_partkey,
 CASE WHEN x > 10 THEN round(greatest(0, least(100, (x - 25 + 10) / 20 * 100)), 1) END AS a, CASE WHEN x > 20 THEN round(greatest(0, least(100, (x - 30 + 15) / 30 * 100)), 1) END AS b,
 CASE WHEN x % 2 = 0 THEN x * 100 / 50 END AS c, CASE WHEN x > 40 THEN round(greatest(0, least(100, (x / 5 + 20) / 40 * 100)), 1) END AS d FROM x),
w AS (SELECT *, (CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END)::DOUBLE AS w FROM p)
SELECT p_partkey, round((coalesce(a * 0.4, 0) + coalesce(b * 0.25, 0) + coalesce(c * 0.2, 0) + coalesce(d * 0.15, 0)) / nullif(w, 0), 4) AS score, round(w, 6) AS coverage FROM w"""),
    "price_reactions": (price_reactions, f"""WITH {DAILY_SQL}, m AS (SELECT event_type, day, (cents - lag(cents) OVER w)::DOUBLE / lag(cents) OVER w * 100 AS move, day(day) % 3 AS s FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, CASE WHEN s = 2 THEN 'neutral' WHEN s = 0 AND move >= 2 THEN 'positive_news_price_up' WHEN s = 0 AND move <= -2 THEN 'positive_news_price_down' WHEN s = 0 THEN 'neutral' WHEN move <= -2 THEN 'negative_news_price_down' ELSE 'negative_news_price_flat_or_up' END AS pattern FROM m WHERE move IS NOT NULL"""),
    "price_scores": (price_scores, f"""WITH {DAILY_SQL}, p AS (SELECT event_type, day, CASE WHEN count(*) OVER w = 10 THEN avg(cents) OVER w END AS ma, cents,
 (cents - lag(cents, 5) OVER o)::DOUBLE / lag(cents, 5) OVER o * 100 AS ret, (cents - max(top) OVER y)::DOUBLE / max(top) OVER y * 100 AS bh FROM daily
 WINDOW o AS (PARTITION BY event_type ORDER BY day), w AS (PARTITION BY event_type ORDER BY day ROWS 9 PRECEDING), y AS (PARTITION BY event_type ORDER BY day ROWS 251 PRECEDING)),
q AS (SELECT event_type, day, list_filter([round(greatest(0, least(100, ((cents - ma) / ma * 100 + 20) / 40 * 100)), 1), CASE WHEN ret IS NOT NULL THEN round(greatest(0, least(100, (ret + 15) / 30 * 100)), 1) END, round(greatest(0, least(100, (bh + 50) / 50 * 100)), 1)], lambda x: x IS NOT NULL) AS l,
 ma IS NULL AS noma, cents, ma, ret, bh FROM p),
z AS (SELECT event_type, day, CASE WHEN ma IS NOT NULL THEN round(greatest(0, least(100, ((cents - ma) / ma * 100 + 20) / 40 * 100)), 1) END AS a, CASE WHEN ret IS NOT NULL THEN round(greatest(0, least(100, (ret + 15) / 30 * 100)), 1) END AS b, round(greatest(0, least(100, (bh + 50) / 50 * 100)), 1) AS c FROM q)
SELECT event_type, day, round((coalesce(a, 0) + coalesce(b, 0) + c) / (1 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 1) AS score FROM z"""),
    "regime_scores": (regime_scores, f"""WITH {DAILY_SQL}, o AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY event_type) AS i, (cents % 1000) / 10.0::DOUBLE AS v FROM daily),
p AS (SELECT day, i, v,
 CASE i WHEN 1 THEN 0.2 WHEN 2 THEN 0.15 WHEN 3 THEN 0.15 WHEN 4 THEN 0.1 WHEN 5 THEN 0.05 END::DOUBLE AS wc,
 CASE i WHEN 1 THEN least(100, CASE WHEN v > 70 THEN greatest(v, 80) ELSE v END) WHEN 2 THEN CASE WHEN v > 60 THEN greatest(v, 75) ELSE v END WHEN 3 THEN greatest(0, 100 - v) WHEN 4 THEN greatest(0, least(100, (v - 0.7) / 0.6 * 100)) ELSE CASE WHEN v > 50 THEN 70 ELSE 15 END END::DOUBLE AS c,
 CASE i WHEN 1 THEN 0.1 WHEN 3 THEN 0.2 WHEN 4 THEN 0.15 WHEN 5 THEN 0.25 END::DOUBLE AS wh,
 CASE i WHEN 1 THEN greatest(0, least(100, 100 - v * 5)) WHEN 3 THEN CASE WHEN v > 55 THEN 80 ELSE 20 END WHEN 4 THEN greatest(0, 40 - v) WHEN 5 THEN v END::DOUBLE AS h FROM o),
g AS (SELECT day, round(sum(wc * c) / sum(wc), 1) AS cooling, round(sum(wh * h) / sum(wh), 1) AS overheating, round((sum(wc) + sum(wh)) / 2, 3) AS coverage,
 bool_or(i = 1 AND v > 70) AS credit, bool_or(i = 3 AND v > 70) AS breadth, bool_or(i = 4 AND v > 80) AS back FROM p GROUP BY 1)
SELECT day, cooling, overheating, coverage, CASE WHEN coverage < 0.5 THEN 'INDETERMINATE' WHEN cooling >= 70 AND credit::INT + breadth::INT + back::INT >= 2 THEN 'STRESS' WHEN overheating >= 65 AND cooling >= 50 AND credit AND breadth THEN 'LATE_CYCLE_DIVERGENCE'
 WHEN overheating >= 70 AND cooling < 55 THEN 'OVERHEATED' WHEN cooling BETWEEN 55 AND 69 AND credit THEN 'COOLING' WHEN cooling < 40 AND overheating < 65 AND NOT breadth THEN 'HEALTHY_RISK_ON' ELSE 'NEUTRAL' END AS regime FROM g"""),
    "signal_persistence": (signal_persistence, f"""WITH {DAILY_SQL}, f AS (SELECT event_type, day, cents % 3 > 0 AS fired FROM daily)
SELECT a.event_type, a.day, a.fired, CASE WHEN a.fired AND coalesce(b.fired, false) THEN 'confirmed' WHEN a.fired THEN 'watch' WHEN coalesce(b.fired, false) THEN 'resolved' ELSE 'normal' END AS status
FROM f a LEFT JOIN f b ON a.event_type = b.event_type AND a.day = b.day + 1"""),
    "new_releases": (new_releases, f"WITH {DAILY_SQL} SELECT event_type, day, true AS up FROM daily QUALIFY volume > lag(volume) OVER (PARTITION BY event_type ORDER BY day)"),
    "data_confidence": (data_confidence, f"WITH {DAILY_SQL} SELECT day, greatest(0, least(100, count(*) FILTER (volume > 50) * 10.0::DOUBLE - count(*) FILTER (volume > 50 AND cents % 5 = 0) * 10.0::DOUBLE)) AS data_confidence FROM daily GROUP BY 1"),
    "bucket_excess": (bucket_excess, f"WITH {_REC} SELECT CASE WHEN score < 35 THEN '0-35' WHEN score < 45 THEN '35-45' WHEN score < 60 THEN '45-60' WHEN score < 70 THEN '60-70' WHEN score < 80 THEN '70-80' ELSE '80-100' END AS bucket, count(*) AS n, round(avg(excess), 6) AS excess FROM r GROUP BY 1"),
    "increase_vs_decrease": (increase_vs_decrease, f"WITH {_REC} SELECT round(avg(excess) FILTER (score > prior), 6) AS increased, round(avg(excess) FILTER (score <= prior), 6) AS others FROM r"),
    "calibration": (calibration, f"WITH {_REC} SELECT conf, round(avg((excess > 0)::INT), 6) AS hit_rate FROM r GROUP BY 1"),
    "brier_score": (brier_score, f"WITH {_REC} SELECT model, round(avg((score / 100 - (excess > 0)::INT) ** 2), 6) AS brier FROM r GROUP BY 1"),
    "champion_challenger": (champion_challenger, f"""WITH {_REC}, s AS (SELECT least(count(*) FILTER (model = 'm1'), count(*) FILTER (model = 'm2')) AS n, avg(excess) FILTER (model = 'm1') AS a, avg(excess) FILTER (model = 'm2') AS b FROM r)
SELECT n, round(a, 6) AS champion, round(b, 6) AS challenger, CASE WHEN n < 20 THEN 'insufficient' WHEN b - a >= 1 THEN 'challenger' WHEN b - a <= -1 THEN 'champion' ELSE 'tie' END AS verdict FROM s"""),
    "hysteresis": (hysteresis, None),
}
