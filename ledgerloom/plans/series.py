"""Time-series queries: one series per event type, a bar a day (close = the day's total)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import series as S
from ledgerloom.session import table

#: Sums run over whole cents, so that both engines add the same integers.
DAILY_SQL = """
daily AS (
  SELECT event_type, CAST(ts AS DATE) AS day,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS volume,
    CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS top
  FROM events GROUP BY 1, 2
)
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.sum(cents).alias("cents"), F.count("*").alias("volume"), F.max(cents).alias("top")
    )


BARS = S.Series(("event_type",), "day")


def r6(c):
    return F.round(c, 6)


def lag_changes(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select(
        "event_type", "day", BARS.back("cents", 3).alias("back_3"), *[BARS.change("cents", n).alias(f"change_{n}") for n in (1, 5, 20)]
    )


def series_growth(spark, sf_dir):
    d = daily(spark, sf_dir).select(
        "event_type", "day", "cents", BARS.ttm("cents").alias("ttm"), BARS.ttm_available("cents").alias("ttm_available")
    )
    return d.select(
        "event_type", "day", "ttm", "ttm_available",
        r6(BARS.yoy_signed("ttm")).alias("yoy_signed"),
        r6(BARS.yoy_absolute("cents")).alias("yoy_absolute"),
        r6(BARS.yoy_percent("cents")).alias("yoy_percent"),
    )


def growth_acceleration(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("yoy", BARS.yoy_absolute("cents"))
    return d.select("event_type", "day", r6(F.col("yoy") - BARS.back("yoy", 1)).alias("acceleration"))


def percentile_ranks(spark, sf_dir):
    d = daily(spark, sf_dir)
    d = S.with_percentile(d, BARS, "cents", 10, "pct_10d")
    d = S.with_percentile(d, BARS, "cents", 365, "pct_1y")
    return d.select("event_type", "day", r6("pct_10d").alias("pct_10d"), r6("pct_1y").alias("pct_1y"))


def zscores(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select("event_type", "day", r6(BARS.zscore("cents", BARS.days(-10, 0))).alias("z_10d"))


def range_windows(spark, sf_dir):
    w = BARS.days(-7, 0)
    t = BARS.trough("cents", 365)
    return daily(spark, sf_dir).select(
        "event_type", "day", F.count("*").over(w).alias("n_7d"), F.sum("cents").over(w).alias("sum_7d"),
        t["v"].alias("trough"), t["at"].alias("trough_day"),
    )


def moving_averages(spark, sf_dir):
    d = daily(spark, sf_dir).select(
        "event_type", "day", "cents", *[BARS.moving_average("cents", n).alias(f"ma{n}") for n in (5, 10, 20)]
    )
    d = BARS.moving_average_slope(d, "ma5", 5)
    return d.select("event_type", "day", *[r6(c).alias(c) for c in ("ma5", "ma10", "ma20", "ma5_slope")])


def price_positions(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select(
        "event_type", "day",
        r6(BARS.below_high("top", "cents", 252)).alias("below_high"),
        r6(BARS.period_return("cents", 5)).alias("return_5"),
        r6(BARS.forward_return("cents", 5)).alias("forward_5"),
        r6(BARS.volume_ratio("volume", 10)).alias("volume_ratio"),
        BARS.new_extreme("cents", 10, True).alias("new_high"),
        BARS.new_extreme("cents", 10, False).alias("new_low"),
    )


def volatility(spark, sf_dir):
    d = S.volatility(daily(spark, sf_dir), BARS, "cents", 10, "vol")
    return d.select("event_type", "day", r6("vol").alias("volatility"))


def max_drawdown(spark, sf_dir):
    d = S.max_drawdown(daily(spark, sf_dir), ["event_type"], "day", "cents", 20)
    return d.select("event_type", r6("max_drawdown").alias("max_drawdown"))


def relative_strength(spark, sf_dir):
    """Each type's return against that of the benchmark type, bar by bar."""
    d = daily(spark, sf_dir).select("event_type", "day", "cents", BARS.period_return("cents", 10).alias("ret"), BARS.back("cents", 10).alias("old"))
    b = d.where("event_type = 'purchase'").select("day", F.col("ret").alias("b_ret"), F.col("cents").alias("b"), F.col("old").alias("b_old"))
    ratio = (F.col("cents") / F.col("b")) / (F.col("old") / F.col("b_old")) - 1
    return d.join(b, "day").select(
        "event_type", "day", r6(F.col("ret") - F.col("b_ret")).alias("relative_strength"), r6(ratio).alias("relative_return")
    )


def market_breadth(spark, sf_dir):
    """By day: share of series above their moving average, numbers at new highs and lows."""
    d = daily(spark, sf_dir)
    d = d.select("day", F.col("cents"), BARS.moving_average("cents", 5).alias("ma"), BARS.new_extreme("cents", 10, True).alias("hi"), BARS.new_extreme("cents", 10, False).alias("lo"))
    above = F.when(F.col("ma").isNotNull(), (F.col("cents") > F.col("ma")).cast("int"))
    return d.groupBy("day").agg(
        r6(F.avg(above) * 100).alias("above_ma"), F.count_if("hi").alias("new_highs"), F.count_if("lo").alias("new_lows")
    )


def linear_slopes(spark, sf_dir):
    d = S.linear_slope(daily(spark, sf_dir), ["event_type"], "day", "cents")
    return d.select("event_type", F.round("slope", 4).alias("slope"), S.trend_of_slope(F.col("slope")).alias("trend"))


def nearest_join(spark, sf_dir):
    """Each day's value against the nearest one of 14 days before, three days either way."""
    d = daily(spark, sf_dir)
    want = d.select("event_type", "day", "cents", F.date_sub("day", 14).alias("target"))
    got = S.nearest_within(want, d.select("event_type", "day", "cents"), ["event_type"], "target", "day", "cents", 3)
    return got.select("event_type", "day", F.col("nearest_value").alias("then"), r6((F.col("cents") - F.col("nearest_value")) / F.col("nearest_value") * 100.0).alias("change_pct"))


def asof_orders(spark, sf_dir, strict: bool = False):
    """For each order the customer's latest order at or before 90 days earlier."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    left = o.withColumn("target", F.col("o_orderdate") - F.expr("INTERVAL 90 DAYS"))
    right = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("key"))
    got = S.as_of_join(left, right, ["o_custkey"], "target", "o_orderdate", ["key"], strict)
    return got.select("o_custkey", "o_orderkey", F.col("asof_key").alias("earlier_orderkey"))


def asof_orders_strict(spark, sf_dir):
    return asof_orders(spark, sf_dir, True)


def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return S.last_per_key(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_type", "event_id")


def signal_change_frequency(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("signal", F.col("cents") > BARS.back("cents", 1))
    return S.change_frequency(d, ["event_type"], "day", "signal").select("event_type", r6("change_frequency").alias("change_frequency"))


def _win(sql: str) -> str:
    return f"WITH {DAILY_SQL} {sql}"


W_ = "(PARTITION BY event_type ORDER BY day)"


def _rows(a: int, b: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY event_type ORDER BY day ROWS BETWEEN {a} PRECEDING AND {b})"


def _asof(op: str) -> str:
    return f"""
SELECT l.o_custkey, l.o_orderkey, r.key AS earlier_orderkey
FROM (SELECT *, o_orderdate - INTERVAL 90 DAY AS target FROM orders) l
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS key FROM orders GROUP BY 1, 2) r
ON l.o_custkey = r.o_custkey AND l.target {op} r.o_orderdate
"""


def _yoy(x: str) -> str:
    return f"CASE WHEN lag({x}, 4) OVER {W_} <> 0 THEN ({x} - lag({x}, 4) OVER {W_})::DOUBLE / abs(lag({x}, 4) OVER {W_}) END"


SQL = {
    "lag_changes": _win(f"SELECT event_type, day, lag(cents, 3) OVER {W_} AS back_3, " + ", ".join(f"cents - lag(cents, {n}) OVER {W_} AS change_{n}" for n in (1, 5, 20)) + " FROM daily"),
    "series_growth": _win(f"""
, t AS (SELECT *, CASE WHEN count(*) OVER {_rows(3)} = 4 THEN sum(cents) OVER {_rows(3)} END::BIGINT AS ttm,
    (sum(cents) OVER {_rows(3)})::BIGINT AS ttm_available FROM daily)
SELECT event_type, day, ttm, ttm_available,
  round(CASE WHEN lag(ttm, 4) OVER {W_} <> 0 THEN (ttm - lag(ttm, 4) OVER {W_})::DOUBLE / lag(ttm, 4) OVER {W_} * 100 END, 6) AS yoy_signed,
  round({_yoy("cents")}, 6) AS yoy_absolute, round(({_yoy("cents")}) * 100, 6) AS yoy_percent FROM t"""),
    "growth_acceleration": _win(f", t AS (SELECT *, {_yoy('cents')} AS yoy FROM daily) SELECT event_type, day, round(yoy - lag(yoy) OVER {W_}, 6) AS acceleration FROM t"),
    "percentile_ranks": _win("""
SELECT a.event_type, a.day,
  round(100.0 * count(*) FILTER (b.day >= a.day - 10 AND b.cents <= a.cents) / count(*) FILTER (b.day >= a.day - 10), 6) AS pct_10d,
  round(100.0 * count(*) FILTER (b.cents <= a.cents) / count(*), 6) AS pct_1y
FROM daily a JOIN daily b ON a.event_type = b.event_type AND b.day BETWEEN a.day - 365 AND a.day GROUP BY 1, 2"""),
    "zscores": _win("""
SELECT event_type, day, round(CASE WHEN count(*) OVER w >= 2 AND stddev_samp(cents) OVER w > 0 THEN (cents - avg(cents) OVER w) / stddev_samp(cents) OVER w END, 6) AS z_10d
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW)"""),
    "range_windows": _win("""
SELECT event_type, day, count(*) OVER w AS n_7d, (sum(cents) OVER w)::BIGINT AS sum_7d, min(cents) OVER y AS trough, arg_min(day, (cents, day)) OVER y AS trough_day
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),
 y AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW)"""),
    "moving_averages": _win(", m AS (SELECT *, " + ", ".join(f"CASE WHEN count(*) OVER {_rows(n - 1)} = {n} THEN avg(cents) OVER {_rows(n - 1)} END AS ma{n}" for n in (5, 10, 20)) + f" FROM daily) SELECT event_type, day, round(ma5, 6) AS ma5, round(ma10, 6) AS ma10, round(ma20, 6) AS ma20, round(ma5 - lag(ma5, 5) OVER {W_}, 6) AS ma5_slope FROM m"),
    "price_positions": _win(f"""
SELECT event_type, day,
  round((cents - max(top) OVER {_rows(251)})::DOUBLE / max(top) OVER {_rows(251)} * 100, 6) AS below_high,
  round(CASE WHEN lag(cents, 5) OVER {W_} > 0 THEN (cents - lag(cents, 5) OVER {W_})::DOUBLE / lag(cents, 5) OVER {W_} * 100 END, 6) AS return_5,
  round(CASE WHEN cents > 0 THEN (lead(cents, 5) OVER {W_} - cents)::DOUBLE / cents * 100 END, 6) AS forward_5,
  round(CASE WHEN count(*) OVER {_rows(10, "1 PRECEDING")} = 10 THEN volume / avg(volume) OVER {_rows(10, "1 PRECEDING")} END, 6) AS volume_ratio,
  CASE WHEN count(*) OVER {_rows(9)} = 10 THEN cents >= max(cents) OVER {_rows(9)} END AS new_high,
  CASE WHEN count(*) OVER {_rows(9)} = 10 THEN cents <= min(cents) OVER {_rows(9)} END AS new_low
FROM daily"""),
    "volatility": _win(f"""
, r AS (SELECT *, CASE WHEN lag(cents) OVER {W_} > 0 THEN (cents - lag(cents) OVER {W_})::DOUBLE / lag(cents) OVER {W_} END AS ret FROM daily)
SELECT event_type, day, round(CASE WHEN count(*) OVER {_rows(10)} = 11 AND count(ret) OVER {_rows(9)} >= 2 THEN stddev_samp(ret) OVER {_rows(9)} * 100 END, 6) AS volatility FROM r"""),
    "max_drawdown": _win("""
, l AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 20),
p AS (SELECT *, max(cents) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM l)
SELECT event_type, round(min((cents - peak)::DOUBLE / peak * 100), 6) AS max_drawdown FROM p GROUP BY 1"""),
    "relative_strength": _win(f"""
, t AS (SELECT *, lag(cents, 10) OVER {W_} AS old, CASE WHEN lag(cents, 10) OVER {W_} > 0 THEN (cents - lag(cents, 10) OVER {W_})::DOUBLE / lag(cents, 10) OVER {W_} * 100 END AS ret FROM daily)
SELECT t.event_type, t.day, round(t.ret - b.ret, 6) AS relative_strength, round((t.cents / b.cents) / (t.old / b.old) - 1, 6) AS relative_return
FROM t JOIN t b ON t.day = b.day AND b.event_type = 'purchase'"""),
    "market_breadth": _win(f"""
, m AS (SELECT day, cents, CASE WHEN count(*) OVER {_rows(4)} = 5 THEN avg(cents) OVER {_rows(4)} END AS ma,
  CASE WHEN count(*) OVER {_rows(9)} = 10 THEN cents >= max(cents) OVER {_rows(9)} END AS hi,
  CASE WHEN count(*) OVER {_rows(9)} = 10 THEN cents <= min(cents) OVER {_rows(9)} END AS lo FROM daily)
SELECT day, round(avg(CASE WHEN ma IS NOT NULL THEN (cents > ma)::INT END) * 100, 6) AS above_ma, count(*) FILTER (hi) AS new_highs, count(*) FILTER (lo) AS new_lows FROM m GROUP BY 1"""),
    "linear_slopes": _win("""
, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM daily)
SELECT event_type, round(regr_slope(cents, i), 4) AS slope, CASE WHEN regr_slope(cents, i) > 0.0005 THEN 'expanding' WHEN regr_slope(cents, i) < -0.0005 THEN 'contracting' ELSE 'stable' END AS trend FROM i GROUP BY 1"""),
    "nearest_join": _win("""
SELECT a.event_type, a.day, arg_min(b.cents, (abs(b.day - (a.day - 14)), b.day)) AS "then",
  round((a.cents - arg_min(b.cents, (abs(b.day - (a.day - 14)), b.day)))::DOUBLE / arg_min(b.cents, (abs(b.day - (a.day - 14)), b.day)) * 100, 6) AS change_pct
FROM daily a LEFT JOIN daily b ON a.event_type = b.event_type AND abs(b.day - (a.day - 14)) <= 3 GROUP BY a.event_type, a.day, a.cents"""),
    "asof_orders": _asof(">="),
    "asof_orders_strict": _asof(">"),
    "latest_per_key": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1",
    "signal_change_frequency": _win(f"""
, s AS (SELECT *, cents > lag(cents) OVER {W_} AS s FROM daily),
p AS (SELECT *, lag(s) OVER {W_} AS p, row_number() OVER {W_} AS n FROM s)
SELECT event_type, round(coalesce(avg(CASE WHEN n > 1 THEN (s IS DISTINCT FROM p)::INT END), 0), 6) AS change_frequency FROM p GROUP BY 1"""),
}

QUERIES = {name: (globals()[name], sql) for name, sql in SQL.items()}
