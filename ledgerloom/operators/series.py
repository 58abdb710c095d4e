"""Time-series operators over long tables (key columns, an order column, a value).

Each function returns a Column over a window of the key ordered by time, so any number of them
share one shuffle and one sort. Missing is null, never zero. Two operators that look alike but differ in a
denominator or a minimum length have names of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Series:
    """A partitioning and an order; `day` is an integer day number for calendar windows."""

    keys: tuple[str, ...]
    order: str
    day: Column | None = None

    def base(self):
        return W.partitionBy(*self.keys).orderBy(self.order)

    def rows(self, start: int, end: int):
        return self.base().rowsBetween(start, end)

    def days(self, start: int, end: int):
        day = self.day if self.day is not None else F.unix_date(F.to_date(self.order))
        return W.partitionBy(*self.keys).orderBy(day).rangeBetween(start, end)

    # lags and changes

    def back(self, v, n: int) -> Column:
        """The value n observations earlier."""
        return F.lag(_c(v), n).over(self.base())

    def change(self, v, n: int) -> Column:
        return _c(v) - self.back(v, n)

    def period_return(self, v, n: int) -> Column:
        """Percent change against n bars ago; null where that is not positive."""
        start = self.back(v, n)
        return F.when(start > 0, (_c(v) - start) / start * 100.0)

    def forward_return(self, v, n: int) -> Column:
        """Percent change n bars ahead; null where this bar is not positive."""
        return F.when(_c(v) > 0, (F.lead(_c(v), n).over(self.base()) - _c(v)) / _c(v) * 100.0)

    # full and partial windows

    def full(self, agg: Column, n: int) -> Column:
        """An aggregate over the last n rows, null until there are n."""
        w = self.rows(-(n - 1), 0)
        return F.when(F.count(F.lit(1)).over(w) == n, agg.over(w))

    def moving_average(self, v, n: int) -> Column:
        return self.full(F.avg(_c(v)), n)

    def moving_average_slope(self, df: DataFrame, ma: str, lookback: int) -> DataFrame:
        """Adds <ma>_slope: the moving average less itself `lookback` bars ago."""
        return df.withColumn(f"{ma}_slope", F.col(ma) - self.back(ma, lookback))

    def ttm(self, v) -> Column:
        """Sum of four quarters, null for the first three."""
        return self.full(F.sum(_c(v)), 4)

    def ttm_available(self, v) -> Column:
        """Sum of the last four quarters or as many as there are."""
        return F.sum(_c(v)).over(self.rows(-3, 0))

    def below_high(self, high, close, n: int = 252) -> Column:
        """Percent below the highest high of the last n bars (fewer at the start)."""
        top = F.max(_c(high)).over(self.rows(-(n - 1), 0))
        return F.when(top > 0, (_c(close) - top) / top * 100.0)

    def volume_ratio(self, volume, n: int = 20) -> Column:
        """Volume over the mean of the n bars before this one."""
        w = self.rows(-n, -1)
        mean = F.when(F.count(F.lit(1)).over(w) == n, F.avg(_c(volume)).over(w))
        return F.when(mean > 0, _c(volume) / mean)

    def new_extreme(self, v, n: int, high: bool) -> Column:
        edge = F.max(_c(v)) if high else F.min(_c(v))
        full = self.full(edge, n)
        return _c(v) >= full if high else _c(v) <= full

    # growth, in three readings

    def yoy_signed(self, v, n: int = 4) -> Column:
        """Against n back, signed denominator, null where it is 0."""
        prior = self.back(v, n)
        return F.when(prior != 0, (_c(v) - prior) / prior * 100.0)

    def yoy_absolute(self, v, n: int = 4) -> Column:
        """Against n back, absolute denominator, as a fraction; null where it is 0."""
        prior = self.back(v, n)
        return F.when(prior != 0, (_c(v) - prior) / F.abs(prior))

    def yoy_percent(self, v, n: int = 4) -> Column:
        return self.yoy_absolute(v, n) * 100.0

    # distribution within a window

    def zscore(self, v, w) -> Column:
        """(x - mean) / sample deviation; null under two values or with deviation 0."""
        sd = F.stddev_samp(_c(v)).over(w)
        return F.when(F.count(_c(v)).over(w) >= 2, (_c(v) - F.avg(_c(v)).over(w)) / F.nullif(sd, F.lit(0.0)))

    def trough(self, v, days: int) -> Column:
        """struct(v, at): the least value of the last `days` days and its first date."""
        return F.min(F.struct(_c(v).alias("v"), F.col(self.order).alias("at"))).over(self.days(-days, 0))


def percentile_in_window(values: Column, current: Column) -> Column:
    """100 * share of values at or below current, null with no values. values: an array."""
    at = F.size(F.filter(values, lambda x: x <= current))
    return F.when(F.size(values) > 0, 100.0 * at / F.size(values))


def with_percentile(df: DataFrame, s: Series, v: str, days: int, out: str) -> DataFrame:
    """Adds the percentile of each value among those of its last `days` days, itself included.

    The window's values travel as one array per row, so the window must be short against the
    series (5 years of days is 1,300 values).
    """
    values = F.collect_list(v).over(s.days(-days, 0))
    return df.withColumn(out, percentile_in_window(values, F.col(v)))


def volatility(df: DataFrame, s: Series, close: str, n: int, out: str) -> DataFrame:
    """Sample deviation of the last n simple returns, in percent; returns from a close that is not
    positive are left out."""
    prior = s.back(close, 1)
    df = df.withColumn("_ret", F.when(prior > 0, (F.col(close) - prior) / prior))
    w = s.rows(-(n - 1), 0)
    enough = F.count(F.lit(1)).over(s.rows(-n, 0)) == n + 1
    got = F.when(enough & (F.count("_ret").over(w) >= 2), F.stddev_samp("_ret").over(w) * 100.0)
    return df.withColumn(out, got).drop("_ret")


def max_drawdown(df: DataFrame, keys: list[str], order: str, close: str, bars: int = 365) -> DataFrame:
    """(keys, max_drawdown): the deepest fall below the running peak over the last `bars` bars, percent."""
    back = W.partitionBy(*keys).orderBy(F.col(order).desc())
    last = df.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= bars)
    peak = F.max(close).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    fell = last.withColumn("_fall", F.when(peak > 0, (F.col(close) - peak) / peak * 100.0))
    return fell.groupBy(*keys).agg(F.min("_fall").alias("max_drawdown"))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order` (give descending columns for the latest)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False
) -> DataFrame:
    """For each left row the right row of its key with the greatest time <= (strict: <) its own.

    Both sides are put in one stream per key and the last right row is carried forward: one shuffle
    on the key, no range join, no row pairs.
    """
    cols = left.columns
    lefts = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
        F.struct(*cols).alias("_left"), F.lit(None).cast(right.select(F.struct(right_time, *values).alias("r")).schema["r"].dataType).alias("_right"),
    )
    rights = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
        F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"), F.struct(right_time, *values).alias("_right"),
    )
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = lefts.unionByName(rights).withColumn("_seen", F.last("_right", ignorenulls=True).over(w))
    both = both.where(F.col("_left").isNotNull())
    return both.select("_left.*", *[F.col(f"_seen.{c}").alias(f"asof_{c}") for c in [right_time, *values]])


def nearest_within(
    left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, value: str, days: int
) -> DataFrame:
    """For each left row the right value nearest in time within `days` days; ties to the earlier.

    The range becomes an equality on buckets of `days` days: each left row looks at its own
    bucket and both neighbours.
    """
    num = lambda c: F.unix_date(F.to_date(c))
    l = left.withColumn("_lid", F.struct(*keys, left_day)).withColumn("_ld", num(left_day))
    probe = l.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_ld") / days) + k for k in (-1, 0, 1)])))
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], num(right_day).alias("_rd"), F.col(value).alias("_v"))
    r = r.withColumn("_rb", F.floor(F.col("_rd") / days))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_b") == F.col("_rb")]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    near = probe.join(r, cond & (F.abs(F.col("_ld") - F.col("_rd")) <= days))
    gap = F.struct(F.abs(F.col("_ld") - F.col("_rd")), F.col("_rd"))
    best = near.groupBy("_lid").agg(F.min_by("_v", gap).alias("nearest_value"))
    return l.join(best, "_lid", "left").drop("_lid", "_ld")


def linear_slope(df: DataFrame, keys: list[str], order: str, v: str, out: str = "slope") -> DataFrame:
    """Least-squares slope of v against 0, 1, 2, ... in order, per key."""
    i = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("_i", i.cast("double")).groupBy(*keys).agg(F.regr_slope(F.col(v), F.col("_i")).alias(out))


def trend_of_slope(slope: Column, flat: float = 0.0005) -> Column:
    return F.when(slope > flat, "expanding").when(slope < -flat, "contracting").otherwise("stable")


def change_frequency(df: DataFrame, keys: list[str], order: str, signal: str) -> DataFrame:
    """Share of neighbouring observations whose signal differs; 0 with fewer than two."""
    w = W.partitionBy(*keys).orderBy(order)
    prev = df.withColumn("_p", F.lag(signal).over(w)).withColumn("_n", F.row_number().over(w))
    differs = F.avg(F.when(F.col("_n") > 1, (~F.col(signal).eqNullSafe(F.col("_p"))).cast("double")))
    return prev.groupBy(*keys).agg(F.coalesce(differs, F.lit(0.0)).alias("change_frequency"))
