"""Indicator flags, data quality, and the upkeep of sources: rewinds, in-place refetches, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import let
from ledgerloom.functions import text as X
from ledgerloom.operators.series import Series, with_percentile


def credit_flags(df: DataFrame, s: Series, v: str) -> DataFrame:
    """Cooling: in the top fifth of ten years or 75 basis points wider in 20 observations; overheating: in the lowest
    tenth and not widening."""
    d = with_percentile(df, s, v, 3650, "percentile_10y").withColumn("change_20", s.change(v, 20))
    cooling = (F.col("percentile_10y") >= 80) | F.coalesce(F.col("change_20") * 100 >= 75, F.lit(False))
    hot = (F.col("percentile_10y") <= 10) & (F.coalesce("change_20", F.lit(0.0)) <= 0)
    return d.withColumn("cooling", F.coalesce(cooling, F.lit(False))).withColumn("overheating", F.coalesce(hot, F.lit(False)))


def conditions_flags(df: DataFrame, s: Series, v: str) -> DataFrame:
    """Tightening above 0 and rising over 13 observations; easing below 0 and falling."""
    d = df.withColumn("change_13", s.change(v, 13))
    no = F.lit(False)
    return d.withColumn("tightening", F.coalesce((F.col(v) > 0) & (F.col("change_13") > 0), no)).withColumn(
        "easing", F.coalesce((F.col(v) < 0) & (F.col("change_13") < 0), no)
    )


def employment_flags(claims_yoy: Column, continued_yoy: Column, sahm: Column, near: float = 0.35, over: float = 0.5) -> Column:
    """struct(approaching, exceeded, cooling)."""
    no = F.lit(False)
    exceeded = F.coalesce(sahm >= over, no)
    claims = F.coalesce((claims_yoy >= 15) & (continued_yoy > 0), no)
    return F.struct(F.coalesce(sahm >= near, no).alias("approaching"), exceeded.alias("exceeded"), (claims | exceeded).alias("cooling"))


def data_quality(obs: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Coverage and the names of what is stale, missing or failed."""
    ok = F.col("status") == "ok"

    def names(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("indicator"))))

    return obs.groupBy(*keys).agg(
        F.round(F.count_if(ok) / total, 3).alias("coverage"), names(ok & F.col("is_stale")).alias("stale"),
        names(F.col("status").isin("unavailable", "error")).alias("unavailable"), names(F.col("status") == "error").alias("errors"),
    )


def rationale(features: DataFrame, keys: list[str], order: Column, most: int = 5) -> DataFrame:
    """(keys, lines, citations): the first lines of what contributed, and its distinct sources in order."""
    line = F.format_string("- %s: %s%s (%s, [%s](%s))", "metric", F.coalesce(F.col("value").cast("string"), F.lit("N/A")), "unit", "period", "source_name", "source_url")
    g = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "metric", line.alias("line"), "source_url"))).alias("x"))
    return g.select(*keys, F.array_join(F.slice(F.transform("x", lambda r: r["line"]), 1, most), "\n").alias("lines"), F.array_distinct(F.transform("x", lambda r: r["source_url"])).alias("citations"))


def rewind(state: DataFrame, source_ids: list[str]) -> DataFrame:
    """State rows of the sources made to start anew; what is already stored is skipped by its hash."""
    hit = F.col("source_id").isin(*source_ids)
    return state.withColumn("last_seen_id", F.when(~hit, F.col("last_seen_id"))).withColumn("backfill_completed", F.col("backfill_completed") & ~hit)


def refetched(docs: DataFrame, bodies: DataFrame, key: str = "id") -> DataFrame:
    """docs with new bodies in place: hash and quality measured again, analysis to be done again."""
    j = docs.join(bodies.select(F.col(key).alias("_k"), F.col("body").alias("_b")), F.col(key) == F.col("_k"), "left")
    new = F.col("_b").isNotNull()
    return j.withColumns({
        "body": F.coalesce("_b", "body"), "content_hash": F.when(new, X.content_hash(F.col("_b"), nfc=False)).otherwise(F.col("content_hash")),
        "readable_ratio": F.when(new, X.readable_ratio(F.col("_b"))).otherwise(F.col("readable_ratio")), "truncated": F.when(new, X.original_chars(F.col("_b")).isNotNull()).otherwise(F.col("truncated")),
        "llm_processed": F.col("llm_processed") & ~new,
    }).drop("_k", "_b")


def once_a_day(wanted: DataFrame, documents: DataFrame, symbol: str, day: str) -> DataFrame:
    """Symbols not yet done on a day, by the stable id that the document would have."""
    key = X.stable_id(F.lit("web_research"), F.col(symbol), F.concat_ws("-", F.col(symbol), F.col(day).cast("string")), F.lit(""))
    return wanted.withColumn("id", key).join(documents.select("id"), "id", "left_anti")


def target_period(filings: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """(key, period): the period of each key's latest filing that has one, unless it is done."""
    t = filings.where("period IS NOT NULL").groupBy(key).agg(F.max_by("period", F.struct("filed", "period")).alias("period"))
    return t.join(done.select(key, "period"), [key, "period"], "left_anti")


# Fixed value: endings of securities' names that tell the form, not the company.
SECURITY_FORM = (
    r"(?i)\s*(?:sponsored\s+)?(?:spn\.?)?\s*(?:adr(?:\s*\d+:\d+)?|reit|inc\.?|corp(?:oration)?\.?|co\.?|ltd\.?|plc|llc|sa|nv|ag|holdings?|hldgs?|group|"
    r"class\s+[a-c]|common|pref|cl\s*[a-c])\b\.?"
)


def security_name(name: Column, rounds: int = 8) -> Column:
    """The company's part of a security's name: forms come off wherever they end a word, and again from what is left, up to
    `rounds` times (a name of 60 characters has fewer forms side by side); 60 characters at most, the whole name if nothing is left."""
    out = F.trim(F.regexp_replace(name, "[‘’'\"]", ""))
    for _ in range(rounds):
        out = F.regexp_replace(F.regexp_replace(out, SECURITY_FORM, ""), r"^[ .,-]+|[ .,-]+$", "")
    return let(out, lambda n: F.substring(F.when(n == "", F.trim(name)).otherwise(n), 1, 60))


def promote(registry: DataFrame, mentioned: DataFrame) -> DataFrame:
    """registry (key, name, active) with what is mentioned made active."""
    m = mentioned.select("key").distinct().withColumn("_m", F.lit(True))
    return registry.join(m, "key", "left").withColumn("active", F.col("active") | F.coalesce("_m", F.lit(False))).drop("_m")
