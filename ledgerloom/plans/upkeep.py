"""Queries of indicator flags and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import upkeep as U
from ledgerloom.plans.series import BARS, DAILY_SQL, daily
from ledgerloom.session import table


def _signed(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("v", (F.col("cents") % 400 - 200) / 100.0)


def credit_flags(spark, sf_dir):
    c = U.credit_flags(_signed(spark, sf_dir), BARS, "v")
    return c.select("event_type", "day", F.round("percentile_10y", 6).alias("percentile"), "cooling", "overheating")


def conditions_flags(spark, sf_dir):
    return U.conditions_flags(_signed(spark, sf_dir), BARS, "v").select("event_type", "day", "tightening", "easing")


def employment_flags(spark, sf_dir):
    d = _signed(spark, sf_dir)
    e = U.employment_flags(F.col("v") * 10, F.when(F.col("volume") % 3 > 0, F.col("v")), F.when(F.col("volume") % 4 > 0, F.col("v") / 2))
    return d.select("event_type", "day", e.alias("e")).select("event_type", "day", "e.approaching", "e.exceeded", "e.cooling")


def data_quality(spark, sf_dir):
    d = daily(spark, sf_dir).select("day", F.col("event_type").alias("indicator"), F.when(F.col("volume") > 60, "ok").when(F.col("volume") > 50, "error").otherwise("unavailable").alias("status"), (F.col("cents") % 2 == 0).alias("is_stale"))
    q = U.data_quality(d, ["day"], 10)
    return q.select("day", "coverage", *[F.array_join(c, ",").alias(c) for c in ("stale", "unavailable", "errors")])


def rationales(spark, sf_dir):
    """Orders of a customer as contributing features, the dearest first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("value"), F.lit("x").alias("unit"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderstatus").alias("source_name"), F.concat(F.lit("u/"), F.col("o_orderstatus")).alias("source_url"))
    r = U.rationale(o, ["o_custkey"], -F.col("value"))
    return r.select("o_custkey", "lines", F.array_join("citations", " ").alias("citations"))


def security_names(spark, sf_dir):
    n = table(spark, sf_dir, "supplier")
    raw = F.concat(F.col("s_name"), F.element_at(F.array(*[F.lit(x) for x in (" Inc.", " Corp Class A", ", Ltd. COM", "", " Co., Ltd. New")]), (F.col("s_suppkey") % 5 + 1).cast("int")))
    return n.select("s_suppkey", U.security_name(raw).alias("name"))


def target_periods(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("period"), F.col("o_orderkey").alias("filed"))
    done = o.where("o_custkey % 2 = 0 AND period IS NOT NULL").groupBy("o_custkey").agg(F.max("period").alias("period"))
    return U.target_period(o, "o_custkey", done)


def refetched(spark, sf_dir):
    """Every fifth document gets a new body."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"), F.lit("old").alias("content_hash"), F.lit(0.5).alias("readable_ratio"), F.lit(False).alias("truncated"), F.lit(True).alias("llm_processed"))
    r = U.refetched(d, d.where("id % 5 = 0").select("id", F.lit(" new  body ").alias("body")))
    return r.select("id", "content_hash", "readable_ratio", "truncated", "llm_processed", F.length("body").alias("chars"))


def source_rewind(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), F.col("n_nationkey").cast("string").alias("last_seen_id"), (F.col("n_nationkey") % 2 == 0).alias("backfill_completed"))
    return U.rewind(s, ["NATION_2", "NATION_3"])


def registry_promotion(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 5000).alias("active"))
    return U.promote(r, table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("key")))


def scraped_once(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("symbol"), F.lit("2024-01-02").alias("day"))
    done = U.once_a_day(c.where("c_custkey % 3 = 0"), spark.createDataFrame([], "id string"), "symbol", "day").select("id")
    return U.once_a_day(c, done, "symbol", "day").select("c_custkey")


_S = f"{DAILY_SQL}, s AS (SELECT *, (cents % 400 - 200) / 100.0::DOUBLE AS v FROM daily)"

QUERIES = {
    "credit_flags": (credit_flags, f"""WITH {_S}, c AS (SELECT *, v - lag(v, 20) OVER (PARTITION BY event_type ORDER BY day) AS ch FROM s),
p AS (SELECT a.event_type, a.day, a.ch, 100.0::DOUBLE * count(*) FILTER (b.v <= a.v) / count(*) AS p FROM c a JOIN c b ON a.event_type = b.event_type AND b.day <= a.day GROUP BY a.event_type, a.day, a.ch, a.v)
SELECT event_type, day, round(p, 6) AS percentile, p >= 80 OR coalesce(ch * 100 >= 75, false) AS cooling, p <= 10 AND coalesce(ch, 0) <= 0 AS overheating FROM p"""),
    "conditions_flags": (conditions_flags, f"WITH {_S}, c AS (SELECT *, v - lag(v, 13) OVER (PARTITION BY event_type ORDER BY day) AS ch FROM s) SELECT event_type, day, coalesce(v > 0 AND ch > 0, false) AS tightening, coalesce(v < 0 AND ch < 0, false) AS easing FROM c"),
    "employment_flags": (employment_flags, f"""WITH {_S}, e AS (SELECT event_type, day, v * 10 AS c, CASE WHEN volume % 3 > 0 THEN v END AS k, CASE WHEN volume % 4 > 0 THEN v / 2 END AS h FROM s)
SELECT event_type, day, coalesce(h >= 0.35, false) AS approaching, coalesce(h >= 0.5, false) AS exceeded, coalesce(c >= 15 AND k > 0, false) OR coalesce(h >= 0.5, false) AS cooling FROM e"""),
    "data_quality": (data_quality, f"""WITH {DAILY_SQL} SELECT day, round(count(*) FILTER (volume > 60) / 10, 3) AS coverage, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (volume > 60 AND cents % 2 = 0), '') AS stale,
 coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (volume <= 60), '') AS unavailable, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (volume <= 60 AND volume > 50), '') AS errors FROM daily GROUP BY 1"""),
    "rationales": (rationales, """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n,
 '- ' || o_orderpriority || ': ' || o_orderkey || 'x (' || year(o_orderdate) || ', [' || o_orderstatus || '](u/' || o_orderstatus || '))' AS line FROM orders),
c AS (SELECT o_custkey, string_agg('u/' || o_orderstatus, ' ' ORDER BY n) AS citations FROM (SELECT o_custkey, o_orderstatus, min(n) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT o_custkey, string_agg(line, chr(10) ORDER BY n) FILTER (n <= 5) AS lines, any_value(citations) AS citations FROM r JOIN c USING (o_custkey) GROUP BY 1"""),
    "security_names": (security_names, "SELECT s_suppkey, s_name || ['', '', ', COM', '', ', New'][s_suppkey % 5 + 1] AS name FROM supplier"),
    "target_periods": (target_periods, """WITH t AS (SELECT o_custkey, arg_max(o_orderdate::DATE, o_orderkey) AS period, max(o_orderdate::DATE) AS latest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o_custkey, period FROM t WHERE NOT (o_custkey % 2 = 0 AND period = latest)"""),
    "refetched": (refetched, "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN sha256('new body') ELSE 'old' END AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS readable_ratio, false AS truncated, doc_id % 5 > 0 AS llm_processed, CASE WHEN doc_id % 5 = 0 THEN 11 ELSE length(coalesce(text, '')) END::INTEGER AS chars FROM documents"),
    "source_rewind": (source_rewind, "SELECT n_name AS source_id, CASE WHEN n_nationkey NOT IN (2, 3) THEN n_nationkey::VARCHAR END AS last_seen_id, n_nationkey % 2 = 0 AND n_nationkey <> 2 AS backfill_completed FROM nation"),
    "registry_promotion": (registry_promotion, "SELECT c_custkey AS key, c_name AS name, c_acctbal > 5000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS active FROM customer"),
    "scraped_once": (scraped_once, "SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0"),
}
