"""Analysis and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.tables import html_tables
from ledgerloom.operators import analysis as A
from ledgerloom.operators import chunking as K
from ledgerloom.operators import indexing as I
from ledgerloom.plans.series import BARS, DAILY_SQL, daily
from ledgerloom.session import table


def _r(c, n=6):
    return F.round(c, n)


def margin_trends(spark, sf_dir):
    """Purchases over clicks by day stands for a margin, a type's share of the week for its key."""
    d = daily(spark, sf_dir)
    w = A.wide(d.withColumn("k", F.dayofweek("day")), ["k", "day"], "event_type", "cents", ["purchase", "click"])
    t = A.margin_trend(A.margins(w, "k", "day", "purchase", "click"), ["k"], "day", "margin")
    return t.select("k", "n", _r("slope").alias("slope"), _r("mean").alias("mean"), _r("deviation").alias("deviation"), _r("latest").alias("latest"), _r("warning").alias("warning"), "trend")


def scenarios(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).alias("v"))
    s = A.scenario(F.col("v") * 3, F.nullif("v", F.lit(0.0)), F.col("v") / 10, F.lit(2.0), years=2.0)
    return c.select("c_custkey", s.alias("s")).select("c_custkey", _r("s.ps").alias("ps"), _r("s.pe").alias("pe"), _r("s.required_revenue", 2).alias("required_revenue"), _r("s.required_cagr").alias("required_cagr"), "s.feasible")


def survivals(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).alias("v"))
    s = A.survival(F.when(F.col("c_custkey") % 7 > 0, F.col("v")), F.when(F.col("c_custkey") % 5 > 0, F.lit(-300000.0)), F.when(F.col("c_custkey") % 3 > 0, F.lit(500000.0)))
    return c.select("c_custkey", s.alias("s")).select("c_custkey", _r("s.fcf", 2).alias("fcf"), _r("s.runway_quarters").alias("runway"), "s.verdict")


def candidate_tiers(spark, sf_dir):
    k = F.col("p_partkey")
    t = A.candidate_tier([F.pmod(k * m, F.lit(15)) for m in (3, 5, 7, 11, 13, 17, 19)], F.col("p_size") > 45)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.total", "t.tier")


def hard_gates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("gate"))
    d = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "gate string")
    g = A.hard_gates(table(spark, sf_dir, "customer").select("c_custkey"), o, d, "c_custkey")
    return g.select("c_custkey", F.array_join("gates", ",").alias("gates"), "blocked")


def model_costs(spark, sf_dir):
    p = spark.createDataFrame([("click", 3.0, 15.0), ("view", 1.0, 5.0)], "model string, input_price double, output_price double")
    u = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("input"), (F.col("event_id") % 100).alias("output"), (F.col("event_id") % 2 == 0).alias("batch"))
    return A.model_cost(p, u).select("event_id", _r("cost", 9).alias("cost"))


def curve_signals(spark, sf_dir):
    """Daily totals less their centre as a spread that inverts."""
    d = daily(spark, sf_dir).withColumn("v", (F.col("cents") % 2000 - 1000) / 500.0)
    c = A.curve_signal(d, BARS, "v", "day")
    return c.select("event_type", "day", "inverted", _r("recovered_bps").alias("recovered_bps"), "rapid")


def positioning(spark, sf_dir):
    d = daily(spark, sf_dir).select("event_type", "day", F.col("cents").alias("long"), F.col("top").alias("short"), (F.col("volume") * 1000).alias("oi"))
    p = A.positioning(d, ["event_type"], "day", "long", "short", "oi")
    return p.select("event_type", "day", _r("net_pct").alias("net_pct"), _r("change_4").alias("change_4"), _r("percentile_5y").alias("percentile_5y"))


def cross_medians(spark, sf_dir):
    return A.median_across(daily(spark, sf_dir), ["day"], ["cents", "volume"])


def snapshot_pivot(spark, sf_dir):
    """Three days as columns, configured types as rows, one of them never recorded."""
    d = daily(spark, sf_dir).select(F.col("event_type").alias("indicator"), F.col("day").cast("string").alias("at"), F.col("volume").alias("value"))
    p = A.snapshot_table(d, ["click", "never", "view"], ["2024-01-02", "2024-01-03", "2024-01-04"])
    return p.select("indicator", *[F.col(f"`2024-01-0{i}`").alias(f"d{i}") for i in (2, 3, 4)])


def known_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return A.require_known(o, table(spark, sf_dir, "customer"), "c_custkey")


def fx_cross(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("currency"), (F.col("n_nationkey") + 1.0).alias("usd"))
    return A.fx_rates(n, "NATION_3").select("currency", _r("rate", 9).alias("rate"))


def index_postings(spark, sf_dir):
    """Terms of the index with their documents and occurrences."""
    p = I.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_update(spark, sf_dir):
    """Document frequencies after some documents went and others came: those of a full rebuild."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old, gone, new = d.where("doc_id % 3 < 2"), d.where("doc_id % 3 = 1"), d.where("doc_id % 3 = 2")
    base = I.postings(old, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))
    return I.df_delta(base, I.postings(gone, "doc_id", "text"), I.postings(new, "doc_id", "text"))


def corpus_stats(spark, sf_dir):
    return I.corpus_stats(table(spark, sf_dir, "conversations"), "conv_id", "text")


def intern_decode(spark, sf_dir):
    """Texts stored once by hash, then put back: the lengths of both agree."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    store = I.interned(d, "text")
    h = d.select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("raw"))
    return I.decoded(h, store, "raw").select("doc_id", F.length("raw").alias("chars"))


def embed_cache(spark, sf_dir):
    """Half of the items are cached; every row gets a vector of length 1."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    _, cache = I.cached_encode(b.where("id % 2 = 0"), spark.createDataFrame([], "text_hash string, model string, dim int, v array<float>"), "hash-3gram", 256, I.hash_encode)
    got, new = I.cached_encode(b, cache, "hash-3gram", 256, I.hash_encode)
    n = new.agg(F.count("*").alias("misses"))
    unit = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return got.select("id", F.round(unit, 4).alias("length")).join(F.broadcast(n))


def vector_scopes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = I.vector_scope(F.when(F.col("lang") == "en", "stable").otherwise("stub"), F.when(F.col("doc_id") % 9 > 0, F.substring("text", 1, 30)))
    return d.select("doc_id", r.alias("skip_reason"))


def gold_coverage(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return I.coverage_report(q.withColumnRenamed("doc_id", "gold"), table(spark, sf_dir, "labels"), "lang", "gold").select("lang", "questions", "missing", "covered", F.array_join("examples", ",").alias("examples"))


def chunk_telemetry(spark, sf_dir):
    c = K.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.lit("m"))
    return I.telemetry(c, "kind", "text")


def page_tables(spark, sf_dir):
    """A table with spans written from each nation, as a pipe table."""
    h = F.format_string("<table><tr><th rowspan=2>N</th><th colspan=2>a|b</th></tr><tr><td>x</td><td>y</td></tr><tr><td>%s</td><td></td><td>&amp;%d</td></tr></table>", "n_name", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(html_tables(h)).alias("table"))


_TERMS = r"SELECT {0} AS id, unnest(list_transform(flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-z0-9][a-z0-9._\-/]*'), lambda r: list_concat([r], list_filter(string_split_regex(r, '[._\-/]+'), lambda p: p <> '' AND p <> r)))), lambda t: CASE WHEN regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g') = '' THEN '_' ELSE regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g') END)) AS term FROM documents"

QUERIES = {
    "margin_trends": (margin_trends, f"""WITH {DAILY_SQL}, w AS (SELECT dayofweek(day) + 1 AS k, day, sum(cents) FILTER (event_type = 'purchase') / sum(cents) FILTER (event_type = 'click') AS m FROM daily GROUP BY ALL HAVING m IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS i FROM w)
SELECT k::INTEGER AS k, count(*) AS n, round(regr_slope(m, i), 6) AS slope, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS deviation, round(arg_max(m, day), 6) AS latest, round(avg(m) - stddev_pop(m), 6) AS warning,
 CASE WHEN regr_slope(m, i) > 0.0005 THEN 'improving' WHEN regr_slope(m, i) < -0.0005 THEN 'worsening' ELSE 'flat' END AS trend FROM i GROUP BY 1 HAVING count(*) >= 2"""),
    "scenarios": (scenarios, """WITH c AS (SELECT c_custkey, round(c_acctbal * 100) AS v FROM customer)
SELECT c_custkey, round(v * 3 / nullif(v, 0), 6) AS ps, round(CASE WHEN v > 0 THEN v * 3 / (v / 10) END, 6) AS pe, round(CASE WHEN v <> 0 THEN v * 30 / 3 END, 2) AS required_revenue,
 round(CASE WHEN v <> 0 THEN sqrt(10) - 1 END, 6) AS required_cagr, CASE WHEN v <> 0 THEN false END AS feasible FROM c"""),
    "survivals": (survivals, """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN round(c_acctbal * 100) END AS ocf, CASE WHEN c_custkey % 5 > 0 THEN 300000 END AS cx, CASE WHEN c_custkey % 3 > 0 THEN 500000 END AS cash FROM customer)
SELECT c_custkey, round(ocf - cx, 2) AS fcf, round(CASE WHEN ocf - cx < 0 THEN cash / (abs(ocf - cx) / 4) END, 6) AS runway,
 CASE WHEN ocf IS NULL THEN 'unknown' WHEN cx IS NULL AND ocf >= 0 THEN 'positive_without_capex' WHEN cx IS NULL THEN 'negative_without_capex' WHEN ocf >= cx THEN 'self_funded' WHEN cash IS NULL THEN 'needs_funding' ELSE 'runway' END AS verdict FROM c"""),
    "candidate_tiers": (candidate_tiers, "WITH t AS (SELECT p_partkey, p_size, " + " + ".join(f"p_partkey * {m} % 15" for m in (3, 5, 7, 11, 13, 17, 19)) + " AS total FROM part) SELECT p_partkey, total, CASE WHEN p_size > 45 THEN 'excluded' WHEN total >= 80 THEN 'candidate' WHEN total >= 65 THEN 'watchlist' ELSE 'excluded' END AS tier FROM t"),
    "hard_gates": (hard_gates, "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS gates, count(o_orderpriority) > 0 AS blocked FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 490000 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1"),
    "model_costs": (model_costs, "SELECT event_id, round((user_id * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 1.0 END::DOUBLE + event_id % 100 * CASE event_type WHEN 'click' THEN 15.0 WHEN 'view' THEN 5.0 END::DOUBLE) / 1e6 * CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1 END, 9) AS cost FROM events"),
    "curve_signals": (curve_signals, f"""WITH {DAILY_SQL}, s AS (SELECT event_type, day, (cents % 2000 - 1000) / 500.0::DOUBLE AS v FROM daily),
t AS (SELECT *, min(v) OVER w AS tv, arg_min(day, (v, day)) OVER w AS td FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW))
SELECT event_type, day, tv < 0 AS inverted, round(CASE WHEN tv < 0 THEN (v - tv) * 100 END, 6) AS recovered_bps, coalesce(tv < 0 AND (v - tv) * 100 >= 75 AND day - td <= 95, false) AS rapid FROM t"""),
    "positioning": (positioning, f"""WITH {DAILY_SQL}, n AS (SELECT event_type, day, (cents - top)::DOUBLE / (volume * 1000) * 100 AS net FROM daily),
c AS (SELECT *, net - lag(net, 4) OVER (PARTITION BY event_type ORDER BY day) AS ch FROM n)
SELECT a.event_type, a.day, round(a.net, 6) AS net_pct, round(a.ch, 6) AS change_4, round(100.0 * count(*) FILTER (b.net <= a.net) / count(*), 6) AS percentile_5y FROM c a JOIN c b ON a.event_type = b.event_type AND b.day BETWEEN a.day - 1825 AND a.day GROUP BY a.event_type, a.day, a.net, a.ch"""),
    "cross_medians": (cross_medians, f"WITH {DAILY_SQL} SELECT day, median(cents) AS median_cents, median(volume) AS median_volume, count(*) AS companies FROM daily GROUP BY 1"),
    "snapshot_pivot": (snapshot_pivot, f"WITH {DAILY_SQL} SELECT i AS indicator, " + ", ".join(f"max(volume) FILTER (day = DATE '2024-01-0{k}') AS d{k}" for k in (2, 3, 4)) + " FROM (VALUES ('click'), ('never'), ('view')) v(i) LEFT JOIN daily ON event_type = i GROUP BY 1"),
    "known_ids": (known_ids, "SELECT o_orderkey, o_custkey AS c_custkey FROM orders"),
    "fx_cross": (fx_cross, "SELECT n_name AS currency, round((n_nationkey + 1.0::DOUBLE) / 4.0::DOUBLE, 9) AS rate FROM nation"),
    "index_postings": (index_postings, f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM ({_TERMS.format('doc_id')}) GROUP BY 1"),
    "index_update": (index_update, f"SELECT term, count(DISTINCT id) AS df FROM ({_TERMS.format('doc_id')} WHERE doc_id % 3 <> 1) GROUP BY 1"),
    "corpus_stats": (corpus_stats, "SELECT count(DISTINCT conv_id) AS documents, count(*) AS chunks, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations"),
    "intern_decode": (intern_decode, "SELECT doc_id, length(coalesce(text, ''))::INTEGER AS chars FROM documents"),
    "embed_cache": (embed_cache, "SELECT item_id AS id, 1.0::DOUBLE AS length, (SELECT count(DISTINCT text) FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 2 = 0)) AS misses FROM benchmark"),
    "vector_scopes": (vector_scopes, "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'status' WHEN doc_id % 9 = 0 OR trim(substr(text, 1, 30)) = '' THEN 'no_body' WHEN length(trim(substr(text, 1, 30))) < 20 THEN 'too_short' END AS skip_reason FROM documents"),
    "gold_coverage": (gold_coverage, "WITH j AS (SELECT lang, d.doc_id, l.doc_id IS NULL AS gone FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT lang, count(*) AS questions, count(*) FILTER (gone) AS missing, round(1 - count(*) FILTER (gone) / count(*), 3) AS covered, coalesce(array_to_string(list_sort(list(DISTINCT doc_id) FILTER (gone))[1:5], ','), '') AS examples FROM j GROUP BY 1"),
    "chunk_telemetry": (chunk_telemetry, None),
    "page_tables": (page_tables, r"SELECT n_nationkey, '| N | a\|b | a\|b |' || chr(10) || '|---|---|---|' || chr(10) || '| N | x | y |' || chr(10) || '| ' || n_name || ' |  | &' || n_nationkey || ' |' AS table FROM nation".replace("AS table", 'AS "table"')),
}
