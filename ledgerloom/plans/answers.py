"""Queries of structured answers and document rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import answers as A
from ledgerloom.plans.series import DAILY_SQL, daily
from ledgerloom.session import table


def snapshot_headers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    body = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("총 보고 가치: 1,%03d 달러 / 보유 포지션 수: 7 (원문 9행) / 상위 5종목 집중도: 46.49%%", F.pmod("s_suppkey", F.lit(1000)))).when(
        F.col("s_suppkey") % 3 == 1, F.format_string("총 보고 가치: %d천 달러 / 보유 종목 수: 12", "s_suppkey")).otherwise("no header")
    h = s.select("s_suppkey", A.snapshot_header(body).alias("h"))
    return h.select("s_suppkey", "h.total", "h.positions", "h.top5", "h.legacy")


def transcripts(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    t = A.is_transcript(F.when(k == 0, "earnings_call_transcript").otherwise("sec_filing"), F.when(k < 3, "8-K").otherwise("10-K"), F.when(k == 1, "[컨퍼런스콜] Q1").when(k == 3, "[컨퍼런스콜]"))
    return table(spark, sf_dir, "nation").select("n_nationkey", t.alias("is_transcript"))


def exhibit_choice(spark, sf_dir):
    """Orders of a customer as files: urgent ones read as transcripts, status P reports results."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "Operator: ... Question-and-Answer").when(F.col("o_orderpriority") == "2-HIGH", "").otherwise("x").alias("text"), (F.col("o_orderstatus") == "P").alias("results"))
    return A.choose_exhibit(o, "o_custkey", "o_orderkey", "text", "results")


def no_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 4 == 0, F.lit("a\n## 원문\n \n## 다음\nx")).when(F.col("doc_id") % 4 == 1, F.lit("랭킹 다이제스트")).otherwise(F.concat(F.lit("## 원문\n"), F.coalesce("text", F.lit(""))))
    skip = A.no_content(F.when(F.col("doc_id") % 4 == 2, "metadata_only").otherwise("full"), body, ["랭킹 다이제스트"])
    return d.select("doc_id", skip.alias("skipped"))


def gold_ids(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("c"), F.col("item_id").cast("string"))).alias("gold_concept"), F.col("item_id").cast("string").alias("gold_doc"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("native_id"), F.col("n_name").alias("concept"))
    return A.resolve_gold(b, n).select("item_id", "gold")


def benchmark_fallback(spark, sf_dir):
    """For each nation the first of three suppliers that has line items of a day's range."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey"), F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 7 * 1000 + F.col("s_suppkey")).alias("prio"))
    li = table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08").select("l_suppkey")
    return A.first_with_rows(s, li, "s_nationkey", "l_suppkey", "prio")


def price_summaries(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("close", F.col("cents"))
    p = A.price_summary(d, ["event_type"], "day")
    return p.select("event_type", "n", "first", "last", F.round("change_pct", 6).alias("change_pct"), F.round("volume_ratio", 6).alias("volume_ratio"))


def term_structures(spark, sf_dir):
    d = daily(spark, sf_dir).select("event_type", "day", "cents")
    near, far = (d.where(F.col("event_type") == t).drop("event_type") for t in ("click", "purchase"))
    return A.term_structure(near, far, "day", "cents").select("day", "ratio", "backwardation")


def holdings_metric(spark, sf_dir):
    """Orders as snapshots of customers, their line items as holdings."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("investor"), F.struct("o_orderdate", "o_orderkey").alias("published"), F.lit(4).alias("reported"), (F.col("o_orderstatus") == "P").alias("legacy"))
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_partkey").alias("issuer"), F.col("l_quantity").alias("weight_pct"), F.when(F.col("l_returnflag") == "R", "sold_out").alias("change_type"))
    a = A.holdings_answer(o, h, "investor", "published")
    return a.select("investor", "snapshot_id", "captured", F.col("largest.issuer").alias("largest"), F.array_join(F.transform("top5", lambda x: x["issuer"].cast("string")), ",").alias("top5"), F.array_join("warnings", ",").alias("warnings"))


def claims_batches(spark, sf_dir):
    """A response per nation for two documents; claims counted by document."""
    p = F.format_string('{"documents":[{"document_id":"a%d","claims":[{"text":"t","direction":"bullish","confidence":"high"}]},{"document_id":"b","claims":[]}]}', "n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch"), p.alias("response"))
    e = n.select("batch", F.explode(F.array(F.concat(F.lit("a"), F.col("batch").cast("string")), F.lit("b"))).alias("document_id"))
    return A.unpack_claims(n, e).select("batch", "document_id", F.size("claims").alias("n"))


QUERIES = {
    "snapshot_headers": (snapshot_headers, """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 1000 + s_suppkey % 1000 WHEN 1 THEN s_suppkey * 1000 END AS total, CASE s_suppkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 12 END AS positions,
 CASE s_suppkey % 3 WHEN 0 THEN 46.49 END::DOUBLE AS top5, CASE s_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS legacy FROM supplier"""),
    "transcripts": (transcripts, "SELECT n_nationkey, n_nationkey % 4 IN (0, 1) AS is_transcript FROM nation"),
    "exhibit_choice": (exhibit_choice, """WITH k AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH' THEN 1 END AS k FROM orders)
SELECT o_custkey, arg_min(o_orderkey, (k, o_orderkey)) AS exhibit, min(k) = 0 AS is_transcript FROM k WHERE k IS NOT NULL GROUP BY 1"""),
    "no_content": (no_content, "SELECT doc_id, doc_id % 4 < 3 OR trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' AS skipped FROM documents"),
    "gold_ids": (gold_ids, "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'c' || item_id ELSE coalesce(n_name, item_id::VARCHAR) END AS gold FROM benchmark LEFT JOIN nation ON n_nationkey = item_id"),
    "benchmark_fallback": (benchmark_fallback, "SELECT s_nationkey, arg_min(s_suppkey, s_suppkey % 7 * 1000 + s_suppkey) AS l_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08) GROUP BY 1"),
    "price_summaries": (price_summaries, f"""WITH {DAILY_SQL}, s AS (SELECT event_type, count(*) AS n, arg_min(cents, day) AS first, arg_max(cents, day) AS last, arg_max(volume, day) AS v, avg(volume) AS m FROM daily GROUP BY 1)
SELECT event_type, n, first, last, round((last - first)::DOUBLE / first * 100, 6) AS change_pct, round(v / m, 6) AS volume_ratio FROM s"""),
    "term_structures": (term_structures, f"WITH {DAILY_SQL} SELECT a.day, round(a.cents / b.cents, 3) AS ratio, round(a.cents / b.cents, 3) >= 1 AS backwardation FROM daily a JOIN daily b ON a.day = b.day AND a.event_type = 'click' AND b.event_type = 'purchase'"),
    "holdings_metric": (holdings_metric, """WITH s AS (SELECT o_custkey AS investor, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1),
h AS (SELECT l_orderkey, count(*) AS captured, list(l_partkey ORDER BY l_quantity DESC, l_partkey DESC) AS l FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT investor, snapshot_id, captured, l[1] AS largest, array_to_string(l[1:5], ',') AS top5, concat_ws(',', CASE WHEN 4 > captured THEN 'truncated' END, CASE WHEN st = 'P' THEN 'legacy_units' END) AS warnings FROM s LEFT JOIN h ON l_orderkey = snapshot_id"""),
    "claims_batches": (claims_batches, "SELECT n_nationkey AS batch, 'a' || n_nationkey AS document_id, 1::INTEGER AS n FROM nation UNION ALL SELECT n_nationkey, 'b', 0 FROM nation"),
}
