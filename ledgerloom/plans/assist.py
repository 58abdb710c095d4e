"""Planning, answering, bundle and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import answers as N
from ledgerloom.operators import assistant as A
from ledgerloom.operators import bundle as B
from ledgerloom.operators import catalog as C
from ledgerloom.operators import indexing as X
from ledgerloom.operators import knowledge as K
from ledgerloom.operators import scoring as S
from ledgerloom.operators import search as R
from ledgerloom.operators import stored_index as I
from ledgerloom.plans.search import _Q1, _bm25_sql, _one
from ledgerloom.plans.series import DAILY_SQL, daily
from ledgerloom.plans.stored import LAYOUT, index_of
from ledgerloom.session import table
from ledgerloom.sources import payloads as P


def question_plans(spark, sf_dir):
    """Customers as companies and houses, asked for in four ways."""
    c = table(spark, sf_dir, "customer")
    word = F.concat(F.lit("N"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("x"))
    lex = c.select(F.when(F.col("c_custkey") % 5 == 0, F.concat(word, F.lit("증권"))).otherwise(F.concat(word, F.lit(" Group N.V."))).alias("name"), F.concat(F.lit("us-"), F.col("c_custkey").cast("string")).alias("key"))
    words = F.array(F.lit(" 2003년 사업보고서"), F.lit(" 13F 보유 현황"), F.lit(" FY2024 실적"), F.lit(" 어때"))
    tail = F.element_at(words, (F.col("c_custkey") % 4 + 1).cast("int"))
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(word, F.lit("증권"))).otherwise(word)
    q = c.select(F.col("c_custkey").alias("qid"), F.concat(name, tail).alias("text"))
    out = A.plan_questions(q, lex)
    return out.select("qid", "entity_key", "entity_name", "house", "period_year", F.array_join("okf_types", ",").alias("okf_types"))


def document_tool(spark, sf_dir):
    """The first hits of the stored index as evidence, for a question with hits and one without."""
    q = _one(spark).unionByName(spark.range(1).select(F.lit(1).alias("qid"), F.lit("qqzzqq").alias("text")))
    hits = I.search(spark, index_of(spark, sf_dir), q, LAYOUT, k=10).withColumn("score", F.round("score", 6))
    top = R.top_k(hits, 10, ["qid"], [F.col("score"), F.col("id")])
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 7 == 0, "corrupt").otherwise("stable").alias("okf_status"))
    r = A.document_results(F.broadcast(top).join(d, "id").withColumn("escalate", F.lit(False)), q)
    return r.select("qid", "ok", "n_evidence", F.array_join(F.transform("evidence", lambda x: x["id"]), ",").alias("ids"), F.array_join("notes", ",").alias("notes"))


def answers_with_fallback(spark, sf_dir):
    """Tools that fail for some questions; documents that fail for fewer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    texts = F.array(F.lit("13F 알려줘"), F.lit("접수번호는"), F.lit("목표주가 근거"), F.lit("안녕"))
    q = o.withColumn("text", F.element_at(texts, (F.col("qid") % 4 + 1).cast("int")))
    own = o.select("qid", F.when(F.col("qid") % 4 == 0, "holdings").otherwise("catalog").alias("tool"), (F.col("qid") % 3 > 0).alias("ok"), F.lit(2).alias("n_evidence")).where("qid % 4 < 2 AND qid % 10 > 0")
    docs = o.select("qid", F.lit("documents").alias("tool"), (F.col("qid") % 7 > 0).alias("ok"), (F.col("qid") % 7).cast("int").alias("n_evidence"))
    return A.answered(q, own.unionByName(docs))


def _concepts(spark, sf_dir):
    """Suppliers as snapshots and filings."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = F.concat(F.lit("총 보고 가치: 1,000 달러 / 보유 포지션 수: 3\n\n| 종목 | CUSIP | 주식수 | 가치 | 비중 |\n|---|---|---|---|---|\n| A"), k.cast("string"), F.lit(" | c1 | 1,0"), (k % 10).cast("string"), F.lit("0 | 600 | 60.0% |\n| B | c2 | 7 | 400 | 40.0% |\n"))
    rows = F.when(k % 6 == 0, F.concat(rows, F.lit("| C | c3 | 1 | 0 | 0% |\n"))).otherwise(rows)
    kind = F.when(k % 2 == 0, "HoldingsSnapshot").when(k % 3 == 0, "SecFiling").otherwise("BlogPost")
    return s.select(
        k.alias("id"), kind.alias("okf_type"), F.lit("stable").alias("okf_status"), F.col("s_name").alias("title"), F.col("s_name").alias("subject"), F.array(F.col("s_nationkey").cast("string")).alias("entity_keys"),
        F.lit("2024").alias("period_year"), F.lit("2024-05-01").cast("date").alias("published"), F.when(k % 2 == 0, rows).otherwise("x").alias("body"),
    )


def structured_snapshots(spark, sf_dir):
    return A.structured_tables(_concepts(spark, sf_dir))["snapshots"].select("id", "entity_key", "total_value", "reported", "captured", "truncated", "legacy")


def structured_holdings(spark, sf_dir):
    return A.structured_tables(_concepts(spark, sf_dir))["holdings"].select("id", "pos", "security", F.col("shares").cast("double").alias("shares"), F.col("weight_pct").cast("double").alias("weight_pct"))


def structured_filings(spark, sf_dir):
    return A.structured_tables(_concepts(spark, sf_dir))["filings"].select("id", "entity_key", "title", "pub_year")


def _documents(spark, sf_dir):
    """Orders as documents of every kind."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("dart", "sec_filing", "sec_13f", "telegram", "naver", "ib_insights", "essay", "other")])
    return o.select(
        k.alias("id"), F.element_at(kinds, (k % 8 + 1).cast("int")).alias("source_type"), F.lit("src").alias("source_name"), F.when(k % 3 > 0, F.concat(F.lit("T["), k.cast("string"), F.lit("]"))).alias("title"),
        F.when(k % 5 == 0, "kim").alias("author"), F.col("o_orderdate").alias("published_at"), F.when(k % 7 == 0, "metadata_only").otherwise("full").alias("capture_mode"),
        F.when(k % 11 == 0, 0.5).otherwise(1.0).alias("readable_ratio"), F.when(k % 2 == 0, "10-K").alias("filing_type"), F.when(k % 4 == 1, F.lit("2023-12-31").cast("date")).alias("reporting_period"),
        F.lit("ko").alias("language"), F.when(k % 9 > 0, F.concat(F.lit("us-"), F.col("o_custkey").cast("string"))).alias("subject_key"), F.when(k % 9 > 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("subject"),
        (k % 13 == 0).alias("superseded"), F.concat(F.lit("## 원문 ch (@ch) — 2026-07-08T23:21:31Z\n**첫 문장 "), k.cast("string"), F.lit(". 둘째 문장.")).alias("body"),
    )


def bundle_concepts(spark, sf_dir):
    c = B.concepts(_documents(spark, sf_dir))
    return c.select("id", "okf_type", "okf_status", "title", "description", "period_year", "pub_year", "stale_after", F.array_join("tags", ",").alias("tags"))


def bundle_listing(spark, sf_dir):
    return B.listing(B.concepts(_documents(spark, sf_dir)), 50).select("okf_type", "rank", "id", "n")


def bundle_validation(spark, sf_dir):
    """Concepts with links in their bodies, some to none, some without a title."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c/"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 10 > 0, "Essay").alias("okf_type"),
        F.when(F.col("o_orderkey") % 4 > 0, "t").otherwise("").alias("title"), F.lit("d").alias("description"), F.col("o_orderdate").alias("published"), F.lit("stable").alias("okf_status"),
        F.concat(F.lit("[x](c/"), (F.col("o_orderkey") + 1).cast("string"), F.lit(".md)")).alias("body"))
    return B.validated(o, K.broken_links(o, "id", "body"), K.links(o, "id", "body"))


def held_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.upper("s_name").alias("symbol"), F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    return C.without_held(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("symbol_or_company")), p).select("c_custkey")


def index_state(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("chunk_count"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("embedded_at"), F.col("o_orderdate").alias("indexed_at"))
    return X.state_summary(s)


def vector_records(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "stub").otherwise("stable").alias("okf_status"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("about").alias("description"), F.repeat(F.lit("ab "), (F.col("o_orderkey") % 12).cast("int")).alias("body"))
    return X.vector_records(c)


def previous_filings(spark, sf_dir):
    """Orders of a customer as a list of filings, latest last; periods go up and down."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("period"))
    return C.previous_listed(o, "o_custkey", "o_orderkey", "period", "previous").select("o_orderkey", "previous")


def replaced_sections(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    keep = lambda d: C.keep_first(d.withColumn("day", F.to_date("at")), ["user_id", "day"], [F.col("at").desc(), F.col("event_id").desc()]).drop("day")
    out = C.replaced_sections(keep(e.where("event_id % 2 = 0")), keep(e.where("event_id % 3 = 0")), ["user_id"], "at", "day")
    return out.select("user_id", F.to_date("at").alias("day"), "event_id")


def dedupe_applied(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plan = o.select((F.col("o_custkey")).alias("id"), F.col("o_orderkey").cast("string").alias("path")).withColumn("_m", F.min(F.col("path").cast("bigint")).over(R.W.partitionBy("id")))
    plan = plan.select("id", "path", (F.col("path").cast("bigint") == F.col("_m")).alias("keep"))
    cat = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("path")).where("o_orderkey % 2 = 0")
    _, moved = C.apply_dedupe(plan.select("path"), plan, cat)
    return moved.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.min("path").alias("path"))


def score_changes(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.col("event_type").alias("ticker"), "day", F.round((F.col("cents") % 1000) / 10.0, 1).alias("score"))
    return S.score_changes(d, d.where("dayofmonth(day) % 3 > 0")).select("ticker", "day", *[F.round(f"change_{n}d", 1).alias(f"change_{n}d") for n in (1, 7, 30)])


def top_signals(spark, sf_dir):
    d = daily(spark, sf_dir).select("day", F.col("event_type").alias("indicator"), (F.col("cents") % 7).alias("severity"), F.when(F.col("volume") % 3 == 0, "watch").when(F.col("volume") % 3 == 1, "confirmed").otherwise("normal").alias("status"))
    return S.top_signals(d, ["day"], 3).select("day", "indicator", "rank")


WEIGHTS = {"growth": 30.0, "quality": 20.0, "normalized_valuation": 25.0, "macro_liquidity": 25.0}


def stock_scores(spark, sf_dir):
    """Customers as tickers: two categories with gaps, two special ones, tiers and gates."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"))
    k = F.col("ticker")
    none = F.array().cast("array<string>")
    growth = c.select("ticker", F.lit("growth").alias("category"), F.when(k % 3 > 0, (k % 100).cast("double")).alias("score"), F.lit(0.5).alias("coverage"), F.when(k % 2 == 0, F.array(F.lit("m1"))).otherwise(none).alias("missing"))
    quality = c.select("ticker", F.lit("quality").alias("category"), F.when(k % 5 > 0, (k % 50).cast("double")).alias("score"), F.lit(1.0).alias("coverage"), none.alias("missing"))
    special = c.select("ticker", F.when(k % 4 > 0, 40.0).alias("normalized_valuation"), F.when(k % 7 > 0, 60.0).alias("macro_liquidity"))
    tiers = c.where(k % 3 > 0).select("ticker", F.explode(F.array(F.lit("official"), F.when(k % 2 == 0, "broker").otherwise("media"))).alias("source_tier"))
    r = S.stock_scores(growth.unionByName(quality), special, WEIGHTS, tiers, c.where(k % 9 == 0).select("ticker", F.lit("g").alias("gate_id")))
    up = S.buy_allowed(F.col("total"), F.col("confidence"), F.col("ticker") % 4, F.col("thesis"), F.col("gate"), F.lit(2), F.lit("accumulate_candidate"), 40.0, 0.5, 2, 2)
    down = S.sell_review(F.col("total"), F.col("thesis"), F.col("gate"), F.col("ticker") % 3, F.lit("hold_watch"))
    return r.select("ticker", "total", "coverage", "confidence", "gate", F.array_join("missing", ",").alias("missing"), up.alias("buy"), down.alias("review"))


def corp_codes(spark, sf_dir):
    item = F.format_string("<list><corp_code>%08d</corp_code><corp_name>A &amp;amp; %s</corp_name><stock_code>%s</stock_code><modify_date>20240101</modify_date></list>".replace("&amp;amp;", "&amp;"), F.col("n_nationkey"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).otherwise(" "))
    x = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<result>"), F.array_join(F.collect_list(item), "\n"), F.lit("</result>")).alias("payload"))
    return P.corp_codes(x).drop("n_regionkey")


def term_percentiles(spark, sf_dir):
    d = daily(spark, sf_dir).select("event_type", "day", (F.col("cents") + 1.0).alias("v"))
    near, far = (d.where(F.col("event_type") == t).select("day", "v") for t in ("click", "view"))
    return N.term_percentiles(N.term_structure(near, far, "day", "v"), "day", "ratio", {"p30": 30}).select("day", F.round("ratio", 6).alias("ratio"), F.round("p30", 6).alias("p30"))


_CONCEPT_SQL = """WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate::DATE AS d FROM orders),
m AS (SELECT k, ['DartFiling', 'SecFiling', 'HoldingsSnapshot', 'MarketCommentary', 'BlogPost', 'ResearchNote', 'Essay', 'Document'][k % 8 + 1] AS okf_type, d, strftime(d, '%Y-%m-%d') AS w,
 ['filings/dart', 'filings/sec', 'holdings', 'commentary', 'blog', 'research', 'essays', 'documents'][k % 8 + 1] || '/' || k AS id,
 ['dart', 'sec_filing', 'sec_13f', 'telegram', 'naver', 'ib_insights', 'essay', 'other'][k % 8 + 1] AS st,
 CASE WHEN k % 9 > 0 THEN 'C' || o_custkey ELSE 'src' END AS who, CASE WHEN k % 7 = 0 THEN ' (본문 미확보, 링크만 보유)' ELSE '' END AS cap,
 CASE WHEN k % 4 = 1 THEN '. 보고 기준일 2023-12-31' ELSE '' END AS basis, CASE WHEN k % 2 = 0 THEN '10-K' ELSE '공시' END AS kind,
 CASE WHEN k % 3 > 0 THEN 'T[' || k || ']' ELSE '제목 없음' END AS t, '첫 문장 ' || k || '.' AS said, o_custkey FROM o),
c AS (SELECT id, okf_type, CASE WHEN k % 11 = 0 THEN 'corrupt' WHEN k % 7 = 0 THEN 'stub' WHEN k % 13 = 0 THEN 'superseded' ELSE 'stable' END AS okf_status,
 CASE WHEN k % 3 > 0 THEN 'T[' || k || ']' ELSE said END AS title,
 CASE okf_type WHEN 'DartFiling' THEN who || '가 ' || w || ' DART에 접수한 ' || kind || basis || cap WHEN 'SecFiling' THEN who || '가 ' || w || ' SEC에 제출한 ' || kind || basis || cap
  WHEN 'HoldingsSnapshot' THEN who || '의 ' || CASE WHEN k % 4 = 1 THEN '2023-12-31' ELSE w END || ' 기준 13F 보유 현황 (제출일 ' || w || ')' || cap
  WHEN 'MarketCommentary' THEN '텔레그램 채널 ' || who || '의 ' || w || ' 메시지. ' || said WHEN 'BlogPost' THEN CASE WHEN k % 5 = 0 THEN 'kim' ELSE who END || ' 블로그 ' || w || ' 글 「' || t || '」. ' || said
  WHEN 'ResearchNote' THEN who || '의 ' || w || ' 리서치 「' || t || '」' || CASE WHEN cap <> '' THEN cap ELSE '. ' || said END
  ELSE trim(who || ', ' || w || '. ' || CASE WHEN k % 3 > 0 THEN t ELSE '' END) || cap END AS description,
 CASE WHEN k % 4 = 1 THEN '2023' END AS period_year, strftime(d, '%Y') AS pub_year, d AS published,
 d + CASE okf_type WHEN 'DartFiling' THEN 400 WHEN 'SecFiling' THEN 400 WHEN 'HoldingsSnapshot' THEN 120 WHEN 'MarketCommentary' THEN 90 WHEN 'Essay' THEN 3650 ELSE 365 END AS stale_after,
 st || CASE WHEN k % 2 = 0 THEN ',10-K' ELSE '' END || CASE WHEN k % 9 > 0 THEN ',us-' || o_custkey ELSE '' END || ',ko' || CASE WHEN k % 7 = 0 THEN ',metadata_only' ELSE '' END AS tags FROM m)"""
_TOOL_TAIL = """
, top AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM scored QUALIFY r <= 5)
SELECT 0 AS qid, true AS ok, count(*)::INTEGER AS n_evidence, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids, CASE WHEN bool_or(id % 7 = 0) THEN 'corrupt_evidence' ELSE '' END AS notes FROM top
UNION ALL SELECT 1, false, 0, NULL, 'no_hits'"""

QUERIES = {
    "question_plans": (question_plans, """SELECT c_custkey AS qid, CASE WHEN c_custkey % 5 > 0 THEN 'us-' || c_custkey END AS entity_key, CASE WHEN c_custkey % 5 > 0 THEN ('N' || lpad(c_custkey::VARCHAR, 9, '0') || 'x') || ' Group N.V.' END AS entity_name,
 CASE WHEN c_custkey % 5 = 0 THEN ('N' || lpad(c_custkey::VARCHAR, 9, '0') || 'x') || '증권' END AS house, CASE c_custkey % 4 WHEN 0 THEN '2003' WHEN 2 THEN '2024' END AS period_year,
 CASE WHEN c_custkey % 5 = 0 THEN 'ResearchNote,MarketCommentary' WHEN c_custkey % 4 = 0 THEN 'DartFiling,SecFiling' WHEN c_custkey % 4 = 1 THEN 'HoldingsSnapshot' ELSE '' END AS okf_types FROM customer"""),
    "document_tool": (document_tool, _bm25_sql(_Q1, {"text": 1.0}, 10, tail=_TOOL_TAIL)),
    "answers_with_fallback": (answers_with_fallback, """WITH q AS (SELECT o_orderkey AS qid, ['holdings', 'catalog', 'documents', 'skip'][o_orderkey % 4 + 1] AS c, o_orderkey % 10 > 0 AND o_orderkey % 3 > 0 AS own, o_orderkey % 7 > 0 AS dok, (o_orderkey % 7)::INTEGER AS dn FROM orders),
r AS (SELECT *, c IN ('holdings', 'catalog') AND NOT own AS back FROM q),
s AS (SELECT qid, c, back, CASE WHEN c = 'skip' THEN 'none' WHEN back THEN 'documents' ELSE c END AS tool, CASE WHEN c = 'skip' THEN true WHEN back OR c = 'documents' THEN dok ELSE own END AS ok, CASE WHEN c = 'skip' THEN 0 WHEN back OR c = 'documents' THEN dn ELSE 2 END AS n FROM r)
SELECT qid, tool, ok, n::INTEGER AS n_evidence, back AS fell_back, c <> 'skip' AND (NOT ok OR n < 1) AS stopped, c <> 'skip' AS needs_search FROM s"""),
    "structured_snapshots": (structured_snapshots, "SELECT s_suppkey AS id, s_nationkey::VARCHAR AS entity_key, 1000::BIGINT AS total_value, 3 AS reported, CASE WHEN s_suppkey % 6 = 0 THEN 3 ELSE 2 END AS captured, s_suppkey % 6 > 0 AS truncated, false AS legacy FROM supplier WHERE s_suppkey % 2 = 0"),
    "structured_holdings": (structured_holdings, "SELECT s_suppkey AS id, 0 AS pos, 'A' || s_suppkey AS security, 1000 + 10.0::DOUBLE * (s_suppkey % 10) AS shares, 60.0::DOUBLE AS weight_pct FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 1, 'B', 7, 40 FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 2, 'C', 1, 0 FROM supplier WHERE s_suppkey % 6 = 0"),
    "structured_filings": (structured_filings, "SELECT s_suppkey AS id, s_nationkey::VARCHAR AS entity_key, s_name AS title, '2024' AS pub_year FROM supplier WHERE s_suppkey % 2 > 0 AND s_suppkey % 3 = 0"),
    "bundle_concepts": (bundle_concepts, _CONCEPT_SQL + " SELECT id, okf_type, okf_status, title, description, period_year, pub_year, stale_after::DATE AS stale_after, tags FROM c"),
    "bundle_listing": (bundle_listing, _CONCEPT_SQL + " SELECT okf_type, (row_number() OVER w)::INTEGER AS rank, id, count(*) OVER (PARTITION BY okf_type) AS n FROM c WINDOW w AS (PARTITION BY okf_type ORDER BY published DESC, id DESC) QUALIFY rank <= 50"),
    "bundle_validation": (bundle_validation, """SELECT count(*) AS concepts, 1::BIGINT AS types, count(*) FILTER (o_orderkey % 10 = 0) AS required_violations, count(*) FILTER (o_orderkey % 4 = 0) AS contract_missing, count(*) AS links_total,
 count(*) FILTER (o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders)) AS links_broken, false AS ok FROM orders"""),
    "held_candidates": (held_candidates, "SELECT c_custkey FROM customer WHERE lower(c_name) NOT IN (SELECT lower(s_name) FROM supplier UNION ALL SELECT 'customer#' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier)"),
    "index_state": (index_state, "SELECT count(*) AS documents, sum(o_orderkey % 5)::BIGINT AS chunks, count(*) FILTER (o_orderkey % 3 = 0) AS embedded, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders"),
    "vector_records": (vector_records, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'about' || chr(10) || chr(10) ELSE '' END || trim(repeat('ab ', (o_orderkey % 12)::INT)) AS embed_text FROM orders WHERE o_orderkey % 4 > 0 AND length(trim(repeat('ab ', (o_orderkey % 12)::INT))) >= 20"),
    "previous_filings": (previous_filings, "SELECT a.o_orderkey, min(b.o_orderkey) AS previous FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate::DATE < a.o_orderdate::DATE GROUP BY 1"),
    "replaced_sections": (replaced_sections, """WITH e AS (SELECT user_id, ts::DATE AS day, event_id, ts FROM events), a AS (SELECT * FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT * FROM e WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, day, coalesce(b.event_id, a.event_id) AS event_id FROM a FULL JOIN b USING (user_id, day)"""),
    "dedupe_applied": (dedupe_applied, "WITH m AS (SELECT o_custkey AS id, min(o_orderkey) AS p FROM orders GROUP BY 1) SELECT id, count(*) AS n, 1::BIGINT AS paths, any_value(p)::VARCHAR AS path FROM orders JOIN m ON o_custkey = id WHERE o_orderkey % 2 = 0 GROUP BY 1"),
    "score_changes": (score_changes, f"""WITH {DAILY_SQL}, d AS (SELECT event_type AS ticker, day, round((cents % 1000) / 10.0::DOUBLE, 1) AS score FROM daily), s AS (SELECT * FROM d WHERE dayofmonth(day) % 3 > 0)
SELECT ticker, day, """ + ", ".join(f"round(score - (SELECT arg_max(s.score, s.day) FROM s WHERE s.ticker = d.ticker AND s.day <= d.day - {n}), 1) AS change_{n}d" for n in (1, 7, 30)) + " FROM d"),
    "top_signals": (top_signals, f"WITH {DAILY_SQL} SELECT day, event_type AS indicator, (row_number() OVER (PARTITION BY day ORDER BY cents % 7 DESC, event_type))::INTEGER AS rank FROM daily WHERE volume % 3 < 2 QUALIFY rank <= 3"),
    "stock_scores": (stock_scores, """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 100)::DOUBLE END AS g, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 50)::DOUBLE END AS q, CASE WHEN c_custkey % 4 > 0 THEN 40.0::DOUBLE END AS v, CASE WHEN c_custkey % 7 > 0 THEN 60.0::DOUBLE END AS m FROM customer),
w AS (SELECT *, (CASE WHEN g IS NULL THEN 0 ELSE 30 END + CASE WHEN q IS NULL THEN 0 ELSE 20 END + CASE WHEN v IS NULL THEN 0 ELSE 25 END + CASE WHEN m IS NULL THEN 0 ELSE 25 END)::DOUBLE AS a,
 (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + (v IS NULL)::INT + (m IS NULL)::INT) AS mi, CASE WHEN k % 3 = 0 THEN 0.5 WHEN k % 2 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS t FROM c),
x AS (SELECT *, CASE WHEN a > 0 THEN round((coalesce(g, 0) * 30 + coalesce(q, 0) * 20 + coalesce(v, 0) * 25 + coalesce(m, 0) * 25) / a, 1) END AS total, round(a / 100, 3) AS coverage FROM w),
y AS (SELECT *, CASE WHEN coverage <= 0 AND k % 3 = 0 THEN 0.0 ELSE round(greatest(0, least(1, 0.5::DOUBLE * coverage + 0.5::DOUBLE * t - least(0.2::DOUBLE, 0.02::DOUBLE * mi))), 3) END AS confidence FROM x)
SELECT k AS ticker, total, coverage, confidence, k % 9 = 0 AS gate, array_to_string(list_sort(list_filter([CASE WHEN k % 2 = 0 THEN 'm1' END, CASE WHEN v IS NULL THEN 'valuation_scenarios' END, CASE WHEN m IS NULL THEN 'macro_liquidity_score' END], lambda z: z IS NOT NULL)), ',') AS missing,
 coalesce(total >= 40 AND confidence >= 0.5 AND k % 4 >= 2 AND k % 9 > 0, false) AS buy, coalesce(total < 50, false) OR k % 9 = 0 OR k % 3 >= 2 AS review FROM y"""),
    "corp_codes": (corp_codes, "SELECT lpad(n_nationkey::VARCHAR, 8, '0') AS corp_code, 'A & ' || n_name AS corp_name, CASE WHEN n_nationkey % 2 = 0 THEN lpad(n_nationkey::VARCHAR, 6, '0') END AS stock_code, '20240101' AS modify_date FROM nation"),
    "term_percentiles": (term_percentiles, f"""WITH {DAILY_SQL}, r AS (SELECT a.day, round((a.cents + 1.0)::DOUBLE / (b.cents + 1.0)::DOUBLE, 3) AS ratio FROM daily a JOIN daily b USING (day) WHERE a.event_type = 'click' AND b.event_type = 'view')
SELECT day, round(ratio, 6) AS ratio, round((SELECT 100.0::DOUBLE * count(*) FILTER (s.ratio <= r.ratio) / count(*) FROM r s WHERE s.day <= r.day AND s.day >= r.day - 30), 6) AS p30 FROM r"""),
}
