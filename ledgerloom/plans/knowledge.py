"""Entity, link, routing and parser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import knowledge as K
from ledgerloom.sources import payloads as P
from ledgerloom.session import table


# Questions people ask, each with the place it goes to, judged by what the words mean and not by a pattern.
ASKED = (
    ("버크셔 13F 알려줘", "holdings"), ("보유 종목이 뭐야", "holdings"), ("포트폴리오 비중 상위 종목", "holdings"), ("AI 매출 비중 전망", "documents"),
    ("삼성전자 공시 요약", "documents"), ("접수번호 알려줘", "catalog"), ("언제 제출했나", "catalog"), ("이 보고서 제출일은", "catalog"), ("함께 언급된 회사", "graph"),
    ("에이피알과 관련 종목", "graph"), ("관련 있는 기업", "documents"), ("안녕하세요 반가워요", "skip"), ("  hello there", "skip"), ("history of the firm", "documents"),
    ("okay", "skip"), ("고마워요!", "skip"), ("", "skip"), ("목표주가 근거", "documents"), ("최대 비중은", "holdings"), ("어떤 종목이 같이 나왔나", "graph"),
)


def routes(spark, sf_dir):
    """Every question of ASKED for each nation."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(q) for q, _ in ASKED])).alias("i", "q"))
    return n.select("n_nationkey", "i", K.route(F.col("q")).alias("route"))


def _lexicon(spark, sf_dir):
    """Long words of benchmark items stand for registered names."""
    b = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z]{8,20}"), F.lit(0))).alias("name"))
    return b.distinct().withColumn("key", F.lower("name"))


def entity_mentions(spark, sf_dir):
    """All names in whole texts; the operator's defaults (8,000 characters, 20 names) are for the pages of a reader."""
    return K.mentions(table(spark, sf_dir, "documents"), _lexicon(spark, sf_dir), "doc_id", F.coalesce("text", F.lit("")), limit=None, chars=None).select(F.col("id").alias("doc_id"), "key", "pos")


def entity_match(spark, sf_dir):
    """Nation names found in sentences, longest first."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("from NATION_"), F.col("s_nationkey").cast("string"), F.lit(" to NATION_"), F.pmod("s_suppkey", F.lit(25)).cast("string")).alias("text"))
    return K.longest_names(q, n)


def _rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("uid"), F.col("o_orderkey").alias("doc_id"), F.pmod("o_custkey", F.lit(40)).alias("channel"),
        F.array(F.pmod("o_orderkey", F.lit(53)).cast("string"), F.pmod("o_custkey", F.lit(31)).cast("string")).alias("entities"), F.col("o_orderdate").alias("published"))


def graph_two_hop(spark, sf_dir):
    return K.two_hop(_rows(spark, sf_dir), F.lit("7"))


def filing_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("entity"), F.year("o_orderdate").cast("string").alias("year"), F.concat(F.lit("t ("), F.date_format("o_orderdate", "yyyy.MM"), F.lit(")")).alias("title"), F.col("o_orderpriority").alias("filing_type"), F.col("o_orderdate").alias("published"))
    return K.filing_lookup(o, "5", "1997", ["URGENT", "HIGH"]).select("id", "title")


def bundle_links(spark, sf_dir):
    """Suppliers as concepts that link to their nation and to one that may not exist."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("[n](/n/"), F.col("s_nationkey").cast("string"), F.lit(".md) [o](s/"), (F.col("s_suppkey") + 50).cast("string"), F.lit(")")).alias("body"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("").alias("body"))
    return K.broken_links(s.unionByName(n), "id", "body").select("src", "target")


def concept_hubs(spark, sf_dir):
    return K.concept_hubs(table(spark, sf_dir, "documents").select("source", "lang"), {"source": "channel", "lang": "language"})


def code_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    codes = c.select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("string")).alias("stock_code"), F.col("c_name").alias("name"), (F.col("c_custkey") + 1000000).alias("corp_code"))
    rows = c.select(F.when(F.col("c_custkey") % 2 > 0, F.col("c_custkey").cast("string")).alias("stock_code"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("name"), "c_custkey")
    return K.fallback_key(rows, codes).select("c_custkey", "corp_code")


def event_details(spark, sf_dir):
    """Free-form details as a variant: the sum of one path by type."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("k").isNull()).alias("missing"))


def price_chart(spark, sf_dir):
    """A chart payload per nation, written from its key and parsed."""
    p = F.format_string('{"chart":{"result":[{"timestamp":[86400,172800,259200],"indicators":{"quote":[{"open":[1,2,3],"high":[2,null,4],"low":[1,1,1],"close":[%d,2,3.5],"volume":[10,20,null]}]}}]}}', "n_nationkey")
    return P.price_chart(table(spark, sf_dir, "nation").select("n_nationkey", p.alias("payload"))).select("n_nationkey", "date", "close", "volume")


def information_table(spark, sf_dir):
    row = '<ns1:infoTable><ns1:nameOfIssuer>A &amp; B %s</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>%s</ns1:cusip><ns1:value>7</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>5</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt><ns1:investmentDiscretion>SOLE</ns1:investmentDiscretion><ns1:votingAuthority><ns1:Sole>1</ns1:Sole><ns1:Shared>2</ns1:Shared><ns1:None>3</ns1:None></ns1:votingAuthority></ns1:infoTable>'
    x = F.format_string('<ns1:informationTable xmlns:ns1="u">' + row + "</ns1:informationTable>", F.col("s_name"), F.col("s_suppkey").cast("string"))
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.lit("2022-11-14")).otherwise("2023-02-14").cast("date").alias("filed"), x.alias("payload"))
    return P.information_table(s).select("issuer", "cusip", "value_usd", "shares", "put_call", "voting_none")


def submissions(spark, sf_dir):
    p = F.format_string('{"filings":{"recent":{"accessionNumber":["a%d","b"],"filingDate":["2024-05-15","2024-02-14"],"reportDate":["2024-03-31",""],"form":["13F-HR","8-K"],"primaryDocument":["x","y"],"items":["","2.02, 9.01"]}}}', "n_nationkey")
    s = P.submissions(table(spark, sf_dir, "nation").select("n_nationkey", p.alias("payload")), ("13F-HR", "8-K"))
    return s.select("n_nationkey", "accession", "form", "filed", "period", F.array_join("items", "|").alias("items"))


def fred_series(spark, sf_dir):
    p = F.format_string('{"observations":[{"date":"2024-01-0%d","value":"%d.5"},{"date":"2024-01-09","value":"."}]}', F.col("r_regionkey") + 1, "r_regionkey")
    return P.fred_series(table(spark, sf_dir, "region").select("r_regionkey", p.alias("payload")))


QUERIES = {
    "routes": (routes, f"SELECT n_nationkey, (i - 1)::INTEGER AS i, l[i] AS route FROM (SELECT n_nationkey, {[r for _, r in ASKED]} AS l, unnest(range(1, {len(ASKED) + 1})) AS i FROM nation)"),
    "entity_mentions": (entity_mentions, """WITH lx AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z]{8,20}')) AS name FROM benchmark),
r AS (SELECT doc_id, i - 1 AS pos, l[i] AS run FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z가-힣]{4,20}') AS l FROM documents))),
t AS (SELECT DISTINCT doc_id, pos, unnest([run, substr(run, 1, greatest(length(run) - 1, 3)), substr(run, 1, greatest(length(run) - 2, 3))]) AS name FROM r),
m AS (SELECT doc_id, lower(name) AS key, min(pos)::INTEGER AS pos FROM t JOIN lx USING (name) GROUP BY 1, 2)
SELECT * FROM m"""),
    "entity_match": (entity_match, """WITH q AS (SELECT s_suppkey AS qid, 'from NATION_' || s_nationkey || ' to NATION_' || (s_suppkey % 25) AS t FROM supplier)
SELECT qid, n_nationkey AS key, n_name AS name, (row_number() OVER (PARTITION BY qid ORDER BY length(n_name) DESC, n_name))::INTEGER AS rank FROM q JOIN nation ON contains(t, n_name)"""),
    "graph_two_hop": (graph_two_hop, """WITH r AS (SELECT o_orderkey, o_custkey % 40 AS ch, list_distinct([(o_orderkey % 53)::VARCHAR, (o_custkey % 31)::VARCHAR]) AS e, o_orderdate FROM orders),
n AS (SELECT * FROM r WHERE ch IN (SELECT ch FROM r WHERE list_contains(e, '7')) ORDER BY o_orderdate DESC, o_orderkey LIMIT 300), u AS (SELECT unnest(e) AS entity FROM n) SELECT entity, count(*) AS n FROM u WHERE entity <> '7' GROUP BY 1"""),
    "filing_lookup": (filing_lookup, """SELECT o_orderkey AS id, 't (' || strftime(o_orderdate, '%Y.%m') || ')' AS title FROM orders WHERE o_custkey % 100 = 5 AND year(o_orderdate) = 1997 AND (contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH')) ORDER BY o_orderdate DESC, o_orderkey LIMIT 5"""),
    "bundle_links": (bundle_links, "SELECT 's/' || a.s_suppkey AS src, 's/' || (a.s_suppkey + 50) AS target FROM supplier a WHERE a.s_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)"),
    "concept_hubs": (concept_hubs, "SELECT source AS hub, 'channel' AS type, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT lang, 'language', count(*) FROM documents WHERE lang IS NOT NULL GROUP BY 1"),
    "code_fallback": (code_fallback, "SELECT c_custkey, CASE WHEN c_custkey % 2 > 0 AND c_custkey % 3 > 0 OR c_custkey % 5 > 0 THEN c_custkey + 1000000 END AS corp_code FROM customer"),
    "event_details": (event_details, "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) FILTER (props->>'$.k' IS NULL) AS missing FROM events GROUP BY 1"),
    "price_chart": (price_chart, "SELECT n_nationkey, DATE '1970-01-02' AS date, n_nationkey::DOUBLE AS close, 10::BIGINT AS volume FROM nation UNION ALL SELECT n_nationkey, DATE '1970-01-04', 3.5, 0 FROM nation"),
    "information_table": (information_table, "SELECT 'A & B ' || s_name AS issuer, s_suppkey::VARCHAR AS cusip, CASE WHEN s_suppkey % 2 = 0 THEN 7000 ELSE 7 END::BIGINT AS value_usd, 5::BIGINT AS shares, NULL::VARCHAR AS put_call, 3::BIGINT AS voting_none FROM supplier"),
    "submissions": (submissions, "SELECT n_nationkey, 'a' || n_nationkey AS accession, '13F-HR' AS form, DATE '2024-05-15' AS filed, DATE '2024-03-31' AS period, '' AS items FROM nation UNION ALL SELECT n_nationkey, 'b', '8-K', DATE '2024-02-14', NULL, '2.02|9.01' FROM nation"),
    "fred_series": (fred_series, "SELECT r_regionkey, DATE '2024-01-01' + r_regionkey AS date, r_regionkey + 0.5::DOUBLE AS value FROM region UNION ALL SELECT r_regionkey, DATE '2024-01-09', NULL FROM region"),
}
