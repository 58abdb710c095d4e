"""Catalogue queries over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import catalog as C
from ledgerloom.operators import chunking as K
from ledgerloom.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def content_hash_dedupe(spark, sf_dir):
    """The first document of each content, with the number of its copies."""
    d = _docs(spark, sf_dir).select("doc_id", X.content_hash(F.coalesce("text", F.lit("")), nfc=False).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def stable_ids(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.stable_id(F.lit("web"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.concat(F.lit("u/"), F.col("doc_id").cast("string"))).alias("stable_id"),
        X.fingerprint(F.coalesce("text", F.lit("")), F.lit("v1")).alias("fingerprint"))


def doc_versions_supersede(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return C.superseded(o, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_orderkey", "superseded")


def cascade_duplicate(spark, sf_dir):
    """Orders from 1999 on against earlier ones: same price, else same customer and priority, else same customer and day."""
    o = _orders(spark, sf_dir).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    new, old = o.where("year(day) >= 1999"), o.where("year(day) < 1999")
    return C.cascade_duplicates(new, old, "o_orderkey", [["cents"], ["o_custkey", "o_orderpriority"], ["o_custkey", "day"]])


def upsert_orders(spark, sf_dir):
    """Orders of status P replaced by a corrected copy."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    fixed = o.where("o_orderstatus = 'P'").withColumn("cents", F.col("cents") + 1)
    return C.upsert(o, fixed, ["o_orderkey"])


def incremental_diff(spark, sf_dir):
    """Present documents against an index that lacks some, has old prints of others and ghosts of a few."""
    d = _docs(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("p"))
    k = d.where("doc_id % 7 <> 0").select(F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("p")).alias("p"))
    return C.diff_plan(d, k, "doc_id", "p")


def idempotent_append(spark, sf_dir):
    """Events of the second half of the month against the log of the first: by user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.round("value").cast("bigint").alias("value"))
    log, late = e.where("day(ts) <= 15"), e.where("day(ts) > 15")
    new = C.keep_first(late, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")])
    return C.idempotent_append(log, new, ["user_id", "event_type"], ["value"], "ts").select("user_id", "event_type", "value", "is_revised")


def _catalog(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id", "source", F.when(F.length(t) < 200, "metadata_only").otherwise("full").alias("capture_mode"),
        X.readable_ratio(F.regexp_replace(t, r"\*\*\*", "�")).alias("readable_ratio"), (F.length(t) > 8000).alias("truncated"), F.col("doc_id").alias("collected_at"),
    )


_CAT = """
c AS (SELECT doc_id, source, CASE WHEN length(coalesce(text, '')) < 200 THEN 'metadata_only' ELSE 'full' END AS capture_mode,
 CASE WHEN coalesce(text, '') = '' THEN 1 ELSE round(1 - (length(replace(text, '***', '#')) - length(replace(text, '***', '')))::DOUBLE / length(replace(text, '***', '#')), 4) END AS readable_ratio,
 length(coalesce(text, '')) > 8000 AS truncated, doc_id AS collected_at FROM documents)
"""


def catalog_health(spark, sf_dir):
    return C.health(_catalog(spark, sf_dir), "source")


def health_gates(spark, sf_dir):
    h = C.health(_catalog(spark, sf_dir), "source")
    return h.select("source", F.array_join(C.gate_failures(F.struct("stubs", "corrupt"), {"stubs": 1, "corrupt": 0}), "; ").alias("failures"))


def refetch_plan(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    r = C.refetch_reason(F.col("capture_mode") != "full", X.is_corrupt(F.col("readable_ratio")), F.col("truncated"))
    return c.select("doc_id", "source", r.alias("reason")).where("reason IS NOT NULL")


def refetch_counts(spark, sf_dir):
    """By reason and by source in one pass."""
    p = refetch_plan(spark, sf_dir)
    return p.groupingSets([["reason"], ["source"]], "reason", "source").agg(F.count("*").alias("n"))


def not_indexed(spark, sf_dir):
    d, l = _docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti")


def has_transcript(spark, sf_dir):
    """Customers with an urgent order in 1998: a semi join."""
    o = _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


def latest_filing(spark, sf_dir):
    """Each customer's latest order of two priorities, with the customer's name."""
    o = _orders(spark, sf_dir).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    best = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(best, "c_custkey")


def unprocessed_window(spark, sf_dir):
    """Orders not done: of the last 30 days, or of rich customers within 180."""
    o = _orders(spark, sf_dir)
    now = o.agg(F.max("o_orderdate").alias("now"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("rich"))
    o = o.where("o_orderstatus <> 'F'").join(F.broadcast(now)).join(rich, "o_custkey", "left")
    days = F.datediff("now", "o_orderdate")
    return o.where((days <= 30) | (F.coalesce("rich", F.lit(False)) & (days <= 180))).select("o_orderkey", days.alias("age"))


def stale_flags(spark, sf_dir):
    """Age against the limit of a frequency; null means never stale."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in {"1-URGENT": 5, "2-HIGH": 10, "3-MEDIUM": 45, "4-NOT SPECIFIED": 120}.items() for x in kv]), F.col("o_orderpriority"))
    age = F.datediff(F.lit("2000-01-01").cast("date"), "o_orderdate")
    return _orders(spark, sf_dir).select("o_orderkey", F.coalesce(age > limit, F.lit(False)).alias("stale"))


def vault_dedupe(spark, sf_dir):
    o = _orders(spark, sf_dir).select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "F").alias("analysed"), F.col("o_orderpriority").alias("body_hash"),
        (F.col("o_totalprice") > 300000).alias("indexed"), F.col("o_orderdate").alias("published"),
    )
    return C.dedupe_plan(o).select("path", "protected", "keep")


def take_until_seen(spark, sf_dir):
    o = _orders(spark, sf_dir)
    o = o.withColumn("pos", F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey"))
    return C.take_until_seen(o, ["o_custkey"], "pos", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


def budget_guard(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cost"))
    e = e.groupBy("ts").agg(F.min("event_id").alias("event_id"), F.sum("cost").alias("cost"))
    return C.within_budget(e, "ts", "cost", 100_000, 2_000_000).select("event_id", "day_spent", "month_spent", "allowed")


def size_packing(spark, sf_dir):
    """Documents of each source packed by eight or 12,000 characters."""
    d = _docs(spark, sf_dir).select("source", "doc_id", "n_chars")
    return C.pack(d, ["source"], "doc_id", "n_chars", 8, 12_000).select("doc_id", "batch")


def chunk_documents(spark, sf_dir):
    """Chunks of every document, with their sizes and a digest of all their text."""
    d = _docs(spark, sf_dir)
    c = K.chunk_documents(d, "doc_id", F.col("text"), F.concat_ws(" ", "source", "lang"))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def section_split(spark, sf_dir):
    """Headings put before every paragraph of benchmark items, then split again."""
    b = table(spark, sf_dir, "benchmark")
    body = F.concat(F.lit("lead\n## One "), F.col("item_id").cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## Next\n")))
    s = b.select("item_id", F.posexplode(K.sections(body)).alias("pos", "s"))
    return s.select("item_id", "pos", "s.heading", "s.text")


def holdings_table(spark, sf_dir):
    """A pipe table written from suppliers, read back as typed rows."""
    row = F.concat(F.lit("| "), F.col("s_name"), F.lit(" | C"), F.col("s_suppkey").cast("string"), F.lit(" | $1,0"), F.col("s_nationkey").cast("string"), F.lit(" | 5.5% | x |"))
    md = F.concat(F.lit("intro\n| issuer | cusip | value | weight | note |\n|---|---|---|---|---|\n"), row, F.lit("\n| short | row |\nend\n| a | b | c | d | e |"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(K.table_rows(md)).alias("c")).where("c[0] <> 'issuer'")
    return s.select("s_suppkey", F.get("c", 0).alias("issuer"), F.get("c", 1).alias("cusip"), X.number(F.get("c", 2)).alias("value"), X.number(F.get("c", 3)).alias("weight"))


def text_slots(spark, sf_dir):
    """Year, quarter, kind and number cues of literal questions, one per nation."""
    qs = ["삼성전자 2023년 사업보고서", "FY2024 guidance", "2024 Q3 목표주가 리포트", "3분기 13F 보유 현황 2021 4분기", "account 2022 total", "규모 2025-06- 집중도"]
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(q) for q in qs]), (F.col("n_nationkey") % len(qs) + 1).cast("int")).alias("q"))
    return n.select("n_nationkey", X.year_slot(F.col("q")).alias("year"), X.quarter_slot(F.col("q")).alias("quarter"), F.array_join(X.type_slot(F.col("q")), ",").alias("types"), X.wants_number(F.col("q")).alias("numeric"))


def markup_text(spark, sf_dir):
    """Visible text of every page: its length and whether a tag is left."""
    p = table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.coalesce("html", F.lit(""))).alias("t"))
    return p.select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def link_targets(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(X.article_urls(F.concat_ws(" ", "url", F.lit("see https://a.b/c). and https://t.me/x")), deny=("t.me",)), " ").alias("urls"))


_NORM = r"regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')"

QUERIES = {
    "content_hash_dedupe": (content_hash_dedupe, f"SELECT sha256({_NORM}) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "stable_ids": (stable_ids, """SELECT doc_id, substr(sha256('web|' || source || '|' || CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'u/' || doc_id END), 1, 16) AS stable_id,
 substr(sha256(('v1'::BLOB || '\\x00'::BLOB || encode(coalesce(text, '')))::BLOB), 1, 32) AS fingerprint FROM documents"""),
    "doc_versions_supersede": (doc_versions_supersede, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 AS superseded FROM orders"),
    "cascade_duplicate": (cascade_duplicate, """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate::DATE AS day FROM orders),
n AS (SELECT * FROM o WHERE year(day) >= 1999), k AS (SELECT * FROM o WHERE year(day) < 1999),
a AS (SELECT cents, min(o_orderkey) AS x FROM k GROUP BY 1), b AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS x FROM k GROUP BY 1, 2), c AS (SELECT o_custkey, day, min(o_orderkey) AS x FROM k GROUP BY 1, 2)
SELECT n.o_orderkey AS id, coalesce(a.x, b.x, c.x) AS duplicate_of, CASE WHEN a.x IS NOT NULL THEN 0 WHEN b.x IS NOT NULL THEN 1 WHEN c.x IS NOT NULL THEN 2 END AS rule
FROM n LEFT JOIN a USING (cents) LEFT JOIN b ON n.o_custkey = b.o_custkey AND n.o_orderpriority = b.o_orderpriority LEFT JOIN c ON n.o_custkey = c.o_custkey AND n.day = c.day"""),
    "upsert_orders": (upsert_orders, "SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS cents FROM orders"),
    "incremental_diff": (incremental_diff, """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS p FROM documents), k AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE p END AS p FROM d WHERE doc_id % 7 <> 0)
SELECT coalesce(d.doc_id, k.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'add' WHEN d.doc_id IS NULL THEN 'remove' WHEN d.p = k.p THEN 'keep' ELSE 'update' END AS action FROM d FULL JOIN k ON d.doc_id = k.doc_id"""),
    "idempotent_append": (idempotent_append, """WITH e AS (SELECT user_id, event_type, ts, event_id, CAST(round(value) AS BIGINT) AS value FROM events),
l AS (SELECT * FROM e WHERE day(ts) <= 15 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1),
n AS (SELECT * FROM e WHERE day(ts) > 15 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1)
SELECT n.user_id, n.event_type, n.value, CASE WHEN l.user_id IS NOT NULL THEN true END AS is_revised FROM n LEFT JOIN l ON n.user_id = l.user_id AND n.event_type = l.event_type WHERE l.user_id IS NULL OR n.value <> l.value"""),
    "catalog_health": (catalog_health, f"WITH {_CAT} SELECT source, count(*) AS n, count(*) FILTER (capture_mode <> 'full') AS stubs, count(*) FILTER (readable_ratio < 0.95) AS corrupt, count(*) FILTER (truncated) AS truncated, max(collected_at) AS latest FROM c GROUP BY 1"),
    "health_gates": (health_gates, f"WITH {_CAT}, h AS (SELECT source, count(*) FILTER (capture_mode <> 'full') AS stubs, count(*) FILTER (readable_ratio < 0.95) AS corrupt FROM c GROUP BY 1) SELECT source, concat_ws('; ', CASE WHEN stubs > 1 THEN 'stubs > 1' END, CASE WHEN corrupt > 0 THEN 'corrupt > 0' END) AS failures FROM h"),
    "refetch_plan": (refetch_plan, f"WITH {_CAT} SELECT doc_id, source, CASE WHEN capture_mode <> 'full' THEN 'stub' WHEN readable_ratio < 0.95 THEN 'corrupt' WHEN truncated THEN 'truncated' END AS reason FROM c WHERE reason IS NOT NULL"),
    "refetch_counts": (refetch_counts, f"WITH {_CAT}, p AS (SELECT source, CASE WHEN capture_mode <> 'full' THEN 'stub' WHEN readable_ratio < 0.95 THEN 'corrupt' WHEN truncated THEN 'truncated' END AS reason FROM c) SELECT reason, source, count(*) AS n FROM p WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason), (source))"),
    "not_indexed": (not_indexed, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "has_transcript": (has_transcript, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998)"),
    "latest_filing": (latest_filing, "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey"),
    "unprocessed_window": (unprocessed_window, """WITH n AS (SELECT max(o_orderdate)::DATE AS now FROM orders) SELECT o_orderkey, (now - o_orderdate::DATE)::INTEGER AS age FROM orders JOIN customer ON o_custkey = c_custkey, n
WHERE o_orderstatus <> 'F' AND (now - o_orderdate::DATE <= 30 OR (c_acctbal > 9000 AND now - o_orderdate::DATE <= 180))"""),
    "stale_flags": (stale_flags, "SELECT o_orderkey, coalesce(DATE '2000-01-01' - o_orderdate::DATE > CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 45 WHEN '4-NOT SPECIFIED' THEN 120 END, false) AS stale FROM orders"),
    "vault_dedupe": (vault_dedupe, """WITH p AS (SELECT o_orderkey AS path, o_custkey, (SELECT count(DISTINCT b.o_orderpriority) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F') > 1 AS protected,
 row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, (o_totalprice > 300000) DESC, o_orderdate DESC, o_orderkey) AS r FROM orders a) SELECT path, protected, protected OR r = 1 AS keep FROM p"""),
    "take_until_seen": (take_until_seen, "SELECT o_custkey, o_orderkey FROM orders QUALIFY max((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) = 0"),
    "budget_guard": (budget_guard, """WITH e AS (SELECT ts, min(event_id) AS event_id, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cost FROM events GROUP BY 1),
l AS (SELECT *, (ts + INTERVAL 9 HOUR)::DATE AS d, date_trunc('month', ts + INTERVAL 9 HOUR)::DATE AS m FROM e),
s AS (SELECT event_id, coalesce(sum(cost) OVER (PARTITION BY d ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS day_spent, coalesce(sum(cost) OVER (PARTITION BY m ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS month_spent FROM l)
SELECT *, day_spent < 100000 AND month_spent < 2000000 AS allowed FROM s"""),
    "size_packing": (size_packing, None),
    "chunk_documents": (chunk_documents, None),
    "section_split": (section_split, """WITH b AS (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark), s AS (
 SELECT item_id, 0 AS pos, '' AS heading, 'lead' AS text FROM b UNION ALL SELECT item_id, 1, 'One ' || item_id, l[1] FROM b
 UNION ALL SELECT item_id, i, 'Next', l[i] FROM (SELECT item_id, l, unnest(range(2, len(l) + 1)) AS i FROM b)) SELECT item_id, pos::INTEGER AS pos, heading, trim(text) AS text FROM s"""),
    "holdings_table": (holdings_table, "SELECT s_suppkey, s_name AS issuer, 'C' || s_suppkey AS cusip, ('10' || s_nationkey)::DOUBLE AS value, 5.5::DOUBLE AS weight FROM supplier"),
    "text_slots": (text_slots, """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN '2023' WHEN 1 THEN '2024' WHEN 2 THEN '2024' WHEN 3 THEN '2021' END AS year,
 CASE n_nationkey % 6 WHEN 2 THEN '2024-Q3' WHEN 5 THEN '2025-Q2' END AS quarter, CASE n_nationkey % 6 WHEN 0 THEN 'DartFiling,SecFiling' WHEN 2 THEN 'ResearchNote,MarketCommentary' WHEN 3 THEN 'HoldingsSnapshot' ELSE '' END AS types,
 n_nationkey % 6 = 5 AS numeric FROM nation"""),
    "markup_text": (markup_text, None),
    "link_targets": (link_targets, "SELECT page_id, regexp_replace(url, '[.,;:!?]+$', '') || ' https://a.b/c' AS urls FROM pages"),
}
