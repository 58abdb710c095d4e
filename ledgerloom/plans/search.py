"""Retrieval queries: documents as the corpus, benchmark items as questions, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import search as S
from ledgerloom.session import table

QUESTION = "the thing that her nation shall have"


def _one(spark, text=QUESTION):
    return spark.range(1).select(F.lit(0).alias("qid"), F.lit(text).alias("text"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _top(scored, k=10):
    t = S.top_k(scored, k, ["qid"], [F.round("score", 6), F.col("id")])
    return t.select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark item."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _top(S.bm25(_docs(spark, sf_dir), q, k=10))


def bm25_question(spark, sf_dir):
    return _top(S.bm25(_docs(spark, sf_dir), _one(spark), k=20), 20)


def bm25_weighted(spark, sf_dir):
    """Two fields, the source's name three times the text's weight."""
    return _top(S.bm25(_docs(spark, sf_dir), _one(spark, QUESTION + " src3 src7"), fields={"source": 3.0, "text": 1.0}, k=20), 20)


def bm25_filtered(spark, sf_dir):
    """German documents only; statistics of all."""
    return _top(S.bm25(_docs(spark, sf_dir), _one(spark, "der die und nicht schen"), allowed=F.col("lang") == "de", k=20), 20)


def bm25_doc_rollup(spark, sf_dir):
    """Lines as chunks, rolled up to their documents by the best one."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    d = d.withColumn("chunk_uid", F.format_string("%d#%05d", "doc_id", "ord"))
    hits = S.bm25(d, _one(spark), id_col="chunk_uid").withColumn("score", F.round("score", 6))
    hits = hits.withColumn("doc_id", F.substring_index("id", "#", 1).cast("bigint")).withColumnRenamed("id", "chunk_uid")
    return S.roll_up(hits, ["doc_id"], 1)


_TOK = r"list_transform(flatten(list_transform(regexp_extract_all(lower({0}), '[가-힣]+|[a-z0-9][a-z0-9._\-/]*'), lambda r: list_concat([r], list_filter(string_split_regex(r, '[._\-/]+'), lambda p: p <> '' AND p <> r)))), lambda t: CASE WHEN regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g') = '' THEN '_' ELSE regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g') END)"


def _bm25_sql(questions: str, fields: dict, k: int, where: str = "true", docs: str = "SELECT doc_id AS id, text, source, lang FROM documents", tail: str = "") -> str:
    toks = " UNION ALL ".join(f"SELECT id, unnest({_TOK.format(f)}) AS term, {w}::DOUBLE AS w FROM docs" for f, w in fields.items())
    tail = tail or f"SELECT qid, id AS doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score, id))::INTEGER AS rank FROM scored QUALIFY rank <= {k}"
    return f"""
WITH docs AS ({docs}), tok AS ({toks}),
len AS (SELECT docs.id, count(tok.term) AS dl FROM docs LEFT JOIN tok ON docs.id = tok.id GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
q AS (SELECT DISTINCT qid, unnest({_TOK.format("text")}) AS term FROM ({questions})),
tf AS (SELECT id, term, sum(w) AS wtf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, avgdl FROM df, st),
scored AS (SELECT q.qid, tf.id, round(-sum(idf * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len ON len.id = tf.id JOIN docs ON docs.id = tf.id WHERE {where} GROUP BY 1, 2)
{tail}"""


def tokenise(spark, sf_dir):
    """Token counts of every document, and the number of distinct ones."""
    t = X.index_tokens(F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def ngrams(spark, sf_dir):
    """Hangul pairs beside identifiers, on literals and a corpus column."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("삼성전자의 10-K/A "), F.col("n_name")).alias("t"))
    return n.select("n_nationkey", F.array_join(X.index_tokens(F.col("t"), keep_word=True), " ").alias("tokens"), F.array_join(X.query_terms(F.col("t")), " ").alias("terms"))


def vector_topk(spark, sf_dir):
    """Ten nearest rows of every 20th vector, itself excluded by no one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    t = S.vector_search(e, q, 10)
    return t.select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("qid"), "embedding")
    t = S.vector_search(e.where("label IN (1, 2, 3)"), q, 15)
    return t.select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_doc_best(spark, sf_dir):
    """The best vector of each label (as a document) for one question."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").select(F.col("vec_id").alias("qid"), "embedding")
    one = S.vector_search(e, q, 300).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    best = one.groupBy("label").agg(F.min_by(F.struct("id", "score"), F.col("rank")).alias("b"))
    return best.select("label", F.col("b.id").alias("vec_id"), F.round("b.score", 6).alias("score"))


def _lists(spark, sf_dir):
    a = S.bm25(_docs(spark, sf_dir), _one(spark), k=100).withColumn("score", F.round("score", 6))
    a = S.top_k(a, 100, ["qid"], [F.col("score"), F.col("id")])
    b = table(spark, sf_dir, "documents").select(F.lit(0).alias("qid"), F.col("doc_id").alias("id"), "n_chars")
    return a, S.top_k(b, 100, ["qid"], [F.col("n_chars").desc(), F.col("id")])


def rrf_fuse(spark, sf_dir):
    """Text ranking fused with a second one (longest first)."""
    f = S.rrf(*_lists(spark, sf_dir), 50)
    return f.select("qid", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "found_by", "rank")


def rrf_weighted(spark, sf_dir):
    f = S.rrf(*_lists(spark, sf_dir), 50, wa=2.0, wb=0.5)
    return f.select("qid", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "found_by", "rank")


def _rrf_sql(wa: float, wb: float) -> str:
    tail = f"""
, a AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM scored QUALIFY r <= 100),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 100),
f AS (SELECT coalesce(a.id, b.id) AS id, a.r AS ar, coalesce({wa} / (60 + a.r), 0)::DOUBLE + coalesce({wb} / (60 + b.r), 0)::DOUBLE AS score,
 CASE WHEN a.r IS NULL THEN 'vector' WHEN b.r IS NULL THEN 'bm25' ELSE 'both' END AS found_by FROM a FULL JOIN b ON a.id = b.id)
SELECT 0 AS qid, id AS doc_id, round(score, 9) AS score, found_by, (row_number() OVER (ORDER BY score DESC, coalesce(ar, 1000000), id))::INTEGER AS rank FROM f QUALIFY rank <= 50"""
    return _bm25_sql(f"SELECT 0 AS qid, '{QUESTION}' AS text", {"text": 1.0}, 100, tail=tail)


def rerank_bonus(spark, sf_dir):
    """Orders as hits: status, entity, year and kind signals over a first ranking by date."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(50)).alias("qid"), "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "stable").when(F.col("o_orderstatus") == "P", "stub").otherwise("").alias("okf_status"),
        F.array(F.lit("kr-").cast("string"), F.col("o_orderpriority")).alias("entity_keys"), F.year("o_orderdate").cast("string").alias("period_year"),
        F.when(F.col("o_totalprice") > 200000, "table").otherwise("prose").alias("kind"),
    )
    top = S.top_k(o, 30, ["qid"], [F.col("o_orderdate").desc(), F.col("id")])
    r = S.rerank(top, F.lit("1-URGENT"), F.lit("1998"), F.lit(True))
    return r.select("qid", F.col("id").alias("o_orderkey"), "bonus", "new_rank")


def coverage_grade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(X.coverage(F.lit(QUESTION), F.coalesce("text", F.lit(""))), 6).alias("coverage"))


def retrieval_metrics(spark, sf_dir):
    """Benchmark items as questions; the gold document is the least id whose text holds the item."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    d = _docs(spark, sf_dir)
    ranked = F.broadcast(bm25_topk(spark, sf_dir).join(F.broadcast(b), "qid")).join(d.select("doc_id", F.col("text").alias("doc")), "doc_id")
    gold = ranked.where(F.contains("doc", "text")).groupBy("qid").agg(F.min("rank").alias("rank"))
    axis = b.select("qid", F.when(F.length("text") > 220, "long").otherwise("short").alias("axis"))
    m = S.retrieval_metrics(axis.join(gold, "qid", "left"), ["axis"])
    return m.select("axis", "questions", *[F.round(c, 6).alias(c) for c in ("recall", "hit_1", "mrr")])


def adaptive_retrieve(spark, sf_dir):
    """The question among one source's documents, then one language's, then all."""
    d = _docs(spark, sf_dir)
    levels = []
    for allowed in (F.col("source") == "src1", F.col("lang") == "en", None):
        s = S.bm25(d, _one(spark, QUESTION + " qqzz"), allowed=allowed, k=5).withColumn("score", F.round("score", 6))
        t = F.broadcast(S.top_k(s, 5, ["qid"], [F.col("score"), F.col("id")])).join(d.select(F.col("doc_id").alias("id"), "text"), "id")
        levels.append(t.select("qid", "id", "rank", X.coverage(F.lit(QUESTION + " qqzz"), F.col("text")).alias("coverage")))
    return S.adaptive(levels).select("qid", F.col("id").alias("doc_id"), "rank", "level", F.round("coverage", 6).alias("coverage"))


_Q1 = f"SELECT 0 AS qid, '{QUESTION}' AS text"
_LONG = "list_distinct(list_filter({0}, lambda t: length(t) >= 2))"
_RAWTOK = r"flatten(list_transform(regexp_extract_all(lower({0}), '[가-힣]+|[a-z0-9][a-z0-9._\-/]*'), lambda r: list_concat([r], list_filter(string_split_regex(r, '[._\-/]+'), lambda p: p <> '' AND p <> r))))"
_ITEMS = "SELECT item_id AS qid, text FROM benchmark"

QUERIES = {
    "bm25_topk": (bm25_topk, _bm25_sql(_ITEMS, {"text": 1.0}, 10)),
    "bm25_question": (bm25_question, _bm25_sql(_Q1, {"text": 1.0}, 20)),
    "bm25_weighted": (bm25_weighted, _bm25_sql(f"SELECT 0 AS qid, '{QUESTION} src3 src7' AS text", {"source": 3.0, "text": 1.0}, 20)),
    "bm25_filtered": (bm25_filtered, _bm25_sql("SELECT 0 AS qid, 'der die und nicht schen' AS text", {"text": 1.0}, 20, "docs.lang = 'de'")),
    "bm25_doc_rollup": (bm25_doc_rollup, _bm25_sql(_Q1, {"text": 1.0}, 0,
        docs="SELECT printf('%d#%05d', doc_id, i - 1) AS id, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
        tail="SELECT split_part(id, '#', 1)::BIGINT AS doc_id, min(score) AS score, arg_min(id, (score, id)) AS chunk_uid FROM scored GROUP BY 1")),
    "tokenise": (tokenise, f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct FROM (SELECT doc_id, {_TOK.format('coalesce(text, chr(32))')} AS t FROM documents)"),
    "ngrams": (ngrams, """SELECT n_nationkey, '삼성 성전 전자 자의 삼성전자의 10ka 10 k a ' || replace(lower(n_name), '_', '') || ' nation ' || split_part(lower(n_name), '_', 2) AS tokens,
 array_to_string(list_sort(list_distinct(['10', '10ka', 'a', 'k', 'nation', split_part(lower(n_name), '_', 2), replace(lower(n_name), '_', ''), '삼성', '성전', '전자', '자의'])), ' ') AS terms FROM nation"""),
    "vector_topk": (vector_topk, """WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT qid, vec_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s QUALIFY rank <= 10"""),
    "vector_filtered": (vector_filtered, """WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id = 0 AND e.label IN (1, 2, 3))
SELECT qid, vec_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s QUALIFY rank <= 15"""),
    "vector_doc_best": (vector_doc_best, """WITH s AS (SELECT e.label, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id = 7),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 300)
SELECT label, arg_min(vec_id, r) AS vec_id, round(arg_min(score, r), 6) AS score FROM r GROUP BY 1"""),
    "rrf_fuse": (rrf_fuse, _rrf_sql(1.0, 1.0)),
    "rrf_weighted": (rrf_weighted, _rrf_sql(2.0, 0.5)),
    "rerank_bonus": (rerank_bonus, """WITH t AS (SELECT *, o_custkey % 50 AS qid, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 30),
b AS (SELECT qid, o_orderkey, rank, (CASE WHEN o_orderstatus = 'P' THEN -3.0 ELSE 0.0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0 ELSE 0.0 END
 + CASE WHEN year(o_orderdate) = 1998 THEN 1.0 ELSE 0.0 END + CASE WHEN o_totalprice > 200000 THEN 1.5 ELSE 0.0 END)::DOUBLE AS bonus FROM t)
SELECT qid, o_orderkey, bonus, (row_number() OVER (PARTITION BY qid ORDER BY bonus DESC, rank))::INTEGER AS new_rank FROM b"""),
    "coverage_grade": (coverage_grade, f"WITH q AS (SELECT {_LONG.format(_RAWTOK.format(repr(QUESTION)))} AS q) SELECT doc_id, round(len(list_intersect(q, {_LONG.format(_RAWTOK.format('coalesce(text, chr(32))'))}))::DOUBLE / len(q), 6) AS coverage FROM documents, q"),
    "retrieval_metrics": (retrieval_metrics, _bm25_sql(_ITEMS, {"text": 1.0}, 10, tail="""
, top AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM scored QUALIFY rank <= 10),
g AS (SELECT b.item_id AS qid, min(rank) AS rank FROM top JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = id WHERE contains(d.text, b.text) GROUP BY 1)
SELECT CASE WHEN length(b.text) > 220 THEN 'long' ELSE 'short' END AS axis, count(*) AS questions, round(avg(coalesce((rank <= 10)::INT, 0)), 6) AS recall,
 round(avg(coalesce((rank = 1)::INT, 0)), 6) AS hit_1, round(avg(coalesce(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank END, 0)), 6) AS mrr
FROM benchmark b LEFT JOIN g ON g.qid = b.item_id GROUP BY 1""")),
    "adaptive_retrieve": (adaptive_retrieve, None),
}
