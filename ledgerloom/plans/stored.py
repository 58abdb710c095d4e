"""Queries over a stored index: documents as the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import search as S
from ledgerloom.operators import stored_index as I
from ledgerloom.plans.search import _ITEMS, _Q1, QUESTION, _bm25_sql, _one, _top
from ledgerloom.session import table, work_path

LAYOUT = I.Layout("doc_id", (("text", 1.0),), ("source_type", "okf_type", "entity_keys", "period_year", "pub_year", "okf_status", "capture_mode"))
_built: dict[tuple[str, str], str] = {}


def _chunks(spark, sf_dir):
    """Documents with the metadata of concepts, made of their own columns."""
    d = table(spark, sf_dir, "documents")
    year = (F.lit(2000) + F.col("doc_id") % 10).cast("string")
    return d.select(
        "doc_id", "text", F.col("source").alias("source_type"), F.col("lang").alias("okf_type"), F.array("lang", "source").alias("entity_keys"),
        year.alias("period_year"), F.lit("2009").alias("pub_year"), F.when(F.col("doc_id") % 7 == 0, "corrupt").otherwise("stable").alias("okf_status"),
        F.when(F.col("doc_id") % 5 == 0, "stub").otherwise("full").alias("capture_mode"),
    )


def index_of(spark, sf_dir) -> str:
    """The index of a corpus, built once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        path = work_path(spark, "index")
        I.build(_chunks(spark, sf_dir), path, LAYOUT)
        _built[key] = path
    return _built[key]


def bm25_indexed(spark, sf_dir):
    return _top(I.search(spark, index_of(spark, sf_dir), _one(spark), LAYOUT, k=20), 20)


def bm25_indexed_items(spark, sf_dir):
    """Every benchmark item as a question, from the stored postings."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _top(I.search(spark, index_of(spark, sf_dir), q, LAYOUT, k=10))


def bm25_prefiltered(spark, sf_dir):
    """The metadata predicate in the scan of the documents; statistics of all."""
    ok = S.prefilter(sources=["src1", "src2", "src3", "src4"], exclude_capture="stub", entity="de", year="2009", types=["de", "fr"], exclude_status=("corrupt",))
    return _top(I.search(spark, index_of(spark, sf_dir), _one(spark, "der die und nicht schen"), LAYOUT, ok, k=20), 20)


def index_build(spark, sf_dir):
    """An index built anew: its documents and tokens."""
    path = work_path(spark, "index")
    I.build(_chunks(spark, sf_dir), path, LAYOUT)
    return spark.read.parquet(f"{path}/stats").select("documents", "tokens")


def index_upsert(spark, sf_dir):
    """A question after documents were replaced, added and removed."""
    path, docs = work_path(spark, "index"), _chunks(spark, sf_dir)
    I.build(docs.where("doc_id % 3 <> 0"), path, LAYOUT)
    changed = docs.where("doc_id % 3 = 0 OR doc_id % 4 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" nation shall")))
    I.update(path, LAYOUT, changed, docs.where("doc_id % 11 = 0 AND doc_id % 4 <> 0 AND doc_id % 3 <> 0").select(F.col("doc_id").alias("uid")))
    I.update(path, LAYOUT, docs.where("doc_id % 13 = 0"), None)
    return _top(I.search(spark, path, _one(spark), LAYOUT, k=20), 20)


def hybrid_search(spark, sf_dir):
    """Stored postings and vectors, fused: vectors of the same ids, and the question's vector."""
    a = I.search(spark, index_of(spark, sf_dir), _one(spark), LAYOUT, k=100).withColumn("score", F.round("score", 6))
    a = S.top_k(a, 100, ["qid"], [F.col("score"), F.col("id")])
    e = table(spark, sf_dir, "embeddings")
    b = S.vector_search(e, e.where("vec_id = 7").select(F.lit(0).alias("qid"), "embedding"), 100)
    f = S.rrf(a, b, 50)
    return f.select("qid", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "found_by", "rank")


_UPSERTED = """SELECT doc_id AS id, source, lang, CASE WHEN doc_id % 13 <> 0 AND (doc_id % 3 = 0 OR doc_id % 4 = 0) THEN coalesce(text, '') || ' nation shall' ELSE text END AS text
 FROM documents WHERE doc_id % 13 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 11 <> 0"""
_HYBRID = """
, a AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM scored QUALIFY r <= 100),
b AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM embeddings q, embeddings e WHERE q.vec_id = 7 QUALIFY r <= 100),
f AS (SELECT coalesce(a.id, b.id) AS id, a.r AS ar, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score,
 CASE WHEN a.r IS NULL THEN 'vector' WHEN b.r IS NULL THEN 'bm25' ELSE 'both' END AS found_by FROM a FULL JOIN b ON a.id = b.id)
SELECT 0 AS qid, id AS doc_id, round(score, 9) AS score, found_by, (row_number() OVER (ORDER BY score DESC, coalesce(ar, 1000000), id))::INTEGER AS rank FROM f QUALIFY rank <= 50"""

QUERIES = {
    "bm25_indexed": (bm25_indexed, _bm25_sql(_Q1, {"text": 1.0}, 20)),
    "bm25_indexed_items": (bm25_indexed_items, _bm25_sql(_ITEMS, {"text": 1.0}, 10)),
    "bm25_prefiltered": (bm25_prefiltered, _bm25_sql("SELECT 0 AS qid, 'der die und nicht schen' AS text", {"text": 1.0}, 20, "docs.lang = 'de' AND docs.source IN ('src1', 'src2', 'src3', 'src4') AND docs.id % 7 <> 0 AND docs.id % 5 <> 0")),
    "index_build": (index_build, "WITH t AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-z0-9][a-z0-9._\\-/]*')) AS r FROM documents), n AS (SELECT sum(1 + len(list_filter(string_split_regex(r, '[._\\-/]+'), lambda p: p <> '' AND p <> r))) AS tokens FROM t) SELECT (SELECT count(*) FROM documents) AS documents, tokens::BIGINT AS tokens FROM n"),
    "index_upsert": (index_upsert, _bm25_sql(_Q1, {"text": 1.0}, 20, docs=_UPSERTED)),
    "hybrid_search": (hybrid_search, _bm25_sql(_Q1, {"text": 1.0}, 100, tail=_HYBRID)),
}
