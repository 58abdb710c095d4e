"""Rules that hold at any size: what a query sends, keeps and reads."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import answers, holdings, indexing, knowledge, search, stored_index


def test_claims_are_unpacked_by_their_own_schema(spark):
    got = '{"documents":[{"document_id":"a","claims":[{"text":"t","direction":"bullish","confidence":"high"}]},{"document_id":"b","claims":[]}]}'
    n = spark.createDataFrame([(1, got)], "batch int, response string")
    e = spark.createDataFrame([(1, "a"), (1, "b")], "batch int, document_id string")
    rows = answers.unpack_claims(n, e).select("document_id", F.size("claims").alias("n"), F.get("claims", 0)["text"].alias("text")).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 1, "t"), ("b", 0, None)]
    with pytest.raises(Exception, match="ids do not match"):
        answers.unpack_claims(n, e.where("document_id = 'a'")).collect()


def test_tokens_are_counted_as_the_index_reads_them(spark):
    texts = ["삼성전자의 10-K/A 가 a​b c&nbsp;d &#12; x..y z-/ İK ＡＢＣ１２３ é 가나", "", "a.-", "-a A_B__C 1.2.3 가1나2 a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for nfkc in (False, True):
        got = {r.i: Counter(r.t) for r in df.select("i", X.index_tokens(F.col("t"), nfkc=nfkc).alias("t")).collect()}
        assert got == {i: X.token_counts(t, nfkc) for i, t in enumerate(texts)}


def _ranked(scored, k):
    return sorted(tuple(r) for r in search.top_k(scored, k, ["qid"], [F.round("score", 6), F.col("id")]).select("qid", "id", "rank").collect())


@pytest.mark.parametrize("block", [5_000, 2])
def test_the_first_k_are_those_of_all_scores(spark, tmp_path, block):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(f"d{i:04d}", texts[i % 60], i % 3) for i in range(900)], "id string, text string, m int").repartition(3)
    q = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (3, "zz"), (4, "aa hh gg ff")], "qid int, text string")
    all_ = search.bm25(docs, q, "id")
    assert _ranked(search.bm25(docs, q, "id", k=7, block=block), 7) == _ranked(all_, 7)
    layout = stored_index.Layout("id", carry=("m",), buckets=2)
    stored_index.build(docs, f"{tmp_path}/i", layout)
    find = lambda ok, **how: stored_index.search(spark, f"{tmp_path}/i", q, layout, ok, **how)
    assert _ranked(find(None, k=7, block=block), 7) == _ranked(find(None), 7) == _ranked(all_, 7)
    ok = F.col("m") == 1
    assert _ranked(find(ok, k=7, block=block), 7) == _ranked(search.bm25(docs, q, "id", allowed=ok), 7)


def test_scores_do_not_leave_their_tasks(spark, tmp_path):
    """Copies tie; without k every score was shuffled, and with it every tie was kept."""
    docs = spark.range(6000).select(F.col("id"), F.lit("aa bb").alias("text")).repartition(2)
    q = spark.createDataFrame([(i, "aa bb") for i in range(20)], "qid int, text string")
    assert search.bm25(docs, q, "id", k=5).count() == 2 * 20 * 5
    e = spark.range(6000).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")).repartition(2)
    best = search.Best(1, 3)
    for _ in range(5):
        best.add(np.ones((200_000, 1)), pa.array(np.arange(200_000)))
    assert best.size < 600_000 and sorted(best.rows()[2].to_pylist()) == [0, 0, 0]
    assert search.vector_search(e, e.where("id < 2").select(F.col("id").alias("qid"), "embedding"), 4, "id").count() == 8


def test_metadata_stand_once_a_document(spark, tmp_path):
    layout = stored_index.Layout("id", carry=("m",), buckets=2)
    stored_index.build(spark.createDataFrame([(1, "a b a", "x")], "id int, text string, m string"), f"{tmp_path}/i", layout)
    assert "m" not in spark.read.parquet(f"{tmp_path}/i/postings").columns and "m" in spark.read.parquet(f"{tmp_path}/i/docs").columns


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_substrings_of_many_questions_meet_in_no_task(spark):
    q = spark.createDataFrame([(1, "aaaa bb"), (2, ""), (3, "b"), (4, None)], "qid int, text string")
    lex = spark.createDataFrame([("aa", 1), ("bb", 2), ("a bb", 3), ("b" * 40, 4)], "name string, key int")
    got = knowledge.longest_names(q, lex)
    assert sorted(tuple(r) for r in got.select("qid", "name", "rank").collect()) == [(1, "a bb", 1), (1, "aa", 2), (1, "bb", 3)]
    assert not re.search(r"Aggregate \[qid#\d+L?, name#\d+\]", _plan(got))


def test_positions_are_dealt_before_they_are_sorted(spark):
    rows = spark.createDataFrame([(1, None, 2, "a"), (1, None, 3, "a"), (1, "p", 4, "a"), (1, "p", 5, None)], "k int, c string, v bigint, d string")
    got = holdings.aggregate_positions(rows, ["k", "c"], ["v"], {"d": F.lit("MULTIPLE")})
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, None, 5, 2, "a"), (1, "p", 9, 2, "MULTIPLE")]))
    assert "RepartitionByExpression" in _plan(got) and "distinct" not in _plan(got)


def test_postings_are_counted_where_a_text_is_read(spark):
    got = indexing.postings(spark.createDataFrame([(7, "b a b 가나다"), (8, None)], "id int, text string"), "id", "text")
    assert sorted(tuple(r) for r in got.select("term", "uid", "tf", "dl").collect()) == [("a", 7, 1, 5), ("b", 7, 2, 5), ("가나", 7, 1, 5), ("나다", 7, 1, 5)]
    assert "Aggregate" not in _plan(got)
