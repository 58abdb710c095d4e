"""Case tables of single operators: literal input, literal result."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import catalog, chunking, holdings, scoring, search, series
from ledgerloom.sources import payloads

D = dt.date


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES(values).items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def TYPES(values):
    return {k: {str: "string", int: "bigint", float: "double", bool: "boolean"}.get(type(v), "string") for k, v in values.items()}


@pytest.mark.parametrize(
    "text,want",
    [
        ("삼성전자의", ["삼성", "성전", "전자", "자의"]),
        ("10-K/A filed", ["10-k/a", "10", "k", "a", "filed"]),
        ("０Ｋ", ["0k"]),
        ("", []),
        ("가", ["가"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.lit(text), nfkc=True)) == want


def test_keep_word(spark):
    assert one(spark, X.tokens(F.lit("투자규모"), keep_word=True)) == ["투자", "자규", "규모", "투자규모"]


@pytest.mark.parametrize("text,want", [("2003년 실적", "2003"), ("FY2024", "2024"), ("2024 Q1", "2024"), ("금액 2024 원", None), ("", None)])
def test_year_slot(spark, text, want):
    assert one(spark, X.year_slot(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("", 1.0), ("abc", 1.0), ("a�bc", 0.75)])
def test_readable(spark, text, want):
    assert one(spark, X.readable_ratio(F.lit(text))) == want


def test_truncation(spark):
    t = "x [...이하 생략, 원문 총 12,345자 중 1,000자까지만 캡처됨"
    assert one(spark, X.original_chars(F.lit(t))) == 12345
    assert one(spark, X.original_chars(F.lit("x"))) is None


def test_bm25_is_that_of_fts5(spark):
    docs = [(i, " ".join("abcdefgh"[(i * k) % 8] * (1 + (i + k) % 2) for k in range(1, 4 + i % 7))) for i in range(40)]
    got = search.bm25(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(0, "a bb hh")], "qid int, text string"))
    got = {r.id: r.score for r in got.collect()}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", [(i + 1, x) for i, x in docs])
    want = dict(con.execute("select rowid - 1, bm25(t) from t where t match '\"a\" OR \"bb\" OR \"hh\"'"))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rrf_ties(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "qid int, id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "qid int, id string, rank int")
    got = [(r.id, r.found_by) for r in search.rrf(a, b, 10).orderBy("rank").collect()]
    assert got == [("y", "both"), ("x", "bm25"), ("z", "vector")]


def test_changes_are_null_safe(spark):
    s = "cusip string, put_call string, value bigint, shares bigint, row_count bigint"
    old = spark.createDataFrame([("a", None, 10, 5, 1), ("b", "Put", 1, 1, 1)], s)
    new = spark.createDataFrame([("a", None, 20, 6, 1), ("a", "Put", 5, 5, 1)], s)
    got = {(r.cusip, r.put_call): (r.change_type, r.weight_pct) for r in holdings.holding_changes(old, new, ["cusip", "put_call"]).collect()}
    assert got == {("a", None): ("increased", 80.0), ("a", "Put"): ("new", 20.0), ("b", "Put"): ("sold_out", None)}


@pytest.mark.parametrize("price,want", [(None, None), (40.0, 100.0), (50.0, 100.0), (75.0, 75.0), (100.0, 50.0), (125.0, 25.0), (160.0, 0.0)])
def test_valuation(spark, price, want):
    n = F.lit(None).cast("double")
    assert one(spark, scoring.valuation_score(F.lit(price).cast("double"), n, F.lit(100.0), n)) == want


def test_weights_renormalise(spark):
    df = spark.createDataFrame([(1, 0.5, 80.0), (1, 0.5, None), (2, 1.0, None)], "k int, w double, p double")
    got = {r.k: (r.score, r.coverage) for r in scoring.weighted(df, ["k"], "w", "p").collect()}
    assert got == {1: (80.0, 0.5), 2: (None, 0.0)}


@pytest.mark.parametrize("cooling,hot,credit,want", [(70.0, 0.0, True, "STRESS"), (69.5, 0.0, True, "NEUTRAL"), (60.0, 10.0, True, "COOLING"), (10.0, 80.0, False, "OVERHEATED"), (10.0, 10.0, False, "NEUTRAL"), (None, 1.0, False, "INDETERMINATE")])
def test_regime(spark, cooling, hot, credit, want):
    c = scoring.market_regime(F.lit(cooling).cast("double"), F.lit(hot), F.lit(0.9), F.lit(credit), F.lit(True), F.lit(False), F.lit(False))
    assert one(spark, c) == want


def test_hysteresis_waits(spark):
    day = [D(2024, 1, d) for d in (1, 2, 8, 9)]
    rows = [("t", d, s, False, g) for d, s, g in zip(day, (75.0, 50.0, 50.0, 85.0), (False, False, False, True))]
    got = scoring.hysteresis(spark.createDataFrame(rows, "ticker string, day date, score double, held boolean, gate boolean"))
    assert [(r.signal, r.since) for r in got.orderBy("day").collect()] == [
        ("accumulate_candidate", day[0]), ("accumulate_candidate", day[0]), ("hold_watch", day[2]), (None, day[3]),
    ]


def test_signal_gap_starts_anew(spark):
    rows = [("i", D(2024, 1, d), True) for d in (1, 2, 4)]
    got = scoring.signal_status(spark.createDataFrame(rows, "i string, day date, fired boolean"), "i", "day", "fired")
    assert [r.status for r in got.orderBy("day").collect()] == ["watch", "confirmed", "watch"]


def test_table_keeps_header():
    t = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(10))
    pieces = chunking.table_texts(t, 150)
    assert len(pieces) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in pieces)
    assert sum(p.count("\n") - 1 for p in pieces) == 10


def test_prose_overlaps():
    pieces = chunking.sentence_texts("One two. " * 60, 100, 20)
    assert all(len(p) <= 121 for p in pieces)
    assert all(b.startswith(a[-20:]) for a, b in zip(pieces, pieces[1:]))


def test_chunks(spark):
    body = "lead text\n## Head\npara one\n\n| a | b |\n|--|--|\n| 1 | 2 |\n\nafter"
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id int, body string")
    got = chunking.chunk_documents(df, "doc_id", F.col("body"), F.lit("the title"))
    got = [(r.doc_id, r.ord, r.heading, r.kind, r.text) for r in got.orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 0, "", "prose", "lead text"), (1, 1, "Head", "prose", "para one"), (1, 2, "Head", "table", "| a | b |\n|--|--|\n| 1 | 2 |"),
        (1, 3, "Head", "prose", "after"), (2, 0, "", "metadata", "the title"), (3, 0, "", "metadata", "the title"),
    ]


def test_incremental_is_full(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, p string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, p string")
    plan = {r.k: r.action for r in catalog.diff_plan(new, old, "k", "p").collect()}
    assert plan == {1: "remove", 2: "keep", 3: "update", 4: "add"}
    touched = new.where(F.col("k").isin([k for k, a in plan.items() if a in ("add", "update")]))
    kept = old.where(~F.col("k").isin([k for k, a in plan.items() if a == "remove"]))
    assert sorted(catalog.upsert(kept, touched, ["k"]).collect()) == sorted(new.collect())


def test_append_is_idempotent(spark):
    s = "k string, value double, at int"
    log = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2)], s)
    new = spark.createDataFrame([("a", 2.0, 3), ("b", None, 3)], s)
    got = catalog.idempotent_append(log, new, ["k"], ["value"], "at").collect()
    assert [(r.k, r.value, r.is_revised) for r in got] == [("b", None, None)]
    changed = catalog.idempotent_append(log, spark.createDataFrame([("a", 5.0, 4)], s), ["k"], ["value"], "at").collect()
    assert [(r.k, r.is_revised) for r in changed] == [("a", True)]


def test_fred_missing(spark):
    df = spark.createDataFrame([('{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-01-02","value":"1.5"},{"date":"x","value":null}]}',)], "payload string")
    assert [(r.date, r.value) for r in payloads.fred_series(df).collect()] == [(D(2024, 1, 1), None), (D(2024, 1, 2), 1.5), (None, None)]


def test_disclosure_status(spark):
    ok = '{"status":"000","list":[{"corp_code":"1","corp_name":"n","stock_code":" ","report_nm":"사업보고서 (2023.12)","rcept_no":"9","flr_nm":"f","rcept_dt":"20240320"}]}'
    got = payloads.disclosure_list(spark.createDataFrame([(ok,), ('{"status":"013"}',)], "payload string")).collect()
    assert [(r.filed, r.kind, r.fiscal_year, r.stock_code) for r in got] == [(D(2024, 3, 20), "annual", "2023", None)]
    with pytest.raises(Exception, match="disclosure list"):
        payloads.disclosure_list(spark.createDataFrame([('{"status":"020","message":"no"}',)], "payload string")).collect()


def test_information_table_must_have_rows(spark):
    df = spark.createDataFrame([("<x/>", D(2024, 1, 1))], "payload string, filed date")
    with pytest.raises(Exception, match="no information table"):
        payloads.information_table(df).collect()


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("가나".encode("cp949")),), (bytearray("가나".encode()),), (None,)], "b binary")
    assert [r.t for r in df.select(payloads.decode_document(F.col("b")).alias("t")).collect()] == ["가나", "가나", None]


def test_vault_document(spark):
    md = "---\ntitle: 'A: b'\ntags:\n- x\n- y\n---\nlead\n## One\ntext"
    df = spark.createDataFrame([("p", md), ("q", "no header")], "path string, payload string")
    (r,) = payloads.vault_documents(df).collect()
    assert r.title == "A: b" and r.meta["tags"] == "x|y"
    assert [(s.heading, s.text) for s in r.sections] == [("", "lead"), ("One", "text")]


def test_nearest_prefers_earlier(spark):
    l = spark.createDataFrame([("k", D(2024, 1, 10))], "k string, t date")
    r = spark.createDataFrame([("k", D(2024, 1, 12), 2.0), ("k", D(2024, 1, 8), 1.0), ("k", D(2024, 2, 1), 9.0)], "k string, d date, v double")
    assert series.nearest_within(l, r, ["k"], "t", "d", "v", 10).first()["nearest_value"] == 1.0


def test_mentions_of_whole_texts(spark):
    from ledgerloom.operators import knowledge

    text = "word " * 2000 + " ".join(f"name{i:03d}" for i in range(30))
    lexicon = spark.createDataFrame([(f"name{i:03d}", i) for i in range(30)], "name string, key int")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    count = lambda **k: knowledge.mentions(docs, lexicon, "doc_id", F.col("text"), **k).count()
    assert (count(), count(chars=None), count(chars=None, limit=None)) == (0, 20, 30)
