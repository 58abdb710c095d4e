"""Payload parsers, stores and chunks: literal input, literal result; properties where a table would be too small."""

import datetime as dt
import hashlib
import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import answers, assistant, bundle, catalog, chunking, indexing, knowledge, scoring, search, stored_index
from ledgerloom.sources import payloads as P
from ledgerloom.sources import store
from ledgerloom.streaming import collect

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, payload):
    return spark.createDataFrame([(payload,)], "payload string")


def test_company_facts(spark):
    fact = {"start": "2023-01-01", "end": "2023-12-31", "val": 5.5, "accn": "a1", "form": "10-K", "filed": "2024-02-01"}
    p = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact], "EUR": [fact]}}, "Other": {"units": {"shares": [fact]}}}, "dei": {}}}
    got = P.company_facts(one(spark, json.dumps(p)))
    assert rows(got) == [("Revenues", D(2023, 1, 1), D(2023, 12, 31), 5.5, "a1", "10-K", D(2024, 2, 1))]
    wanted = spark.createDataFrame([("a1", D(2023, 12, 31)), ("a2", D(2023, 12, 31))], "accession string, end date")
    assert sorted(rows(P.fact_lookup(got, ["Sales", "Revenues"], wanted))) == [("a1", D(2023, 12, 31), 5.5), ("a2", D(2023, 12, 31), None)]


def test_fundamentals(spark):
    p = {"timeseries": {"result": [{"meta": {"type": ["quarterlyRevenue"]}, "timestamp": [1], "quarterlyRevenue": [{"asOfDate": "2024-03-31", "currencyCode": "USD", "reportedValue": {"raw": 7.0}}, None]}, {"meta": {"type": ["none"]}}]}}
    assert rows(P.fundamentals(one(spark, json.dumps(p)))) == [("quarterlyRevenue", D(2024, 3, 31), 7.0, "USD")]


def test_ohlc(spark):
    assert rows(P.ohlc_arrays(one(spark, "[[86400000, 1, 2, 0.5, 1.5]]"))) == [(D(1970, 1, 2), 1.0, 2.0, 0.5, 1.5, 0)]


def test_positioning(spark, tmp_path):
    (tmp_path / "p.csv").write_text("market,day,long,short,oi\nES,2024-01-02,5,3,10\nES,2024-01-09,5,3,0\nES,bad,1,1,1\n")
    assert rows(P.positioning_csv(spark, str(tmp_path / "p.csv"))) == [("ES", D(2024, 1, 2), 5, 3, 10)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        head = ",".join(P.POSITIONING.values())
        z.writestr("F.TXT", f"{head}\n13874A ,2024-01-02,200,60,40,10,30\n13874A,2024-01-09,0,1,1,1,1\n13874A,x,1,1,1,1,1\n999,2024-01-02,1,1,1,1,1\n")
    (tmp_path / "z").mkdir()
    (tmp_path / "z/2024.zip").write_bytes(buffer.getvalue())
    assert rows(P.positioning_zips(spark, str(tmp_path / "z"), "13874A")) == [(D(2024, 1, 2), 200.0, 10.0, -10.0)]


def test_constituents(spark):
    page = '<table id="constituents"><tr><th>S</th></tr><tr><td><a>BRK.B</a></td><td>x</td></tr><tr><td>lower</td></tr><tr><td>A</td></tr></table>'
    assert rows(P.constituents(one(spark, page))) == [("BRK-B",), ("A",)]
    with pytest.raises(Exception, match="no table of constituents"):
        P.constituents(one(spark, "<p>")).collect()


def test_feeds_and_channels(spark):
    item = "<item><title><![CDATA[T & t]]></title><link>u</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>"
    got = rows(P.feed_items(one(spark, f"<rss>{item}{item.replace('T &', 'second')}</rss>")))
    assert [(a, b) for a, b, _ in got] == [("u", "T & t")] and got[0][2] == dt.datetime(2024, 1, 2, 3, 4, 5)
    page = '<div data-post="ch/1"><div class="message_text">a<br>b &amp; c</div><time datetime="2024-01-02T03:04:05+00:00"></time>'
    assert rows(P.channel_messages(one(spark, page))) == [("ch/1", "a\nb & c", dt.datetime(2024, 1, 2, 3, 4, 5))]


def test_links(spark):
    html = '<a href="/x/a.pdf?v=1">p</a> "buttonLink":"https://ir.example.com/r" openPDF(\'M_JPN\', \'https://e/j.pdf\') openPDF(\'M\', \'https://e/m.pdf\') <a href="/s20240201a.htm"> <a href="/s20240315a.htm">'
    d = one(spark, html)
    got = d.select(P.pdf_link(F.col("payload")), P.button_link(F.col("payload"), "ir.example.com"), P.original_pdf(F.col("payload")), P.absolute(P.pdf_link(F.col("payload")), "https://b.org/x")).first()
    assert tuple(got) == ("/x/a.pdf", "https://ir.example.com/r", "https://e/m.pdf", "https://b.org/x/a.pdf")
    assert [s.url for s in d.select(P.dated_links(F.col("payload")).alias("x")).first().x] == ["/s20240315a.htm", "/s20240201a.htm"]


def test_index_page(spark):
    card = lambda u, t: f'<a class="c" href="{u}" data-gs-uitk-component="card"><h4 data-gs-uitk-component="card-title">{t}</h4></a>'
    page = card("/a", "One <b>two</b>") + card("/a", "again") + card("/b", "") + card("https://z/c", "C") + '<a href="/d">no card</a>'
    assert sorted(rows(P.index_articles(one(spark, page), P.CARDS).select("url", "title"))) == [("https://www.goldmansachs.com/a", "One two"), ("https://z/c", "C")]


def test_headers_are_yaml(spark):
    md = '---\ntitle: "A: b"\ntags: [x, y]\ndate: 2024-01-02\nok: true\nlong: |\n  one\n  two\nnest:\n  k: [1]\nempty:\n---\nbody'
    df = spark.createDataFrame([("p", md), ("bad", "---\na: [\n---\nx"), ("list", "---\n- a\n---\nx"), ("none", "text")], "path string, payload string")
    (r,) = P.vault_documents(df).collect()
    assert r.body == "body" and r.title == "A: b"
    assert r.meta == {"title": "A: b", "tags": "x|y", "date": "2024-01-02", "ok": "true", "long": "one\ntwo\n", "nest": '{"k": [1]}', "empty": None}


def test_config_is_a_table(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("sources:\n- id: a\n  weight: 2.5\n  more: x\n- id: b\n")
    assert rows(P.config_table(spark, str(tmp_path / "c.yaml"), "sources", "id string, weight double")) == [("a", 2.5), ("b", None)]


def test_documents_are_current(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    make = lambda *r: spark.createDataFrame([(i, "blog", at(0), at(h), c, b) for i, h, c, b in r], "id string, source_type string, published_at timestamp, collected_at timestamp, content_hash string, body string")
    path = f"{tmp_path}/docs"
    store.write_documents(make(("1", 1, "x", "old"), ("2", 1, "y", "same")), path)
    known = store.current_documents(spark, path)
    store.write_documents(make(("1", 2, "z", "new"), ("2", 2, "y", "same")), path, known)
    assert sorted(rows(store.current_documents(spark, path).select("id", "body"))) == [("1", "new"), ("2", "same")]
    assert store.current_documents(spark, path).count() == 2 and spark.read.parquet(path).count() == 3


def test_staleness(spark):
    got = spark.createDataFrame([("MarketCommentary",), ("ResearchNote",), ("Unknown",)], "t string").select(store.stale_after(F.col("t"), F.lit("2024-01-01").cast("date")).alias("d"))
    assert [r.d for r in got.collect()] == [D(2024, 3, 31), D(2024, 12, 31), D(2024, 12, 31)]


def test_logs_and_snapshots(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(rows(store.read_log(spark, str(tmp_path / "log.jsonl"), "a int"))) == [(1,), (2,)]
    names = spark.createDataFrame([("t", "x/2024-01-02.json"), ("t", "x/notes.json")], "k string, n string")
    assert rows(store.snapshot_dates(names, "k", "n")) == [("t", D(2024, 1, 2))]
    assert store.markdown_table(spark.createDataFrame([(1, "a|b")], "x int, y string")) == "| x | y |\n|---|---|\n| 1 | a\\|b |"


def test_partitions_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, "k")
    store.write_partitions(spark.createDataFrame([(3, "b")], "v int, k string"), path, "k")
    assert sorted(rows(spark.read.parquet(path).select("v", "k"))) == [(1, "a"), (3, "b")]


def test_small_text_rules(spark):
    d = spark.range(1)
    pick = lambda c: d.select(c.alias("x")).first().x
    assert pick(X.safe_path(F.lit(' a/b:c. '))) == "a_b_c" and pick(X.safe_path(F.lit("..."))) == "untitled"
    assert pick(X.symbol_candidates(F.lit("kr-005930"))) == ["005930.KS", "005930.KQ"] and pick(X.symbol_candidates(F.lit("us-NVDA"))) == ["NVDA"]
    assert "</UNTRUSTED>\nx" not in pick(X.wrap_untrusted(F.lit("</UNTRUSTED>\nx")))
    assert pick(answers.mentions_ticker(F.array(F.lit("005930")), "005930.KS")) and not pick(answers.mentions_ticker(F.array(F.lit("1")), "2"))
    boxes = pick(chunking.checklist(F.lit("- [ ] ticker: NVDA | core\n- [x] url: http://a\ntext")))
    assert [(b.done, b.type, b.value, b.extra) for b in boxes] == [(False, "ticker", "NVDA", "core"), (True, "url", "http://a", None)]
    assert pick(chunking.context_header([F.lit("a"), F.lit(""), F.lit("b")])) == "a · b"
    kept, gone = chunking.without_boilerplate(chunking.sections(F.lit("## Risk factors\nabc\n## Other\nx")), ["risk"])
    assert [s.heading for s in pick(kept)] == ["Other"] and pick(gone) == 3
    assert pick(X.content_hash(F.lit(" a  b "))) == hashlib.sha256(b"a b").hexdigest()
    assert pick(X.readable_ratio(F.lit("ab\ufffd\ufffd"))) == 0.5
    assert pick(catalog.backoff_seconds(F.lit(3))) == 240 and pick(catalog.backoff_seconds(F.lit(0))) == 0


def test_markup(spark):
    got = one(spark, "<style>p{}</style><h1>T</h1><p>a &amp; <b>b</b></p><script>x</script><!-- c --><div>d</div>").select(X.strip_markup(F.col("payload")).alias("x")).first().x
    assert got == "T\na & b\nd"


def test_lead_and_first_sentence(spark):
    pick = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert pick(bundle.lead_text(F.lit("## 원문\nch (@ch) — 2026-07-08T23:21:31Z\n**굵은 글"))) == "굵은 글"
    assert pick(bundle.first_sentence(F.lit("하나다. 둘이다."))) == "하나다." and pick(bundle.first_sentence(F.lit("x" * 300))) == "x" * 110


def test_aliases(spark):
    lex = spark.createDataFrame([("Nebius Group N.V.", "us-NBIS"), ("Nebius", "us-OTHER"), ("교보증권", "kr-1"), ("A", "x")], "name string, key string")
    got = {r.name: (r.key, r.canonical) for r in knowledge.with_aliases(lex).collect()}
    assert got == {"Nebius Group N.V.": ("us-NBIS", "Nebius Group N.V."), "Nebius": ("us-OTHER", "Nebius"), "교보증권": ("kr-1", "교보증권"), "Nebius Group": ("us-NBIS", "Nebius Group N.V.")}


def test_sampled_questions_repeat(spark):
    d = spark.createDataFrame([(i, f"n{i}" if i % 2 else "", f"title {i // 2}", f"word{i} " * 40) for i in range(20)], "id int, native_id string, title string, text string")
    a, b = (sorted(rows(assistant.sampled_questions(d, 4))) for _ in range(2))
    assert a == b and len(a) == 8 and {k for _, k, *_ in a} == {"identifier", "span"}
    assert all(t in f"word{g} " * 40 for _, k, t, g in a if k == "span")


def test_chunks_keep_every_word():
    rng = random.Random(4)
    for _ in range(300):
        lines = []
        for k in range(rng.randrange(8)):
            if rng.random() < 0.3:
                lines += ["| h | h |", "|--|--|"] + [f"| t{k}x{i} | {'y' * rng.randrange(30)} |" for i in range(rng.randrange(6))] + [""]
            else:
                lines += [" ".join(f"w{k}n{i}{rng.choice(['', '.', '!'])}" for i in range(rng.randrange(60))), ""]
        text, sizes = "\n".join(lines), chunking.Sizes(90, 120, rng.choice([0, 15]))
        got = chunking.chunk_section(text, sizes)
        words = lambda s: [w for w in s.replace("|", " ").split() if w[0] in "wt"]
        have = set(w for _, t in got for w in words(t))
        assert set(words(text)) <= have
        assert all(len(t) <= sizes.target + sizes.most + 2 for k, t in got if k == "prose")
        assert all(t.startswith("| h | h |\n|--|--|") for k, t in got if k == "table")
        # each piece of prose leads with the end of the one before, cut out of the same text
        if not sizes.overlap:
            order = [w for k, t in got if k == "prose" for w in words(t)]
            assert order == [w for w in words(text) if w[0] == "w"]


def test_hash_encode_is_brute_force(spark):
    texts = ["abcd", "ab", "", None, "  aaaa ", "삼성전자 실적", "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", indexing.hash_encode(F.col("t"), 64).alias("v")).collect():
        t, v = (texts[r.i] or "").strip(), np.zeros(64)
        for k in range(max(1, len(t) - 2)) if t else ():
            v[int.from_bytes(hashlib.blake2b(t[k : k + 3].encode(), digest_size=8).digest(), "big") % 64] += 1
        n = np.sqrt((v * v).sum())
        assert np.allclose(r.v, v / n if n else v, atol=1e-6)


def test_packing_is_brute_force(spark):
    rng = random.Random(1)
    items = [(rng.choice("ab"), i, rng.choice([0, 3, 40, 90, 200])) for i in range(80)]
    got = catalog.pack(spark.createDataFrame(items, "s string, i int, n int"), ["s"], "i", "n", 4, 120).collect()
    for s in "ab":
        batch = count = total = 0
        for _, i, n in sorted(x for x in items if x[0] == s):
            if count + 1 > 4 or (total + n > 120 and count):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + n
            assert next(r.batch for r in got if r.i == i) == batch


def test_index_compacts(spark, tmp_path):
    layout = stored_index.Layout("id", buckets=4)
    docs = spark.createDataFrame([(i, f"alpha b{i} {'beta' if i % 3 else ''}") for i in range(40)], "id int, text string")
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    stored_index.build(docs, a, layout)
    stored_index.update(a, layout, spark.createDataFrame([(5, "alpha gamma"), (99, None)], "id int, text string"), spark.createDataFrame([(7,)], "uid int"))
    stored_index.update(a, layout, None, spark.createDataFrame([(8,), (99,)], "uid int"))
    assert stored_index.stats(spark, a)[:2] == (2, 38)
    q = spark.createDataFrame([(1, "beta gamma"), (2, "alpha"), (3, "zz")], "qid int, text string")
    find = lambda p: sorted((r.qid, r.id, round(r.score, 9)) for r in stored_index.search(spark, p, q, layout).collect())
    stored_index.compact(spark, a, b, layout)
    assert find(a) == find(b) and (1, 5) in {r[:2] for r in find(a)} and not {7, 8} & {r[1] for r in find(a)}
    assert stored_index.stats(spark, b)[1:] == stored_index.stats(spark, a)[1:]


def test_index_knows_other_forms(spark, tmp_path):
    layout = stored_index.Layout("id", buckets=2)
    docs = spark.createDataFrame([(1, "ＡＢＣ１２３ corp"), (2, "삼성전자"), (3, "other")], "id int, text string")
    stored_index.build(docs, f"{tmp_path}/i", layout)
    q = spark.createDataFrame([(1, "abc123"), (2, "삼성"), (3, "ＯＴＨＥＲ")], "qid int, text string")
    assert sorted((r.qid, r.id) for r in stored_index.search(spark, f"{tmp_path}/i", q, layout).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_sources_fail_alone():
    told = []

    def ask(s):
        if s == "b":
            raise ValueError("no")
        return 2

    got = collect.run_sources(["a", "b", "c"], ask, told.append)
    assert got == told and [(r.source_id, r.n, r.error) for r in got] == [("a", 2, None), ("b", 0, "ValueError: no"), ("c", 2, None)]


def test_due(spark):
    c = spark.createDataFrame([("a", None), ("b", dt.datetime(2024, 1, 2)), ("c", dt.datetime(2023, 1, 1))], "source_id string, next_retry_at timestamp")
    assert sorted(r.source_id for r in collect.due(c, F.lit("2024-01-01").cast("timestamp")).collect()) == ["a", "c"]


def test_hysteresis_is_a_fold(spark):
    rng, c = random.Random(2), scoring.Hysteresis()
    data = [(t, D(2024, 1, 1) + dt.timedelta(days=i), rng.choice([None, 30.0, 55.0, 72.0, 85.0]), rng.random() < 0.5, rng.random() < 0.1) for t in "ab" for i in range(60)]
    got = {(r.ticker, r.day): (r.signal, r.since) for r in scoring.hysteresis(spark.createDataFrame(data, "ticker string, day date, score double, held boolean, gate boolean")).collect()}
    for t in "ab":
        signal = since = None
        for _, day, score, held, gate in (r for r in data if r[0] == t):
            if score is None:
                implied = None
            elif held:
                implied = "strong_buy_candidate" if score >= c.entry else "hold_watch" if score >= c.reduce else "reduce_review" if score >= c.sell else "sell_review"
            else:
                implied = ("strong_buy_candidate" if score >= 80 else "accumulate_candidate") if score >= c.entry else "hold_watch"
            if gate:
                if implied in ("strong_buy_candidate", "accumulate_candidate"):
                    implied = "hold_watch" if held else None
                signal, since = implied, day
            elif signal is None or (implied != signal and (day - since).days >= c.cooldown):
                signal, since = implied, day
            assert got[t, day] == (signal, since)


def test_payloads_are_whole_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("one\ntwo")
    (tmp_path / "y.txt").write_text("no")
    assert [(p.rsplit("/", 1)[1], t) for p, t in rows(P.read_payloads(spark, str(tmp_path), "*.md"))] == [("x.md", "one\ntwo")]


@pytest.mark.parametrize("block", [5_000, 3])
def test_vector_search_is_brute_force(spark, block):
    rng = random.Random(6)
    vec = lambda d=4: [float(rng.randrange(-2, 3)) for _ in range(d)]
    data = [(f"r{i:03d}", vec()) for i in range(150)] + [("null", None), ("short", vec(3)), ("empty", [])]
    asked = [(i, vec()) for i in range(7)] + [(90, vec(3)), (91, None)]
    got = search.vector_search(spark.createDataFrame(data, "vec_id string, embedding array<float>").repartition(5), spark.createDataFrame(asked, "qid int, embedding array<float>"), 10, block=block)
    want = []
    for q, v in asked:
        near = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in data if v and w and len(w) == len(v))[:10]
        want += [(q, i, -s, n) for n, (s, i) in enumerate(near, 1)]
    assert sorted((r.qid, r.id, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def test_claims_are_spliced(spark):
    body = "lead\n## 핵심 주장\nold\n## Other\nkeep\n## 근거\n## 언급 자산\nx\n"
    claims = [("c1", "bullish", "high", ["e1", "e2"], [], ["NVDA", "AMD"]), ("c2", "bearish", "low", None, [], ["NVDA"])]
    df = spark.createDataFrame([(body, claims), (body, [])], f"body string, claims {answers.CLAIMS}")
    a, b = (r.x for r in df.select(answers.spliced(F.col("body"), F.col("claims")).alias("x")).collect())
    assert a == "lead\n## 핵심 주장\n- c1 (bullish, 확신도: high)\n- c2 (bearish, 확신도: low)\n\n## Other\nkeep\n## 근거\n- e1\n- e2\n\n## 언급 자산\nNVDA, AMD\n\n"
    assert b == "lead\n## 핵심 주장\n(추출된 핵심 주장 없음)\n\n## Other\nkeep\n## 근거\n(근거 없음)\n\n## 언급 자산\n(언급 자산 없음)\n\n"


def test_inbox(spark):
    lines = ["- [ ] sec: NVDA | core", "- [x] sec: OLD", "- [ ] sec: nvda", "- [ ] dart: 005930", "- [ ] what: x", "text", "", "- [ ] sec: TSLA"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, text string")
    known = spark.createDataFrame([("sec", "TSLA")], "type string, key string")
    got = sorted((r.line_no, r.status, r.text) for r in answers.inbox_plan(df, known, ["sec", "dart"]).collect())
    assert got == [
        (1, "added", "- [x] sec: NVDA | core"), (3, "skipped_duplicate", "- [x] sec: nvda"), (4, "added", "- [x] dart: 005930"), (5, "parse_error", "- [ ] what: x"),
        (6, "parse_error", "text"), (8, "skipped_duplicate", "- [x] sec: TSLA"),
    ]


def test_growth_features(spark):
    q = [D(2023, 3, 31), D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 31), D(2024, 3, 31)]
    points = [("A", "operating_cash_flow", d, v) for d, v in zip(q, (100.0, 1.0, 1.0, 1.0, 150.0))]
    points += [("A", "capital_expenditure", d, -v) for d, v in zip(q, (50.0, 1.0, 1.0, 1.0, 40.0))] + [("B", "operating_cash_flow", q[0], 1.0)]
    got = answers.growth_features(spark.createDataFrame(points, "ticker string, concept string, as_of date, value double")).collect()
    assert sorted((r.ticker, r.metric, r.value, r.period) for r in got) == [("A", "capex_growth", -20.0, q[4]), ("A", "free_cash_flow_growth", 120.0, q[4]), ("A", "operating_cash_flow_growth", 50.0, q[4])]


def test_tools_run(spark):
    q = spark.createDataFrame([(1, "13F 알려줘"), (2, "근거가 뭐야"), (3, "접수번호")], "qid int, text string")
    tool = lambda name, ok, n: assistant.Tool(name, name, lambda d: d.select("qid", F.lit(ok).alias("ok"), F.lit(n).alias("n_evidence")))
    ran = assistant.run_tools(q, [tool("holdings", True, 3), tool("catalog", False, 0), tool("documents", True, 2)])
    got = {r.qid: (r.tool, r.ok, r.n_evidence, r.fell_back) for r in assistant.answered(q, ran).collect()}
    assert got == {1: ("holdings", True, 3, False), 2: ("documents", True, 2, False), 3: ("documents", True, 2, True)}
    chunks = spark.createDataFrame([("a", "title", "")], "chunk_uid string, t string, d string")
    assert assistant.metadata_context(["t", "d"])(chunks).first().context == "title"
