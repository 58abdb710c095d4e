"""Entities, links and question routing over tables of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Endings of names of research houses; words that send a question to a tool, in order; beginnings that need no search.
HOUSE = r"(증권|투자증권|자산운용|캐피탈|금융투자)$"
ROUTES = (
    ("holdings", r"13F|보유\s*(현황|종목|규모)|편입\s*종목|포트폴리오\s*(비중|상위|편입)|집중도|쏠림|최대\s*비중"),
    ("catalog", r"접수번호|공시번호|accession|제출\s*(일|시점|했나|됐나)|언제\s*(제출|접수|냈)"),
    ("graph", r"또\s*무엇을?\s*언급|함께\s*언급|같이\s*언급|관련\s*종목|연관\s*종목|어떤\s*종목.*(함께|같이)"),
)
GREETING = r"^\s*(?:안녕|반갑|반가워|고마|감사|잘\s*지|수고|ㅎㅇ|ㄱㅅ)|(?i)^\s*(?:hi|hello|hey|thanks?|thank you|ok|okay)(?![\p{L}\p{N}_])|^\s*$"


def route(question: Column) -> Column:
    """skip for a greeting or an empty question, else the first tool whose words it holds, else documents."""
    out = F.when(F.coalesce(question, F.lit("")).rlike(GREETING), "skip")
    for name, pattern in ROUTES:
        out = out.when(question.rlike(pattern), name)
    return out.otherwise("documents")


def with_aliases(lexicon: DataFrame) -> DataFrame:
    """(name, key, canonical): names of two characters or more, and for a name of several Latin words its first two and its
    first, if of four characters or more and no name themselves; of one alias of several names, the least name's."""
    names = lexicon.where(F.length("name") >= 2).groupBy("name").agg(F.min("key").alias("key")).withColumn("canonical", F.col("name"))
    words = F.regexp_extract_all("name", F.lit(r"[A-Za-z][A-Za-z0-9&.\-]*"), F.lit(0))
    short = names.withColumn("w", words).select("key", "canonical", F.explode(F.array(*[
        F.when(F.size("w") > n, F.array_join(F.slice("w", 1, n), " ")) for n in (2, 1)
    ])).alias("name")).where(F.length("name") >= 4)
    short = short.groupBy("name").agg(F.min(F.struct("canonical", "key")).alias("m")).select("name", "m.key", "m.canonical")
    return names.unionByName(short.join(names.select("name"), "name", "left_anti"))


def mentions(docs: DataFrame, lexicon: DataFrame, id_col: str, text: Column, limit: int | None = 20, chars: int | None = 8000) -> DataFrame:
    """(id, key, pos): names of the lexicon (name, key) among runs of 4 to 20 letters of a document's first
    characters, a run also without its last one or two; the first `limit` keys by place. None of chars or limit: all.

    Runs become rows and meet the lexicon by equality, so the cost is that of a hash join, whatever
    the lexicon's size; no document is compared with every name.
    """
    part = text if chars is None else F.substring(text, 1, chars)
    runs = F.regexp_extract_all(part, F.lit(r"[0-9A-Za-z가-힣]{4,20}"), F.lit(0))
    d = docs.select(F.col(id_col).alias("id"), F.posexplode(runs).alias("pos", "run"))
    n = F.length("run")
    tries = F.array_distinct(F.array(F.col("run"), F.substring(F.col("run"), F.lit(1), F.greatest(n - 1, F.lit(3))), F.substring(F.col("run"), F.lit(1), F.greatest(n - 2, F.lit(3)))))
    t = d.select("id", "pos", F.posexplode(tries).alias("cut", "name")).join(lexicon.select("name", "key"), "name")
    first = t.groupBy("id", "key").agg(F.min("pos").alias("pos"))
    if limit is None:
        return first
    w = W.partitionBy("id").orderBy("pos", "key")
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def houses_apart(found: DataFrame, name: str) -> DataFrame:
    """Adds is_house: the name ends as a research house's does."""
    return found.withColumn("is_house", F.col(name).rlike(HOUSE))


def longest_names(questions: DataFrame, lexicon: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, key, name, rank): names contained in a question, longest first, each key once.

    Questions are short, so every substring of a length that the lexicon's names have is probed by equality, once a question: repeats
    go where they are made, no task holds the substrings of many questions."""
    lens = lexicon.agg(F.array_sort(F.collect_set(F.length("name"))).alias("lens"))  # a row of as many numbers as names have lengths
    q = questions.select(F.col(qid).alias("qid"), F.col(text).alias("t")).join(F.broadcast(lens))
    fits = F.filter("lens", lambda n: (n > 0) & (n <= F.length("t")))
    each = F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring("t", i, n)))
    subs = q.select("qid", F.explode(F.array_distinct(F.flatten(each))).alias("name"))
    hit = subs.join(lexicon.select("name", "key"), "name")
    best = hit.groupBy("qid", "key").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))
    w = W.partitionBy("qid").orderBy(F.length("name").desc(), "name")
    return best.withColumn("rank", F.row_number().over(w))


def two_hop(rows: DataFrame, entity: Column, latest: int = 300, distinct_docs: bool = False) -> DataFrame:
    """(entity, n): entities beside one in its channels' latest rows. rows (uid, doc_id, channel, entities, published)."""
    channels = rows.where(F.array_contains("entities", entity)).select("channel").distinct()
    near = rows.join(channels, "channel", "left_semi").orderBy(F.col("published").desc(), "uid").limit(latest)
    each = near.select("doc_id", "uid", F.explode(F.array_distinct("entities")).alias("entity")).where(F.col("entity") != entity)
    return each.groupBy("entity").agg((F.count_distinct("doc_id") if distinct_docs else F.count("*")).alias("n"))


def links(concepts: DataFrame, id_col: str, body: str) -> DataFrame:
    """(src, target) of markdown links between concepts."""
    t = F.regexp_extract_all(body, F.lit(r"\]\(/?([^)#\s]+?)(?:\.md)?\)"), F.lit(1))
    return concepts.select(F.col(id_col).alias("src"), F.explode(t).alias("target"))


def broken_links(concepts: DataFrame, id_col: str, body: str) -> DataFrame:
    return links(concepts, id_col, body).join(concepts.select(F.col(id_col).alias("target")), "target", "left_anti")


def filing_lookup(filings: DataFrame, entity: str, year: str | None, types: list[str], n: int = 5) -> DataFrame:
    cond = F.col("entity") == entity
    if year:
        cond &= (F.col("year") == year) | F.col("title").contains(f"({year}.")
    if types:
        cond &= F.exists(F.array(*[F.lit(t) for t in types]), lambda t: F.col("filing_type").contains(t))
    return filings.where(cond).orderBy(F.col("published").desc(), "id").limit(n)


def citable(hits: DataFrame) -> DataFrame:
    """Adds citable and, per question, sufficient: some evidence is neither corrupt nor a stub."""
    ok = ~F.coalesce(F.col("okf_status"), F.lit("")).isin("corrupt", "stub")
    h = hits.withColumn("citable", ok)
    return h.withColumn("sufficient", F.max(F.col("citable").cast("int")).over(W.partitionBy("qid")) == 1)


def fallback_key(rows: DataFrame, table: DataFrame, out: str = "corp_code") -> DataFrame:
    """rows (stock_code, name) with the code found by stock code, else by name."""
    by_code = table.where("stock_code IS NOT NULL").groupBy("stock_code").agg(F.min("corp_code").alias("_c"))
    by_name = table.groupBy("name").agg(F.min("corp_code").alias("_n"))
    j = rows.join(by_code, "stock_code", "left").join(by_name, "name", "left")
    return j.withColumn(out, F.coalesce("_c", "_n")).drop("_c", "_n")


def concept_hubs(docs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(hub, type, documents): one hub per distinct value of each key column, type by column."""
    each = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("hub")) for c, t in keys.items()])
    e = docs.select(F.explode(each).alias("h")).where("h.hub IS NOT NULL")
    return e.groupBy("h.hub", "h.type").agg(F.count("*").alias("documents"))
