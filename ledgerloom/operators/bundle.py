"""Documents to a bundle of typed concepts: descriptions, tags, hubs, folder listings, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import let
from ledgerloom.sources.store import stale_after

# Concept type and folder of a source's documents; the folder's first rows that an index lists.
TYPES = {
    "dart": ("DartFiling", "filings/dart"), "sec_filing": ("SecFiling", "filings/sec"), "sec_13f": ("HoldingsSnapshot", "holdings"),
    "telegram": ("MarketCommentary", "commentary"), "naver": ("BlogPost", "blog"), "ib_insights": ("ResearchNote", "research"),
    "essay": ("Essay", "essays"), "central_bank": ("CentralBankStatement", "central_bank"), "web_search": ("WebSearchResult", "web_search"),
}
LISTED = 200
# Fields a concept must have, and fields of the bundle's own contract.
REQUIRED = ("okf_type",)
CONTRACT = ("title", "description", "published", "okf_status")
PREAMBLE = r"^\s*(?:##\s*원문\s*)?(?:[^\n]*\(@[^\n]*\)\s*—\s*\d{4}-\d{2}-\d{2}T[^\n]*\n|[^\n]*—\s*[^\n]*\(\d{4}-\d{2}-\d{2}[^\n]*\)\s*\n)?"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lead_text(body: Column) -> Column:
    """A body without the line that says where it was taken from, and without marks before its first words."""
    head = F.regexp_extract(_trim(body), PREAMBLE, 0)
    return F.regexp_replace(_trim(F.substring(_trim(body), F.length(head) + 1, F.length(body))), r"^[\[\]\s*#]+", "")


def first_sentence(text: Column, limit: int = 110) -> Column:
    """The first sentence if it ends within limit + 40 characters, else the first limit characters."""
    flat = F.regexp_replace(F.regexp_replace(_trim(text), r"\s+", " "), r"^#+ *", "")

    def cut(t: Column) -> Column:
        near = F.substring(t, 1, limit + 40)
        end = F.length(F.regexp_extract(near, r"(?s)^.*?(?:[.!?。]|다\.)", 0))
        return _trim(F.when(end > 0, F.substring(t, F.lit(1), end)).otherwise(F.substring(t, 1, limit)))

    return let(flat, cut)


def described(doc_type: Column, subject: Column, d: dict[str, Column]) -> Column:
    """One sentence about a document, from its metadata. d: published and reporting_period (dates), filing_type, author,
    title, capture_mode, source_name, body."""
    empty = F.lit("")
    when = F.coalesce(F.date_format(d["published"], "yyyy-MM-dd"), empty)
    who = F.coalesce(subject, d["source_name"])
    cap = F.when(d["capture_mode"] == "full", "").otherwise(" (본문 미확보, 링크만 보유)")
    period = F.date_format(d["reporting_period"], "yyyy-MM-dd")
    kind = F.coalesce(F.nullif(d["filing_type"], empty), F.lit("공시"))
    title = F.coalesce(F.nullif(d["title"], empty), F.lit("제목 없음"))
    basis = F.coalesce(F.concat(F.lit(". 보고 기준일 "), period), empty)
    said = first_sentence(lead_text(d["body"]))
    filed = lambda where, did: F.concat(who, F.lit("가 "), when, F.lit(f" {where}에 {did} "), kind, basis, cap)
    return (
        F.when(doc_type == "DartFiling", filed("DART", "접수한"))
        .when(doc_type == "SecFiling", filed("SEC", "제출한"))
        .when(doc_type == "HoldingsSnapshot", F.concat(who, F.lit("의 "), F.coalesce(period, when), F.lit(" 기준 13F 보유 현황 (제출일 "), when, F.lit(")"), cap))
        .when(doc_type == "MarketCommentary", F.concat(F.lit("텔레그램 채널 "), who, F.lit("의 "), when, F.lit(" 메시지. "), said))
        .when(doc_type == "BlogPost", F.concat(F.coalesce(F.nullif(d["author"], empty), who), F.lit(" 블로그 "), when, F.lit(" 글 「"), title, F.lit("」. "), said))
        .when(doc_type == "ResearchNote", F.concat(who, F.lit("의 "), when, F.lit(" 리서치 「"), title, F.lit("」"), F.when(cap != "", cap).otherwise(F.concat(F.lit(". "), said))))
        .otherwise(F.concat(_trim(F.concat(who, F.lit(", "), when, F.lit(". "), F.coalesce(d["title"], empty))), cap))
    )


def tags(source_type: Column, filing_type: Column, subject_key: Column, language: Column, capture: Column) -> Column:
    """Up to eight distinct tags in order."""
    some = [source_type, *[F.nullif(c, F.lit("")) for c in (filing_type, subject_key, language)], F.when(capture != "full", capture)]
    return F.slice(F.array_distinct(F.array_compact(F.array(*some))), 1, 8)


def concepts(docs: DataFrame) -> DataFrame:
    """Typed concepts of documents (id, source_type, source_name, title, author, published_at, capture_mode, readable_ratio, filing_type,
    reporting_period, language, subject_key, subject, superseded, body), with status, years, description, tags and staleness."""
    types = F.create_map(*[F.lit(x) for k, (t, _) in TYPES.items() for x in (k, t)])
    folders = F.create_map(*[F.lit(x) for k, (_, f) in TYPES.items() for x in (k, f)])
    d = docs.withColumn("okf_type", F.coalesce(F.try_element_at(types, F.col("source_type")), F.lit("Document")))
    published = F.to_date("published_at")
    status = F.when(F.col("readable_ratio") < 0.95, "corrupt").when(F.col("capture_mode") != "full", "stub").when(F.col("superseded"), "superseded").otherwise("stable")
    meta = {c: F.col(c) for c in ("reporting_period", "filing_type", "author", "title", "capture_mode", "source_name")}
    about = described(F.col("okf_type"), F.col("subject"), {**meta, "published": published, "body": F.coalesce("body", F.lit(""))})
    key = F.when(F.col("subject_key").isNotNull(), F.array("subject_key")).otherwise(F.array().cast("array<string>"))
    folder = F.coalesce(F.try_element_at(folders, F.col("source_type")), F.lit("documents"))
    return d.select(
        F.concat_ws("/", folder, F.col("id").cast("string")).alias("id"), "okf_type", status.alias("okf_status"),
        F.coalesce(F.nullif("title", F.lit("")), first_sentence(lead_text(F.coalesce("body", F.lit(""))), 60)).alias("title"), about.alias("description"), key.alias("entity_keys"),
        F.year("reporting_period").cast("string").alias("period_year"), F.year(published).cast("string").alias("pub_year"), published.alias("published"),
        stale_after(F.col("okf_type"), published).alias("stale_after"),
        tags(F.col("source_type"), F.col("filing_type"), F.col("subject_key"), F.col("language"), F.col("capture_mode")).alias("tags"), F.col("id").cast("string").alias("source_id"), "body",
    )


def listing(all_: DataFrame, first: int = LISTED) -> DataFrame:
    """(okf_type, rank, id, title, n): what each type's index page lists, latest first, and how many concepts there are."""
    w = W.partitionBy("okf_type").orderBy(F.col("published").desc_nulls_last(), F.col("id").desc())
    n = all_.groupBy("okf_type").agg(F.count("*").alias("n"))
    clean = F.regexp_replace("title", r"[\[\]]", "")
    top = all_.select("okf_type", "id", clean.alias("title"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= first)
    return top.join(F.broadcast(n), "okf_type")  # a row a type


def write_bundle(all_: DataFrame, path: str) -> None:
    """Concepts by type, and the pages' listings: partitions of the types that are there are replaced whole."""
    all_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("okf_type").parquet(f"{path}/concepts")
    listing(all_).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("okf_type").parquet(f"{path}/index")


def validated(all_: DataFrame, broken: DataFrame, n_links: DataFrame) -> DataFrame:
    """(concepts, types, required_violations, contract_missing, links_total, links_broken, ok): one row.

    broken and n_links: broken and all links (src, target)."""
    gone = lambda names: sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1).otherwise(0) for c in names), F.lit(0))
    one = all_.agg(F.count("*").alias("concepts"), F.count_distinct("okf_type").alias("types"), F.sum(gone(REQUIRED)).alias("required_violations"), F.sum(gone(CONTRACT)).alias("contract_missing"))
    out = one.crossJoin(n_links.agg(F.count("*").alias("links_total"))).crossJoin(broken.agg(F.count("*").alias("links_broken")))  # a row each
    return out.withColumn("ok", (F.col("links_broken") == 0) & (F.col("required_violations") == 0))
