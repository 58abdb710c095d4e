"""Recorded payloads of filings, prices and facts to rows.

All are native: a payload column is parsed with a declared schema (nothing is inferred), parallel
arrays are zipped and exploded. Files are read whole, one payload a row, so a file is never split in mid-record.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.holdings import value_unit

try:
    import yaml
except ImportError:  # headers are then read natively, configuration is not
    yaml = None


def read_payloads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, payload): whole text files under a folder, however deep."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def _inline(arrays: dict[str, Column]) -> Column:
    return F.arrays_zip(*[v.alias(k) for k, v in arrays.items()])


SUBMISSIONS = (
    "struct<filings:struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,"
    "form:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>,items:array<string>>>>"
)


def submissions(df: DataFrame, forms: tuple[str, ...] = ("13F-HR",), payload: str = "payload") -> DataFrame:
    """Filings of the wanted forms: accession, form, filed, period (null if blank), document, items."""
    r = df.withColumn("_r", F.from_json(payload, SUBMISSIONS)["filings"]["recent"])
    names = ["accessionNumber", "filingDate", "reportDate", "form", "primaryDocument", "items"]
    z = F.arrays_zip(*[F.col(f"_r.{n}") for n in names])
    e = r.select(*[c for c in df.columns if c != payload], F.explode(z).alias("f")).where(F.col("f.form").isin(*forms))
    day = lambda c: F.nullif(c, F.lit("")).try_cast("date")
    return e.select(
        *[c for c in df.columns if c != payload], F.col("f.accessionNumber").alias("accession"), "f.form", day(F.col("f.filingDate")).alias("filed"),
        day(F.col("f.reportDate")).alias("period"), F.col("f.primaryDocument").alias("document"),
        F.filter(F.split(F.coalesce(F.col("f.items"), F.lit("")), r"\s*,\s*"), lambda x: x != "").alias("items"),
    )


def information_table(df: DataFrame, payload: str = "payload", filed: str = "filed") -> DataFrame:
    """Holding rows of information-table XML, whatever its namespace prefix; values in dollars. A payload without
    a table, or a row without its issuer, security id or value, is an error."""
    keep = [c for c in df.columns if c != payload]
    plain = F.regexp_replace(F.regexp_replace(F.col(payload), r"(</?)\w+:", "$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = F.regexp_extract_all(plain, F.lit(r"(?s)<infoTable>(.*?)</infoTable>"), F.lit(1))
    rows = F.when(plain.contains("<informationTable"), rows).otherwise(F.raise_error(F.lit("no information table")).cast("array<string>"))
    e = df.select(*keep, F.explode(rows).alias("x"))

    def tag(name: str, must: bool = False) -> Column:
        got = F.nullif(F.trim(F.regexp_extract("x", rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            got = F.replace(got, F.lit(entity), F.lit(char))
        return F.coalesce(got, F.raise_error(F.lit(f"row without {name}")).cast("string")) if must else got

    return e.select(
        *keep, tag("nameOfIssuer", True).alias("issuer"), tag("titleOfClass").alias("title_of_class"), tag("cusip", True).alias("cusip"),
        (tag("value", True).cast("bigint") * value_unit(F.col(filed))).alias("value_usd"), tag("sshPrnamt").try_cast("bigint").alias("shares"),
        tag("sshPrnamtType").alias("shares_type"), tag("putCall").alias("put_call"), tag("investmentDiscretion").alias("investment_discretion"),
        tag("otherManager").alias("other_manager"), *[F.coalesce(tag(t).try_cast("bigint"), F.lit(0)).alias(f"voting_{t.lower()}") for t in ("Sole", "Shared", "None")],
    )


DISCLOSURES = (
    "struct<status:string,message:string,list:array<struct<corp_code:string,corp_name:string,stock_code:string,report_nm:string,rcept_no:string,flr_nm:string,rcept_dt:string>>>"
)


def disclosure_list(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of a disclosure list; status 013 is an empty one, any other than 000 an error."""
    r = df.select(F.from_json(payload, DISCLOSURES).alias("r"))
    rows = (
        F.when(F.col("r.status") == "000", F.col("r.list")).when(F.col("r.status") == "013", F.array().cast("array<struct<corp_code:string,corp_name:string,stock_code:string,report_nm:string,rcept_no:string,flr_nm:string,rcept_dt:string>>"))
        .otherwise(F.raise_error(F.concat_ws(" ", F.lit("disclosure list:"), "r.status", "r.message")).cast("array<struct<corp_code:string,corp_name:string,stock_code:string,report_nm:string,rcept_no:string,flr_nm:string,rcept_dt:string>>"))
    )
    e = r.select(F.explode(rows).alias("x")).select("x.*")
    return e.withColumns({
        "filed": F.try_to_date("rcept_dt", "yyyyMMdd"), "stock_code": F.nullif(F.trim("stock_code"), F.lit("")), "kind": X.filing_kind(F.col("report_nm")),
        "fiscal_year": F.nullif(F.regexp_extract("report_nm", r"\((\d{4})\.\d{2}\)", 1), F.lit("")),
    })


FACTS = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>>"


def company_facts(df: DataFrame, taxonomy: str = "us-gaap", payload: str = "payload") -> DataFrame:
    """Dollar facts in long form (concept, start, end, value, accession, form, filed)."""
    concepts = F.try_element_at(F.from_json(payload, FACTS)["facts"], F.lit(taxonomy))
    keep = [c for c in df.columns if c != payload]
    e = df.select(*keep, F.explode(concepts).alias("concept", "c"))
    e = e.select(*keep, "concept", F.explode(F.try_element_at(F.col("c.units"), F.lit("USD"))).alias("f"))
    return e.select(
        *keep, "concept", F.col("f.start").try_cast("date").alias("start"), F.col("f.end").try_cast("date").alias("end"), F.col("f.val").alias("value"),
        F.col("f.accn").alias("accession"), "f.form", F.col("f.filed").try_cast("date").alias("filed"),
    )


def fact_lookup(facts: DataFrame, aliases: list[str], wanted: DataFrame) -> DataFrame:
    """For each (accession, end) of wanted the value of the first alias that has one."""
    order = F.create_map(*[F.lit(x) for i, a in enumerate(aliases) for x in (a, i)])
    f = facts.where(F.col("concept").isin(*aliases)).withColumn("_p", F.try_element_at(order, F.col("concept")))
    best = f.groupBy("accession", "end").agg(F.min_by("value", "_p").alias("value"))
    return wanted.join(best, ["accession", "end"], "left")


CHART = (
    "struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>>"
)


def corp_codes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(corp_code, corp_name, stock_code or null, modify_date) of a corporation-code file's XML; missing parts are empty."""
    items = F.explode(F.regexp_extract_all(payload, F.lit(r"(?s)<list>(.*?)</list>"), F.lit(1)))
    part = lambda tag: unescape_xml(F.trim(F.regexp_extract("x", rf"(?s)<{tag}>(.*?)</{tag}>", 1)))
    rows = df.select(*[c for c in df.columns if c != payload], items.alias("x"))
    out = {t: part(t) for t in ("corp_code", "corp_name", "stock_code", "modify_date")}
    return rows.withColumns(out).withColumn("stock_code", F.nullif("stock_code", F.lit(""))).drop("x")


def unescape_xml(text: Column) -> Column:
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def price_chart(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars of a chart payload; a bar without a price is dropped, a missing volume is 0."""
    keep = [c for c in df.columns if c != payload]
    r = df.select(*keep, F.get(F.from_json(payload, CHART)["chart"]["result"], 0).alias("r"))
    q = F.get(F.col("r.indicators.quote"), 0)
    z = F.arrays_zip(F.col("r.timestamp").alias("ts"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    e = r.select(*keep, F.explode(z).alias("b")).select(*keep, F.to_date(F.timestamp_seconds("b.ts")).alias("date"), "b.open", "b.high", "b.low", "b.close", F.coalesce("b.volume", F.lit(0)).alias("volume"))
    return e.dropna(subset=["open", "high", "low", "close"])


def ohlc_arrays(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars of [[milliseconds, open, high, low, close], ...]; volume 0."""
    keep = [c for c in df.columns if c != payload]
    e = df.select(*keep, F.explode(F.from_json(payload, "array<array<double>>")).alias("a"))
    return e.select(*keep, F.to_date(F.timestamp_millis(F.get("a", 0).cast("bigint"))).alias("date"), *[F.get("a", i).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)], F.lit(0).cast("bigint").alias("volume"))


def fred_series(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(date, value): '.', '' and null are missing."""
    keep = [c for c in df.columns if c != payload]
    o = F.from_json(payload, "struct<observations:array<struct<date:string,value:string>>>")["observations"]
    e = df.select(*keep, F.explode(o).alias("o"))
    return e.select(*keep, F.col("o.date").try_cast("date").alias("date"), F.when(~F.col("o.value").isin(".", ""), F.col("o.value").try_cast("double")).alias("value"))


def fundamentals(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(concept, as_of, value, currency) of a time-series payload whose field names are the concepts."""
    keep = [c for c in df.columns if c != payload]
    results = F.from_json(F.get_json_object(payload, "$.timeseries.result"), "array<map<string,string>>")
    e = df.select(*keep, F.explode(results).alias("m"))
    concept = F.get(F.from_json(F.try_element_at("m", F.lit("meta")), "struct<type:array<string>>")["type"], 0)
    e = e.withColumn("concept", concept)
    points = F.from_json(F.try_element_at("m", F.col("concept")), "array<struct<asOfDate:string,currencyCode:string,reportedValue:struct<raw:double>>>")
    p = e.select(*keep, "concept", F.explode(points).alias("p")).where("p IS NOT NULL")
    return p.select(*keep, "concept", F.col("p.asOfDate").try_cast("date").alias("as_of"), F.col("p.reportedValue.raw").alias("value"), F.col("p.currencyCode").alias("currency"))


def positioning_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of positioning reports; a row that does not parse or has no open interest is left out."""
    r = spark.read.option("header", True).schema("market string, day string, long string, short string, oi string").csv(path)
    n = {c: F.col(c).try_cast("bigint") for c in ("long", "short", "oi")}
    return r.select("market", F.col("day").try_cast("date").alias("day"), *[v.alias(k) for k, v in n.items()]).where("oi > 0 AND long IS NOT NULL AND short IS NOT NULL AND day IS NOT NULL")


def constituents(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Symbols of the first column of the table of constituents; '.' becomes '-'."""
    table = F.regexp_extract(payload, r"(?is)<table[^>]*\bid=[\"']constituents[\"'][^>]*>(.*?)</table>", 1)
    checked = F.when(table != "", table).otherwise(F.raise_error(F.lit("no table of constituents")).cast("string"))
    rows = F.regexp_extract_all(checked, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    s = df.select(F.explode(rows).alias("c")).select(F.replace(F.trim(F.regexp_replace("c", "<[^>]+>", "")), F.lit("."), F.lit("-")).alias("symbol"))
    return s.where(F.col("symbol").rlike(r"^[A-Z][A-Z0-9\-]{0,6}$"))


def feed_items(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(link, title, published) of RSS, links once, the first kept."""
    items = F.regexp_extract_all(payload, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    e = df.select(F.posexplode(items).alias("pos", "x"))

    def tag(n: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    e = e.select("pos", tag("link").alias("link"), tag("title").alias("title"), F.try_to_timestamp(F.regexp_replace(tag("pubDate"), r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"))
    return e.groupBy("link").agg(F.min_by(F.struct("title", "published"), "pos").alias("i")).select("link", "i.*")


def channel_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(post, text, at) of a channel's preview page."""
    posts = F.regexp_extract_all(payload, F.lit(r"(?s)data-post=\"([^\"]+)\"(.*?)(?=data-post=|$)"), F.lit(0))
    e = df.select(F.explode(posts).alias("x"))
    return e.select(
        F.regexp_extract("x", 'data-post="([^"]+)"', 1).alias("post"), X.strip_markup(F.regexp_extract("x", r'(?s)message_text[^>]*>(.*?)</div>', 1)).alias("text"),
        F.try_to_timestamp(F.regexp_extract("x", r'datetime="([^"]+)"', 1)).alias("at"),
    )


def pdf_link(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)href=[\"']([^\"']+\.pdf)(?:[?#][^\"']*)?[\"']", 1), F.lit(""))


def dated_links(html: Column, pattern: str = r'href="([^"]*?(20\d{2})(\d{2})(\d{2})[^"]*)"') -> Column:
    """array<struct<url, day>>: links that carry a date in their name, distinct, latest first."""
    urls = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))

    def of(u: Column) -> Column:
        d = F.regexp_extract(u, r"(20\d{6})", 1)
        return F.struct(F.try_to_date(d, "yyyyMMdd").alias("day"), u.alias("url"))

    return F.sort_array(F.filter(F.transform(urls, of), lambda s: s["day"].isNotNull()), asc=False)


def decode_document(raw: Column) -> Column:
    """Text of document bytes: the first of UTF-8, CP949 and UTF-16 that decodes without error; else UTF-8
    with what is wrong replaced. A zip holds the document as its first .xml member."""
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            b = bytes(b)
            if b[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(b)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".xml")] or z.namelist()
                    b = z.read(names[0])
            declared = re.search(rb"encoding=[\"']([A-Za-z0-9_\-]+)", b[:200])
            for name in ([declared[1].decode()] if declared else []) + ["utf-8", "cp949", "utf-16"]:
                try:
                    return b.decode(name)
                except (UnicodeDecodeError, LookupError):
                    continue
            return b.decode("utf-8", "replace")

        return s.map(one)

    return decode(raw)


def header_map(head: Column) -> Column:
    """map<string, string> of a YAML header: lists as values joined by |, nested mappings as JSON, dates as ISO; null where it is
    no YAML mapping. Without PyYAML, `key: value` lines and `- item` lists are read natively."""
    if yaml is None:
        folded = F.regexp_replace(F.regexp_replace(head, r"\n\s*-\s+", "|"), r":\s*\|", ": ")
        lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
        key = lambda x: F.trim(F.substring_index(x, ":", 1))
        value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']|[\"']$", "")
        return F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x), value(x))))

    def plain(v) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, list) and not any(isinstance(x, (list, dict)) for x in v):
            return "|".join("" if x is None else plain(x) for x in v)
        if isinstance(v, (list, dict)):
            return json.dumps(v, ensure_ascii=False, default=str)
        return str(v).lower() if isinstance(v, bool) else v.isoformat() if hasattr(v, "isoformat") else str(v)

    @F.pandas_udf("map<string,string>")
    def parse(heads: pd.Series) -> pd.Series:
        def one(h: str | None):
            try:
                got = yaml.load(h, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if h else None
            except yaml.YAMLError:
                return None
            return {str(k): plain(v) for k, v in got.items()} if isinstance(got, dict) else None

        return heads.map(one)

    return parse(head)


def vault_documents(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(path, meta map, title, body, sections) of markdown with a YAML header between --- lines; a document without one, or
    with one that does not parse, is dropped."""
    from ledgerloom.operators.chunking import sections

    head = F.regexp_extract(payload, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    body = F.regexp_replace(payload, r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    d = df.where(head != "").select(*[c for c in df.columns if c != payload], header_map(head).alias("meta"), body.alias("body"))
    return d.where("meta IS NOT NULL").withColumn("title", F.try_element_at("meta", F.lit("title"))).withColumn("sections", sections(F.col("body")))


def config_table(spark: SparkSession, path: str, root: str, schema: str) -> DataFrame:
    """The list under `root` of a YAML file as a table; keys that are not declared are left out, missing ones are null.

    A file of configuration is small: it is read on the driver, by Spark's reader, from any store."""
    from pyspark.sql.types import StructType

    if yaml is None:
        raise ImportError("reading YAML configuration needs PyYAML")
    (text,) = [r.payload for r in read_payloads(spark, path).collect()]
    fields = StructType.fromDDL(schema).fieldNames()
    rows = (yaml.safe_load(text) or {}).get(root) or []
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


# Columns of the published positioning reports.
POSITIONING = {
    "code": "CFTC_Contract_Market_Code", "day": "Report_Date_as_YYYY-MM-DD", "oi": "Open_Interest_All",
    "manager_long": "Asset_Mgr_Positions_Long_All", "manager_short": "Asset_Mgr_Positions_Short_All",
    "leveraged_long": "Lev_Money_Positions_Long_All", "leveraged_short": "Lev_Money_Positions_Short_All",
}


def positioning_zips(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(day, oi, manager_net_pct, leveraged_net_pct) of one contract from yearly zip files of reports: net positions in percent of
    the open interest. Rows that do not parse or have no open interest are left out. A file is a row: a year is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".txt")]
                    table = z.read(names[0]).decode("utf-8", "replace") if names else ""
                rows = [{k: (r.get(c) or "").strip() for k, c in POSITIONING.items()} for r in csv.DictReader(io.StringIO(table))]
                mine = [r for r in rows if r["code"] == code]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in mine], pa.string()) for k in POSITIONING], list(POSITIONING))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    r = files.select("content").mapInArrow(run, ", ".join(f"{k} string" for k in POSITIONING))
    number = {k: F.col(k).try_cast("double") for k in POSITIONING if k not in ("code", "day")}
    r = r.select(F.col("day").try_cast("date").alias("day"), *[v.alias(k) for k, v in number.items()]).dropna().where("oi <> 0")
    net = lambda side: ((F.col(f"{side}_long") - F.col(f"{side}_short")) / F.col("oi") * 100).alias(f"{side}_net_pct")
    return r.select("day", "oi", net("manager"), net("leveraged"))


def absolute(url: Column, base: str) -> Column:
    """A link against its page's site."""
    site = re.match(r"https?://[^/]+", base)[0]
    return F.when(url.rlike(r"^https?://"), url).when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(F.startswith(url, F.lit("/")), F.concat(F.lit(site), url)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), url))


def button_link(html: Column, host: str) -> Column:
    """The link of a button in a page's embedded JSON that leads to a host; null without one."""
    return F.nullif(F.regexp_extract(html, rf'"buttonLink":"(https://{re.escape(host)}/[^"]+)"', 1), F.lit(""))


def original_pdf(html: Column) -> Column:
    """Of labelled files that a page opens, the first whose label names no translation."""
    call = r"openPDF\('([^']*)',\s*'(https://[^']*\.pdf[^']*)'\)"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(call), F.lit(1)).alias("label"), F.regexp_extract_all(html, F.lit(call), F.lit(2)).alias("url"))
    return F.get(F.filter(pairs, lambda p: ~p["label"].rlike(r"_(JPN|KRN|SC|TC)$")), F.lit(0))["url"]


@dataclass(frozen=True)
class IndexPage:
    """How a site's index lists articles: a pattern of a card (group 1 its link, group 2 its inside), one of the title in it, and of
    parts it may have: summary, date (read by `date_format`)."""

    card: str
    title: str
    base: str
    summary: str | None = None
    date: str | None = None
    date_format: str = "MMMM d, yyyy"


#: Cards are links with a marked heading.
CARDS = IndexPage(r'(?s)<a\b(?=[^>]*data-gs-uitk-component="card")[^>]*?href="([^"]+)"[^>]*>(.*?)</a>', r'(?s)<h4\b[^>]*data-gs-uitk-component="card-title"[^>]*>(.*?)</h4>', "https://www.goldmansachs.com")


def index_articles(df: DataFrame, page: IndexPage, payload: str = "payload") -> DataFrame:
    """(url, title, summary, day) of an index page's articles, links made whole, each once, the first kept; a card without a
    title is none."""
    keep = [c for c in df.columns if c != payload]
    pick = lambda i: F.regexp_extract_all(payload, F.lit(page.card), F.lit(i))
    e = df.select(*keep, F.posexplode(F.arrays_zip(pick(1).alias("link"), pick(2).alias("inside"))).alias("pos", "c"))
    part = lambda pattern: F.trim(X.strip_markup(F.regexp_extract("c.inside", pattern, 1))) if pattern else F.lit(None).cast("string")
    day = F.try_to_date(part(page.date), page.date_format) if page.date else F.lit(None).cast("date")
    e = e.select(*keep, "pos", absolute(F.col("c.link"), page.base).alias("url"), part(page.title).alias("title"), F.nullif(part(page.summary), F.lit("")).alias("summary"), day.alias("day")).where("title <> ''")
    return e.groupBy(*keep, "url").agg(F.min_by(F.struct("title", "summary", "day"), "pos").alias("a")).select(*keep, "url", "a.*")
