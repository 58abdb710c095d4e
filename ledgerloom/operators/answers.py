"""Structured answers and the small rules around documents: snapshot headers, transcripts, gold ids,
fallbacks, price summaries, batches of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.series import Series, with_percentile

# What a snapshot's header says, in today's and in the older form (thousands of dollars).
HEADER = r"총 보고 가치:\s*([\d,]+)\s*달러\s*/\s*보유 포지션 수:\s*(\d+)(?:\s*\(원문\s*\d+행\))?(?:\s*/\s*상위 5종목 집중도:\s*([\d.]+)%)?"
HEADER_OLD = r"총 보고 가치:\s*([\d,]+)천 달러\s*/\s*보유 종목 수:\s*(\d+)(?:\s*/\s*상위 5종목 집중도:\s*([\d.]+)%)?"
TRANSCRIPT_TITLE = "[컨퍼런스콜]"


def snapshot_header(body: Column) -> Column:
    """struct(total, positions, top5, legacy); all null where there is no header."""

    def parts(pattern: str, unit: int, legacy: bool) -> tuple[Column, Column]:
        g = [F.regexp_extract(body, pattern, i) for i in (1, 2, 3)]
        total = F.regexp_replace(g[0], ",", "").try_cast("bigint") * unit
        s = F.struct(total.alias("total"), g[1].try_cast("int").alias("positions"), g[2].try_cast("double").alias("top5"), F.lit(legacy).alias("legacy"))
        return body.rlike(pattern), s

    (now, a), (old, b) = parts(HEADER, 1, False), parts(HEADER_OLD, 1000, True)
    return F.when(now, a).when(old, b)


def is_transcript(document_type: Column, filing_type: Column, title: Column) -> Column:
    titled = (document_type == "sec_filing") & (filing_type == "8-K") & F.startswith(title, F.lit(TRANSCRIPT_TITLE))
    return (document_type == "earnings_call_transcript") | F.coalesce(titled, F.lit(False))


def choose_exhibit(files: DataFrame, key: str, pos: str, text: str, results_item: str) -> DataFrame:
    """(key, exhibit, is_transcript): the first file that reads as a transcript; else, where the filing reports results,
    the first that is not empty."""
    call = F.lower(text).contains("operator") & F.lower(text).rlike("question[- ]and[- ]answer|q&a")
    rank = F.when(call, 0).when(F.col(results_item) & (F.trim(text) != ""), 1)
    f = files.withColumn("_k", rank).where("_k IS NOT NULL")
    g = f.groupBy(key).agg(F.min(F.struct("_k", pos)).alias("b"))
    return g.select(key, F.col(f"b.{pos}").alias("exhibit"), (F.col("b._k") == 0).alias("is_transcript"))


def no_content(capture: Column, body: Column, markers: list[str]) -> Column:
    """True where nothing can be extracted: metadata only, a digest, or an empty source section."""
    source = F.regexp_extract(body, r"(?s)(?:^|\n)## 원문[^\n]*\n(.*?)(?=\n## |$)", 1)
    empty = body.rlike(r"(?:^|\n)## 원문") & (F.trim(F.regexp_replace(source, r"\s+", " ")) == "")
    out = (capture == "metadata_only") | empty
    for m in markers:
        out = out | body.contains(m)
    return out


def mentions_ticker(companies: Column, ticker: str) -> Column:
    """The ticker, or what stands before its dot, is among the companies."""
    return F.array_contains(companies, ticker) | F.array_contains(companies, ticker.split(".")[0])


def resolve_gold(questions: DataFrame, native: DataFrame) -> DataFrame:
    """Adds gold: the given concept, else the concept of the native id, else that id."""
    n = native.select(F.col("native_id").alias("_n"), F.col("concept").alias("_c"))
    j = questions.join(n, F.col("gold_doc") == F.col("_n"), "left")
    return j.withColumn("gold", F.coalesce(F.nullif("gold_concept", F.lit("")), "_c", "gold_doc")).drop("_n", "_c")


def first_with_rows(wanted: DataFrame, rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name): of each key's names in order the first that has rows (benchmarks and their fallbacks)."""
    have = rows.select(name).distinct()
    return wanted.join(have, name, "left_semi").groupBy(key).agg(F.min_by(name, order).alias(name))


def price_summary(bars: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First and last close, their change in percent, the last volume against the mean of those not 0."""
    g = bars.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("close", day).alias("first"), F.max_by("close", day).alias("last"),
        F.max_by("volume", day).alias("_v"), F.avg(F.when(F.col("volume") > 0, F.col("volume"))).alias("_m"),
    )
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100.0)
    return g.withColumn("change_pct", change).withColumn("volume_ratio", F.when(F.col("_v") > 0, F.col("_v") / F.col("_m"))).drop("_v", "_m")


def term_structure(near: DataFrame, far: DataFrame, day: str, value: str) -> DataFrame:
    """Ratio of two series by day and whether the nearer is at or above the farther."""
    j = near.join(far.select(day, F.col(value).alias("_far")), day)
    ratio = F.round(F.try_divide(F.col(value), F.col("_far")), 3)
    return j.withColumn("ratio", ratio).withColumn("backwardation", F.coalesce(ratio >= 1.0, F.lit(False))).drop("_far")


def term_percentiles(ratios: DataFrame, day: str, ratio: str, windows: dict[str, int]) -> DataFrame:
    """Adds the percentile of each ratio among those of its last days, a column a window (name: days, a year or five)."""
    s = Series(("_one",), day)
    out = ratios.withColumn("_one", F.lit(0))  # one series: a ratio a day
    for name, days in windows.items():
        out = with_percentile(out, s, ratio, days, name)
    return out.drop("_one")


def holdings_answer(snapshots: DataFrame, holdings: DataFrame, investor: str, published: str) -> DataFrame:
    """The latest snapshot of each investor with its largest holding, five largest and warnings. Holdings that were
    sold out do not count."""
    last = snapshots.groupBy(investor).agg(F.max_by(F.struct(*snapshots.columns), published).alias("s")).select("s.*")
    h = holdings.where(F.coalesce(F.col("change_type"), F.lit("")) != "sold_out")
    h = h.join(last.select("snapshot_id"), "snapshot_id", "left_semi")
    w = F.reverse(F.array_sort(F.collect_list(F.struct("weight_pct", "issuer"))))
    # a filing has thousands of positions at most
    top = h.groupBy("snapshot_id").agg(F.count("*").alias("captured"), F.slice(w, 1, 5).alias("top5"))
    warn = F.array_compact(F.array(F.when(F.col("reported") > F.col("captured"), "truncated"), F.when(F.col("legacy"), "legacy_units")))
    return last.join(top, "snapshot_id", "left").withColumn("largest", F.get("top5", 0)).withColumn("warnings", warn)


CLAIM_RESPONSE = "struct<documents:array<struct<document_id:string,claims:array<struct<text:string,direction:string,confidence:string>>>>>"


def unpack_claims(responses: DataFrame, expected: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, document_id, claims). expected (batch, document_id): a batch whose ids are not exactly those is an error."""
    d = responses.select(batch, F.explode_outer(F.from_json("response", CLAIM_RESPONSE)["documents"]).alias("d")).select(batch, "d.*")
    e = expected.select(F.col(batch).alias("_b"), F.col("document_id").alias("_id"))
    j = d.join(e, (F.col(batch) == F.col("_b")) & (F.col("document_id") == F.col("_id")), "full_outer")
    bad = F.col("_id").isNull() | F.col("document_id").isNull()
    ok = F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("ids do not match:"), "document_id", "_id")).cast("boolean")).otherwise(F.lit(True))
    return j.where(ok).select(batch, "document_id", "claims")


def stable_sector_config(base: dict, overlay: dict | None) -> dict:
    """A sector's file replaces weights and metrics as a whole; its gates are added."""
    if not overlay:
        return dict(base)
    out = {**base, **{k: v for k, v in overlay.items() if k != "hard_gates"}}
    out["hard_gates"] = [*base.get("hard_gates", []), *overlay.get("hard_gates", [])]
    return out


def macro_liquidity(cooling: Column) -> Column:
    return 100.0 - cooling


def monetisation_gap(capex_growth: Column, revenue_growth: Column) -> Column:
    return capex_growth - revenue_growth


# Sections that claims fill, and what they hold without any.
CLAIM_SECTIONS = {"핵심 주장": "(추출된 핵심 주장 없음)", "근거": "(근거 없음)", "반대 근거": "(반대 근거 없음)", "언급 자산": "(언급 자산 없음)"}


def spliced(body: Column, claims: Column) -> Column:
    """A body whose sections of CLAIM_SECTIONS hold what claims say; other sections stay as they are.

    claims: array<struct<claim, direction, confidence, evidence array, counter_evidence array, assets array>>."""
    claims = F.coalesce(claims, F.array().cast(CLAIMS))
    bullets = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")
    gathered = lambda name: F.flatten(F.transform(claims, lambda c: F.coalesce(c[name], F.array().cast("array<string>"))))
    said = F.transform(claims, lambda c: F.concat(c["claim"], F.lit(" ("), c["direction"], F.lit(", 확신도: "), c["confidence"], F.lit(")")))
    texts = [bullets(said), bullets(gathered("evidence")), bullets(gathered("counter_evidence")), F.array_join(F.array_distinct(gathered("assets")), ", ")]
    parts = F.split(body, r"(?m)(?=^## .)")

    def part(p: Column) -> Column:
        name = F.trim(F.regexp_extract(p, r"\A## (.+)", 1))
        out = p
        for (section, none), text in zip(CLAIM_SECTIONS.items(), texts, strict=True):
            filled = F.concat(F.lit(f"## {section}\n"), F.when(text == "", none).otherwise(text), F.lit("\n\n"))
            out = F.when(F.startswith(p, F.lit("## ")) & (name == section), filled).otherwise(out)
        return out

    return F.array_join(F.transform(parts, part), "")


CLAIMS = "array<struct<claim:string,direction:string,confidence:string,evidence:array<string>,counter_evidence:array<string>,assets:array<string>>>"


def inbox_plan(lines: DataFrame, known: DataFrame, supported: list[str]) -> DataFrame:
    """(line_no, type, value, status, text): what becomes of each line of an inbox (line_no, text).

    Ticked lines are left alone; of the others, one that is no `- [ ] type: value` or of another type is parse_error, one whose value is
    known (type, key) or stands in a line before is skipped_duplicate, the rest is added. Lines that were added or skipped
    come back ticked."""
    pattern = r"^\s*- \[([ xX])\]\s*(\w+)\s*:\s*([^|]+?)\s*(?:\|.*)?$"
    g = [F.regexp_extract("text", pattern, i) for i in (1, 2, 3)]
    p = lines.select("line_no", "text", F.nullif(F.lower(g[1]), F.lit("")).alias("type"), F.nullif(g[2], F.lit("")).alias("value"), F.col("text").rlike(r"^\s*- \[[xX]\]").alias("_ticked"))
    p = p.where("NOT _ticked AND trim(text) <> ''").withColumn("_key", F.lower("value"))
    first = p.groupBy("type", "_key").agg(F.min("line_no").alias("_first"))
    have = known.select("type", F.lower("key").alias("_key")).distinct().withColumn("_known", F.lit(True))
    j = p.join(first, ["type", "_key"], "left").join(have, ["type", "_key"], "left")
    bad = F.col("type").isNull() | ~F.col("type").isin(*supported)
    again = F.coalesce("_known", F.lit(False)) | (F.col("line_no") > F.col("_first"))
    status = F.when(bad, "parse_error").when(again, "skipped_duplicate").otherwise("added")
    ticked = F.regexp_replace("text", r"^(\s*- \[) \]", "$1x]")
    return j.select("line_no", "type", "value", status.alias("status"), F.when(bad, F.col("text")).otherwise(ticked).alias("text"))


def growth_features(points: DataFrame) -> DataFrame:
    """(ticker, metric, value, period, max_age_days) of quarterly points (ticker, concept, as_of, value) of operating cash flow
    and capital expenditure: growth against four quarters back, in percent of its size; free cash flow where both are known."""
    w = W.partitionBy("ticker", "metric").orderBy("as_of")
    named = {"capital_expenditure": "capex_growth", "operating_cash_flow": "operating_cash_flow_growth"}
    metric = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    own = points.where(F.col("concept").isin(*named)).select("ticker", "as_of", metric[F.col("concept")].alias("metric"), F.when(F.col("concept") == "capital_expenditure", F.abs("value")).otherwise(F.col("value")).alias("value"))
    both = points.where(F.col("concept").isin(*named)).groupBy("ticker", "as_of").agg(F.sum("value").alias("value"), F.count_distinct("concept").alias("_n"))
    free = both.where("_n = 2").select("ticker", "as_of", F.lit("free_cash_flow_growth").alias("metric"), "value")
    e = own.unionByName(free).withColumn("_old", F.lag("value", 4).over(w)).withColumn("_last", F.row_number().over(W.partitionBy("ticker", "metric").orderBy(F.col("as_of").desc())))
    e = e.where("_last = 1 AND _old <> 0")
    return e.select("ticker", "metric", F.round((F.col("value") - F.col("_old")) / F.abs("_old") * 100.0, 2).alias("value"), F.col("as_of").alias("period"), F.lit(120).alias("max_age_days"))
