"""Questions to answers: plans of questions, the tables the tools read, results and what to do where one fails.

Every step takes and gives DataFrames, a row a question, so any number of questions is answered in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.answers import snapshot_header
from ledgerloom.operators.chunking import table_rows
from ledgerloom.operators.knowledge import HOUSE, longest_names, route, with_aliases

# What a question that names a research house looks for.
HOUSE_TYPES = ("ResearchNote", "MarketCommentary")
WARNINGS = ("no_hits", "corrupt_evidence", "low_coverage")


def plan_questions(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(qid, text, entity_key, entity_name, house, period_year, okf_types): what a question says about metadata.

    Names of the lexicon (name, key) and their aliases count, longest first. A research house is who wrote, not what is asked
    about: it sets the types, never the entity."""
    names = with_aliases(lexicon)
    found = longest_names(questions, names.select("name", "key")).join(names.select("name", "key", "canonical"), ["name", "key"])
    found = found.withColumn("is_house", F.col("canonical").rlike(HOUSE))
    first = lambda cond, col: F.min_by(F.when(cond, F.col(col)), F.when(cond, F.col("rank")))
    who = found.groupBy("qid").agg(
        first(~F.col("is_house"), "key").alias("entity_key"), first(~F.col("is_house"), "canonical").alias("entity_name"), first(F.col("is_house"), "canonical").alias("house")
    )
    q = questions.select("qid", "text").join(who, "qid", "left")
    types = F.when(F.col("house").isNotNull(), F.array(*[F.lit(t) for t in HOUSE_TYPES])).otherwise(X.type_slot(F.col("text")))
    return q.withColumns({"period_year": X.year_slot(F.col("text")), "okf_types": types})


def document_results(hits: DataFrame, questions: DataFrame, least: int = 5, chars: int = 200) -> DataFrame:
    """(qid, ok, n_evidence, evidence array, notes array, escalate) of ranked hits (qid, id, rank, text, okf_status, escalate):
    the first few with the beginnings of their texts; a question without hits gets a row too."""
    h = hits.where(F.col("rank") <= least)
    one = F.struct(F.col("rank").alias("rank"), F.col("id").cast("string").alias("id"), F.substring("text", 1, chars).alias("text"), F.col("okf_status").alias("status"))
    e = h.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("evidence"), F.coalesce(F.bool_or("escalate"), F.lit(False)).alias("escalate"))
    r = questions.select("qid").join(e, "qid", "left")
    n = F.coalesce(F.array_size("evidence"), F.lit(0))
    corrupt = F.coalesce(F.exists("evidence", lambda x: F.coalesce(x["status"] == "corrupt", F.lit(False))), F.lit(False))
    notes = [F.when(c, F.lit(w)) for c, w in zip((n == 0, corrupt, F.coalesce("escalate", F.lit(False))), WARNINGS, strict=True)]
    return r.select("qid", (n > 0).alias("ok"), n.alias("n_evidence"), "evidence", F.array_compact(F.array(*notes)).alias("notes"), F.coalesce("escalate", F.lit(False)).alias("escalate"))


def answered(questions: DataFrame, results: DataFrame, least: int = 1) -> DataFrame:
    """(qid, tool, ok, n_evidence, fell_back, stopped, needs_search): the result of the tool a question goes to, that of the
    documents where the tool has none, and whether to stop for want of evidence.

    results: (qid, tool, ok, n_evidence), tool as `route` names it; a tool without a row failed."""
    q = questions.select("qid", route(F.col("text")).alias("chosen"))
    own = results.select("qid", F.col("tool").alias("chosen"), F.col("ok").alias("_ok"), F.col("n_evidence").alias("_n"))
    docs = results.where("tool = 'documents'").select("qid", F.col("ok").alias("_dok"), F.col("n_evidence").alias("_dn"))
    j = q.join(own, ["qid", "chosen"], "left").join(docs, "qid", "left")
    skip, good = F.col("chosen") == "skip", F.coalesce("_ok", F.lit(False))
    back = ~skip & ~good & (F.col("chosen") != "documents")
    ok = F.when(skip, True).when(back, F.coalesce("_dok", F.lit(False))).otherwise(good)
    n = F.when(skip, 0).when(back, F.coalesce("_dn", F.lit(0))).otherwise(F.coalesce("_n", F.lit(0)))
    tool = F.when(skip, "none").when(back, "documents").otherwise(F.col("chosen"))
    return j.select("qid", tool.alias("tool"), ok.alias("ok"), n.cast("int").alias("n_evidence"), back.alias("fell_back"), (~skip & (~ok | (n < least))).alias("stopped"), (~skip).alias("needs_search"))


def structured_tables(concepts: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """holdings, snapshots and filings of concepts (id, okf_type, okf_status, title, subject, entity_keys, period_year, published,
    body): what the tools read. A snapshot without rows is none; it is truncated if it reports more positions than it has rows."""
    key = F.coalesce(F.get("entity_keys", F.lit(0)), F.lit("")).alias("entity_key")
    s = concepts.where("okf_type = 'HoldingsSnapshot'").withColumn("_rows", table_rows(F.col("body"))).withColumn("_h", snapshot_header(F.col("body")))
    s = s.withColumn("_cells", F.slice("_rows", 2, limit or 1_000_000)).where(F.size("_cells") > 0)
    short = F.coalesce(F.size("_cells") < F.col("_h.positions"), F.lit(False))
    snapshots = s.select("id", key, "subject", "published", F.col("_h.total").alias("total_value"), F.col("_h.positions").alias("reported"), F.col("_h.top5").alias("top5"), F.size("_cells").alias("captured"), short.alias("truncated"), F.coalesce("_h.legacy", F.lit(False)).alias("legacy"))
    number = lambda i: X.number(F.get("c", F.lit(i)))
    holdings = s.select("id", key, "published", F.posexplode("_cells").alias("pos", "c")).select(
        "id", "entity_key", "published", "pos", F.get("c", F.lit(0)).alias("security"), F.get("c", F.lit(1)).alias("cusip"), number(2).alias("shares"), number(3).alias("value_usd"), number(4).alias("weight_pct")
    )
    filings = concepts.where(F.col("okf_type").isin("DartFiling", "SecFiling")).select("id", key, "okf_type", "title", "published", "period_year", F.year("published").cast("string").alias("pub_year"), "okf_status")
    return {"holdings": holdings, "snapshots": snapshots, "filings": filings}


def sampled_questions(documents: DataFrame, n: int, seed: int = 7, chars: int = 60) -> DataFrame:
    """(qid, kind, text, gold): questions made of documents (id, native_id, title, text) for evaluation: by identifier, by a
    title's beginning that no other document has, and by a span of the text. The same seed gives the same questions."""
    place = lambda kind: F.xxhash64(F.lit(seed), F.lit(kind), F.col("id"))
    prefix = F.substring("title", 1, chars)
    alone = documents.withColumn("_p", prefix).groupBy("_p").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1 AND _p <> ''").select("id", F.col("_p").alias("q"))
    length = F.length("text")
    span = F.substring("text", (F.pmod(place("at"), F.greatest(length - chars, F.lit(1))) + 1).cast("int"), F.lit(chars))
    made = {
        "identifier": documents.where("native_id <> ''").select("id", F.col("native_id").alias("q")),
        "title": alone,
        "span": documents.where(length > 2 * chars).select("id", F.trim(span).alias("q")),
    }
    out = None
    for kind, rows in made.items():
        some = rows.orderBy(place(kind), "id").limit(n).select(F.lit(kind).alias("kind"), F.col("q").alias("text"), F.col("id").alias("gold"))
        out = some if out is None else out.unionByName(some)
    return out.withColumn("qid", F.row_number().over(W.orderBy("kind", "gold"))).select("qid", "kind", "text", "gold")


@dataclass(frozen=True)
class Tool:
    """What a model is told of a tool, and how a frame of questions (qid, text) is run through it: to (qid, ok, n_evidence, ..)."""

    name: str
    description: str
    run: Callable[[DataFrame], DataFrame]
    parameters: dict = field(default_factory=lambda: {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]})


def run_tools(questions: DataFrame, tools: list[Tool]) -> DataFrame:
    """(qid, tool, ok, n_evidence) of each tool for the questions that go to it; the tool named documents answers all."""
    routed, out = questions.withColumn("_to", route(F.col("text"))), None
    for t in tools:
        mine = questions if t.name == "documents" else routed.where(F.col("_to") == t.name).drop("_to")
        got = t.run(mine).select("qid", F.lit(t.name).alias("tool"), "ok", "n_evidence")
        out = got if out is None else out.unionByName(got)
    return out


class SearchBackend(Protocol):
    """A search over a corpus: (qid, id, score) of questions (qid, text), lower scores first."""

    def __call__(self, queries: DataFrame, allowed=None) -> DataFrame: ...


class PriceSource(Protocol):
    """Bars (symbol, date, open, high, low, close, volume) of symbols (symbol)."""

    def __call__(self, symbols: DataFrame, days: int) -> DataFrame: ...


class Contextualizer(Protocol):
    """Chunks (chunk_uid, text, ..) with a column `context` to stand before each: from metadata, or from a model."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


def metadata_context(columns: list[str]) -> Contextualizer:
    """Context from metadata alone: what is known of a chunk's document, in one line."""
    from ledgerloom.operators.chunking import context_header

    return lambda chunks: chunks.withColumn("context", context_header([F.col(c) for c in columns]))
