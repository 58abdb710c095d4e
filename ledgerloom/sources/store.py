"""Tables of the engine in a folder: documents, observations, snapshots, concepts; reports for people.

Schemas are declared; a column that an older file lacks reads as null and gets its default where it is used.
Writers are idempotent: what is already there with the same content is left alone, a partition is written whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.catalog import keep_first

DOCUMENTS = (
    "id string, source_type string, source_name string, title string, author string, canonical_url string, published_at timestamp, collected_at timestamp, "
    "content_hash string, capture_mode string, capture_reason string, companies array<string>, filing_type string, reporting_period date, language string, "
    "readable_ratio double, truncated boolean, original_chars bigint, llm_processed boolean, body string"
)
CONCEPTS = (
    "id string, okf_type string, okf_status string, title string, description string, entity_keys array<string>, period_year string, pub_year string, "
    "published date, stale_after date, source_id string, body string"
)
BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"
FEATURES = (
    "ticker string, metric string, value double, unit string, period string, published_at timestamp, retrieved_at timestamp, source_name string, "
    "source_url string, source_tier string, fact_type string, confidence double, max_age_days int, details map<string,string>"
)
# Days after which a concept of a type is stale.
STALE_AFTER = {
    "DartFiling": 400, "SecFiling": 400, "HoldingsSnapshot": 120, "MarketCommentary": 90, "BlogPost": 365, "ResearchNote": 365, "Essay": 3650,
    "CentralBankStatement": 400, "WebSearchResult": 30,
}
STALE_DEFAULT = 365


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_documents(new: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append documents that are not there with the same content, by type and year. `current_documents` reads them: a
    document whose content changed is there in both versions, of which the one collected last counts."""
    if known is not None:
        new = new.join(known.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    new.withColumn("year", F.year("published_at")).write.mode("append").partitionBy("source_type", "year").parquet(path)


def current_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    """Each document once, as it was collected last."""
    return keep_first(spark.read.schema(schema).parquet(path), ["id"], [F.col("collected_at").desc_nulls_last(), F.col("content_hash")])


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace just the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are left out."""
    d = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    return d.where("_bad IS NULL").drop("_bad")


def snapshot_dates(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, as_of) of file names that are dates; others are skipped."""
    day = F.regexp_extract(name, r"([^/]+)\.json$", 1).try_cast("date")
    return df.select(key, day.alias("as_of")).where("as_of IS NOT NULL").distinct()


def stale_after(okf_type, published):
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in STALE_AFTER.items() for x in kv]), okf_type)
    return F.date_add(published, F.coalesce(days, F.lit(STALE_DEFAULT)))


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A small result as a markdown table, for reports; the first `limit` rows."""
    got = rows.limit(limit).collect()
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in got)])
