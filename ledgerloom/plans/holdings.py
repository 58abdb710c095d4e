"""Holdings and portfolio queries: lineitem as information-table rows, suppliers as managers,
parts as securities; customers as positions, nations as sectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import holdings as H
from ledgerloom.operators import portfolio as P
from ledgerloom.session import table

PERIODS = ("1998", "1999")


def _rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("manager"), F.col("l_partkey").alias("cusip"),
        F.nullif("l_returnflag", F.lit("N")).alias("put_call"), F.year("l_shipdate").alias("year"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("value"),
        F.col("l_quantity").cast("bigint").alias("shares"), F.col("l_linestatus").alias("discretion"),
    )


_POS = """
r AS (SELECT l_suppkey AS manager, l_partkey AS cusip, nullif(l_returnflag, 'N') AS put_call, year(l_shipdate) AS year,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS value, CAST(l_quantity AS BIGINT) AS shares, l_linestatus AS discretion FROM lineitem),
p AS (SELECT manager, cusip, put_call, year, sum(value)::BIGINT AS value, sum(shares)::BIGINT AS shares, count(*) AS row_count,
  CASE WHEN count(DISTINCT coalesce(discretion, '')) = 1 THEN any_value(discretion) ELSE 'MULTIPLE' END AS discretion FROM r GROUP BY 1, 2, 3, 4)
"""


def _positions(spark, sf_dir):
    return H.aggregate_positions(
        _rows(spark, sf_dir), ["manager", "cusip", "put_call", "year"], ["value", "shares"], {"discretion": F.lit("MULTIPLE")}
    )


def holding_positions(spark, sf_dir):
    return _positions(spark, sf_dir)


def holding_changes(spark, sf_dir):
    p = _positions(spark, sf_dir)
    old, new = (p.where(F.col("year") == y).drop("year") for y in PERIODS)
    out = H.holding_changes(old, new, ["cusip", "put_call"], ["manager"])
    return out.select(
        "manager", "cusip", "put_call", "change_type", "previous_shares", "current_shares", "value",
        F.round("shares_change_pct", 6).alias("shares_change_pct"), F.round("weight_pct", 6).alias("weight_pct"),
    )


def concentration(spark, sf_dir):
    c = H.concentration(_positions(spark, sf_dir), ["manager", "year"], "value")
    return c.withColumn("concentration_pct", F.round("concentration_pct", 6))


def top_holdings(spark, sf_dir):
    t = H.top_positions(_positions(spark, sf_dir), ["manager", "year"], "value", 10, ["cusip", "put_call"])
    return t.select("manager", "year", "rank", "cusip", "put_call", "value")


def issuer_counts(spark, sf_dir):
    """Positions and issuers of each manager and year, and the value of the largest issuer."""
    p = _positions(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cusip"), F.col("p_brand").alias("issuer")), "cusip")
    return p.groupBy("manager", "year").agg(
        F.count("*").alias("positions"), F.count_distinct("issuer").alias("issuers"), F.max("value").alias("largest")
    )


def value_units(spark, sf_dir):
    """Dollar values by the unit of their filing day (the cut-over moved to 2000 for these dates)."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity")
    unit = F.when(F.to_date("l_shipdate") < F.lit("2000-01-03").cast("date"), 1000).otherwise(1)
    return li.groupBy(F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_quantity").cast("bigint") * unit).alias("dollars"))


def _customers(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("symbol"), F.col("n_name").alias("sector"), F.col("c_mktsegment").alias("asset_type"), cents.alias("quantity"))
    return P.totals_weight(c.withColumn("one", F.lit(1)), "quantity", ["one"]).drop("one")


_CUST = """
c AS (SELECT c_custkey AS symbol, n_name AS sector, c_mktsegment AS asset_type, CAST(round(c_acctbal * 100) AS BIGINT) AS quantity FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, quantity / sum(quantity) OVER () AS weight, sum(quantity) OVER (PARTITION BY sector) / sum(quantity) OVER () AS sector_weight FROM c)
"""


def portfolio_metrics(spark, sf_dir):
    """Positions of customers in parts valued at list price, in the currency of their segment."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    pos = c.select(
        F.col("c_custkey").alias("symbol"), F.lit(3).alias("quantity"), F.lit(950.0).alias("average_cost"), F.col("c_mktsegment").alias("currency")
    )
    prices = n.select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"))
    rates = spark.createDataFrame([("BUILDING", 2.0), ("MACHINERY", 0.5)], "currency string, rate double")
    m = P.position_metrics(pos, prices, rates)
    return m.select("symbol", F.round("market_value", 4).alias("market_value"), F.round("return_pct", 6).alias("return_pct"))


def sector_weights(spark, sf_dir):
    s = P.sector_weights(_customers(spark, sf_dir), "sector", "quantity")
    return s.select("sector", "sector_value", F.round("sector_weight", 8).alias("sector_weight"))


def guardrails(spark, sf_dir):
    c = _customers(spark, sf_dir)
    s = P.sector_weights(c, "sector", "quantity").select("sector", "sector_weight")
    return P.guardrails(c.join(s, "sector"), 0.0012, 0.045)


def allocation_rank(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.pmod("s_suppkey", F.lit(100)).alias("confidence"))
    n = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("confidence"), F.when(F.col("n_regionkey") < 3, "candidate").otherwise("watchlist").alias("tier")
    )
    return P.rank_allocation(s, n).select("name", "kind", "confidence", "rank")


def claim_votes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"),
        F.when(F.col("o_orderstatus") == "F", "bullish").when(F.col("o_orderstatus") == "P", "bearish").otherwise("neutral").alias("direction"),
        F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low").alias("confidence"),
    )
    return P.vote(o, ["ticker"])


def capped_ratings(spark, sf_dir):
    r = F.element_at(F.array(*[F.lit(x) for x in P.RATINGS]), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))
    cap = F.when(F.col("c_acctbal") < 0, "hold")
    c = table(spark, sf_dir, "customer").select("c_custkey", P.capped_rating(r, cap).alias("rating"), F.pmod("c_custkey", F.lit(101)).alias("strength"))
    low = P.low_confidence(F.col("strength"), F.col("rating"))
    return c.select("c_custkey", low["rating"].alias("rating"), low["status"].alias("status"))


QUERIES = {
    "holding_positions": (holding_positions, f"WITH {_POS} SELECT * FROM p"),
    "holding_changes": (holding_changes, f"""WITH {_POS},
j AS (SELECT coalesce(c.manager, o.manager) AS manager, coalesce(c.cusip, o.cusip) AS cusip, coalesce(c.put_call, o.put_call) AS put_call,
  CASE WHEN o.row_count IS NULL THEN 'new' WHEN c.row_count IS NULL THEN 'sold_out' WHEN c.shares > o.shares THEN 'increased' WHEN c.shares < o.shares THEN 'decreased' ELSE 'held' END AS change_type,
  o.shares AS previous_shares, c.shares AS current_shares, coalesce(c.value, o.value) AS value, c.value AS now,
  CASE WHEN o.shares <> 0 THEN (c.shares - o.shares)::DOUBLE / o.shares * 100 END AS shares_change_pct
 FROM (SELECT * FROM p WHERE year = {PERIODS[0]}) o FULL JOIN (SELECT * FROM p WHERE year = {PERIODS[1]}) c
 ON o.manager = c.manager AND o.cusip = c.cusip AND o.put_call IS NOT DISTINCT FROM c.put_call)
SELECT manager, cusip, put_call, change_type, previous_shares, current_shares, value, round(shares_change_pct, 6) AS shares_change_pct,
  round(now * 100.0::DOUBLE / sum(now) OVER (PARTITION BY manager), 6) AS weight_pct FROM j"""),
    "concentration": (concentration, f"""WITH {_POS}, k AS (SELECT *, row_number() OVER (PARTITION BY manager, year ORDER BY value DESC) AS n FROM p)
SELECT manager, year, round(coalesce(sum(value) FILTER (n <= 5) * 100.0::DOUBLE / nullif(sum(value), 0), 0), 6) AS concentration_pct FROM k GROUP BY 1, 2"""),
    "top_holdings": (top_holdings, f"""WITH {_POS} SELECT manager, year, (row_number() OVER w)::INTEGER AS rank, cusip, put_call, value FROM p
WINDOW w AS (PARTITION BY manager, year ORDER BY value DESC, cusip, put_call NULLS FIRST) QUALIFY rank <= 10"""),
    "issuer_counts": (issuer_counts, f"WITH {_POS} SELECT manager, year, count(*) AS positions, count(DISTINCT p_brand) AS issuers, max(value) AS largest FROM p JOIN part ON cusip = p_partkey GROUP BY 1, 2"),
    "value_units": (value_units, "SELECT year(l_shipdate) AS year, sum(CAST(l_quantity AS BIGINT) * CASE WHEN l_shipdate::DATE < DATE '2000-01-03' THEN 1000 ELSE 1 END)::BIGINT AS dollars FROM lineitem GROUP BY 1"),
    "portfolio_metrics": (portfolio_metrics, """SELECT c_custkey AS symbol, round(3 * p_retailprice * CASE c_mktsegment WHEN 'BUILDING' THEN 2.0 WHEN 'MACHINERY' THEN 0.5 ELSE 1.0 END::DOUBLE, 4) AS market_value,
 round((p_retailprice - 950.0::DOUBLE) / 950.0::DOUBLE * 100, 6) AS return_pct FROM customer LEFT JOIN part ON c_custkey = p_partkey"""),
    "sector_weights": (sector_weights, f"WITH {_CUST} SELECT sector, sum(quantity)::BIGINT AS sector_value, round(sum(quantity) / (SELECT sum(quantity) FROM c), 8) AS sector_weight FROM c GROUP BY 1"),
    "guardrails": (guardrails, f"""WITH {_CUST} SELECT symbol, unnest(list_filter([CASE WHEN weight > 0.0012 THEN 'max_single_position_weight' END, CASE WHEN sector_weight > 0.045 THEN 'max_sector_weight' END,
 CASE WHEN quantity < 0 THEN 'short_selling_allowed' END, CASE WHEN lower(asset_type) LIKE '%option%' THEN 'options_allowed' END], lambda x: x IS NOT NULL)) AS rule FROM w"""),
    "allocation_rank": (allocation_rank, """WITH r AS (SELECT s_name AS name, 'held' AS kind, s_suppkey % 100 AS confidence, 0 AS o FROM supplier UNION ALL SELECT n_name, 'new', n_nationkey, 1 FROM nation WHERE n_regionkey < 3)
SELECT name, kind, confidence, (row_number() OVER (ORDER BY confidence DESC, o, name))::INTEGER AS rank FROM r"""),
    "claim_votes": (claim_votes, """WITH c AS (SELECT o_custkey AS ticker, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority[1] IN ('1', '2')) AS bullish, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority[1] IN ('1', '2')) AS bearish FROM orders GROUP BY 1)
SELECT *, CASE WHEN bullish > bearish THEN 'buy' WHEN bearish > bullish THEN 'reduce' ELSE 'hold' END AS rating FROM c"""),
    "capped_ratings": (capped_ratings, """WITH r AS (SELECT c_custkey, ['sell', 'reduce', 'hold', 'buy', 'strong_buy'][c_custkey % 5 + 1] AS r, c_acctbal < 0 AS cap, c_custkey % 101 AS s FROM customer)
SELECT c_custkey, CASE WHEN s >= 70 THEN CASE WHEN cap AND r IN ('buy', 'strong_buy') THEN 'hold' ELSE r END END AS rating, CASE WHEN s < 70 THEN 'pending' ELSE 'complete' END AS status FROM r"""),
}
