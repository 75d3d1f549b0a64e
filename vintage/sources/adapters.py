"""Views of the market data model over the generated tables.

The generated tables hold no prices or filings; these views give the same
shapes from them. Every view is one scan (and at most one broadcastable
dimension join) followed by one partial aggregation on its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days between the end of a quarter and its publication, and that of its restatement.
PUBLICATION_DAYS, RESTATEMENT_DAYS = 45, 200
#: The last order year; memberships that reach it are open.
OPEN_FROM = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced_lines(spark: SparkSession, sf_dir: str, split: int = 1) -> DataFrame:
    """Shipments with their brand as company; ``split``: so many companies a brand, by supplier."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        (F.col("p_brand") if split == 1 else F.concat("p_brand", F.lit("."), F.col("l_suppkey") % split)).alias("company_id"), F.to_date("l_shipdate").alias("trading_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"),
        "l_quantity", "l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
    )


def bars(spark: SparkSession, sf_dir: str, split: int = 1) -> DataFrame:
    """Daily bars ``company_id, trading_date, open, high, low, close, volume``: unit prices of a brand's shipments of a day."""
    return _priced_lines(spark, sf_dir, split).groupBy("company_id", "trading_date").agg(
        F.min_by("u", "at").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.max_by("u", "at").alias("close"), F.sum("l_quantity").alias("volume")
    )


def calm_bars(spark: SparkSession, sf_dir: str, split: int = 1) -> DataFrame:
    """Bars as a stock moves from day to day, for setups and trades: means of 40 raw closes, with the raw bar's shape as a narrow range around them.

    Raw unit prices of a day's shipments jump by more than any entry gate allows.
    """
    by = Window.partitionBy("company_id").orderBy("trading_date")
    mean = F.avg("close").over(by.rowsBetween(-39, 0))
    place = F.coalesce((F.col("close") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")), F.lit(0.47))
    x = bars(spark, sf_dir, split).withColumns({"c": mean, "place": place})
    return x.select(
        "company_id", "trading_date", F.coalesce(F.lag("c").over(by), F.col("c")).alias("before"), (F.col("c") * (1.004 + 0.008 * F.col("place"))).alias("high"), (F.col("c") * (0.988 + 0.008 * F.col("place"))).alias("low"),
        F.col("c").alias("close"), "volume",
    ).select("company_id", "trading_date", F.least(F.greatest("before", "low"), F.col("high")).alias("open"), "high", "low", "close", "volume")


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company_id, trading_date, traded_qty, delivery_qty, delivery_pct``; shipments that are not returned count as delivered."""
    taken = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0))
    out = _priced_lines(spark, sf_dir).groupBy("company_id", "trading_date").agg(F.sum("l_quantity").alias("traded_qty"), taken.alias("delivery_qty"))
    return out.withColumn("delivery_pct", F.col("delivery_qty") / F.col("traded_qty") * 100)


def benchmark_bars(bars: DataFrame) -> DataFrame:
    """``trading_date, close``: mean close of all companies."""
    return bars.groupBy("trading_date").agg(F.avg("close").alias("close"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal quarterly filings per nation: the original and, for quarters with finished orders, a later restatement."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("company_id"))
    quarter = F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 3), 1)
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("period_end", quarter)
    both = rows.groupBy("company_id", "period_end").agg(
        F.sum("o_totalprice").alias("original"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("restated")
    )
    original = both.select("company_id", "period_end", F.date_add("period_end", PUBLICATION_DAYS).alias("published"), F.lit(0).alias("vintage"), F.col("original").alias("revenue"))
    restated = both.where("restated IS NOT NULL").select("company_id", "period_end", F.date_add("period_end", RESTATEMENT_DAYS).alias("published"), F.lit(1).alias("vintage"), F.col("restated").alias("revenue"))
    return original.unionByName(restated)


def actions(bars: DataFrame) -> DataFrame:
    """Corporate actions: a 1:1 bonus (factor 0.5) on the first session of every even year."""
    year = F.year("trading_date")
    return bars.where(year % 2 == 0).groupBy("company_id", year.alias("y")).agg(F.min("trading_date").alias("ex_date")).select("company_id", "ex_date", F.lit(0.5).alias("factor"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership intervals per customer, open where the last order falls into the last year."""
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(
        F.min(F.to_date("o_orderdate")).alias("effective_from"), F.max(F.to_date("o_orderdate")).alias("last")
    )
    return spans.select("company_id", "effective_from", F.when(F.col("last") < OPEN_FROM, F.col("last")).alias("effective_to"))


def label_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open label intervals of a year per order."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("company_id"), day.alias("label_start"), F.date_add(day, 365).alias("label_end")
    )


#: Event types of announcements, by document number; fixed values.
EVENT_TYPES = (
    "ORDER_WIN", "CAPEX_COMMISSIONING", "CAPACITY_EXPANSION", "CONTRACT_AWARD", "EARNINGS_RELEASE", "DIVIDEND", "BUYBACK", "ACQUISITION",
    "CREDIT_RATING_UPGRADE", "CREDIT_RATING_DOWNGRADE", "MANAGEMENT_CHANGE", "REGULATORY_ACTION", "PLEDGE_INCREASE", "BOARD_MEETING", "GENERAL_UPDATE", "LITIGATION",
)


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, headline, event_type, published``: one per document with its whole text, an hour apart."""
    docs = table(spark, sf_dir, "documents")
    kinds = F.array(*(F.lit(t) for t in EVENT_TYPES))
    return docs.select(
        "doc_id", F.col("text").alias("headline"), F.element_at(kinds, (F.col("doc_id") % 16 + 1).cast("int")).alias("event_type"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)").alias("published"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks ``event_id, ts, symbol, price, kind``."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("symbol"), F.col("value").alias("price"), F.col("event_type").alias("kind"))
