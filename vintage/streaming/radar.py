"""The quote radar as Structured Streaming: each function takes and returns a streaming or batch DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may come, and how long an id is remembered.
LATENESS = "1 hour"
#: Minutes after which a quote is stale.
STALE_MINUTES = 30


def read_ticks(spark: SparkSession, folder: str, schema: str, glob: str) -> DataFrame:
    """Ticks from files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def deduplicated(ticks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event id once, within the watermark; state is bounded by it."""
    if not ticks.isStreaming:
        return ticks.dropDuplicates(["event_id"])
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def in_session(ts: str = "ts") -> Column:
    """Whether a UTC time lies in the exchange's session: 09:15 to 15:30 in Kolkata, Monday to Friday."""
    local = F.from_utc_timestamp(ts, "Asia/Kolkata")
    minute = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & minute.between(9 * 60 + 15, 15 * 60 + 30)


def bars_from_ticks(ticks: DataFrame, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Bars per window and symbol; first and last by event time and id."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", lateness)
    at = F.struct("ts", "event_id")
    bars = ticks.groupBy(F.window("ts", width).alias("w"), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("ticks"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def microstructure(quotes: DataFrame) -> DataFrame:
    """Stateless signals of a quote: order-book imbalance, distance from the average price, gap, setup; no signal from a depth that is not real."""
    total = F.col("buy_qty") + F.col("sell_qty")
    x = quotes.withColumns({
        "imbalance": (F.col("buy_qty") - F.col("sell_qty")) / F.when(total > 0, total), "vwap_delta": (F.col("price") / F.col("average") - 1) * 100, "gap_pct": (F.col("open") / F.col("prev_close") - 1) * 100,
    })
    signal = F.when(F.col("synthetic"), "NO_DEPTH").when((F.col("imbalance") > 0.3) & (F.col("vwap_delta") > 0), "BUY_PRESSURE").when((F.col("imbalance") < -0.3) & (F.col("vwap_delta") < 0), "SELL_PRESSURE").otherwise("NEUTRAL")
    return x.withColumn("signal", signal)


def latest_per_symbol(ticks: DataFrame) -> DataFrame:
    """The newest tick of every symbol; run in update mode when streaming."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", at).alias("price"))


def with_staleness(latest: DataFrame, now: Column) -> DataFrame:
    """Age in minutes, and whether the quote still may be served."""
    age = F.timestamp_diff("SECOND", F.col("ts"), now) / 60
    return latest.withColumn("age_minutes", age).withColumn("usable", age <= STALE_MINUTES)
