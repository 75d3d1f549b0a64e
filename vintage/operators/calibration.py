"""Statistics of labelled trades and predictions: one partial aggregation each, intervals and tiers as expressions on its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f

#: Observations that shrinkage counts the parent's mean as.
SHRINKAGE = 15.0


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def trade_metrics() -> list[Column]:
    """Aggregates over trades; everything else about a subset follows from them."""
    r, pnl = F.col("r"), F.col("pnl_pct")
    stopped = F.contains("outcome", F.lit("STOPPED_OUT"))
    return [
        F.count("*").alias("n"), F.count_if(F.col("hit_t1")).alias("wins"), share(F.col("hit_t1")).alias("win_rate"), share(F.col("outcome") == "T2_HIT").alias("t2_rate"), share(stopped).alias("stop_rate"),
        (F.sum(F.when(pnl > 0, pnl).otherwise(0.0)) / F.greatest(F.lit(0.1), F.abs(F.sum(F.when(pnl < 0, pnl).otherwise(0.0))))).alias("profit_factor"), F.avg(r).alias("mean_r"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(1.8)).alias("win_r"), F.coalesce(F.avg(F.when(r <= 0, F.abs(r))), F.lit(1.0)).alias("loss_r"), F.avg("days_t1").alias("days_t1"), F.avg("days_stop").alias("days_stop"),
        share(F.col("r1")).alias("p_1r"), share(F.col("r2")).alias("p_2r"), share(F.col("r3")).alias("p_3r"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"), F.avg("mfe_full").alias("mfe_full"),
    ]


def with_derived(x: DataFrame, parent_r: Column) -> DataFrame:
    """Wilson interval, expected value, evidence tier and the mean shrunk towards the parent's."""
    low, high = f.wilson(F.col("wins"), F.col("n"))
    win = F.col("win_rate") / 100
    ev = win * F.col("win_r") - (1 - win) * F.col("loss_r")
    weight = F.col("n") / (F.col("n") + SHRINKAGE)
    return x.withColumns({
        "wilson_low": low, "wilson_high": high, "ev_r": ev, "ev_score": f.clamp(50 + ev * 20, 10.0, 100.0), "tier": f.evidence_tier(F.col("n")), "shrunk_r": weight * F.col("mean_r") + (1 - weight) * parent_r,
    })


def hierarchy(trades: DataFrame) -> DataFrame:
    """Metrics by setup, setup and quality, and all three with regime in one pass; each level has its least number of trades (3, 4, 5)."""
    x = trades.groupingSets([["setup"], ["setup", "quality"], ["setup", "quality", "regime"]], "setup", "quality", "regime").agg(F.grouping_id("setup", "quality", "regime").alias("level"), *trade_metrics())
    least = F.when(F.col("level") == 3, 3).when(F.col("level") == 1, 4).otherwise(5)
    return x.where(F.col("n") >= least)


def brier(predictions: DataFrame) -> DataFrame:
    """Brier score of probabilities ``p`` for outcomes ``y``, that of the base rate, and the skill over it."""
    x = predictions.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("base_rate"))
    base = F.col("base_rate") * (1 - F.col("base_rate"))
    return x.withColumn("base_brier", base).withColumn("skill_pct", (1 - F.col("brier") / F.when(base != 0, base)) * 100)


def reliability(predictions: DataFrame, buckets: int = 10) -> DataFrame:
    """Mean probability and frequency of the outcome per bucket of probability."""
    b = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    return predictions.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("frequency"))


def concentration(shares: DataFrame, group: str, value: str) -> DataFrame:
    """Herfindahl index, share of the three largest and the regime per group."""
    from pyspark.sql import Window

    whole = Window.partitionBy(group)
    x = shares.withColumn("share", F.col(value) / F.sum(value).over(whole) * 100).withColumn("place", F.row_number().over(whole.orderBy(F.col(value).desc())))
    out = x.groupBy(group).agg(F.sum(F.pow("share", F.lit(2))).alias("hhi"), F.sum(F.when(F.col("place") <= 3, F.col("share"))).alias("cr3"), F.count("*").alias("n"))
    return out.withColumn("regime", F.when(F.col("hhi") >= 2500, "CONCENTRATED").when(F.col("hhi") >= 1500, "MODERATE").otherwise("FRAGMENTED"))


def rank_correlation(x: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Pearson and Spearman correlation per group; ties get their middle rank."""
    from pyspark.sql import Window

    def middle(c: str) -> Column:
        order = Window.partitionBy(by).orderBy(c)
        return F.rank().over(order) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    ranked = x.withColumns({"_ra": middle(a), "_rb": middle(b)})
    return ranked.groupBy(by).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))
