"""Ranking, top-k and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_allocation(rows: DataFrame, sector: list[str], conviction: str, tie: str, stock_cap: float, sector_cap: float, least: float = 0.5) -> DataFrame:
    """Weights by falling conviction: each takes its cap until the sector's is used up; crumbs are left out."""
    before = Window.partitionBy(*sector).orderBy(F.col(conviction).desc(), tie).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.lit(stock_cap)).over(before), F.lit(0.0))
    return rows.withColumn("weight", F.least(F.lit(stock_cap), F.lit(sector_cap) - used)).where(F.col("weight") > least)


def stratified(rows: DataFrame, bucket: Column, shares: dict[str, float], rank: list[Column], size: int) -> DataFrame:
    """Quota per bucket, then backfill by rank: ``size`` rows in all.

    Counts per bucket are few; ranks within buckets are pruned before the shuffle.
    """
    x = rows.withColumn("bucket", bucket)
    quota = F.lit(0)
    for name, share in shares.items():
        quota = F.when(F.col("bucket") == name, max(1, round(share * size))).otherwise(quota)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*rank))
    x = x.withColumn("place", place).where(F.col("place") <= size).withColumn("picked", F.col("place") <= quota)
    return x.orderBy(F.col("picked").desc(), *rank).limit(size).drop("place")


def latest(rows: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The newest ``n`` rows per key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")
