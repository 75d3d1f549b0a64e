"""Point-in-time reads of filings: versions, as-of reads, year-over-year matches, trailing sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_over_year(q: DataFrame, value: str = "revenue") -> DataFrame:
    """Growth against the same month of the prior year, else against another filing of that calendar quarter; an equi-join on company and year."""
    prior = q.select("company_id", (F.year("period_end") + 1).alias("y"), F.quarter("period_end").alias("pq"), F.month("period_end").alias("pm"), F.col("period_end").alias("prior_end"), F.col(value).alias("prior"))
    x = q.withColumns({"y": F.year("period_end"), "cq": F.quarter("period_end"), "cm": F.month("period_end")})
    pairs = x.join(prior, ["company_id", "y"], "left")
    fits = F.when(F.col("cm") == F.col("pm"), 0).when(F.col("cq") == F.col("pq"), 1)
    best = pairs.groupBy("company_id", "period_end").agg(F.first(value).alias(value), F.min_by(F.when(fits.isNotNull(), F.col("prior")), F.coalesce(fits, F.lit(2))).alias("prior"))
    return best.withColumn("growth", (F.col(value) / F.when(F.col("prior") != 0, F.col("prior")) - 1) * 100)


def cadence(filings: DataFrame) -> DataFrame:
    """Days between the two latest period ends; over 130 means semi-annual reports."""
    ends = Window.partitionBy("company_id").orderBy("period_end")
    x = filings.select("company_id", "period_end").distinct().withColumn("gap", F.datediff("period_end", F.lag("period_end").over(ends)))
    return x.groupBy("company_id").agg(F.max_by("gap", "period_end").alias("last_gap")).withColumn("semi_annual", F.col("last_gap") > 130)


def scd2(rows: DataFrame, key: list[str], start: str, fields: list[str], tolerance: float = 0.01) -> DataFrame:
    """Versions of a record: a row opens one if any field moves by the tolerance; it closes when the next opens, the last stays open to 9999-12-31."""
    by = Window.partitionBy(*key).orderBy(start)
    before = F.lag(F.struct(*fields)).over(by)
    moved: Column = before.isNull()
    for f in fields:
        moved = moved | (F.abs(F.col(f) - before[f]) >= tolerance) | F.col(f).isNull().__ne__(before[f].isNull())
    kept = rows.withColumn("_moved", moved).where("_moved").drop("_moved")
    return kept.withColumnRenamed(start, "rec_start").withColumn("rec_end", F.coalesce(F.lead("rec_start").over(Window.partitionBy(*key).orderBy("rec_start")), F.lit("9999-12-31").cast("date")))


def as_of(filings: DataFrame, dates: DataFrame, limit: int = 8) -> DataFrame:
    """Bitemporal as-of read: for every (company, t0) the newest ``limit`` periods published by then, one vintage each.

    ``dates``: ``company_id, t0``. An equi-join on the company with the publication as
    condition; versions of a period are reduced by one partial aggregate before ranking.
    """
    seen = dates.join(filings, "company_id").where("published <= t0")
    values = [c for c in filings.columns if c not in ("company_id", "period_end")]
    latest = seen.groupBy("company_id", "t0", "period_end").agg(F.max_by(F.struct(*values), F.struct("published", "vintage")).alias("v"))
    rank = F.dense_rank().over(Window.partitionBy("company_id", "t0").orderBy(F.col("period_end").desc()))
    return latest.withColumn("age", rank).where(F.col("age") <= limit).select("company_id", "t0", "period_end", "age", "v.*")


def trailing_sum(newest: DataFrame, value: str = "revenue", periods: int = 4) -> DataFrame:
    """Trailing sum of the newest periods of an as-of read, scaled up where a value is missing."""
    last = newest.where(F.col("age") <= periods).groupBy("company_id", "t0").agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    return last.select("company_id", "t0", F.when(F.col("k") > 0, F.col("s") * periods / F.col("k")).alias("ttm"), F.col("k").alias("periods"))


def price_as_of(points: DataFrame, prices: DataFrame, time: str, forward: bool = False) -> DataFrame:
    """As-of join without candidate pairs: points and prices on one timeline per company, the last price is carried on.

    ``forward``: the first price at or after the point instead.
    """
    keys = [c for c in points.columns if c not in ("company_id", time)]
    a = points.select("company_id", F.col(time).alias("_t"), F.struct(*([F.col(k) for k in keys] or [F.lit(0).alias("_")])).alias("_point"), F.lit(None).cast("double").alias("_p"), F.lit(None).cast("date").alias("_d"))
    b = prices.select("company_id", F.col("trading_date").alias("_t"), F.lit(None).cast(a.schema["_point"].dataType).alias("_point"), F.col("close").alias("_p"), F.col("trading_date").alias("_d"))
    order = [F.col("_t").desc() if forward else F.col("_t"), F.col("_point").isNotNull()]
    w = Window.partitionBy("company_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumns({"price": F.last("_p", ignorenulls=True).over(w), "price_date": F.last("_d", ignorenulls=True).over(w)})
    return both.where("_point IS NOT NULL").select("company_id", F.col("_t").alias(time), *(F.col(f"_point.{k}").alias(k) for k in keys), "price", "price_date")
