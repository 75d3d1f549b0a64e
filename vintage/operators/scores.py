"""Composite scores as expressions over feature columns. A missing input stays missing: null is not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, logistic

c = F.col

#: Weights of the frozen factor score, in percent.
FROZEN_WEIGHTS = {"quality": 30, "growth": 25, "momentum": 20, "valuation": 15, "governance": 10}


def _or(name: str, default: float) -> Column:
    return F.coalesce(c(name), F.lit(default))


def frozen_factors(x: DataFrame) -> DataFrame:
    """Five factor scores and their weighted, truncated composite; the composite is null without quality or governance."""
    growth = clamp(50 + clamp(_or("revenue_growth", 0.0), -30, 50) * 0.5 + clamp(_or("pat_growth", 0.0), -30, 50) * 0.5, 15, 99)
    quality = clamp(30 + clamp(c("roce"), 0, 50) * 0.9 + F.least(F.lit(35.0), c("ebitda_margin")) * 0.7, 20, 99)
    pe = c("pe")
    base = F.when(pe <= 0, 60.0).when(pe < 12, 92.0).when(pe < 20, 82.0).when(pe < 35, 68.0).when(pe < 60, 50.0).when(pe.isNotNull(), 35.0).otherwise(60.0)
    valuation = clamp(base + F.when(c("pb") < 2.5, 5.0).otherwise(0.0), 20, 95)
    trend = clamp(_or("dist_sma50", 0.0), -15, 20) + clamp(_or("dist_sma200", 0.0) * 0.5, -10, 15)
    momentum = clamp(40 + (20 - F.abs(_or("rsi", 50.0) - 60) * 0.8) + trend + (100 + _or("dist_high", -15.0)) * 0.2 + F.least(F.lit(15.0), (_or("volume_acceleration", 1.0) - 1) * 15), 15, 99)
    debt = F.when(c("debt_to_equity") > 2.5, 25.0).when(c("debt_to_equity") > 1.5, 12.0).otherwise(0.0)
    governance = F.when(c("debt_to_equity").isNotNull() & c("pat_margin").isNotNull(), clamp(85 - debt - F.when(c("pat_margin") < 3, 15.0).otherwise(0.0), 25, 95))
    known = c("roce").isNotNull() & c("ebitda_margin").isNotNull()
    parts = {"growth": growth, "quality": F.when(known, quality), "valuation": valuation, "momentum": momentum, "governance": governance}
    x = x.withColumns({f"{k}_score": v.cast("int") for k, v in parts.items()})
    total = sum((c(f"{k}_score") * w for k, w in FROZEN_WEIGHTS.items()), F.lit(0)) / 100  # whole numbers: nothing is lost before truncation
    return x.withColumn("conviction", F.when(total.isNotNull(), F.least(F.lit(99), F.greatest(F.lit(20), total.cast("int")))))


def durability(x: DataFrame) -> DataFrame:
    """Durability, valuation, momentum and their blend (30, 25, 45 %)."""
    de, margin, pe, pb = c("debt_to_equity"), c("operating_margin"), c("pe"), F.coalesce("pb", F.lit(3.0))
    solid = F.when(c("financial"), 85.0).when(de.isNull(), 65.0).when(de < 0.3, 95.0).when(de < 0.7, 85.0).when(de < 1.0, 70.0).when(de < 1.5, 50.0).when(de < 2.0, 35.0).otherwise(20.0)
    solid = F.when(margin > 20, F.least(F.lit(100.0), solid + 5)).when(margin < 5, F.greatest(F.lit(10.0), solid - 10)).otherwise(solid)
    by_book = F.when(pb < 2, 80.0).when(pb < 5, 60.0).otherwise(40.0)
    value = F.when(pe.isNull() | (pe <= 0), by_book).when(pe < 18, 90.0).when(pe < 30, 80.0).when(pe < 45, 65.0).when(pe < 65, 45.0).when(pe < 85, 30.0).otherwise(15.0)
    off = (c("high_52w") - c("close")) / c("high_52w") * 100
    trend = F.when((c("close") > c("mean50")) & (c("mean50") > c("mean200")), 30.0).when(c("close") > c("mean50"), 15.0).otherwise(0.0)
    near = F.when(off <= 3.5, 25.0).when(off <= 6, 18.0).when(off <= 12, 10.0).otherwise(0.0)
    rvol, rsi = _or("rvol", 1.0), _or("rsi", 55.0)
    volume = F.when(rvol >= 2.5, 15.0).when(rvol >= 1.8, 10.0).when(rvol >= 1.3, 5.0).otherwise(0.0)
    corridor = F.when(rsi.between(52, 68), 10.0).when(rsi.between(48, 72), 5.0).otherwise(0.0)
    x = x.withColumns({"durability": solid, "valuation": value, "momentum": clamp(30 + trend + near + volume + corridor, 10, 100)})
    return x.withColumn("composite", c("durability") * 0.30 + c("valuation") * 0.25 + c("momentum") * 0.45)


def continuation(x: DataFrame) -> DataFrame:
    """Probability that a strong day goes on: evidence from close location, wick, delivery, stretch and volume through a logistic; overrides cap it."""
    z = (c("location") - 0.5) * 2.0 - c("wick") * 1.5 + F.coalesce((c("delivery_pct") - 45) / 30, F.lit(0.0)) + clamp(c("rvol") - 1, -1, 2) * 0.4 - clamp(c("stretch") - 2.5, 0, 3) * 0.5
    p = clamp(logistic(z), 0.05, 0.95)
    trap = (c("wick") > 0.45) & (c("location") < 0.5)
    x = x.withColumn("probability", F.when(c("locked"), F.least(p, F.lit(0.5))).when(trap, F.least(p, F.lit(0.35))).otherwise(p))
    verdict = F.when(c("locked"), "CIRCUIT_LOCKED").when(trap, "WICK_TRAP").when(c("probability") >= 0.7, "CONTINUE").when(c("probability") >= 0.5, "WATCH").otherwise("FADE")
    reasons = F.array_compact(F.array(F.when(c("location") >= 0.8, "strong close"), F.when(c("wick") > 0.45, "upper wick"), F.when(c("delivery_pct") >= 60, "delivery"), F.when(c("rvol") >= 2, "volume"), F.when(c("stretch") > 4, "stretched")))
    return x.withColumn("verdict", verdict).withColumn("reasons", reasons)


def structure_score(x: DataFrame) -> DataFrame:
    """Price structure in points: stage 50, relative strength 30, contraction 20; a decline trips the breaker."""
    stage = F.when(c("stage").isin("STAGE_2_UPTREND", "STAGE_2_EMERGING"), 50).when(c("stage") == "STAGE_1_ACCUMULATION", 30).otherwise(0)
    strength = F.when(c("score") > 10, 30).when(c("score") > 0, 20).when(c("score") > -5, 10).otherwise(0)
    return x.withColumn("technical_score", stage + strength + F.when(c("contracted"), 20).otherwise(0)).withColumn("breaker", c("stage") == "STAGE_4_DECLINE")


def graduation(x: DataFrame) -> DataFrame:
    """Readiness of a watched company for a swing: potential, structure and setup weigh 40, 30 and 30 %."""
    ready = c("potential") * 0.4 + c("technical_score") * 0.3 + c("readiness") * 0.3
    return x.withColumn("graduation", ready).withColumn("board", F.when(ready >= 85, "READY").when(ready >= 65, "NEAR").otherwise("WAIT"))
