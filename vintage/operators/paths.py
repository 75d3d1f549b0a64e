"""What follows and precedes a bar: relative strength, contraction, forward outcomes, wealth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import passage
from .windows import sessions, last_bars


def mansfield(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Relative strength against the benchmark (all companies' mean close) over its 50-session mean; aligned by date.

    The benchmark is joined by shuffle or broadcast as its size says; its own mean needs no join.
    """
    if benchmark is None:
        benchmark = bars.groupBy("trading_date").agg(F.avg("close").alias("benchmark"))
    x = bars.join(benchmark, "trading_date").withColumn("rs", F.col("close") / F.col("benchmark"))
    x = x.withColumn("score", F.when(F.row_number().over(sessions()) >= 50, (F.col("rs") / F.avg("rs").over(last_bars(50)) - 1) * 100))
    score = F.col("score")
    status = F.when(score.isNull(), "UNKNOWN").when(score > 10, "LEADER").when(score > 0, "OUTPERFORMER").when(score > -5, "IN_LINE").otherwise("LAGGARD")
    return x.withColumn("status", status)


def contraction(x: DataFrame) -> DataFrame:
    """Range of the last ten bars against the thirty before, and volume dry-up; both rounded before they are compared."""
    before = F.col("high30_before10") - F.col("low30_before10")
    squeeze = (F.col("high10") - F.col("low10")) / F.when(before != 0, before)
    x = x.withColumn("squeeze", squeeze).withColumn("dry_up", F.col("vol5") / F.col("vol40"))
    tight = (F.round(F.coalesce("squeeze", F.lit(1.0)), 2) <= 0.60) & (F.round("dry_up", 2) <= 0.70)
    return x.withColumn("contracted", (F.col("n") >= 40) & tight)


def contraction_percentile(x: DataFrame) -> DataFrame:
    """Share, in percent, of the earlier samples (bars 30, 33, ...) whose ratio does not exceed the rounded current one; 50 before bar 45."""
    before = sessions().rowsBetween(Window.unboundedPreceding, -1)
    sample = F.collect_list(F.when((F.col("n") >= 30) & (F.col("n") % 3 == 0), F.col("ratio"))).over(before)
    now = F.round("ratio", 2)
    share = F.size(F.filter(sample, lambda r: r <= now)) / F.size(sample) * 100
    return x.withColumn("percentile", F.when((F.col("n") >= 45) & (F.size(sample) > 0), share).otherwise(50.0))


def accumulation(x: DataFrame, bars: int = 19) -> DataFrame:
    """Up and down volume and distribution days over the last changes; a distribution day is measured against the current mean volume."""
    frame = last_bars(bars)
    up = F.col("close") >= F.col("prev_close")
    x = x.withColumns({
        "up_volume": F.sum(F.when(up, F.col("volume"))).over(frame), "down_volume": F.sum(F.when(~up, F.col("volume"))).over(frame),
        "up_days": F.count(F.when(up, 1)).over(frame), "down_volumes": F.collect_list(F.when(~up, F.col("volume"))).over(frame),
    })
    heavy = F.size(F.filter("down_volumes", lambda v: v > 1.3 * F.col("vol40"))).cast("long")
    return x.withColumn("distribution_days", heavy).drop("down_volumes")


def wick_trap(x: DataFrame, pivot: Column, bars: int = 3) -> DataFrame:
    """Whether one of the last bars reached the pivot and closed in its lower half under a long upper wick."""
    x = x.withColumn("recent", F.collect_list(F.struct("high", "low", "close")).over(last_bars(bars))).withColumn("pivot", pivot)

    def wick(b: Column) -> Column:
        return (b["high"] - b["close"]) / F.greatest(F.lit(0.01), b["high"] - b["low"])

    def low_close(b: Column) -> Column:
        return (b["close"] - b["low"]) / F.greatest(F.lit(0.01), b["high"] - b["low"]) < 0.5

    near = F.filter("recent", lambda b: b["high"] >= F.col("pivot") * 0.992)
    x = x.withColumn("trapped", F.exists(near, lambda b: (wick(b) >= 0.35) & low_close(b)))
    return x.withColumn("wick", F.aggregate(near, F.lit(0.0), lambda m, b: F.greatest(m, wick(b)))).drop("recent")


def year_anchors(bars: DataFrame) -> DataFrame:
    """Decision dates: each company's first session of a year."""
    return bars.groupBy("company_id", F.year("trading_date").alias("y")).agg(F.min("trading_date").alias("t0")).select("company_id", "t0")


#: Multiples of the start price whose first passage is an outcome.
MULTIPLES = (1.2, 2.0, 5.0, 10.0)


def outcomes(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """Drawdown, run and first passages per decision date: ``bar_*`` (bars from the start), ``date_*``, ``price_*`` and ``low_*`` (lowest close before) for 1.2 (``up``), 2, 5 and 10 times the start price."""
    rows = passage.numbered(bars)
    start = passage.starts(rows, anchors)
    asked = start.select("company_id", "t0", "i", "p0", F.explode(F.array(*(F.lit(m) for m in MULTIPLES))).alias("multiple")).withColumn("level", F.col("multiple") * F.col("p0"))
    found = passage.first_passages(asked, passage.Levels(rows))
    named = {"up": 1.2, "2x": 2.0, "5x": 5.0, "10x": 10.0}

    def only(m: float, value: Column) -> Column:
        return F.max(F.when(F.col("multiple") == m, value))

    hit = F.col("hit").isNotNull()
    columns = [c for n, m in named.items() for c in (
        only(m, F.col("hit") - F.col("i")).cast("long").alias(f"bar_{n}"), only(m, F.col("hit_date")).alias(f"date_{n}"), only(m, F.col("hit_price")).alias(f"price_{n}"), only(m, F.when(hit, F.col("low_before"))).alias(f"low_{n}"),
    )]
    wide = found.groupBy("company_id", "t0").agg(*columns)
    out = start.drop("i").join(wide, ["company_id", "t0"])
    return out.withColumn("failed", (F.col("max_drawdown") <= -50) & F.col("bar_2x").isNull())


def low_before(bars: DataFrame, anchors: DataFrame, multiple: float) -> DataFrame:
    """Lowest price before the first passage of a multiple; null where it never passes."""
    rows = passage.numbered(bars)
    asked = passage.starts(rows, anchors).withColumn("level", F.lit(multiple) * F.col("p0"))
    found = passage.first_passages(asked, passage.Levels(rows))
    return found.select("company_id", "t0", F.when(F.col("hit").isNotNull(), F.col("low_before")).alias("low_before"))


def path_vectors(bars: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """The first prices of each path as an array of bounded length."""
    rows = passage.numbered(bars)
    x = passage.spans(passage.starts(rows, anchors), rows, length, "p")
    return x.select("company_id", "t0", F.col("path.p").alias("path"))


def wealth(x: DataFrame, start: float) -> DataFrame:
    """Value of a stake bought at the first close: dividends reinvested at the close, or kept as cash."""
    running = sessions().rowsBetween(Window.unboundedPreceding, 0)
    shares = F.lit(start) / F.first("close").over(running)
    growth = F.exp(F.sum(F.log1p(F.col("dividend") / F.col("close"))).over(running))
    return x.withColumn("reinvested", shares * growth * F.col("close")).withColumn("cash", shares * (F.col("close") + F.sum("dividend").over(running)))


def reverse_factors(actions: DataFrame) -> DataFrame:
    """Cumulative price factor of an action and all later ones."""
    later = Window.partitionBy("company_id").orderBy(F.col("ex_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return actions.withColumn("factor", F.product("factor").over(later))


def delivery_velocity(delivery: DataFrame, sessions: int = 3) -> DataFrame:
    """Change of the delivery share per market session over the last sessions of the market, not of the company."""
    market = delivery.select("trading_date").distinct().withColumn("session", F.dense_rank().over(Window.orderBy("trading_date")).cast("long"))
    frame = Window.partitionBy("company_id").orderBy("session").rangeBetween(-(sessions - 1), 0)
    x = delivery.join(market, "trading_date")
    x = x.withColumns({"present": F.count("*").over(frame), "pct0": F.first("delivery_pct").over(frame), "s0": F.first("session").over(frame)})
    return x.withColumn("velocity", F.when(F.col("session") > F.col("s0"), (F.col("delivery_pct") - F.col("pct0")) / (F.col("session") - F.col("s0"))))


def trailing_percentile(bars: DataFrame, when: Column, days: int) -> DataFrame:
    """Rank of a close among the closes of the calendar days before, as a share; computed for the chosen bars only."""
    frame = Window.partitionBy("company_id").orderBy(F.datediff("trading_date", F.lit("1990-01-01"))).rangeBetween(-days, 0)
    x = bars.withColumn("closes", F.collect_list("close").over(frame)).where(when)
    below = F.size(F.filter("closes", lambda c: c < F.col("close")))
    return x.withColumn("percentile", below / F.greatest(F.size("closes") - 1, F.lit(1))).drop("closes")
