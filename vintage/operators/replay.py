"""Historical replay: at every quarter end plus 45 days what was known of a company, how it was judged, and what became of it.

State comes from one timeline of publications and dates (:mod:`.timeline`),
outcomes from running aggregates and range levels (:mod:`.passage`): neither
dates and filings nor dates and bars meet as candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from . import engines, lookup, passage, timeline

c = F.col
#: Days from a quarter's end to its reading; quarters before the first reading; days a price may be old; bars of an outcome, at least, and of a mature one.
LAG_DAYS, FIRST_QUARTER, PRICE_DAYS, LEAST_BARS, MATURE_BARS = 45, 5, 30, 30, 756
#: Quarters that a company needs for a replay, for training and for full eligibility.
LEAST_QUARTERS, TRAINING_QUARTERS, FULL_QUARTERS = 8, 12, 16
TAX = 0.25


def _period(k: int, name: str) -> Column:
    return F.get("periods", F.lit(k))[name]


def _sum_of(name: str, first: int, n: int = 4) -> Column:
    """Sum over ``n`` periods; what is missing counts 0."""
    return F.aggregate(F.slice("periods", first + 1, n), F.lit(0.0), lambda s, p: s + F.coalesce(p[name], F.lit(0.0)))


def _newest(name: str) -> Column:
    """The newest known value of an item that not every period reports."""
    return F.get(F.filter("periods", lambda p: p[name].isNotNull()), F.lit(0))[name]


def year_growth(k: int, name: str) -> Column:
    """Growth of the k-th newest period against the same month, else the same calendar quarter, a year before, else four periods before; 0 where that is nearly nothing."""
    p = F.get("periods", F.lit(k))
    day = p["period_end"]
    last_year = F.filter("periods", lambda q: F.year(q["period_end"]) == F.year(day) - 1)
    same = F.coalesce(
        F.get(F.filter(last_year, lambda q: F.month(q["period_end"]) == F.month(day)), F.lit(0)), F.get(F.filter(last_year, lambda q: F.quarter(q["period_end"]) == F.quarter(day)), F.lit(0)), F.get("periods", F.lit(k + 4)),
    )
    base = same[name]
    return F.when(same.isNotNull(), F.when(F.abs(F.coalesce(base, F.lit(0.0))) < 0.1, 0.0).otherwise(F.round((F.coalesce(p[name], F.lit(0.0)) - base) / F.abs(base) * 100, 2)))


def acceleration(x: DataFrame) -> DataFrame:
    """Earnings acceleration from ``periods`` (newest first): change of year-on-year growth of revenue, EBIT and profit, change of margin, persistence, status.

    Fewer than six periods are ``INSUFFICIENT_HISTORY``.
    """
    enough = F.size("periods") >= 6
    x = x.withColumns({f"_{n}{k}": F.when(enough, year_growth(k, n)) for n in ("revenue", "ebit") for k in (0, 1)} | {f"_pat{k}": F.when(F.size("periods") >= 6 if k < 2 else F.size("periods") >= 5 + k, year_growth(k, "pat")) for k in range(4)})
    margin = lambda k: F.when(_period(k, "revenue") != 0, F.round(_period(k, "ebit") / F.greatest(F.lit(0.1), _period(k, "revenue")) * 100, 2)).otherwise(0.0)
    x = x.withColumns({f"{n}_acceleration": F.round(c(f"_{n}0") - c(f"_{n}1"), 2) for n in ("revenue", "ebit", "pat")} | {"margin_change": F.when(enough, F.round(margin(0) - margin(4), 2)), "_a1": F.round(c("_pat1") - c("_pat2"), 2), "_a2": F.round(c("_pat2") - c("_pat3"), 2)})
    pat, revenue = c("pat_acceleration"), c("revenue_acceleration")
    faster = F.coalesce(((pat > 5) & (revenue > 0)) | ((c("ebit_acceleration") > 8) & (c("margin_change") > 1)), F.lit(False))
    persistence = F.when(pat > 0, F.when(c("_a1") > 0, F.when(c("_a2") > 0, 3).otherwise(2)).otherwise(1)).otherwise(0)
    status = (
        F.when(pat.isNull(), "INSUFFICIENT_HISTORY").when((pat >= 15) & (revenue >= 10) & (c("margin_change") > 1.5), "ACCELERATING_EARNINGS_EXPLOSION").when((pat > 5) & (revenue > 0), "STEADY_ACCELERATION")
        .when((pat >= -5) & (c("_pat0") >= 20), "HIGH_PLATEAU_COMPOUNDING").when(pat < -10, "DECELERATING_SLOWDOWN").otherwise("NORMAL_FLUCTUATION")
    )
    x = x.withColumns({"revenue_growth": c("_revenue0"), "pat_growth": c("_pat0"), "accelerating": faster, "persistence": persistence, "acceleration_status": status})
    return x.drop(*(f"_{n}{k}" for n in ("revenue", "ebit") for k in (0, 1)), *(f"_pat{k}" for k in range(4)), "_a1", "_a2")


def reading_dates(statements: DataFrame) -> DataFrame:
    """``company_id, t0``: 45 days behind the end of every quarter with four quarters before it, of companies with eight quarters at least."""
    quarters = statements.where("period_type = 'QUARTERLY'").select("company_id", "period_end").distinct()
    by = Window.partitionBy("company_id").orderBy("period_end")
    x = quarters.withColumns({"k": F.row_number().over(by), "n": F.count("*").over(Window.partitionBy("company_id"))})
    return x.where((c("k") >= FIRST_QUARTER) & (c("n") >= LEAST_QUARTERS)).select("company_id", F.date_add("period_end", LAG_DAYS).alias("t0"))


def snapshots(statements: DataFrame, bars: DataFrame, sectors: DataFrame, dates: DataFrame) -> DataFrame:
    """Features of each ``(company_id, t0)`` from what was published by then; ``sectors(company_id, sector)`` names the market."""
    x = timeline.carried_periods(statements, dates, "QUARTERLY", 8)
    x = x.where(F.size("periods") > 0)
    sums = {f"ttm_{n}": _sum_of(n, 0) for n in ("revenue", "ebit", "pat")} | {"before_revenue": _sum_of("revenue", 1)}
    known = {"net_worth": _newest("net_worth"), "debt": F.coalesce(_newest("total_debt"), F.lit(0.0)), "cash": F.coalesce(_newest("cash"), F.lit(0.0)), "shares": _newest("shares"), "depreciation": F.coalesce(_period(0, "depreciation"), F.lit(0.0)), "capex": F.coalesce(_period(0, "capex"), F.lit(0.0))}
    x = acceleration(x.withColumns(sums | known | {"source_period_end": _period(0, "period_end"), "source_published": F.array_max("periods.published"), "source_facts": F.size("periods")}))
    price = timeline.nearest_within(dates, bars.select("company_id", "trading_date", "close"), "t0", "trading_date", PRICE_DAYS).select("company_id", "t0", c("close").alias("price"))
    x = x.join(price, ["company_id", "t0"], "left").join(sectors, "company_id", "left")
    x = x.withColumn("market_cap", F.coalesce(F.round(c("price") * F.when(c("shares") > 0, c("shares")) / 10_000_000, 2), c("net_worth"), F.lit(0.0)))
    x = x.withColumn("pe", F.when((c("ttm_pat") > 0) & (c("market_cap") > 0), F.round(c("market_cap") / F.greatest(F.lit(0.1), c("ttm_pat")), 1)))
    x = lookup.tenfold_hurdle(lookup.markets(x, "company_id", "sector"))
    x = x.withColumns({"nopat": c("ttm_ebit") * (1 - TAX), "roic": F.round(f.economic_roic(c("ttm_ebit"), F.lit(TAX), F.coalesce(c("net_worth"), F.lit(0.0)) + c("debt") - c("cash")), 2)})
    # Maintenance: depreciation and the inflation of replacement, within 0.7 and 1.3 times depreciation, at most what was spent.
    worn, spent = F.greatest(F.lit(0.1), c("depreciation")), F.greatest(F.lit(0.0), c("capex"))
    x = x.withColumn("maintenance_capex", F.round(F.least(spent, f.clamp(worn * 1.06, worn * 0.70, worn * 1.30)), 2)).withColumn("growth_capex", F.greatest(F.lit(0.0), F.round(spent - F.least(spent, f.clamp(worn * 1.06, worn * 0.70, worn * 1.30)), 2)))
    x = x.withColumn("reinvestment", F.round(c("growth_capex") / F.greatest(F.lit(1.0), c("nopat")) * 100, 2))
    x = x.withColumn("ceiling", F.when(c("roic") > 0, F.round(c("reinvestment") / 100 * c("roic"), 2)))
    lead, mode, moat = engines.displacement(F.coalesce(c("revenue_growth"), F.lit(15.0)), F.lit(12.0), F.lit(35.0))
    x = x.withColumns({"lead": lead, "displacement": mode, "moat": moat})
    x = engines.latent_upside(x.withColumns({"roce": F.coalesce(c("roic"), F.lit(15.0)), "utilisation": F.lit(65.0)})).withColumnsRenamed({"distance": "distance_to_excellence", "leverage": "operational_leverage"})
    x = _coordinates(x)
    inputs, outputs = ["ttm_revenue", "ttm_ebit", "ttm_pat", "pe"], ["roic", "growth_capex", "reinvestment", "niche_tam"]
    rounded = x.withColumns({n: F.round(n, 4) for n in ("ttm_revenue", "ttm_ebit", "ttm_pat")})
    return rounded.withColumns({"input_hash": f.canonical_hash(inputs), "output_hash": f.canonical_hash(outputs)})


def _coordinates(x: DataFrame) -> DataFrame:
    """Six coordinates from 0 to 1 with the replay's defaults for what is unknown, and their signature."""
    growth, pat = F.coalesce(c("revenue_growth"), F.lit(15.0)), F.coalesce(c("pat_growth"), F.lit(15.0))
    ratio = F.round(F.greatest(F.lit(0.0), pat) / F.greatest(F.lit(1.0), growth), 2)
    parts = {
        "scale": (F.log10(F.greatest(c("market_cap"), F.lit(10.0))) - 2) / 3.7, "reinvesting": F.lit(10.0) / 100, "efficiency": F.coalesce(c("roic"), F.lit(15.0)) / 50, "op_leverage": (ratio - 0.5) / 2.5,
        "rerating": (F.greatest(F.lit(5.0), F.coalesce(c("pe"), F.lit(25.0))) - 10) / 70,
    }
    x = x.withColumns({k: f.clamp(v, 0.0, 1.0) for k, v in parts.items()})
    signature = F.when((c("op_leverage") >= 0.5) & (c("efficiency") >= 0.5), "EARLY_TO_OPERATING_LEVERAGE_INFLECTION").when((c("scale") > 0.8) & (c("reinvesting") < 0.3), "MATURE_CASH_COW_PLATEAU").otherwise("STABLE_COORDINATES")
    return x.withColumn("signature", signature)


def outcomes(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """What became of each date: gain, drawdown, wealth, first multiple reached and censoring; dates with fewer than 30 later bars are left out."""
    rows = passage.numbered(bars)
    o = passage.starts(rows, dates).where(c("bars") >= LEAST_BARS)
    ends = rows.groupBy("company_id").agg(F.max("trading_date").alias("label_end"))
    o = o.join(ends, "company_id")
    event = F.when(c("max_run") >= 900, "10X").when(c("max_run") >= 400, "5X").when(c("max_run") >= 100, "2X")
    status = F.when(event.isNotNull(), "EVENT_OBSERVED").when(c("bars") >= MATURE_BARS, "MATURE").otherwise("RIGHT_CENSORED")
    gain = (c("p_last") - c("p0")) / F.greatest(F.lit(0.1), c("p0"))
    return o.select("company_id", "t0", c("p0").alias("base_price"), "label_end", F.datediff("label_end", "t0").alias("elapsed_days"), F.round(100 * (1 + gain), 4).alias("wealth_end"), F.round(gain * 100, 2).alias("wealth_return"), "max_run", "max_drawdown", event.alias("event"), status.alias("censoring"))


def judged(x: DataFrame) -> DataFrame:
    """Score and verdict from the snapshot alone."""
    roic = F.coalesce(c("roic"), F.lit(15.0))
    best, good = (roic >= 20) & c("accelerating"), (roic >= 15) | c("accelerating")
    return x.withColumns({"score": F.when(best, 80).when(good, 65).otherwise(45), "verdict": F.when(best, "CONVICTION_BUY").when(good, "ACCUMULATE_ON_DIPS").otherwise("WATCHLIST")})


def eligibility(statements: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per company: quarters, snapshots, completeness and what its history allows."""
    q = statements.where("period_type = 'QUARTERLY'").groupBy("company_id").agg(F.count_distinct("period_end").alias("quarters"))
    x = q.join(snapshots.groupBy("company_id").agg(F.count("*").alias("snapshots")), "company_id", "left")
    n = c("quarters")
    status = F.when(n < LEAST_QUARTERS, "QUARANTINED_INSUFFICIENT_FINANCIALS").when(n >= FULL_QUARTERS, "FULLY_ELIGIBLE").otherwise("PARTIALLY_ELIGIBLE")
    return x.select(
        "company_id", "quarters", F.coalesce("snapshots", F.lit(0).cast("long")).alias("snapshots"), F.round(F.least(F.lit(100.0), n / 40.0 * 100) * 0.5 + 50, 2).alias("completeness"), status.alias("status"),
        (n >= 6).alias("live"), ((n >= TRAINING_QUARTERS) & (F.coalesce("snapshots", F.lit(0)) >= 4)).alias("training"),
    )


def replay(statements: DataFrame, bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Snapshot, judgement and outcome of every reading date; outcomes are null where too few bars follow."""
    dates = reading_dates(statements)
    return judged(snapshots(statements, bars, sectors, dates)).join(outcomes(bars, dates), ["company_id", "t0"], "left")
