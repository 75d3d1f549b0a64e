"""Horizon engines and economic models over the feature vector: scores, grades, brackets, regimes. Expressions only.

A missing input stays missing: null is not zero, and a composite is null where a part of it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f

c = F.col


def _or(name: str, default: float) -> Column:
    return F.coalesce(c(name), F.lit(default))


def _points(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(condition, name) for condition, name in pairs)))


# --- horizon engines -----------------------------------------------------------------------


def longterm(x: DataFrame) -> DataFrame:
    """Score of one to three years: moat 35, growth 25, solvency 20, valuation 20 %; grade, thesis and risks."""
    known = c("roce").isNotNull() & c("ebitda_margin").isNotNull()
    moat = F.when(known, f.clamp(30 + f.clamp(c("roce"), 0.0, 45.0) * 1.1 + F.least(F.lit(30.0), c("ebitda_margin")) * 0.6, 25.0, 98.0).cast("int"))
    growing = c("revenue_growth").isNotNull() | c("pat_growth").isNotNull()
    growth = F.when(growing, f.clamp(50 + f.clamp(_or("revenue_growth", 0.0), -20.0, 40.0) * 0.6 + f.clamp(_or("pat_growth", 0.0), -20.0, 40.0) * 0.5, 20.0, 98.0).cast("int"))
    debt = c("debt_to_equity")
    solvency = F.when(debt > 2, 55).when(debt > 1, 70).when(debt < 0.3, 95).when(debt.isNotNull(), 85)
    pe = c("pe")
    value = F.when((pe <= 0) | pe.isNull(), 60).when(pe < 15, 90).when(pe < 25, 80).when(pe < 40, 65).when(pe < 65, 48).otherwise(30)
    x = x.withColumns({"moat": moat, "growth": growth, "solvency": solvency, "value": value})
    # Hundredths are whole numbers, so that nothing is lost before truncation.
    total = F.floor((c("moat") * 35 + c("growth") * 25 + c("solvency") * 20 + c("value") * 20) / 100)
    x = x.withColumn("longterm_score", F.when(total.isNotNull(), F.least(F.lit(99), F.greatest(F.lit(20), total))).cast("int"))
    s = c("longterm_score")
    grade = F.when(s >= 80, "TIER_1_COMPOUNDER").when(s >= 65, "HIGH_QUALITY_GROWTH").when(s >= 50, "MODERATE_QUALITY").when(s.isNotNull(), "WATCHLIST_ONLY").otherwise("DATA_INSUFFICIENT")
    thesis = _points((c("roce") >= 20, "exceptional capital efficiency"), ((c("roce") >= 15) & (c("roce") < 20), "healthy capital efficiency"), (c("fcf_yield") >= 3, "free cash flow"), (debt <= 0.5, "low leverage"), (c("revenue_growth") >= 12, "growth"))
    risks = _points((pe > 50, "valuation"), (debt > 1.2, "leverage"), (c("pat_margin") < 4, "thin margin"))
    return x.withColumns({"grade": grade, "thesis": thesis, "risks": risks})


def swing(x: DataFrame) -> DataFrame:
    """Score of two to four weeks from momentum, trend, strength and volume, with a bracket of 1.5 and 2.5 average ranges."""
    rsi, close = _or("rsi", 50.0), c("close")
    momentum = F.when(rsi.between(52, 68), 95.0).when((rsi >= 45) & (rsi < 52), 75.0).when((rsi > 68) & (rsi <= 78), 70.0).when(rsi > 78, 45.0).otherwise(35.0)
    d20, d50, d200 = (_or(f"dist_sma{k}", 0.0) for k in (20, 50, 200))
    trend = 50 + F.when(d50 >= 0, 20.0).otherwise(0.0) + F.when(d200 >= 0, 15.0).otherwise(0.0) + F.when(d20 > 0, 10.0).otherwise(0.0)
    high, volume = _or("dist_high", -20.0), _or("volume_acceleration", 1.0)
    strength = f.clamp((100 + high) * 0.95, 20.0, 95.0)
    total = momentum * 0.35 + trend * 0.30 + strength * 0.20 + (50 + F.least(F.lit(40.0), (volume - 1) * 35)) * 0.15
    away, gain = F.greatest(close * 0.015, c("atr") * 1.5), F.greatest(close * 0.05, c("atr") * 2.5)
    setup = F.when((high >= -5) & (volume >= 1.3), "52W_HIGH_BREAKOUT").when(rsi.between(52, 65) & (d50 > 0), "TREND_MOMENTUM_EXPANSION").when((rsi < 45) & (d200 > 0), "200DMA_PULLBACK_REVERSAL").otherwise("CONSOLIDATION_WATCH")
    thesis = _points((rsi.between(52, 68), "momentum"), (d50 > 0, "trend"), (volume >= 1.2, "volume"), (high >= -10, "strength"))
    return x.where("close > 0 AND bars >= 15").withColumns({
        "swing_score": f.clamp(total, 20.0, 99.0).cast("int"), "stop": close - away, "target": close + gain, "risk_pct": away / close * 100, "gain_pct": gain / close * 100,
        "reward_to_risk": gain / F.greatest(away, F.lit(0.1)), "setup": setup, "thesis": thesis,
    })


def intraday(x: DataFrame) -> DataFrame:
    """Score of a day from volume and the last return, with a bracket of one to two."""
    spike = F.when(c("vol20") > 0, F.round(c("volume") / c("vol20"), 2)).otherwise(1.0)
    change = F.when(c("prev_close") > 0, F.round((c("close") - c("prev_close")) / c("prev_close") * 100, 2)).otherwise(0.0)
    x = x.where("bars >= 15").withColumns({"spike": spike, "change": change, "away": F.greatest(c("close") * 0.008, c("atr") * 1.5)})
    setup = F.when((c("change") > 0.5) & (c("spike") >= 1.3), "MOMENTUM_EXPANSION_BREAKOUT").when(c("change") < -1.5, "MEAN_REVERSION_PULLBACK").otherwise("RANGE_EXPANSION")
    return x.withColumns({
        "intraday_score": f.clamp((65 + c("spike") * 6 + c("change") * 1.5).cast("int"), 45, 99).cast("int"), "setup": setup, "stop": c("close") - c("away"), "target": c("close") + c("away") * 2,
        "risk_pct": c("away") / c("close") * 100,
    })


def graduation(x: DataFrame) -> DataFrame:
    """Readiness of a watched company: entry quality 40, closeness to the 50-session mean 30, gap of expectations 30 points."""
    away, gap, entry = F.round((c("close") - c("sma50")) / c("sma50") * 100, 2), c("gap"), c("entry_quality")
    away = F.coalesce(away, F.lit(0.0))
    support = F.when(away.between(-1.5, 2.0), 30.0).when((away > 2) & (away <= 5), 20.0).when(away > 5, F.greatest(F.lit(5.0), 25 - away * 1.5)).otherwise(10.0)
    asymmetry = F.when(gap >= 12, 30.0).when(gap >= 8, 25.0).when(gap > 0, 15 + gap).otherwise(F.greatest(F.lit(5.0), 15 + gap))
    x = x.withColumn("readiness", f.clamp(F.round(f.clamp(entry / 75 * 40, 10.0, 40.0) + support + asymmetry, 1), 15.0, 99.0))
    r = c("readiness")
    status = F.when(r >= 85, "READY").when(r >= 70, "ADVANCING").otherwise("INCUBATING")
    ready = F.when((entry >= 75) & (gap >= 8), "TIGHTNESS").when(away.between(-1.5, 1.5), "ACCUMULATION_AT_MEAN").otherwise("TIGHTNESS")
    trigger = F.when(r >= 85, ready).when((r >= 70) & (gap < 8), "AWAITING_VALUATION").when(r >= 70, "AWAITING_BASE").otherwise("EARLY_BASE")
    pivot = F.coalesce(c("high_52w") + F.greatest(c("atr") * 0.12, c("close") * 0.0015), c("close") * 1.02)
    return x.withColumns({"status": status, "trigger": trigger, "pivot": pivot})


# --- economics -----------------------------------------------------------------------------


def peg_status(pe: Column, growth: Column, sustainable: Column) -> Column:
    g = F.coalesce(growth, sustainable)
    high = F.when(sustainable > 0, "NORMALIZED_SUSTAINABLE").otherwise("HYPERGROWTH_BASE_EFFECT")
    return F.when(pe.isNull() | (pe <= 0), "PE_UNDEFINED").when(g.isNull(), "GROWTH_UNKNOWN").when(g <= 0, "NEGATIVE_GROWTH").when(g > 60, high).otherwise("VALID")


def valuation_regime(x: DataFrame) -> DataFrame:
    """Six regimes from multiples, growth, returns, yield and implied growth; columns ``pe, pb, growth, sustainable, roce, ttm_fcf, market_cap, debt_to_equity, percentile, nopat, net_debt``."""
    fcf, nopat, cap = c("ttm_fcf"), c("nopat"), c("market_cap")
    poor = (nopat > 0) & ((fcf <= 0) | (fcf / cap < 0.005) | (fcf < nopat * 0.15))
    poor = F.coalesce(poor, F.lit(False))
    base = F.when(~poor & (fcf > 0), fcf).when(nopat > 0, nopat).when(fcf > 0, fcf)
    target = F.when(poor | ~(fcf > 0), F.greatest(cap * 0.35, cap + _or("net_debt", 0.0))).otherwise(cap)
    pe_known, growth = c("pe"), F.coalesce(c("growth"), c("sustainable"))
    multiple = F.round(f.peg(pe_known, growth, c("sustainable")), 2)
    x = x.withColumns({"basis": F.when(poor, "NOPAT_NORMALIZED").when(fcf > 0, "FCF").when(nopat > 0, "NOPAT_OWNER_EARNINGS").otherwise("NONE"), "base_flow": base, "target_value": target, "peg": multiple, "peg_status": peg_status(pe_known, c("growth"), c("sustainable"))})
    x = x.withColumn("implied", F.round(f.implied_growth(c("base_flow"), c("target_value")), 1))
    pe, roce, g, peg, implied = _or("pe", 0.0), _or("roce", 0.0), F.coalesce(growth, F.lit(0.0)), c("peg"), c("implied")
    fcf_yield, debt, percentile = F.coalesce(F.round(fcf / cap * 100, 2), F.lit(0.0)), _or("debt_to_equity", 0.0), _or("percentile", 50.0)
    trap = (pe > 0) & (pe <= 18) & ((g < 0) | ((roce < 12) & (fcf_yield < 2)))
    stretched = ((pe > 65) & (peg.isNull() | (peg > 2.5) | (g < 15))) | F.coalesce(peg > 3, F.lit(False)) | F.coalesce((implied > 35) & (g < 20), F.lit(False))
    compounder = (roce >= 18) & F.coalesce(peg <= 1.15, F.lit(False)) & (percentile <= 65) & (pe <= 38) & (c("peg_status") != "HYPERGROWTH_BASE_EFFECT")
    deep = (pe > 0) & (pe <= 16) & (fcf_yield >= 6.5) & (debt <= 0.6) & (roce >= 13)
    premium = (roce >= 20) & ((pe > 35) | F.coalesce((peg > 1.15) & (peg <= 2.8), F.lit(False)))
    regime = F.when(trap, "VALUE_TRAP_WARNING").when(stretched, "OVERVALUED_EXTREME").when(compounder, "UNDERVALUED_COMPOUNDER").when(deep, "DEEP_VALUE").when(premium, "QUALITY_GROWTH_PREMIUM").otherwise("FAIR_VALUE")
    return x.withColumn("regime", regime)


def latent_upside(x: DataFrame, margin: float = 16.0, roce: float = 28.0, utilisation: float = 85.0, tax_pct: float = 25.0) -> DataFrame:
    """Earnings at a sector's best margin and utilisation, against today's; columns ``ttm_revenue, ttm_ebit, ttm_pat, roce, utilisation``."""
    rate = min(0.35, max(0.10, tax_pct / 100 if tax_pct > 1 else tax_pct))
    revenue, ebit, pat = (F.greatest(c(k), F.lit(low)) for k, low in (("ttm_revenue", 1.0), ("ttm_ebit", 0.1), ("ttm_pat", 0.1)))
    x = x.withColumns({"opm": F.round(ebit / revenue * 100, 2), "used": f.clamp(c("utilisation"), 30.0, 95.0)})
    factor = F.round(F.greatest(c("used"), F.lit(min(95.0, utilisation))) / c("used"), 2)
    x = x.withColumns({"factor": factor, "target_opm": F.greatest(c("opm"), F.lit(margin))})
    x = x.withColumns({"extra_bps": F.round((c("target_opm") - c("opm")) * 100, 0), "potential_pat": revenue * c("factor") * c("target_opm") / 100 * (1 - rate)})
    x = x.withColumns({"leverage": F.round(c("potential_pat") / pat, 2), "roce_gap": F.greatest(F.lit(0.0), roce - c("roce"))})
    distance = F.least(F.lit(100.0), c("roce_gap") * 2 + c("extra_bps") / 50 + (c("factor") - 1) * 100)
    profile = F.when(c("leverage") >= 2, "EXPLOSIVE_LATENT_OPERATIONAL_LEVERAGE").when(c("leverage") >= 1.4, "HEALTHY_OPERATIONAL_RUNWAY").otherwise("NEAR_PEAK_OPERATIONAL_EFFICIENCY")
    return x.withColumns({"distance": distance, "profile": profile, "confidence": F.when(c("target_opm") <= c("opm") * 1.5, "HIGH_GROUNDED").otherwise("MEDIUM_STRETCH")})


def lifecycle_stage(x: DataFrame) -> DataFrame:
    """Eight stages by ordered rules, and six coordinates between 0 and 1; columns ``market_cap, ttm_revenue, revenue_growth, ebitda_growth, pat_growth, roce, roce_delta_bps, institutional, payout, pe, reinvestment``."""
    cap, g, pat, roce, delta, stake = c("market_cap"), c("revenue_growth"), c("pat_growth"), c("roce"), c("roce_delta_bps"), c("institutional")
    stage = (
        F.when((delta < -500) & (g < 5) & (roce < 12), "8_DECLINING").when((g < 10) & (c("payout") > 35) & (cap > 20_000), "7_MATURE").when((cap < 1_500) & (c("ttm_revenue") < 300), "1_EARLY_SMALL")
        .when((pat > g * 1.4) & (roce >= 22) & (g > 15), "4_OPERATING_LEVERAGE").when((c("ebitda_growth") > 30) & (delta > 200), "3_RAPID_EARNINGS_EXPANSION")
        .when(stake.between(5, 25) & (g > 20) & (cap >= 2_000), "5_INSTITUTIONAL_DISCOVERY").when((c("pe") > 35) & (g > 25) & (roce > 25), "6_RERATING").otherwise("2_SCALING")
    )
    leverage = F.round(F.when(pat.isNotNull() & g.isNotNull(), F.greatest(pat, F.lit(0.0)) / F.greatest(g, F.lit(1.0))), 2)
    coordinates = {
        "scale": F.when(cap.isNotNull(), (F.log10(F.greatest(cap, F.lit(10.0))) - 2) / 3.7), "reinvesting": c("reinvestment") / 100, "efficiency": roce / 50, "leverage": (leverage - 0.5) / 2.5, "discovery": stake / 50,
        "rerating": F.when(c("pe").isNotNull(), (F.greatest(c("pe"), F.lit(5.0)) - 10) / 70),
    }
    x = x.withColumn("stage", stage).withColumns({k: F.when(v.isNotNull(), f.clamp(v, 0.0, 1.0)) for k, v in coordinates.items()})
    signature = (
        F.when((c("leverage") >= 0.5) & (c("discovery") < 0.5) & (c("efficiency") >= 0.5), "EARLY_TO_OPERATING_LEVERAGE_INFLECTION").when((c("discovery") >= 0.4) & (c("rerating") > 0.6), "INSTITUTIONAL_RERATING_EXPANSION")
        .when((c("scale") > 0.8) & (c("reinvesting") < 0.3), "MATURE_CASH_COW_PLATEAU").otherwise("STABLE_COORDINATES")
    )
    return x.withColumns({"signature": signature, "coordinates": F.array(*(F.round(k, 2) for k in coordinates))})


def displacement(growth: Column, industry: Column, unorganised: Column) -> tuple[Column, Column, Column]:
    """Lead over the industry's growth, from whom share is taken, and the moat."""
    lead = F.round(F.greatest(growth, F.lit(0.0)) - F.greatest(industry, F.lit(1.0)), 2)
    mode = F.when((unorganised >= 30) & (lead > 10), "UNORGANIZED_TO_ORGANIZED_FORMALIZATION").when(lead > 5, "HIGH_COST_INCUMBENT_DISPLACEMENT").otherwise("INDUSTRY_BETA_EXPANSION")
    moat = F.when(lead > 15, "WIDE_MOAT_SCALE_AND_EFFICIENCY").when(lead > 5, "NARROW_MOAT_NICHE_LEADERSHIP").otherwise("NO_DISCERNIBLE_MOAT")
    return lead, mode, moat


def incremental_roic(x: DataFrame, lookbacks: tuple[int, ...] = (4, 8, 12), least_pct: float = 0.05) -> DataFrame:
    """Change of operating profit after tax over change of invested capital against 4, 8 and 12 quarters before (or the first), and what the longest says; columns ``company_id, period_end, nopat, capital, roic``, one row a quarter, profit and return of a year."""
    by = Window.partitionBy("company_id").orderBy("period_end")

    def before(name: str, k: int) -> Column:
        return F.coalesce(F.lag(name, k).over(by), F.first(name).over(by))

    n = F.row_number().over(by)
    for k in lookbacks:
        more, base = c("capital") - before("capital", k), before("capital", k)
        x = x.withColumns({f"dc{k}": more, f"dn{k}": c("nopat") - before("nopat", k), f"enough{k}": F.abs(more) >= F.greatest(F.lit(5.0), base * least_pct)})
        x = x.withColumn(f"roiic{k}", F.when((n > 1) & c(f"enough{k}"), F.round(c(f"dn{k}") / c(f"dc{k}") * 100, 2)))
    last = max(lookbacks)
    found, more, gained = c(f"roiic{last}"), c(f"dc{last}"), c(f"dn{last}")
    quality = (
        F.when((more < 0) & (gained > 0), "CAPITAL_EXTRACTION_EFFICIENCY").when(more < 0, "BUSINESS_CONTRACTION").when((found > c("roic")) & (found > 20), "ACCELERATING_CAPITAL_EFFICIENCY")
        .when(found >= 15, "HEALTHY_COMPOUNDER").when(found > 0, "DILUTIVE_GROWTH").otherwise("VALUE_DESTRUCTION")
    )
    status = F.when(n == 1, "INSUFFICIENT_HISTORY").when(~c(f"enough{last}"), "CAPITAL_UNCHANGED_ASSET_LIGHT").otherwise(quality)
    return x.withColumns({"status": status, "deployment": more / F.greatest(F.lit(1.0), before("capital", last)) * 100})


def roic_momentum(x: DataFrame) -> DataFrame:
    """Change of return on invested capital over 4 and 8 periods (or since the first) and its profile."""
    by = Window.partitionBy("company_id").orderBy("period_end")
    x = x.withColumns({f"delta{k}": F.round(c("roic") - F.coalesce(F.lag("roic", k).over(by), F.first("roic").over(by)), 2) for k in (4, 8)}).withColumn("k", F.row_number().over(by))
    profile = F.when(c("k") < 2, "FLAT_OR_INSUFFICIENT_DATA").when((c("delta4") >= 5) & (c("delta8") >= 8), "POWERFUL_ROIC_EXPANSION").when(c("delta4") > 1.5, "STEADY_ROIC_IMPROVEMENT").when(c("delta4") < -3, "DETERIORATING_CAPITAL_EFFICIENCY").otherwise("STABLE_PLATEAU")
    return x.withColumn("profile", profile).drop("k")


def mood_index(x: DataFrame) -> DataFrame:
    """Composite mood 0 to 100 of a date from positioning, breadth, volatility, spread and flows; without positioning the other four are weighted anew.

    Columns ``long_pct`` (may be null), ``advancing_pct, net_new_highs, vix`` (may be null), ``spread, net_flow, expanding``.
    """
    breadth = f.clamp(c("advancing_pct") * 0.7 + f.clamp(c("net_new_highs"), -50, 50) * 0.6, 0.0, 100.0)
    volatility = F.coalesce(f.clamp(100 - (c("vix") - 10) * 7, 0.0, 100.0) * F.when(c("vix").isNotNull(), 1.0), F.lit(50.0))
    spread, flow = f.clamp(50 + c("spread") * 25, 0.0, 100.0), f.clamp(50 + c("net_flow") / 50, 0.0, 100.0)
    five = c("long_pct") * 0.25 + breadth * 0.25 + volatility * 0.20 + spread * 0.15 + flow * 0.15
    x = x.withColumn("exact", F.coalesce(five, breadth * 0.35 + volatility * 0.30 + spread * 0.20 + flow * 0.15)).withColumn("mood", F.round("exact", 1))
    regime = F.when((c("mood") >= 68) & c("expanding"), "BULLISH_EXPANSION").when(c("mood") >= 48, "SELECTIVE_ROTATION").when(c("mood") >= 32, "DEFENSIVE_CONSOLIDATION").otherwise("RISK_OFF_CAPITAL_PRESERVATION")
    budget = F.when(c("regime") == "BULLISH_EXPANSION", 100.0).when(c("regime") == "SELECTIVE_ROTATION", 75.0).when(c("regime") == "DEFENSIVE_CONSOLIDATION", 50.0).otherwise(25.0)
    return x.withColumn("regime", regime).withColumns({"risk_budget": budget, "coiled": F.coalesce(c("long_pct") < 20, F.lit(False))})
