"""The staged screen over the feature vector: eligibility, prescreen, stratified choice, deep evaluation, routing to feeds.

All stages are columns of one plan: every company at every date carries the stage
that it reached, the gate that stopped it, its evaluation and its feeds, so that
attrition is one aggregate and no stage runs twice. Rounding is decimal by floor
(:func:`.setups.half_up`), the same on every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from . import lookup, paths, scores, setups, timeline
from . import windows as w
from .quality import _conversion_status
from .setups import half_up

c = F.col

# Sector groups by words of a company's industry, in order of precedence.
CATEGORY_WORDS = (
    ("FINANCIALS", ("bank", "finance", "financial", "housing", "insurance", "capital markets", "lending", "nbfc")),
    ("COMMODITIES_MATERIALS", ("steel", "metals", "mining", "aluminum", "zinc", "copper", "chemical", "fertilizer", "refinery")),
    ("UTILITIES_POWER", ("power", "energy", "transmission", "utility", "electricity", "gas distribution")),
    ("INDUSTRIALS_CAPGOODS", ("engineering", "capital goods", "infrastructure", "construction", "heavy equipment", "epc")),
)
OTHER_CATEGORY = "ASSET_LIGHT_GROWTH"
# Upper ends of the small and middle market values in crore and the shares of each size in a choice.
SMALL_CAP, MIDDLE_CAP, SHARES, MOST_CHOSEN = 5_000.0, 25_000.0, (0.40, 0.36, 0.24), 50
TAX = 0.25


@dataclass(frozen=True)
class Screen:
    """A request: thresholds of the prescreen, and how many are wanted."""

    min_market_cap: float = 250.0
    max_market_cap: float | None = None
    min_quality: float = 15.0
    min_growth: float = 12.0
    max_debt: float = 1.2
    max_pe: float | None = None
    near_high_pct: float = 35.0
    stage_2_only: bool = False
    limit: int = 30


def _or(name: str, default: float) -> Column:
    return F.coalesce(c(name), F.lit(default))


# --- inputs --------------------------------------------------------------------------------


def categories(x: DataFrame, industry: str) -> DataFrame:
    """``x`` plus ``category``: the first group with a word in the industry's name."""
    words = x.sparkSession.createDataFrame([(i, word, name) for i, (name, ws) in enumerate(CATEGORY_WORDS) for word in ws], "_order int, _term string, _category string")
    out = lookup.first_contained(x, industry, words, "_term", "_order", equal_first=False)
    return out.select(*x.columns, F.coalesce("_category", F.lit(OTHER_CATEGORY)).alias("category"))


def structure(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per bar what the tape says: stage and structure score, setup, ranges and volumes. All windows share one sort."""
    x = paths.accumulation(paths.contraction(w.stage(w.indicators(bars))))
    one = w.last_bars
    x = x.withColumns({
        "support": F.min("low").over(one(20)), "high_1m": F.max("high").over(one(22)), "high_3m": F.max("high").over(one(66)), "rvol": half_up(c("volume") / c("vol20_before"), 2), "range_expansion": half_up((c("high") - c("low") - c("atr20")) / c("atr20") * 100, 1),
        "vwap_gap": half_up((c("close") - (c("high") + c("low") + c("close")) / 3) / ((c("high") + c("low") + c("close")) / 3) * 100, 2), "turnover": half_up(c("vol20_before") * c("close") / 10_000_000, 6),
    })
    x = x.join(benchmark.select("trading_date", c("close").alias("benchmark")), "trading_date").join(setups.market_regime(benchmark), "trading_date")
    x = x.withColumn("rs", c("close") / c("benchmark"))
    x = x.withColumn("score", F.when(c("n") >= 50, (c("rs") / F.avg("rs").over(one(50)) - 1) * 100))
    x = setups.audit(scores.structure_score(x.withColumn("contracted", F.coalesce("contracted", F.lit(False)))))
    return x.select(
        "company_id", "trading_date", "stage", "technical_score", "breaker", "support", "high_1m", "high_3m", "rvol", "range_expansion", "vwap_gap", "turnover", "setup", "pivot", "stop", "t1", "t2", "risk_pct", "reward", "status", "readiness",
    )


def statement_items(statements: DataFrame, dates: DataFrame) -> DataFrame:
    """Per date the newest known items that not every quarter reports, and how operating profit moved."""
    x = timeline.carried_periods(statements, dates, "QUARTERLY", 8)
    newest = lambda k: F.get(F.filter("periods", lambda p: p[k].isNotNull()), F.lit(0))[k]
    e = lambda k: F.get("periods", F.lit(k))["ebitda"]
    n = F.size("periods")
    second = F.when(n >= 6, (e(0) - e(4)) - (e(1) - e(5))).when(n == 5, (e(0) - e(4)) - (e(1) - e(2))).when(n >= 3, (e(0) - e(1)) - (e(1) - e(2)))
    first = F.when(n >= 5, e(0) - e(4)).when(n >= 3, e(0) - e(1))
    method = F.when(n >= 6, "YOY_DESEASONALIZED").when(n == 5, "HYBRID_YOY").when(n >= 3, "SEQUENTIAL").otherwise("INSUFFICIENT")
    return x.select(
        "company_id", "t0", *(newest(k).alias(k) for k in ("receivables", "inventories", "payables", "cfo", "capex", "depreciation")), F.get("periods", F.lit(0))["ebitda"].alias("quarter_ebitda"),
        method.alias("acceleration_method"), half_up(second, 2).alias("acceleration"), ((second > 0) & (first > 0)).alias("is_accelerating"),
    )


def panel(vector: DataFrame, statements: DataFrame, bars: DataFrame, benchmark: DataFrame, industries: DataFrame) -> DataFrame:
    """What the screen reads of each ``(company_id, t0)``; ``industries(company_id, industry, sector)``."""
    x = vector.join(statement_items(statements, vector.select("company_id", "t0")), ["company_id", "t0"]).join(industries, "company_id", "left")
    x = x.join(structure(bars, benchmark), ["company_id", "trading_date"], "left")
    return categories(lookup.markets(x, "company_id", "sector"), "industry")


# --- stage 2 -------------------------------------------------------------------------------


def prescreen(x: DataFrame, request: Screen) -> DataFrame:
    """``gate``: the first gate that stops the company, null if none; ``rank``: its factor score. What is not known stops nobody but for a balance sheet, a price and shares."""
    financial = c("category") == "FINANCIALS"
    x = x.withColumns({"financial": financial, "roe": half_up(c("ttm_pat") / F.greatest(F.lit(10.0), c("net_worth")) * 100, 1)})
    x = x.withColumn("quality", F.when(c("financial"), F.coalesce("roe", F.lit(0.0))).otherwise(F.coalesce(half_up(c("roce"), 1), F.lit(0.0))))
    debt, growth = c("debt_to_equity"), half_up(c("revenue_growth"), 1)
    away = (c("high_52w") - c("close")) / c("high_52w") * 100
    unbounded = F.lit(False)
    gate = (
        F.when(c("net_worth").isNull(), "NO_BALANCE_SHEET").when(c("net_worth") <= 0, "INSOLVENT").when(c("close").isNull(), "NO_PRICE").when(c("market_cap").isNull(), "NO_SHARES").when(away > request.near_high_pct, "FAR_FROM_HIGH")
        .when(F.coalesce(~((c("close") > c("sma50")) & (c("sma50") > c("sma200"))), F.lit(True)) if request.stage_2_only else unbounded, "NOT_IN_UPTREND").when(~c("financial") & (debt > 4), "LEVERAGE").when(c("market_cap") < request.min_market_cap, "TOO_SMALL")
        .when(c("market_cap") > request.max_market_cap if request.max_market_cap is not None else unbounded, "TOO_LARGE").when(c("quality") < request.min_quality, "LOW_QUALITY").when(~c("financial") & (debt > request.max_debt), "DEBT")
        .when((growth < request.min_growth) if request.min_growth > 0 else unbounded, "LOW_GROWTH").when(c("pe") > request.max_pe if request.max_pe is not None else unbounded, "HIGH_PE")
    )
    efficiency = F.when(c("financial"), f.clamp(c("quality") / 16.0 * 80.0, 20.0, 100.0)).otherwise(f.clamp(c("quality") / 25.0 * 80.0, 10.0, 100.0))
    solvency = F.when(c("financial"), 80.0).otherwise(f.clamp(100.0 - F.coalesce(debt, F.lit(0.0)) * 35.0, 20.0, 100.0))
    rising = f.clamp(F.coalesce(growth, F.lit(0.0)) / 20.0 * 85.0, 30.0, 100.0)
    return x.withColumns({"gate": gate, "rank": half_up(efficiency * 0.40 + solvency * 0.35 + rising * 0.25, 1)})


# --- stage 3 -------------------------------------------------------------------------------


def stratified(x: DataFrame, limit: int) -> DataFrame:
    """``chosen``: among the survivors of a date so many of each market size, best ranks first, and the best of the rest where places are left."""
    most = min(2 * limit, MOST_CHOSEN)
    alive = c("gate").isNull()
    size = F.when(c("market_cap") <= SMALL_CAP, 0).when(c("market_cap") <= MIDDLE_CAP, 1).otherwise(2)
    best = [F.desc("rank"), F.col("company_id")]
    x = x.withColumns({"alive": alive, "size": size})
    x = x.withColumn("in_size", F.row_number().over(Window.partitionBy("t0", "alive", "size").orderBy(*best)))
    quota = F.when(c("size") == 0, max(1, round(most * SHARES[0]))).when(c("size") == 1, max(1, round(most * SHARES[1]))).otherwise(max(1, round(most * SHARES[2])))
    x = x.withColumn("by_quota", c("alive") & (c("in_size") <= quota))
    order = Window.partitionBy("t0").orderBy(F.desc("alive"), F.desc("by_quota"), F.when(c("by_quota"), c("size")), *best)
    return x.withColumn("turn", F.row_number().over(order)).withColumn("chosen", c("alive") & (c("turn") <= most)).drop("alive", "size", "in_size", "by_quota", "turn")


def evaluate(x: DataFrame) -> DataFrame:
    """Five pillars, four vectors and what follows from them; columns of :func:`panel`."""
    return_, growth = F.coalesce(half_up(c("roce"), 1), F.lit(20.0)), _or("revenue_growth", 0.0)
    x = x.withColumns({"return": return_, "nopat": c("ttm_ebit") * (1 - TAX)})
    x = x.withColumn("p1", half_up(f.clamp(c("return") * 0.70 + growth * 0.30, 15.0, 100.0), 1))
    # Reinvestment: spending beyond what replaces worn capital.
    spends = F.coalesce((c("capex") > 0) & (c("ttm_revenue") > 0), F.lit(False))
    worn = F.greatest(F.lit(0.1), _or("depreciation", 0.0))
    more = F.greatest(F.lit(0.0), half_up(c("capex") - F.least(c("capex"), worn * 1.06), 2))
    x = x.withColumn("growth_capex", F.when(spends, more))
    x = x.withColumns({
        "reinvested": F.when(spends, f.clamp(half_up(c("growth_capex") / F.greatest(F.lit(1.0), c("nopat")) * 100, 2), 10.0, 90.0)).otherwise(30.0),
        "p2": F.when(spends, half_up(f.clamp(50.0 + half_up(c("growth_capex") / F.greatest(F.lit(0.1), c("capex")) * 100, 1) * 0.50, 25.0, 100.0), 1)).otherwise(50.0),
    })
    # Working capital.
    x = x.withColumns({"dso": f.days_outstanding(c("receivables"), c("ttm_revenue"), 365), "conversion": F.when(c("quarter_ebitda") > 0, half_up(c("cfo") / c("quarter_ebitda") * 100, 1))})
    x = x.withColumn("conversion_status", _conversion_status(c("cfo"), c("quarter_ebitda"), c("conversion")))
    severe = c("conversion_status") == "SEVERE_EARNINGS_QUALITY_TRAP"
    risk = F.when(severe, 40.0).when(c("conversion_status") == "LOW_CONVERSION_WARNING", 15.0).otherwise(0.0) + F.when(c("dso") > 180, 15.0).otherwise(0.0)
    x = x.withColumn("wc_risk", risk).withColumns({"wc_trap": (c("wc_risk") >= 50) | (severe & ~F.coalesce(c("dso") < 65, F.lit(False))), "p3": half_up(F.greatest(F.lit(10.0), 100.0 - c("wc_risk")), 1)})
    # Expectations: growth that the price implies against growth that the business can fund.
    fcf, cap, nopat = c("ttm_fcf"), c("market_cap"), c("nopat")
    poor = F.coalesce((nopat > 0) & ((fcf <= 0) | (fcf / cap < 0.005) | (fcf < nopat * 0.15)), F.lit(False))
    base = F.when(~poor & (fcf > 0), fcf).when(nopat > 0, nopat).when(fcf > 0, fcf)
    target = F.when(poor | ~(fcf > 0), F.greatest(cap * 0.35, cap + F.coalesce(-c("net_cash"), F.lit(0.0)))).otherwise(cap)
    x = x.withColumn("implied", F.round(f.implied_growth(base, target), 1))
    x = x.withColumn("fundable", F.when(c("implied").isNotNull(), half_up(f.clamp(c("return"), 0.0, 100.0) * f.clamp(c("reinvested"), 0.0, 100.0) / 100, 2)))
    x = x.withColumn("gap", half_up(c("fundable") - c("implied"), 1))
    x = x.withColumn("p4", F.when(c("gap").isNotNull(), half_up(f.clamp(50.0 + c("gap") * 2.5, 20.0, 100.0), 1)).otherwise(50.0))
    x = x.withColumn("p5", F.coalesce(c("technical_score").cast("double"), F.lit(50.0)))
    x = x.withColumns({"potential": half_up(c("p1") * 0.40 + c("p2") * 0.35 + c("p3") * 0.25, 1), "entry": half_up(f.clamp(c("p5") * 0.70 + c("p1") * 0.30, 15.0, 100.0), 1), "gap0": F.coalesce("gap", F.lit(0.0))})
    x = x.withColumns({"asymmetry": half_up(c("potential") * 0.45 + c("p4") * 0.35 + c("p5") * 0.20, 1), "conviction": half_up(c("potential") * 0.40 + c("p4") * 0.35 + c("p5") * 0.15 + c("p3") * 0.10, 1)})
    likelihood = F.when((c("asymmetry") >= 85) & (c("gap0") >= 5), "CONVICTION").when(c("asymmetry") >= 70, "HIGH").when(c("asymmetry") >= 50, "MEDIUM").otherwise("EMERGING")
    return x.withColumns({
        "likelihood": likelihood, "failure_risk": F.when(c("p3") >= 70, "LOW").when(c("p3") >= 40, "MEDIUM").otherwise("HIGH"), "p_2x": half_up(f.clamp(c("asymmetry") * 0.78, 25.0, 88.0), 1), "p_5x": half_up(f.clamp(c("asymmetry") * 0.45, 10.0, 58.0), 1),
        "p_10x": half_up(f.clamp(c("asymmetry") * 0.22, 3.0, 32.0), 1), "margin": half_up(F.when(c("ttm_revenue") > 0, c("ttm_ebit") / c("ttm_revenue") * 100).otherwise(15.0), 1),
    })


def synthesis(x: DataFrame) -> DataFrame:
    """Composite of five pillars and its tier; a working-capital trap or a decline disqualifies. Columns of :func:`evaluate`."""
    compounding = half_up(F.least(F.lit(100.0), f.clamp(c("return"), 0.0, 80.0) * f.clamp(c("reinvested"), 0.0, 90.0) / 100 / 30 * 100), 1)
    turnover = c("ttm_revenue") / c("capital_employed")
    capacity = half_up(c("capital_employed") * F.when(turnover.between(0.5, 8.0), turnover).otherwise(2.0), 2)
    som = half_up(c("niche_tam") * 0.25, 1)
    x = x.withColumns({"compounding": compounding, "obtainable": F.least(som, F.when(capacity > 0, capacity)), "bottleneck": F.when(F.coalesce((capacity > 0) & (capacity < som), F.lit(False)), "PHYSICAL_ASSET_CAPACITY").otherwise("MARKET_SHARE_CEILING")})
    growth = F.when(F.coalesce(c("revenue_growth"), F.lit(0.0)) != 0, c("revenue_growth")).otherwise(20.0)
    years = F.when(c("obtainable") <= c("ttm_revenue"), 0.0).when((c("ttm_revenue") > 0) & (growth > 0), F.round(F.log(c("obtainable") / c("ttm_revenue")) / F.log1p(growth / 100), 1))
    x = x.withColumn("runway", years)
    runway = F.when(c("runway") >= 7, 100.0).when(c("runway") >= 4, 75.0).when(c("runway") >= 2, 50.0).when(c("runway").isNotNull(), 25.0).otherwise(50.0)
    gap = F.when(c("gap") >= 8, 100.0).when(c("gap") >= 2, 80.0).when(c("gap") >= -3, 60.0).when(c("gap") >= -10, 30.0).when(c("gap").isNotNull(), 10.0).otherwise(50.0)
    x = x.withColumn("composite", half_up(c("compounding") * 0.25 + runway * 0.20 + (100.0 - c("wc_risk")) * 0.20 + gap * 0.20 + c("p5") * 0.15, 1))
    decline = F.coalesce("breaker", F.lit(False))
    rising = F.coalesce(c("stage").isin("STAGE_2_UPTREND", "STAGE_2_EMERGING"), F.lit(False))
    tier = (
        F.when(c("wc_trap") | decline, "DISQUALIFIED_BY_CIRCUIT_BREAKER").when((c("composite") >= 80) & (c("gap") >= 2), "TIER_1_ASYMMETRIC_INFLECTION").when(c("composite") >= 65, "TIER_2_HIGH_QUALITY_COMPOUNDER")
        .when(rising & (c("p5") >= 70), "TACTICAL_MOMENTUM_RUNNER").when(c("composite") >= 45, "WATCHLIST_INCUBATING").otherwise("AVOID_OR_DISTRIBUTION")
    )
    flags = F.array_compact(F.array(F.when(c("wc_trap"), "WORKING_CAPITAL_TRAP"), F.when(decline, "STAGE_4_DECLINE")))
    return x.withColumns({"tier": tier, "breakers": flags})


# --- stage 4 -------------------------------------------------------------------------------


def route(x: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Verdict, setup grade, signal, ticket, feeds and what would invalidate the thesis; columns of :func:`evaluate`."""
    strong = (c("potential") >= 85) & (c("gap0") >= 8)
    verdict = F.when(strong & (c("entry") >= 75), "CONVICTION_BUY").when(strong, "ACCUMULATE_ON_DIPS").when((c("potential") >= 72) & (c("entry") < 70), "STRATEGIC_WATCHLIST").when(c("potential") >= 72, "ACCUMULATE_ON_DIPS").otherwise("WATCHLIST")
    thesis = F.when(strong & (c("entry") >= 75), "CONVICTION_BUY").when(~strong & (c("potential") >= 72) & (c("entry") >= 70), "SWING_SETUP").otherwise("STRATEGIC_WATCHLIST")
    active = F.coalesce((c("p5") >= 65) & c("status").isin("TRIGGER_WATCH", "ACTIONABLE_BUY", "LATE_BUY_ZONE") & (c("reward") >= 1.7) & (c("risk_pct") <= 8.5), F.lit(False))
    grade = (
        F.when(c("risk_pct") > 8.5, "DISQUALIFIED").when((c("entry") >= 78) & (c("p5") >= 72) & (c("risk_pct") <= 6.5) & (c("reward") >= 2.0), "A_PRIME")
        .when((c("entry") >= 68) & (c("p5") >= 65) & (c("risk_pct") <= 8.5) & (c("reward") >= 1.7), "B_SELECTIVE").otherwise("C_DEVELOPING")
    )
    signal = half_up(c("potential") * 0.35 + f.clamp(c("gap0") * 3.33 + 50.0, 0.0, 100.0) * 0.25 + c("p5") * 0.20 + c("entry") * 0.20, 1)
    rvol, spread, vwap = _or("rvol", 1.0), _or("range_expansion", 0.0), _or("vwap_gap", 0.0)
    scalp = (
        F.when((rvol >= 1.8) & (spread > 15), "LONG_MOMENTUM_BREAKOUT").when((rvol >= 1.3) & (vwap > 0.1), "MOMENTUM_EXPANSION").when((spread < -15) & (rvol < 0.8), "VOLATILITY_CONTRACTION").when((vwap < -1.5) & (rvol > 1.2), "MEAN_REVERSION_LONG")
        .otherwise("NEUTRAL")
    )
    x = x.withColumns({"verdict": verdict, "thesis": thesis, "swing_active": active, "grade": grade, "signal": signal, "scalp": scalp})
    liquid = (_or("turnover", 0.0) >= 25) | ((_or("turnover", 0.0) >= 10) & (c("market_cap") >= 10_000))
    intraday = F.coalesce(liquid & ((rvol >= 1.25) | (F.abs(spread) >= 15) | (c("scalp") != "NEUTRAL")) & (c("market_cap") >= 1_000), F.lit(False))
    margin_floor = F.when(c("margin") > 3, half_up(c("margin") - 1.5, 1)).otherwise(half_up(c("margin") * 0.7, 1))
    return x.withColumns({
        "intraday_active": intraday, "quantity": F.when(c("pivot") > c("stop"), f.position_size(F.lit(capital), c("pivot"), c("stop"))),
        "return_floor": F.when(c("category") == "FINANCIALS", F.greatest(F.lit(10.0), half_up(F.coalesce("quality", F.lit(15.0)) - 3.0, 1))), "margin_floor": F.when(c("category") != "FINANCIALS", margin_floor),
        "dso_ceiling": F.when(c("category") != "FINANCIALS", half_up(c("dso") + 15, 0)), "price_floor": half_up(c("support"), 2),
        "feeds": F.array_compact(F.array(
            F.when(c("thesis") == "CONVICTION_BUY", "LONG_TERM"), F.when((c("thesis") == "STRATEGIC_WATCHLIST") & (c("potential") >= 70), "STRATEGIC"), F.when(c("swing_active") | (c("thesis") == "SWING_SETUP"), "SWING"), F.when(intraday, "INTRADAY"),
        )),
    })


def run_screen(x: DataFrame, request: Screen, by: str = "BLEND") -> DataFrame:
    """All stages for every company and date: ``stage`` reached (1 to 4), ``gate``, ``place`` in the final order, evaluation, route.

    ``by``: the final order: BLEND (conviction and potential), CONVICTION, SWING (readiness) or INTRADAY (volume and range).
    """
    x = route(synthesis(evaluate(stratified(prescreen(x, request), request.limit))))
    key = {
        "BLEND": c("conviction") * 0.6 + c("potential") * 0.4, "CONVICTION": c("conviction"), "SWING": _or("readiness", 0.0), "INTRADAY": _or("rvol", 1.0) * (1.0 + F.abs(_or("range_expansion", 0.0)) / 100.0),
    }[by]
    place = F.row_number().over(Window.partitionBy("t0", "chosen").orderBy(F.desc(key), "company_id"))
    x = x.withColumn("place", F.when(c("chosen"), place))
    stage = F.when(c("place") <= request.limit, 4).when(c("chosen"), 3).when(c("gate").isNull(), 2).otherwise(1)
    return x.withColumns({"stage_reached": stage, "feeds": F.when(stage == 4, c("feeds")).otherwise(F.array().cast("array<string>"))})


def attrition(screened: DataFrame) -> DataFrame:
    """Survivors and losses in percent of every stage, per date: one aggregate over the stage that each row reached."""
    n = {k: F.count_if(c("stage_reached") >= k) for k in (1, 2, 3, 4)}
    x = screened.groupBy("t0").agg(*(v.alias(f"stage{k}") for k, v in n.items()))
    lost = lambda k: half_up((1 - c(f"stage{k}") / F.when(c(f"stage{k - 1}") > 0, c(f"stage{k - 1}"))) * 100, 2)
    return x.select("t0", *(f"stage{k}" for k in n), *(F.coalesce(lost(k), F.lit(0.0)).alias(f"lost{k}") for k in (2, 3, 4)))


# --- missing data --------------------------------------------------------------------------


def missing_data_guard(x: DataFrame, source: str = "LOCAL_DB") -> DataFrame:
    """Sector-aware quality and solvency, what a negative cash flow means, provenance of each metric and fidelity of the row; columns ``category, company_name, roce, roe, net_margin, debt_to_equity, opm, sales_growth, pe, fcf, cash, debt, dso``."""
    financial = c("category") == "FINANCIALS"
    quality = F.when(financial, F.coalesce(c("roe"), F.when(c("net_margin") > 0, F.least(F.lit(30.0), c("net_margin") * 0.8)), F.lit(15.0))).otherwise(F.coalesce("roce", "roe"))
    basis = F.when(financial, F.when(c("roe").isNotNull(), "RETURN_ON_EQUITY").when(c("net_margin") > 0, "MARGIN_PROXY").otherwise("SECTOR_MEDIAN")).when(c("roce").isNotNull(), "RETURN_ON_CAPITAL").when(c("roe").isNotNull(), "RETURN_ON_EQUITY").otherwise("NONE")
    known = lambda condition: F.coalesce(condition, F.lit(False))
    attractive, growing = known(c("roce") >= 14) | known(c("roe") >= 14), known(c("sales_growth") >= 15)
    thin = (c("debt") > 0) & (c("debt") > c("cash")) & (c("cash") / c("debt") < 0.20) & (c("debt_to_equity") > 1.2)
    safe = ~known(c("debt_to_equity") > 2) & ~known(c("opm") < 0) & ~known(thin)
    status = F.when(financial, "EXEMPT_FINANCIAL").when(c("fcf").isNull(), "DATA_UNAVAILABLE").when(c("fcf") >= 0, "CASH_GENERATIVE").when(attractive & growing & safe, "GROWTH_REINVESTMENT").otherwise("FCF_RISK")
    reasons = F.when(status == "FCF_RISK", F.array_compact(F.array(F.when(~attractive, "RETURNS"), F.when(~growing, "GROWTH"), F.when(~safe, "SOLVENCY"))))
    local = F.lit(source == "LOCAL_DB")

    def provenance(name: str, checked: Column, proxy: Column) -> Column:
        return F.struct(F.when(c(name).isNotNull() & ~checked & proxy, "DERIVED").otherwise(source).alias("source"), F.when(c(name).isNull() & ~proxy, "MISSING").when(checked & c(name).isNotNull(), "CROSS_CHECKED").when(proxy, "PROXY").otherwise("VERIFIED").alias("quality"))

    no = F.lit(False)
    metrics = {"roce": (local, no), "debt_to_equity": (no, financial), "opm": (no, no), "sales_growth": (no, no), "pe": (no, no), "fcf": (no, no)}
    missing = F.when(financial, c("roe")).otherwise(c("roce")).isNull().cast("int") + sum((c(k).isNull().cast("int") for k in ("sales_growth", "opm", "pe")), F.lit(0))
    small = F.contains(F.upper(c("company_name")), F.lit("SME"))
    fidelity = F.when(missing >= 2, 0.50).when(local & ~small, 1.00).when(small, 0.70).otherwise(0.75)
    rating = F.when(missing >= 2, "LIMITED_DATA").when(local & ~small, "FULL_OHLCV").when(small, "SME_CLOUD_PROXY").otherwise("CLOUD_PROXY")
    return x.withColumns({
        "effective_quality": quality, "quality_basis": basis, "effective_solvency": F.when(financial, 1.0).otherwise(c("debt_to_equity")), "fcf_status": status, "fcf_reasons": reasons, "grower": status == "GROWTH_REINVESTMENT",
        "provenance": F.create_map(*(e for k, (checked, proxy) in metrics.items() for e in (F.lit(k), provenance(k, checked, proxy)))), "fidelity": fidelity, "rating": rating,
    })
