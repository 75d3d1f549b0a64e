"""Column functions of the domain: pure expressions that stay in generated code, but for the root search of ``implied_growth``.

Where a definition compares rounded values they are rounded first. Constants are
fixed values of the domain.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Keyword lists and weights of announcement scoring.
POSITIVE = ("awarded", "commissioned", "expansion", "approved", "upgraded", "growth", "highest ever", "debt free", "order win", "patent granted", "record profit", "secured", "wins order", "contract signed", "commercial production")
NEGATIVE = ("resigned", "fraud", "investigation", "downgraded", "strike", "penalty", "delayed", "cancelled", "loss", "show cause", "default", "breached", "resignation", "warning", "sebi order", "tax notice")
STRUCTURAL_TYPES = ("CAPEX_COMMISSIONING", "CAPACITY_EXPANSION", "ORDER_WIN", "CONTRACT_AWARD")
STRUCTURAL_WORDS = ("multi-year", "5-year", "10-year", "megawatt", "capacity addition", "new plant")
TYPE_WEIGHTS = {
    "REGULATORY_APPROVAL": 100.0, "REGULATORY_BAN": 100.0, "CAPEX_COMMISSIONING": 90.0, "CAPACITY_EXPANSION": 90.0, "ORDER_WIN": 85.0, "CONTRACT_AWARD": 85.0,
    "AUDITOR_RESIGNATION": 80.0, "MANAGEMENT_CHANGE": 80.0, "CREDIT_RATING_UPGRADE": 75.0, "CREDIT_RATING_DOWNGRADE": 75.0, "EARNINGS_SURPRISE": 70.0,
    "EARNINGS_FILING": 70.0, "DIVIDEND": 40.0, "BONUS_SPLIT": 40.0, "BUYBACK": 50.0, "GENERAL_FILING": 20.0,
}
OTHER_WEIGHT = 30.0
#: Crore rupees of a million dollars.
CRORE_PER_MILLION_USD = 8.4
#: Hours after which an announcement counts half.
TACTICAL_HOURS, STRUCTURAL_HOURS = 48.0, 2160.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return a / F.when(b != 0, b)


# --- candles -------------------------------------------------------------------------------


def close_location(high: Column, low: Column, close: Column) -> Column:
    return F.when(high - low <= 0.0001, 0.5).otherwise(clamp((close - low) / (high - low), 0.0, 1.0))


def upper_wick(open_: Column, high: Column, low: Column, close: Column) -> Column:
    return F.when(high - low <= 0.0001, 0.0).otherwise(F.greatest(high - F.greatest(open_, close), F.lit(0.0)) / (high - low))


def float_absorption(delivered: Column, floating: Column) -> Column:
    return F.when((floating > 1000) & (delivered > 0), delivered / floating * 100)


def elasticity(price: Column, mean: Column, atr: Column) -> Column:
    return F.coalesce(F.when((mean != 0) & (atr > 0.01), (price - mean) / atr), F.lit(1.5))


def circuit_locked(change_pct: Column) -> Column:
    return F.exists(F.array(*(F.lit(float(b)) for b in (2, 5, 10, 20))), lambda b: F.abs(F.abs(change_pct) - b) <= 0.35)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


# --- text ----------------------------------------------------------------------------------


def crore_value(text: Column) -> Column:
    """Monetary value in crore: a crore figure, else millions of dollars; null without one."""
    crore = F.regexp_extract(text, r"(?i)(?:Rs\.?|₹|INR)?\s*([\d,]+(?:\.\d+)?)\s*(?:Cr|Crore|Crores)", 1)
    usd = F.regexp_extract(text, r"(?i)(?:\$|USD)\s*([\d,]+(?:\.\d+)?)\s*(?:Mn|Million)", 1)

    def number(s: Column) -> Column:
        return F.regexp_replace(s, ",", "").try_cast("double")

    return F.coalesce(number(crore), F.round(number(usd) * CRORE_PER_MILLION_USD, 2))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words. Written out: a lambda over the words would change the case of the whole text anew for each of them."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds."""
    return reduce(add, (F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words))


def direction(text: Column, weight: Column) -> Column:
    lower = F.lower(text)
    good, bad = hits(lower, POSITIVE), hits(lower, NEGATIVE)
    return F.when(bad > good, -1.0).when(good > 0, 1.0).when(weight >= 70, 1.0).otherwise(0.5)


def type_weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def track(kind: Column, headline: Column) -> Column:
    return F.when(F.upper(kind).isin(*STRUCTURAL_TYPES) | contains_any(F.lower(headline), STRUCTURAL_WORDS), "STRUCTURAL").otherwise("TACTICAL")


def materiality(kind: Column, text: Column, value: Column, revenue: Column) -> Column:
    weight = type_weight(kind)
    share = ratio(value, revenue)
    size = F.when(share >= 0.5, 2.0).when(share >= 0.2, 1.5).when(share >= 0.05, 1.0).when(share.isNotNull(), 0.6).otherwise(1.0)
    return clamp(weight * size * direction(text, weight), -100.0, 100.0)


def macro_probability(score: Column, mood: Column, index_change: Column, beta: Column) -> tuple[Column, Column]:
    """Probability in percent of a score, between 10 and 92, and the factor by which the market moves it: 0.8 to 1.1, as the beta lets it; 1 without a mood."""
    factor = F.when(mood.isNull(), 1.0).otherwise(clamp(1 + ((mood - 50) / 100 * 0.5 + index_change / 10 * 0.5) * clamp(beta, 0.4, 2.0), 0.80, 1.10))
    return clamp(clamp(logistic((score - 50) / 20) * 100, 10.0, 92.0) * factor, 10.0, 92.0), factor


# Classes of filings by ordered keywords, and words of the event parser, with their weights.
FILING_CLASSES = (
    ("EARNINGS_RESULT", "HIGH", ("FINANCIAL RESULT", "UNAUDITED FINANCIAL", "AUDITED FINANCIAL", "EARNINGS", "Q1", "Q2", "Q3", "Q4")),
    ("CAPACITY_EXPANSION", "HIGH", ("CAPEX", "EXPANSION", "NEW PLANT", "COMMISSIONING", "COMMENCEMENT")),
    ("ORDER_WIN", "HIGH", ("ORDER", "CONTRACT", "AGREEMENT", "AWARD OF WORK", "LOA")),
    ("MANAGEMENT_CHANGE", "MEDIUM", ("RESIGNATION", "APPOINTMENT", "CHIEF EXECUTIVE OFFICER", "MANAGING DIRECTOR", "CFO")),
    ("CORPORATE_ACTION", "MEDIUM", ("DIVIDEND", "BONUS", "SPLIT", "SUB-DIVISION", "BUYBACK", "RIGHTS ISSUE")),
    ("REGULATORY_ACTION", "HIGH", ("REGULATORY", "SEBI", "FDA", "SHOW CAUSE", "PENALTY", "INVESTIGATION")),
    ("ESOP_ALLOTMENT", "LOW", ("ESOP", "ALLOTMENT OF SHARES")),
)
EVENT_WORDS = (
    ("ORDER_WIN", 0.75, ("bagged order", "order worth", "received order", "awarded contract")),
    ("CAPEX", 0.80, ("capacity expansion", "new plant", "capex", "investment of")),
    ("MANAGEMENT_CHANGE", 0.70, ("resignation of ceo", "appointment of ceo", "cfo resigns")),
)
ORDER_SIZE = r"(?:rs\.?|inr|worth)\s*(\d+(?:,\d+)*(?:\.\d+)?)\s*(?:cr|crore)"


def _first_class(text: Column, classes: tuple) -> Column:
    """The place of the first class of which the text has a keyword."""
    out = F
    for place, row in enumerate(classes):
        out = out.when(contains_any(text, row[2]), place)
    return out


def _of_class(place: Column, classes: tuple, value: int, otherwise) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(row[value]) for row in classes)), place), F.lit(otherwise))


def filing_class(text: Column) -> tuple[Column, Column]:
    """Class and weight of a filing: the first class of which the text has a keyword."""
    place = _first_class(F.upper(text), FILING_CLASSES)
    return _of_class(place, FILING_CLASSES, 0, "GENERAL_CORPORATE_DISCLOSURE"), _of_class(place, FILING_CLASSES, 1, "LOW")


def event_of(text: Column) -> tuple[Column, Column, Column]:
    """Event, materiality and, of an order, its size in rupees."""
    lower = F.lower(text)
    place = _first_class(lower, EVENT_WORDS)
    kind = _of_class(place, EVENT_WORDS, 0, "OTHER")
    size = F.regexp_replace(F.regexp_extract(lower, ORDER_SIZE, 1), ",", "")
    return kind, _of_class(place, EVENT_WORDS, 1, 0.5), F.when((kind == "ORDER_WIN") & (size != ""), size.try_cast("double") * 10_000_000)


def macro_regime(vix: Column, crude: Column) -> Column:
    """Regime from volatility and the oil price; unknown where both feeds are missing."""
    calm = (vix < 14) & (crude.isNull() | (crude < 85))
    return F.when(vix.isNull() & crude.isNull(), "DATA_OFFLINE_UNKNOWN").when(calm, "BULLISH_EXPANSION").when(F.coalesce(vix > 18, F.lit(False)) | F.coalesce(crude > 95, F.lit(False)), "RISK_OFF_CORRECTION").otherwise("NEUTRAL_CONSOLIDATION")


def decay(score: Column, hours: Column, structural: Column) -> Column:
    half = F.when(structural, STRUCTURAL_HOURS).otherwise(TACTICAL_HOURS)
    return score * F.exp(-F.log(F.lit(2.0)) / half * F.greatest(hours, F.lit(0.0)))


def lifecycle(decayed: Column, raw: Column, hours: Column, structural: Column) -> Column:
    """Where an announcement stands: a day as new, then decaying until its horizon passes or little of its score is left."""
    longest = F.when(structural, 4320.0).otherwise(168.0)
    least = F.abs(raw) * F.when(structural, 0.15).otherwise(0.08)
    absorbed = F.when(structural, "ABSORBED_INTO_FINANCIALS").otherwise("ABSORBED_INTO_PRICE")
    return F.when(hours <= 24, "NEW_ACTIVE").when((hours > longest) | (F.abs(F.round(decayed, 1)) < least), absorbed).otherwise("DECAYING")


def mixed_date(text: Column) -> Column:
    """A date in any of the usual forms; a month and year alone mean the month's last day."""
    whole = F.coalesce(*(F.try_to_date(text, f) for f in ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "dd-MM-yyyy")))
    return F.coalesce(whole, F.last_day(F.try_to_date(F.concat(F.lit("01 "), text), "dd MMM yyyy")))


# --- time ----------------------------------------------------------------------------------


#: Last days of the development, validation and locked partitions.
PARTITION_ENDS = ("2021-12-31", "2023-12-31", "2026-12-31")


def partition_of(t0: Column, ends: tuple[str, str, str] = PARTITION_ENDS) -> Column:
    """Research partition of a decision date; nothing may be fitted on the locked one."""
    return F.when(t0 <= ends[0], "DEVELOPMENT").when(t0 <= ends[1], "VALIDATION").when(t0 <= ends[2], "LOCKED_OOS").otherwise("OUT_OF_BOUNDS")


def censoring(t0: Column, years: float, today: Column, happened: Column) -> Column:
    """An outcome whose horizon has not passed is censored, not a failure."""
    done = F.date_add(t0, int(years * 365.25)) <= today
    return F.when(happened, "EVENT_OBSERVED").when(done, "HORIZON_COMPLETED_NO_EVENT").otherwise("RIGHT_CENSORED")


def board_status(meeting: Column, today: Column) -> Column:
    days = F.datediff(meeting, today)
    return F.when(days < 0, "COMPLETED").when(days <= 3, "IMMINENT").otherwise("SCHEDULED")


def blackout(meeting: Column, today: Column) -> Column:
    """The trading window opens two days after the meeting."""
    return F.datediff(today, meeting) < 2


# --- economics -----------------------------------------------------------------------------


def economic_roic(ebit: Column, tax_rate: Column, capital: Column) -> Column:
    return F.when(capital > 0, ebit * (1 - clamp(tax_rate, 0.0, 0.4)) / capital * 100)


def growth_capex(capex: Column, depreciation: Column, share: Column) -> Column:
    """Capex beyond maintenance, which is depreciation times a factor between 0.7 and 1.3."""
    return F.greatest(capex - depreciation * clamp(share, 0.7, 1.3), F.lit(0.0))


def peg(pe: Column, growth: Column, sustainable: Column | None = None) -> Column:
    """Price/earnings to growth; growth below 5 counts as 5, beyond 60 the sustainable growth within 5 to 50 stands in, if known."""
    usual = F.greatest(growth, F.lit(5.0))
    if sustainable is not None:
        usual = F.when((growth > 60) & (sustainable > 0), clamp(sustainable, 5.0, 50.0)).otherwise(usual)
    return F.when((pe > 0) & (growth > 0), pe / usual)


def fcf_yield(fcf: Column, market_cap: Column) -> Column:
    return F.when(market_cap > 0, fcf / market_cap * 100)


#: Reverse discounted cash flow: discount rate, terminal growth, years, search range in percent and steps.
DISCOUNT, TERMINAL, YEARS, LOWEST, HIGHEST, STEPS, CLOSE_ENOUGH = 0.12, 0.05, 10, -50.0, 200.0, 60, 0.01


def _present_value(cash: Column, growth: Column) -> Column:
    """Closed form of ten growing flows and a terminal value."""
    q = (1 + growth / 100) / (1 + DISCOUNT)
    flows = F.when(F.abs(q - 1) < 1e-12, F.lit(float(YEARS))).otherwise(q * (1 - F.pow(q, F.lit(YEARS))) / (1 - q))
    return cash * (flows + F.pow(q, F.lit(YEARS)) * (1 + TERMINAL) / (DISCOUNT - TERMINAL))


@F.pandas_udf(DoubleType())
def _bisected(cash: pd.Series, value: pd.Series) -> pd.Series:
    """A batch of rows halves its ranges together; a row leaves where its gap is close enough, and after all steps at the latest."""
    cash, value = cash.to_numpy(dtype=float), value.to_numpy(dtype=float)
    found, rows = np.empty(len(cash)), np.arange(len(cash))
    lo, hi = np.full(len(cash), LOWEST), np.full(len(cash), HIGHEST)
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            q = (1 + mid / 100) / (1 + DISCOUNT)
            power = q**YEARS
            flows = np.where(np.abs(q - 1) < 1e-12, YEARS, q * (1 - power) / (1 - q))
            gap = cash * (flows + power * (1 + TERMINAL) / (DISCOUNT - TERMINAL)) - value
            below, hit = gap < 0, np.abs(gap) < CLOSE_ENOUGH
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            if hit.any():
                found[rows[hit]] = mid[hit]
                rows, cash, value, lo, hi = (v[~hit] for v in (rows, cash, value, lo, hi))
                if not len(rows):
                    break
    found[rows] = (lo + hi) / 2
    return pd.Series(found)


def implied_growth(cash: Column, value: Column) -> Column:
    """Growth that the value implies, by bisection; the ends of the range where it lies outside; null without cash flow."""
    # A fold over 60 steps would be interpreted and write out the present value anew at each use.
    cash, value = cash.cast("double"), value.cast("double")
    inside = F.when(_present_value(cash, F.lit(LOWEST)) >= value, LOWEST).when(_present_value(cash, F.lit(HIGHEST)) <= value, HIGHEST).otherwise(_bisected(cash, value))
    return F.when((cash > 0) & (value > 0), inside)


def expectations_regime(sustainable: Column, implied: Column) -> Column:
    gap = sustainable - implied
    return F.when(gap.isNull(), "UNKNOWN").when(gap >= 10, "DEEPLY_UNDERVALUED").when(gap >= 3, "UNDERVALUED").when(gap > -3, "FAIR").when(gap > -10, "DEMANDING").otherwise("EXTREME")


def runway_years(capacity: Column, revenue: Column, growth: Column) -> Column:
    """Years until growth fills the capacity."""
    return F.when((revenue > 0) & (growth > 0) & (capacity > revenue), F.log(capacity / revenue) / F.log1p(growth)).otherwise(0.0)


# --- trading -------------------------------------------------------------------------------

# Rates of the delivery and intraday cost stacks, in shares of value, and charges in rupees.
STT_DELIVERY, STT_INTRADAY, STAMP_DELIVERY, STAMP_INTRADAY = 0.0010, 0.00025, 0.00015, 0.00003
EXCHANGE_FEE, SEBI_FEE, BROKERAGE, BROKERAGE_CAP, GST, DP_CHARGE = 0.0000345, 0.0000010, 0.0005, 20.0, 0.18, 15.93


def trade_costs(capital: Column, gross_pct: Column, delivery: Column, slippage_pct: float = 0.15) -> Column:
    """Costs of a round trip: struct of statutory and slippage costs and the net return in percent."""
    buy = F.greatest(capital, F.lit(100.0))
    sell = F.greatest(buy * (1 + gross_pct / 100), F.lit(0.0))
    turnover = buy + sell
    taxes = F.when(delivery, STT_DELIVERY * turnover + STAMP_DELIVERY * buy).otherwise(STT_INTRADAY * sell + STAMP_INTRADAY * buy)
    fees = (EXCHANGE_FEE + SEBI_FEE) * turnover
    broker = F.least(F.lit(BROKERAGE_CAP), BROKERAGE * buy) + F.least(F.lit(BROKERAGE_CAP), BROKERAGE * sell)
    depot = F.when(delivery & (sell > 0), DP_CHARGE).otherwise(0.0)
    statutory = taxes + fees + broker + GST * (broker + fees) + depot
    slippage = turnover * slippage_pct / 100
    return F.struct(statutory.alias("statutory"), slippage.alias("slippage"), ((sell - buy - statutory - slippage) / buy * 100).alias("net_pct"))


def position_size(capital: Column, entry: Column, stop: Column) -> Column:
    """Shares by 1 % risk, at most 20 % of the capital."""
    by_risk = capital * 0.01 / F.when(entry > stop, entry - stop)
    return F.floor(F.least(by_risk, capital * 0.20 / entry))


def market_impact(price: Column, quantity: Column, daily_volume: Column, side: Column) -> Column:
    """Execution price: half a percent times the root of the share of the day's volume against the trader."""
    return price * (1 + side * 0.005 * F.sqrt(ratio(quantity, daily_volume)))


def compliance(drawdown: Column, locked: Column, stock_pct: Column, sector_pct: Column, adv_pct: Column) -> Column:
    return (
        F.when(drawdown <= -15, "REJECT_DRAWDOWN").when(locked, "REJECT_CIRCUIT").when(stock_pct > 5, "RESIZE_STOCK").when(sector_pct > 20, "RESIZE_SECTOR")
        .when(adv_pct > 5, "RESIZE_LIQUIDITY").otherwise("APPROVED")
    )


# --- statistics ----------------------------------------------------------------------------

Z95 = 1.95996


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of a share, in percent."""
    p = k / n
    centre = p + Z95**2 / (2 * n)
    spread = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    size = 1 + Z95**2 / n
    return F.greatest((centre - spread) / size, F.lit(0.0)) * 100, F.least((centre + spread) / size, F.lit(1.0)) * 100


def evidence_tier(n: Column) -> Column:
    return F.when(n >= 400, "ROBUST").when(n >= 150, "SOLID").when(n >= 20, "EARLY").otherwise("INSUFFICIENT")


def readiness_bin(score: Column) -> Column:
    return F.when(score >= 85, "85+").when(score >= 75, "75-84").when(score >= 65, "65-74").when(score >= 55, "55-64").otherwise("<55")


def canonical_hash(columns: list[str]) -> Column:
    """SHA-256 of ``name=value`` pairs in order of name; numbers with six decimals, nulls as ``null``."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("decimal(38,6)").cast("string"), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


# --- companies and quotes ------------------------------------------------------------------

#: What a thesis must not say on both sides: (for, against, name).
CONTRADICTIONS = (
    ("strong liquidity", ("insufficient liquidity", "illiquid"), "LIQUIDITY"), ("attractive valuation", ("expensive valuation",), "VALUATION"),
    ("accelerating revenue", ("revenue contraction",), "GROWTH"),
)


def contradictions(reasons_for: Column, reasons_against: Column) -> Column:
    """Names of the contradictions between two arrays of reasons."""
    good, bad = F.lower(F.array_join(reasons_for, " ")), F.lower(F.array_join(reasons_against, " "))
    found = []
    for claim, denials, name in CONTRADICTIONS:
        found.append(F.when(F.contains(good, F.lit(claim)) & contains_any(bad, denials), name))
    return F.array_compact(F.array(*found))


def terminal_return(start: Column, *recovered: Column) -> Column:
    """Return in percent when a company ends: what is recovered a share against the price at the start."""
    price = F.when(start > 0, start).otherwise(1.0)
    return (sum(recovered, F.lit(0.0)) - price) / price * 100


def reinvestment(growth_capex: Column, working_capital: Column, nopat: Column) -> tuple[Column, Column]:
    """Growth reinvestment rate in percent, and the posture that it means."""
    rate = (growth_capex + F.greatest(working_capital, F.lit(0.0))) / F.greatest(nopat, F.lit(1.0)) * 100
    return rate, F.when(rate > 70, "AGGRESSIVE_EXPANSION").when(rate >= 30, "BALANCED_COMPOUNDER").otherwise("CASH_DISTRIBUTOR")


def days_outstanding(balance: Column, flow: Column, days: int = 365) -> Column:
    return F.when((balance >= 0) & (flow > 0), balance / flow * days)


def cash_cycle(dso: Column, dio: Column, dpo: Column) -> Column:
    """Cash conversion cycle; inventories and payables that are missing count 0, receivables do not."""
    return dso + F.coalesce(dio, F.lit(0.0)) - F.coalesce(dpo, F.lit(0.0))


def gap_character(gap: Column) -> Column:
    return F.when(gap >= 4.5, "EXHAUSTION_GAP_WARNING").when(gap >= 0.5, "GAP_AND_GO").when(gap >= -1.5, "FLAT_OPEN_SURGE").otherwise("GAP_DOWN_REVERSAL")


def session_phase(minute: Column) -> Column:
    return F.when(minute < 615, "OPENING_RANGE_WINDOW").when(minute < 810, "MIDDAY_CHOP_ZONE").otherwise("AFTERNOON_TREND_RUN")
