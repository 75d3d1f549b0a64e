"""Queries over the staged screen: prescreen, deep evaluation, synthesis, routing, attrition, missing-data guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screening as sc
from ..sources import adapters as a
from ..sources import statements as s
from ..sources.stored import stored
from .bar_windows import AVERAGES, MANSFIELD, STAGE, TR, VCP
from .feature_sql import FEATURES
from .fundamentals import _SOLVED, _VALUED, features
from .histories import _SEGMENT_SQL, _market_of, sectors
from .registry import query
from .setup_sql import IND, REGIME, r
from .views import MARKET, over

c = F.col
REQUEST = sc.Screen(min_market_cap=600.0, max_market_cap=40_000.0, min_quality=9.0, min_growth=1.0, max_debt=1.6, max_pe=45.0, near_high_pct=45.0, limit=3)
#: What a customers' segment is called as an industry.
INDUSTRIES = {"AUTOMOBILE": "Auto components", "BUILDING": "Construction and steel", "FURNITURE": "Power and energy", "HOUSEHOLD": "Housing finance", "MACHINERY": "Heavy equipment engineering"}

# --- SQL -----------------------------------------------------------------------------------

_INDUSTRY = "CASE sector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INDUSTRIES.items()) + " END"
_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(industry), '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in sc.CATEGORY_WORDS) + f" ELSE '{sc.OTHER_CATEGORY}' END"
_ITEMS = ("receivables", "inventories", "payables", "cfo", "capex", "depreciation")
_E = [f"max(CASE WHEN age = {k + 1} THEN ebitda END)" for k in range(6)]
_TYPICAL = "((high + low + close) / 3)"

_PANEL = f"""{_VALUED}, {_SOLVED}, {TR}, {REGIME}, {IND}, {AVERAGES}, {STAGE}, {MANSFIELD.replace(f"{MARKET}, ", "")}, {VCP}, {_SEGMENT_SQL}, {_market_of('sectors')},
 spread AS (SELECT company_id, trading_date, min(low) OVER {over(20)} AS support, {r(f'volume / avg(volume) OVER {over(20, 1)}', 2)} AS rvol, {r(f'(high - low - avg(true_range) OVER {over(20)}) / avg(true_range) OVER {over(20)} * 100', 1)} AS range_expansion,
  {r(f'(close - {_TYPICAL}) / {_TYPICAL} * 100', 2)} AS vwap_gap, {r(f'avg(volume) OVER {over(20, 1)} * close / 10000000', 6)} AS turnover FROM ranged),
 tape AS (SELECT CAST(CAST(regexp_extract(x.company_id, '[0-9]+') AS INT) - 1 AS VARCHAR) AS company_id, x.trading_date, st.stage, CASE WHEN st.stage IN ('STAGE_2_UPTREND', 'STAGE_2_EMERGING') THEN 50 WHEN st.stage = 'STAGE_1_ACCUMULATION' THEN 30 ELSE 0 END
   + CASE WHEN m.score > 10 THEN 30 WHEN m.score > 0 THEN 20 WHEN m.score > -5 THEN 10 ELSE 0 END + CASE WHEN v.n >= 40 AND round(coalesce(v.squeeze, 1), 2) <= 0.60 AND round(v.dry, 2) <= 0.70 THEN 20 ELSE 0 END AS technical_score, st.stage = 'STAGE_4_DECLINE' AS breaker,
   support, rvol, range_expansion, vwap_gap, turnover, setup, pivot_ AS entry_pivot, x.stop, x.t1, x.t2, risk_pct, reward, status, readiness
  FROM audited x JOIN stages st USING (company_id, trading_date) JOIN mansfield m USING (company_id, trading_date) JOIN vcp v USING (company_id, trading_date) JOIN spread USING (company_id, trading_date)),
 items AS (SELECT company_id, t0, {', '.join(f"arg_min({k}, age) FILTER ({k} IS NOT NULL) AS {k}" for k in _ITEMS)}, count(*) AS held, {', '.join(f"{e} AS e{k}" for k, e in enumerate(_E))} FROM nq GROUP BY company_id, t0),
 moved AS (SELECT company_id, t0, {', '.join(_ITEMS)}, e0 AS quarter_ebitda, CASE WHEN held >= 6 THEN 'YOY_DESEASONALIZED' WHEN held = 5 THEN 'HYBRID_YOY' WHEN held >= 3 THEN 'SEQUENTIAL' ELSE 'INSUFFICIENT' END AS acceleration_method,
   CASE WHEN held >= 6 THEN (e0 - e4) - (e1 - e5) WHEN held = 5 THEN (e0 - e4) - (e1 - e2) WHEN held >= 3 THEN (e0 - e1) - (e1 - e2) END AS second, CASE WHEN held >= 5 THEN e0 - e4 WHEN held >= 3 THEN e0 - e1 END AS first_ FROM items),
 panel AS (SELECT f.*, mo.* EXCLUDE (company_id, t0), ta.* EXCLUDE (company_id, trading_date), market, niche_tam, {_INDUSTRY} AS industry, {_CATEGORY.replace('industry', f'({_INDUSTRY})')} AS category, implied
  FROM features f JOIN moved mo USING (company_id, t0) JOIN sectors se USING (company_id) JOIN marketed mk2 USING (company_id) LEFT JOIN tape ta ON ta.company_id = f.company_id AND ta.trading_date = f.trading_date LEFT JOIN solved so ON so.company_id = f.company_id AND so.t0 = f.t0)"""

_GATED = f"""{_PANEL}, q0 AS (SELECT *, category = 'FINANCIALS' AS financial, {r('ttm_pat / greatest(10.0::DOUBLE, net_worth) * 100', 1)} AS roe, {r('revenue_growth', 1)} AS growth1 FROM panel),
 q1 AS (SELECT *, CASE WHEN financial THEN coalesce(CASE WHEN net_worth IS NOT NULL THEN roe ELSE {r('ttm_pat / 10.0::DOUBLE * 100', 1)} END, 0) ELSE coalesce({r('roce', 1)}, 0) END AS quality FROM q0),
 gated AS (SELECT *, CASE WHEN net_worth IS NULL THEN 'NO_BALANCE_SHEET' WHEN net_worth <= 0 THEN 'INSOLVENT' WHEN close IS NULL THEN 'NO_PRICE' WHEN market_cap IS NULL THEN 'NO_SHARES' WHEN (high_52w - close) / high_52w * 100 > {REQUEST.near_high_pct} THEN 'FAR_FROM_HIGH'
   WHEN NOT financial AND debt_to_equity > 4 THEN 'LEVERAGE' WHEN market_cap < {REQUEST.min_market_cap} THEN 'TOO_SMALL' WHEN market_cap > {REQUEST.max_market_cap} THEN 'TOO_LARGE' WHEN quality < {REQUEST.min_quality} THEN 'LOW_QUALITY' WHEN NOT financial AND debt_to_equity > {REQUEST.max_debt} THEN 'DEBT'
   WHEN growth1 < {REQUEST.min_growth} THEN 'LOW_GROWTH' WHEN pe > {REQUEST.max_pe} THEN 'HIGH_PE' END AS gate,
  {r("CASE WHEN financial THEN least(100.0::DOUBLE, greatest(20.0::DOUBLE, quality / 16.0::DOUBLE * 80.0::DOUBLE)) ELSE least(100.0::DOUBLE, greatest(10.0::DOUBLE, quality / 25.0::DOUBLE * 80.0::DOUBLE)) END * 0.40::DOUBLE + CASE WHEN financial THEN 80.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(20.0::DOUBLE, 100.0::DOUBLE - coalesce(debt_to_equity, 0.0::DOUBLE) * 35.0::DOUBLE)) END * 0.35::DOUBLE + least(100.0::DOUBLE, greatest(30.0::DOUBLE, coalesce(growth1, 0.0::DOUBLE) / 20.0::DOUBLE * 85.0::DOUBLE)) * 0.25::DOUBLE", 1)} AS rank_ FROM q1)"""

_MOST = min(2 * REQUEST.limit, sc.MOST_CHOSEN)
_QUOTA = " ".join(f"WHEN {k} THEN {max(1, round(_MOST * share))}" for k, share in enumerate(sc.SHARES))
_CHOSEN = f"""{_GATED}, z0 AS (SELECT *, gate IS NULL AS alive, CASE WHEN market_cap <= {sc.SMALL_CAP} THEN 0 WHEN market_cap <= {sc.MIDDLE_CAP} THEN 1 ELSE 2 END AS size FROM gated),
 z1 AS (SELECT *, alive AND row_number() OVER (PARTITION BY t0, alive, size ORDER BY rank_ DESC, company_id) <= CASE size {_QUOTA} END AS by_quota FROM z0),
 chosen AS (SELECT *, alive AND row_number() OVER (PARTITION BY t0 ORDER BY alive DESC, by_quota DESC, CASE WHEN by_quota THEN size END, rank_ DESC, company_id) <= {_MOST} AS chosen FROM z1)"""


def D(text: str) -> str:
    """Number literals as doubles, so that DuckDB does no decimal arithmetic."""
    import re

    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?!\d|::)", r"\1::DOUBLE", text)


_STATUS = """CASE WHEN quarter_ebitda IS NULL OR quarter_ebitda <= 0 THEN CASE WHEN cfo < 0 THEN 'NEGATIVE_CFO_AND_EBITDA' ELSE 'EBITDA_NON_POSITIVE' END WHEN cfo IS NULL THEN 'CFO_DATA_MISSING' WHEN conversion >= 80 THEN 'EXCELLENT_CASH_CONVERSION' WHEN conversion >= 70 THEN 'ACCEPTABLE_CONVERSION' WHEN conversion >= 50 THEN 'LOW_CONVERSION_WARNING' ELSE 'SEVERE_EARNINGS_QUALITY_TRAP' END"""
_EVALUATED = _CHOSEN + D(f""", k0 AS (SELECT *, coalesce({r('roce', 1)}, 20.0) AS ret, ttm_ebit * 0.75 AS own_flow, coalesce(capex > 0 AND ttm_revenue > 0, false) AS spends, greatest(0.1, coalesce(depreciation, 0.0)) AS worn, receivables / ttm_revenue * 365 AS dso0, CASE WHEN quarter_ebitda > 0 THEN {r('cfo / quarter_ebitda * 100', 1)} END AS conversion FROM chosen),
 k1 AS (SELECT *, {r('least(100.0, greatest(15.0, ret * 0.70 + coalesce(revenue_growth, 0.0) * 0.30))', 1)} AS p1, CASE WHEN spends THEN greatest(0.0, {r('capex - least(capex, worn * 1.06)', 2)}) END AS growth_capex, CASE WHEN ttm_revenue > 0 THEN dso0 END AS dso, {_STATUS} AS conversion_status FROM k0),
 k2 AS (SELECT *, CASE WHEN spends THEN least(90.0, greatest(10.0, {r('growth_capex / greatest(1.0, own_flow) * 100', 2)})) ELSE 30.0 END AS reinvested, CASE WHEN spends THEN {r(f"least(100.0, greatest(25.0, 50.0 + {r('growth_capex / greatest(0.1, capex) * 100', 1)} * 0.50))", 1)} ELSE 50.0 END AS p2,
   CASE WHEN conversion_status = 'SEVERE_EARNINGS_QUALITY_TRAP' THEN 40.0 WHEN conversion_status = 'LOW_CONVERSION_WARNING' THEN 15.0 ELSE 0.0 END + CASE WHEN dso > 180 THEN 15.0 ELSE 0.0 END AS wc_risk FROM k1),
 k3 AS (SELECT *, wc_risk >= 50 OR (conversion_status = 'SEVERE_EARNINGS_QUALITY_TRAP' AND NOT coalesce(dso < 65, false)) AS wc_trap, {r('greatest(10.0, 100.0 - wc_risk)', 1)} AS p3, CASE WHEN implied IS NOT NULL THEN {r('least(100.0, greatest(0.0, ret)) * least(100.0, greatest(0.0, reinvested)) / 100', 2)} END AS fundable FROM k2),
 k4 AS (SELECT *, {r('fundable - implied', 1)} AS gap, coalesce(technical_score::DOUBLE, 50.0) AS p5 FROM k3),
 k5 AS (SELECT *, CASE WHEN gap IS NOT NULL THEN {r('least(100.0, greatest(20.0, 50.0 + gap * 2.5))', 1)} ELSE 50.0 END AS p4, {r('p1 * 0.40 + p2 * 0.35 + p3 * 0.25', 1)} AS potential, {r('least(100.0, greatest(15.0, p5 * 0.70 + p1 * 0.30))', 1)} AS entry, coalesce(gap, 0.0) AS gap0 FROM k4),
 k6 AS (SELECT *, {r('potential * 0.45 + p4 * 0.35 + p5 * 0.20', 1)} AS asymmetry, {r('potential * 0.40 + p4 * 0.35 + p5 * 0.15 + p3 * 0.10', 1)} AS conviction FROM k5),
 evaluated AS (SELECT *, CASE WHEN asymmetry >= 85 AND gap0 >= 5 THEN 'CONVICTION' WHEN asymmetry >= 70 THEN 'HIGH' WHEN asymmetry >= 50 THEN 'MEDIUM' ELSE 'EMERGING' END AS likelihood, CASE WHEN p3 >= 70 THEN 'LOW' WHEN p3 >= 40 THEN 'MEDIUM' ELSE 'HIGH' END AS failure_risk,
   {r('least(88.0, greatest(25.0, asymmetry * 0.78))', 1)} AS p_2x, {r('least(58.0, greatest(10.0, asymmetry * 0.45))', 1)} AS p_5x, {r('least(32.0, greatest(3.0, asymmetry * 0.22))', 1)} AS p_10x, {r('CASE WHEN ttm_revenue > 0 THEN ttm_ebit / ttm_revenue * 100 ELSE 15.0 END', 1)} AS margin FROM k6)""")

_SYNTHESIS = _EVALUATED + D(f""", y0 AS (SELECT *, {r('least(100.0, least(80.0, greatest(0.0, ret)) * least(90.0, greatest(0.0, reinvested)) / 100 / 30 * 100)', 1)} AS compounding, {r('niche_tam * 0.25', 1)} AS som,
   {r('capital_employed * CASE WHEN ttm_revenue / capital_employed BETWEEN 0.5 AND 8.0 THEN ttm_revenue / capital_employed ELSE 2.0 END', 2)} AS capacity, CASE WHEN coalesce(revenue_growth, 0) <> 0 THEN revenue_growth ELSE 20.0 END AS g FROM evaluated),
 y1 AS (SELECT *, CASE WHEN capacity > 0 THEN least(som, capacity) ELSE som END AS obtainable, CASE WHEN coalesce(capacity > 0 AND capacity < som, false) THEN 'PHYSICAL_ASSET_CAPACITY' ELSE 'MARKET_SHARE_CEILING' END AS bottleneck FROM y0),
 y2 AS (SELECT *, CASE WHEN obtainable <= ttm_revenue THEN 0.0 WHEN ttm_revenue > 0 AND g > 0 THEN round(ln(obtainable / ttm_revenue) / ln(1 + g / 100), 1) END AS runway FROM y1),
 y3 AS (SELECT *, {r('''compounding * 0.25 + CASE WHEN runway >= 7 THEN 100.0 WHEN runway >= 4 THEN 75.0 WHEN runway >= 2 THEN 50.0 WHEN runway IS NOT NULL THEN 25.0 ELSE 50.0 END * 0.20 + (100.0 - wc_risk) * 0.20
   + CASE WHEN gap >= 8 THEN 100.0 WHEN gap >= 2 THEN 80.0 WHEN gap >= -3 THEN 60.0 WHEN gap >= -10 THEN 30.0 WHEN gap IS NOT NULL THEN 10.0 ELSE 50.0 END * 0.20 + p5 * 0.15''', 1)} AS composite FROM y2),
 synthesis AS (SELECT *, CASE WHEN wc_trap OR coalesce(breaker, false) THEN 'DISQUALIFIED_BY_CIRCUIT_BREAKER' WHEN composite >= 80 AND gap >= 2 THEN 'TIER_1_ASYMMETRIC_INFLECTION' WHEN composite >= 65 THEN 'TIER_2_HIGH_QUALITY_COMPOUNDER'
   WHEN coalesce(stage IN ('STAGE_2_UPTREND', 'STAGE_2_EMERGING'), false) AND p5 >= 70 THEN 'TACTICAL_MOMENTUM_RUNNER' WHEN composite >= 45 THEN 'WATCHLIST_INCUBATING' ELSE 'AVOID_OR_DISTRIBUTION' END AS tier, concat_ws(',', CASE WHEN wc_trap THEN 'WORKING_CAPITAL_TRAP' END, CASE WHEN breaker THEN 'STAGE_4_DECLINE' END) AS breakers FROM y3)""")

_ROUTED = _SYNTHESIS + D(f""", u0 AS (SELECT *, potential >= 85 AND gap0 >= 8 AS strong, coalesce(rvol, 1.0) AS rv, coalesce(range_expansion, 0.0) AS re, coalesce(vwap_gap, 0.0) AS vg, coalesce(turnover, 0.0) AS tu FROM synthesis),
 u1 AS (SELECT *, CASE WHEN strong AND entry >= 75 THEN 'CONVICTION_BUY' WHEN strong THEN 'ACCUMULATE_ON_DIPS' WHEN potential >= 72 AND entry < 70 THEN 'STRATEGIC_WATCHLIST' WHEN potential >= 72 THEN 'ACCUMULATE_ON_DIPS' ELSE 'WATCHLIST' END AS verdict,
   CASE WHEN strong AND entry >= 75 THEN 'CONVICTION_BUY' WHEN NOT strong AND potential >= 72 AND entry >= 70 THEN 'SWING_SETUP' ELSE 'STRATEGIC_WATCHLIST' END AS thesis, coalesce(p5 >= 65 AND status IN ('TRIGGER_WATCH', 'ACTIONABLE_BUY', 'LATE_BUY_ZONE') AND reward >= 1.7 AND risk_pct <= 8.5, false) AS swing_active,
   CASE WHEN risk_pct > 8.5 THEN 'DISQUALIFIED' WHEN entry >= 78 AND p5 >= 72 AND risk_pct <= 6.5 AND reward >= 2.0 THEN 'A_PRIME' WHEN entry >= 68 AND p5 >= 65 AND risk_pct <= 8.5 AND reward >= 1.7 THEN 'B_SELECTIVE' ELSE 'C_DEVELOPING' END AS grade,
   {r('potential * 0.35 + least(100.0, greatest(0.0, gap0 * 3.33 + 50.0)) * 0.25 + p5 * 0.20 + entry * 0.20', 1)} AS signal,
   CASE WHEN rv >= 1.8 AND re > 15 THEN 'LONG_MOMENTUM_BREAKOUT' WHEN rv >= 1.3 AND vg > 0.1 THEN 'MOMENTUM_EXPANSION' WHEN re < -15 AND rv < 0.8 THEN 'VOLATILITY_CONTRACTION' WHEN vg < -1.5 AND rv > 1.2 THEN 'MEAN_REVERSION_LONG' ELSE 'NEUTRAL' END AS scalp FROM u0),
 routed AS (SELECT *, coalesce((tu >= 25 OR (tu >= 10 AND market_cap >= 10000)) AND (rv >= 1.25 OR abs(re) >= 15 OR scalp <> 'NEUTRAL') AND market_cap >= 1000, false) AS intraday_active, CASE WHEN entry_pivot > stop THEN CAST(floor(least(100000.0 * 0.01 / (entry_pivot - stop), 100000.0 * 0.20 / entry_pivot)) AS BIGINT) END AS quantity,
   CASE WHEN category = 'FINANCIALS' THEN greatest(10.0, {r('coalesce(quality, 15.0) - 3.0', 1)}) END AS return_floor, CASE WHEN category <> 'FINANCIALS' THEN CASE WHEN margin > 3 THEN {r('margin - 1.5', 1)} ELSE {r('margin * 0.7', 1)} END END AS margin_floor,
   CASE WHEN category <> 'FINANCIALS' THEN {r('dso + 15', 0)} END AS dso_ceiling, {r('support', 2)} AS price_floor FROM u1),
 placed AS (SELECT *, CASE WHEN chosen THEN row_number() OVER (PARTITION BY t0, chosen ORDER BY conviction * 0.6 + potential * 0.4 DESC, company_id) END AS place FROM routed),
 screened AS (SELECT *, CASE WHEN place <= {REQUEST.limit} THEN 4 WHEN chosen THEN 3 WHEN gate IS NULL THEN 2 ELSE 1 END AS stage_reached FROM placed)""")

_FEEDS = "concat_ws(',', CASE WHEN thesis = 'CONVICTION_BUY' THEN 'LONG_TERM' END, CASE WHEN thesis = 'STRATEGIC_WATCHLIST' AND potential >= 70 THEN 'STRATEGIC' END, CASE WHEN swing_active OR thesis = 'SWING_SETUP' THEN 'SWING' END, CASE WHEN intraday_active THEN 'INTRADAY' END)"

# --- queries -------------------------------------------------------------------------------


def panel(spark, sf_dir):
    """The screen's inputs, written once: evaluation, synthesis and routing are projections of it."""
    rows = stored(s.statements(spark, sf_dir), "statements")
    dates = s.reading_dates(rows)
    bars = stored(s.listed_bars(spark, sf_dir), "bars")
    names = F.create_map(*(F.lit(x) for kv in INDUSTRIES.items() for x in kv))
    industries = sectors(spark, sf_dir).withColumn("industry", names[c("sector")])
    x = sc.panel(features.feature_vector(rows, bars, dates), rows, bars, a.benchmark_bars(bars), industries)
    return stored(x, "panel")


@query("M15_prescreen", f"WITH RECURSIVE {_GATED} SELECT company_id, t0, category, quality, gate, rank_ AS rank FROM gated")
def prescreen(spark, sf_dir):
    """Factor rank of every company and date, and the first gate that stops it."""
    return sc.prescreen(panel(spark, sf_dir), REQUEST).select("company_id", "t0", "category", "quality", "gate", "rank")


@query("M16_deep_evaluation", f"WITH RECURSIVE {_EVALUATED} SELECT company_id, t0, p1, p2, p3, p4, p5, reinvested, implied, fundable, gap, potential, entry, asymmetry, conviction, likelihood, failure_risk, p_2x, p_5x, p_10x, conversion_status FROM evaluated")
def deep_evaluation(spark, sf_dir):
    """Five pillars and the vectors made of them."""
    x = sc.evaluate(sc.stratified(sc.prescreen(panel(spark, sf_dir), REQUEST), REQUEST.limit))
    return x.select("company_id", "t0", "p1", "p2", "p3", "p4", "p5", "reinvested", "implied", "fundable", "gap", "potential", "entry", "asymmetry", "conviction", "likelihood", "failure_risk", "p_2x", "p_5x", "p_10x", "conversion_status")


@query("M14_five_pillars", f"WITH RECURSIVE {_SYNTHESIS} SELECT company_id, t0, acceleration_method, floor(second * 100 + 0.5) / 100 AS acceleration, second > 0 AND first_ > 0 AS is_accelerating, compounding, obtainable, bottleneck, runway, composite, tier, breakers FROM synthesis")
def five_pillars(spark, sf_dir):
    """Composite of the pillars, circuit breakers and tier; how operating profit accelerates, by the method that the history allows."""
    x = sc.synthesis(sc.evaluate(sc.stratified(sc.prescreen(panel(spark, sf_dir), REQUEST), REQUEST.limit)))
    return x.select("company_id", "t0", "acceleration_method", "acceleration", "is_accelerating", "compounding", "obtainable", "bottleneck", "runway", "composite", "tier", F.concat_ws(",", "breakers").alias("breakers"))


@query("M18_routing", f"WITH RECURSIVE {_ROUTED} SELECT company_id, t0, verdict, thesis, setup, swing_active, grade, signal, scalp, intraday_active, quantity, return_floor, margin_floor, dso_ceiling, price_floor FROM screened")
def routing(spark, sf_dir):
    """Verdict, setup grade, signal, ticket and invalidation levels of every company and date."""
    x = sc.run_screen(panel(spark, sf_dir), REQUEST)
    return x.select("company_id", "t0", "verdict", "thesis", "setup", "swing_active", "grade", "signal", "scalp", "intraday_active", "quantity", "return_floor", "margin_floor", "dso_ceiling", "price_floor")


@query("M20_staged_screen", f"WITH RECURSIVE {_ROUTED} SELECT company_id, t0, stage_reached, gate, place, conviction, CASE WHEN stage_reached = 4 THEN {_FEEDS} ELSE '' END AS feeds FROM screened")
def staged_screen(spark, sf_dir):
    """Stages 1 to 4 and the four feeds in one plan."""
    x = sc.run_screen(panel(spark, sf_dir), REQUEST)
    return x.select("company_id", "t0", "stage_reached", "gate", c("place").cast("long").alias("place"), "conviction", F.concat_ws(",", "feeds").alias("feeds"))


_LOST = ", ".join(f"coalesce({r(f'(1 - stage{k}::DOUBLE / nullif(stage{k - 1}, 0)) * 100', 2)}, 0) AS lost{k}" for k in (2, 3, 4))


@query("A22_stage_attrition", f"WITH RECURSIVE {_ROUTED}, n AS (SELECT t0, {', '.join(f'count(*) FILTER (stage_reached >= {k}) AS stage{k}' for k in (1, 2, 3, 4))} FROM screened GROUP BY t0) SELECT t0, stage1, stage2, stage3, stage4, {_LOST} FROM n")
def stage_attrition(spark, sf_dir):
    """Survivors and losses of every stage, per date."""
    return sc.attrition(sc.run_screen(panel(spark, sf_dir), REQUEST))


def _provenance(name: str, checked: bool, proxy: str) -> str:
    quality = f"CASE WHEN {name} IS NULL AND NOT ({proxy}) THEN 'MISSING' WHEN {str(checked).lower()} AND {name} IS NOT NULL THEN 'CROSS_CHECKED' WHEN {proxy} THEN 'PROXY' ELSE 'VERIFIED' END"
    return f"'{name}=' || {quality}"


_GUARD = D(f"""WITH {FEATURES}, {_SEGMENT_SQL}, g0 AS (SELECT f.company_id, t0, {_CATEGORY.replace('industry', f'({_INDUSTRY})')} AS category, CASE WHEN ascii(right(f.company_id, 1)) % 4 = 0 THEN 'SME ' ELSE 'Co ' END || f.company_id AS company_name, roce, CASE WHEN net_worth > 0 THEN ttm_pat / net_worth * 100 END AS roe, pat_margin AS net_margin, debt_to_equity,
  ebitda_margin AS opm, revenue_growth AS sales_growth, pe, ttm_fcf - ttm_ebitda * 0.66 AS fcf, net_cash + debt_to_equity * net_worth AS cash, debt_to_equity * net_worth AS debt FROM features f JOIN sectors USING (company_id)),
 g1 AS (SELECT *, category = 'FINANCIALS' AS fin, coalesce(roce >= 14, false) OR coalesce(roe >= 14, false) AS attractive, coalesce(sales_growth >= 15, false) AS growing, NOT coalesce(debt_to_equity > 2, false) AND NOT coalesce(opm < 0, false) AND NOT coalesce(debt > 0 AND debt > cash AND cash / debt < 0.20 AND debt_to_equity > 1.2, false) AS safe FROM g0),
 g2 AS (SELECT *, CASE WHEN fin THEN 'EXEMPT_FINANCIAL' WHEN fcf IS NULL THEN 'DATA_UNAVAILABLE' WHEN fcf >= 0 THEN 'CASH_GENERATIVE' WHEN attractive AND growing AND safe THEN 'GROWTH_REINVESTMENT' ELSE 'FCF_RISK' END AS fcf_status, (CASE WHEN fin THEN roe ELSE roce END IS NULL)::INT + (sales_growth IS NULL)::INT + (opm IS NULL)::INT + (pe IS NULL)::INT AS missing, contains(company_name, 'SME') AS sme FROM g1)""")


@query("F30_missing_data_guard", f"""{_GUARD} SELECT company_id, t0, category, round(CASE WHEN fin THEN coalesce(roe, CASE WHEN net_margin > 0 THEN least(30, net_margin * 0.8) END, 15) ELSE coalesce(roce, roe) END, 4) AS effective_quality,
 CASE WHEN fin THEN CASE WHEN roe IS NOT NULL THEN 'RETURN_ON_EQUITY' WHEN net_margin > 0 THEN 'MARGIN_PROXY' ELSE 'SECTOR_MEDIAN' END WHEN roce IS NOT NULL THEN 'RETURN_ON_CAPITAL' WHEN roe IS NOT NULL THEN 'RETURN_ON_EQUITY' ELSE 'NONE' END AS quality_basis,
 round(CASE WHEN fin THEN 1 ELSE debt_to_equity END, 4) AS effective_solvency, fcf_status, CASE WHEN fcf_status = 'FCF_RISK' THEN concat_ws(',', CASE WHEN NOT attractive THEN 'RETURNS' END, CASE WHEN NOT growing THEN 'GROWTH' END, CASE WHEN NOT safe THEN 'SOLVENCY' END) ELSE '' END AS fcf_reasons, fcf_status = 'GROWTH_REINVESTMENT' AS grower,
 CASE WHEN missing >= 2 THEN 0.5 WHEN NOT sme THEN 1 ELSE 0.7 END::DOUBLE AS fidelity, CASE WHEN missing >= 2 THEN 'LIMITED_DATA' WHEN NOT sme THEN 'FULL_OHLCV' ELSE 'SME_CLOUD_PROXY' END AS rating, {" || ',' || ".join(_provenance(k, k == 'roce', 'fin' if k == 'debt_to_equity' else 'false') for k in ('roce', 'debt_to_equity', 'opm', 'sales_growth', 'pe', 'fcf'))} AS provenance FROM g2""")
def missing_data_guard(spark, sf_dir):
    """Every company and date; free cash flow after two thirds of operating profit for growth spending, so that all classes occur."""
    from .fundamentals import vector

    names = F.create_map(*(F.lit(x) for kv in INDUSTRIES.items() for x in kv))
    x = vector(spark, sf_dir).join(sectors(spark, sf_dir).withColumn("industry", names[c("sector")]), "company_id")
    debt = c("debt_to_equity") * c("net_worth")
    x = x.select(
        "company_id", "t0", "industry", F.concat(F.when(F.ascii(F.right("company_id", F.lit(1))) % 4 == 0, "SME ").otherwise("Co "), "company_id").alias("company_name"), "roce", F.when(c("net_worth") > 0, c("ttm_pat") / c("net_worth") * 100).alias("roe"), c("pat_margin").alias("net_margin"),
        "debt_to_equity", c("ebitda_margin").alias("opm"), c("revenue_growth").alias("sales_growth"), "pe", (c("ttm_fcf") - c("ttm_ebitda") * 0.66).alias("fcf"), (c("net_cash") + debt).alias("cash"), debt.alias("debt"),
    )
    x = sc.missing_data_guard(sc.categories(x, "industry"))
    provenance = F.array_join(F.transform(F.array(*(F.lit(k) for k in ("roce", "debt_to_equity", "opm", "sales_growth", "pe", "fcf"))), lambda k: F.concat(k, F.lit("="), F.try_element_at("provenance", k)["quality"])), ",")
    return x.select(
        "company_id", "t0", "category", F.round("effective_quality", 4).alias("effective_quality"), "quality_basis", F.round("effective_solvency", 4).alias("effective_solvency"), "fcf_status", F.concat_ws(",", F.coalesce("fcf_reasons", F.array().cast("array<string>"))).alias("fcf_reasons"), "grower",
        c("fidelity").cast("double").alias("fidelity"), "rating", provenance.alias("provenance"),
    )
