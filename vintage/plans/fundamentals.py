"""Queries over the feature vector and statements: engines, valuation, lifecycle, returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import engines, features, scores
from ..sources import statements as s
from ..sources.stored import stored
from .feature_sql import FEATURES, FUNDAMENTALS, newest
from .registry import query

c = F.col
#: Features as reported: names, and digits of the numeric ones.
TEXTS = ("latest_period", "scope_flag", "scope", "roce_method", "trading_date")
NUMBERS = (
    "latest_revenue", "latest_pat", "ttm_revenue", "ttm_pat", "ttm_ebit", "ttm_ebitda", "ttm_depreciation", "ebitda_margin", "pat_margin", "revenue_growth", "pat_growth", "roce", "capital_employed", "net_worth",
    "debt_to_equity", "net_debt_to_equity", "financial_debt_to_equity", "debt_to_ebitda", "net_cash", "ttm_cfo", "ttm_capex", "ttm_fcf", "cfo_to_pat", "fcf_conversion", "ttm_eps", "shares", "market_cap", "pe", "pb",
    "fcf_yield", "close", "sma20", "sma50", "sma200", "dist_sma20", "dist_sma50", "dist_sma200", "rsi", "atr", "atr_pct", "high_52w", "low_52w", "dist_high", "dist_low", "volume_acceleration",
)


def vector(spark, sf_dir, split=1):
    """The feature vector of every company and date; ``split``: so many companies for each of the 25."""
    rows = stored(s.statements(spark, sf_dir, split), "statements")  # quarters, years and dates are read from it
    return features.feature_vector(rows, s.listed_bars(spark, sf_dir, split), s.reading_dates(rows))


def _rounded(x, names, digits=4):
    return [F.round(k, digits).alias(k) for k in names]


def _sql_rounded(names, digits=4):
    return ", ".join(f"round({k}, {digits}) AS {k}" for k in names)


@query("M1_feature_vector", f"WITH {FEATURES} SELECT company_id, t0, {', '.join(TEXTS)}, {_sql_rounded(NUMBERS, 5)} FROM features")
def feature_vector(spark, sf_dir):
    x = vector(spark, sf_dir)
    return x.select("company_id", "t0", *TEXTS, *_rounded(x, NUMBERS, 5))


@query("M2_feature_store", f"""WITH {FEATURES} SELECT company_id, t0, '1.0' AS version, {' + '.join(f"({k} IS NULL)::INT" for k in NUMBERS)} AS missing, round(100 - 100.0 * ({' + '.join(f"({k} IS NULL)::INT" for k in NUMBERS)}) / {len(NUMBERS)}, 4) AS completeness FROM features""")
def feature_store(spark, sf_dir):
    """Versioned features with their completeness."""
    missing = sum((c(k).isNull().cast("int") for k in NUMBERS), F.lit(0))
    return vector(spark, sf_dir).select("company_id", "t0", F.lit(features.FEATURE_VERSION).alias("version"), missing.alias("missing"), F.round(100 - missing * 100 / len(NUMBERS), 4).alias("completeness"))


@query("M35_vector_catalogue", f"""WITH {FEATURES}, chosen AS (SELECT company_id, t0, roce, pe, revenue_growth, sma200, fcf_yield FROM features), long AS (SELECT * FROM chosen UNPIVOT INCLUDE NULLS (value FOR feature IN (roce, pe, revenue_growth, sma200, fcf_yield)))
SELECT company_id, t0, feature, round(value, 4) AS value, '1.0' AS version, value IS NULL AS missing FROM long""")
def feature_catalogue(spark, sf_dir):
    x = vector(spark, sf_dir).select("company_id", "t0", "roce", "pe", "revenue_growth", "sma200", "fcf_yield")
    return features.catalogue(x).select("company_id", "t0", "feature", F.round("value", 4).alias("value"), "version", "missing")


_STRICT = newest("nq", "QUARTERLY", 4, 8).replace("s.published <= d.t0", "s.published <= d.t0 AND s.rec_start <= d.t0 AND d.t0 < s.rec_end")


@query("J1_strict_system_time", f"""WITH {FUNDAMENTALS.split(', dates AS')[0]}, timed AS (SELECT *, published AS rec_start, coalesce(lead(published) OVER (PARTITION BY company_id, period_type, period_end ORDER BY published), DATE '9999-12-31') AS rec_end FROM statements),
  dates AS (SELECT DISTINCT company_id, CAST(period_end + INTERVAL 75 DAY AS DATE) AS t0 FROM statements), {_STRICT.replace('JOIN statements s', 'JOIN timed s')} SELECT company_id, t0, period_end, age, vintage, round(revenue, 4) AS revenue FROM nq""")
def strict_system_time(spark, sf_dir):
    """As-of read under both times: published by the date and, of a period's vintages, the one that the system held then."""
    rows = s.statements(spark, sf_dir)
    by = Window.partitionBy("company_id", "period_type", "period_end").orderBy("published")
    timed = rows.withColumns({"rec_start": c("published"), "rec_end": F.coalesce(F.lead("published").over(by), F.lit("9999-12-31").cast("date"))})
    x = features.newest_statements(timed, s.reading_dates(rows), "QUARTERLY", 8, strict=True)
    return x.select("company_id", "t0", "period_end", c("age").cast("long").alias("age"), "vintage", F.round("revenue", 4).alias("revenue"))


_LONG = """scored AS (SELECT *, CASE WHEN roce IS NOT NULL AND ebitda_margin IS NOT NULL THEN CAST(trunc(least(98, greatest(25, 30 + least(45, greatest(0, roce)) * 1.1 + least(30, ebitda_margin) * 0.6))) AS INT) END AS moat,
  CASE WHEN revenue_growth IS NOT NULL OR pat_growth IS NOT NULL THEN CAST(trunc(least(98, greatest(20, 50 + least(40, greatest(-20, coalesce(revenue_growth, 0))) * 0.6 + least(40, greatest(-20, coalesce(pat_growth, 0))) * 0.5))) AS INT) END AS growth,
  CASE WHEN debt_to_equity > 2 THEN 55 WHEN debt_to_equity > 1 THEN 70 WHEN debt_to_equity < 0.3 THEN 95 WHEN debt_to_equity IS NOT NULL THEN 85 END AS solvency,
  CASE WHEN pe <= 0 OR pe IS NULL THEN 60 WHEN pe < 15 THEN 90 WHEN pe < 25 THEN 80 WHEN pe < 40 THEN 65 WHEN pe < 65 THEN 48 ELSE 30 END AS val FROM features), total AS (
  SELECT *, least(99, greatest(20, (moat * 35 + growth * 25 + solvency * 20 + val * 20) // 100)) AS s FROM scored WHERE moat IS NOT NULL AND growth IS NOT NULL AND solvency IS NOT NULL
  UNION ALL SELECT *, NULL FROM scored WHERE moat IS NULL OR growth IS NULL OR solvency IS NULL)"""


@query("M4_longterm", f"""WITH {FEATURES}, {_LONG} SELECT company_id, t0, moat, growth, solvency, val AS value, CAST(s AS INT) AS longterm_score, CASE WHEN s >= 80 THEN 'TIER_1_COMPOUNDER' WHEN s >= 65 THEN 'HIGH_QUALITY_GROWTH' WHEN s >= 50 THEN 'MODERATE_QUALITY' WHEN s IS NOT NULL THEN 'WATCHLIST_ONLY' ELSE 'DATA_INSUFFICIENT' END AS grade,
  concat_ws(', ', CASE WHEN roce >= 20 THEN 'exceptional capital efficiency' WHEN roce >= 15 THEN 'healthy capital efficiency' END, CASE WHEN fcf_yield >= 3 THEN 'free cash flow' END, CASE WHEN debt_to_equity <= 0.5 THEN 'low leverage' END, CASE WHEN revenue_growth >= 12 THEN 'growth' END) AS thesis,
  concat_ws(', ', CASE WHEN pe > 50 THEN 'valuation' END, CASE WHEN debt_to_equity > 1.2 THEN 'leverage' END, CASE WHEN pat_margin < 4 THEN 'thin margin' END) AS risks FROM total""")
def longterm(spark, sf_dir):
    x = engines.longterm(vector(spark, sf_dir))
    return x.select("company_id", "t0", "moat", "growth", "solvency", "value", "longterm_score", "grade", F.concat_ws(", ", "thesis").alias("thesis"), F.concat_ws(", ", "risks").alias("risks"))


@query("M5_swing", f"""WITH {FEATURES}, r AS (SELECT *, greatest(close * 0.015, atr * 1.5) AS away, greatest(close * 0.05, atr * 2.5) AS gain,
  CASE WHEN rsi >= 52 AND rsi <= 68 THEN 95 WHEN rsi >= 45 AND rsi < 52 THEN 75 WHEN rsi > 68 AND rsi <= 78 THEN 70 WHEN rsi > 78 THEN 45 ELSE 35 END * 0.35
  + (50 + CASE WHEN coalesce(dist_sma50, 0) >= 0 THEN 20 ELSE 0 END + CASE WHEN coalesce(dist_sma200, 0) >= 0 THEN 15 ELSE 0 END + CASE WHEN coalesce(dist_sma20, 0) > 0 THEN 10 ELSE 0 END) * 0.30
  + least(95, greatest(20, (100 + dist_high) * 0.95)) * 0.20 + (50 + least(40, (volume_acceleration - 1) * 35)) * 0.15 AS total FROM features WHERE close > 0 AND bars >= 15)
SELECT company_id, t0, CAST(trunc(least(99, greatest(20, total))) AS INT) AS swing_score, round(close - away, 4) AS stop, round(close + gain, 4) AS target, round(away / close * 100, 4) AS risk_pct, round(gain / close * 100, 4) AS gain_pct, round(gain / greatest(away, 0.1), 4) AS reward_to_risk,
  CASE WHEN dist_high >= -5 AND volume_acceleration >= 1.3 THEN '52W_HIGH_BREAKOUT' WHEN rsi BETWEEN 52 AND 65 AND coalesce(dist_sma50, 0) > 0 THEN 'TREND_MOMENTUM_EXPANSION' WHEN rsi < 45 AND coalesce(dist_sma200, 0) > 0 THEN '200DMA_PULLBACK_REVERSAL' ELSE 'CONSOLIDATION_WATCH' END AS setup,
  concat_ws(', ', CASE WHEN rsi BETWEEN 52 AND 68 THEN 'momentum' END, CASE WHEN dist_sma50 > 0 THEN 'trend' END, CASE WHEN volume_acceleration >= 1.2 THEN 'volume' END, CASE WHEN dist_high >= -10 THEN 'strength' END) AS thesis FROM r""")
def swing(spark, sf_dir):
    x = engines.swing(vector(spark, sf_dir))
    return x.select("company_id", "t0", "swing_score", *_rounded(x, ("stop", "target", "risk_pct", "gain_pct", "reward_to_risk")), "setup", F.concat_ws(", ", "thesis").alias("thesis"))


@query("M6_intraday", f"""WITH {FEATURES}, r AS (SELECT *, CASE WHEN vol20 > 0 THEN round(volume / vol20, 2) ELSE 1 END AS spike, CASE WHEN prev_close > 0 THEN round((close - prev_close) / prev_close * 100, 2) ELSE 0 END AS change, greatest(close * 0.008, atr * 1.5) AS away FROM features WHERE bars >= 15)
SELECT company_id, t0, CAST(least(99, greatest(45, trunc(65 + spike * 6 + change * 1.5))) AS INT) AS intraday_score, CASE WHEN change > 0.5 AND spike >= 1.3 THEN 'MOMENTUM_EXPANSION_BREAKOUT' WHEN change < -1.5 THEN 'MEAN_REVERSION_PULLBACK' ELSE 'RANGE_EXPANSION' END AS setup,
  round(close - away, 4) AS stop, round(close + away * 2, 4) AS target, round(away / close * 100, 4) AS risk_pct FROM r""")
def intraday(spark, sf_dir):
    x = engines.intraday(vector(spark, sf_dir))
    return x.select("company_id", "t0", "intraday_score", "setup", *_rounded(x, ("stop", "target", "risk_pct")))


_FROZEN = {"growth": "growth_score", "quality": "quality_score", "valuation": "valuation_score", "momentum": "momentum_score", "governance": "governance_score"}


@query("M3_frozen_features", f"""WITH {FEATURES}, p AS (SELECT company_id, t0,
  least(99, greatest(15, 50 + least(50, greatest(-30, coalesce(revenue_growth, 0))) * 0.5 + least(50, greatest(-30, coalesce(pat_growth, 0))) * 0.5)) AS g,
  CASE WHEN roce IS NOT NULL AND ebitda_margin IS NOT NULL THEN least(99, greatest(20, 30 + least(50, greatest(0, roce)) * 0.9 + least(35, ebitda_margin) * 0.7)) END AS q,
  least(95, greatest(20, CASE WHEN pe <= 0 THEN 60 WHEN pe < 12 THEN 92 WHEN pe < 20 THEN 82 WHEN pe < 35 THEN 68 WHEN pe < 60 THEN 50 WHEN pe IS NOT NULL THEN 35 ELSE 60 END + CASE WHEN pb < 2.5 THEN 5 ELSE 0 END)) AS v,
  least(99, greatest(15, 40 + (20 - abs(coalesce(rsi, 50) - 60) * 0.8) + least(20, greatest(-15, coalesce(dist_sma50, 0))) + least(15, greatest(-10, coalesce(dist_sma200, 0) * 0.5)) + (100 + coalesce(dist_high, -15)) * 0.2 + least(15, (coalesce(volume_acceleration, 1) - 1) * 15))) AS m,
  CASE WHEN debt_to_equity IS NOT NULL AND pat_margin IS NOT NULL THEN least(95, greatest(25, 85 - CASE WHEN debt_to_equity > 2.5 THEN 25 WHEN debt_to_equity > 1.5 THEN 12 ELSE 0 END - CASE WHEN pat_margin < 3 THEN 15 ELSE 0 END)) END AS o FROM features),
 i AS (SELECT company_id, t0, CAST(trunc(g) AS INT) AS g, CAST(trunc(q) AS INT) AS q, CAST(trunc(v) AS INT) AS v, CAST(trunc(m) AS INT) AS m, CAST(trunc(o) AS INT) AS o FROM p)
SELECT company_id, t0, g AS growth_score, q AS quality_score, v AS valuation_score, m AS momentum_score, o AS governance_score, CASE WHEN q IS NOT NULL AND o IS NOT NULL THEN CAST(least(99, greatest(20, (q * 30 + g * 25 + m * 20 + v * 15 + o * 10) // 100)) AS INT) END AS conviction FROM i""")
def frozen_features(spark, sf_dir):
    """The frozen factor score over the whole feature vector."""
    return scores.frozen_factors(vector(spark, sf_dir)).select("company_id", "t0", *_FROZEN.values(), c("conviction").cast("int").alias("conviction"))


_VALUED = f"""{FEATURES}, v AS (SELECT company_id, t0, pe, pb, pat_growth AS growth, revenue_growth AS sustainable, roce, ttm_fcf AS fcf, market_cap AS cap, debt_to_equity, 50.0 AS percentile, ttm_ebit * 0.75 AS nopat, -net_cash AS net_debt FROM features), b AS (
  SELECT *, coalesce(nopat > 0 AND (fcf <= 0 OR fcf / cap < 0.005 OR fcf < nopat * 0.15), false) AS poor, coalesce(growth, sustainable) AS g FROM v), d AS (
  SELECT *, CASE WHEN NOT poor AND fcf > 0 THEN fcf WHEN nopat > 0 THEN nopat WHEN fcf > 0 THEN fcf END AS cash, CASE WHEN poor OR NOT fcf > 0 THEN greatest(cap * 0.35, cap + coalesce(net_debt, 0)) ELSE cap END AS target,
    CASE WHEN poor THEN 'NOPAT_NORMALIZED' WHEN fcf > 0 THEN 'FCF' WHEN nopat > 0 THEN 'NOPAT_OWNER_EARNINGS' ELSE 'NONE' END AS basis,
    CASE WHEN pe > 0 AND g > 0 THEN round(pe / CASE WHEN g > 60 AND sustainable > 0 THEN least(50, greatest(5, sustainable)) ELSE greatest(g, 5) END, 2) END AS peg,
    CASE WHEN pe IS NULL OR pe <= 0 THEN 'PE_UNDEFINED' WHEN g IS NULL THEN 'GROWTH_UNKNOWN' WHEN g <= 0 THEN 'NEGATIVE_GROWTH' WHEN g > 60 THEN CASE WHEN sustainable > 0 THEN 'NORMALIZED_SUSTAINABLE' ELSE 'HYPERGROWTH_BASE_EFFECT' END ELSE 'VALID' END AS peg_status FROM b)"""
_PRESENT = "cash * (CASE WHEN abs(q - 1) < 1e-12 THEN 10 ELSE q * (1 - power(q, 10)) / (1 - q) END + power(q, 10) * 1.05 / (0.12 - 0.05))"
_SOLVED = f"""w AS (SELECT company_id, t0, cash, target, 1 AS step, -50.0::DOUBLE AS lo, 200.0::DOUBLE AS hi, false AS done FROM d WHERE cash > 0 AND target > 0 UNION ALL
  SELECT company_id, t0, cash, target, step + 1, CASE WHEN done THEN lo WHEN hit OR gap < 0 THEN mid ELSE lo END, CASE WHEN done THEN hi WHEN hit OR gap >= 0 THEN mid ELSE hi END, done OR hit
  FROM (SELECT *, abs(gap) < 0.01 AS hit FROM (SELECT *, {_PRESENT} - target AS gap FROM (SELECT *, (lo + hi) / 2 AS mid, (1 + (lo + hi) / 200) / 1.12 AS q FROM w WHERE step <= 60)))), ends AS (
  SELECT company_id, t0, (lo + hi) / 2 AS mid, {_PRESENT.replace('q', '(0.5 / 1.12)').replace('s(0.5 / 1.12)rt', 'sqrt')} >= target AS low, {_PRESENT.replace('q', '(3.0 / 1.12)')} <= target AS high FROM w WHERE step = 61), solved AS (
  SELECT d.*, CASE WHEN low THEN -50 WHEN high THEN 200 ELSE round(mid, 1) END AS implied, coalesce(round(fcf / cap * 100, 2), 0) AS y, coalesce(pe, 0) AS p0, coalesce(roce, 0) AS r0, coalesce(g, 0) AS g0 FROM d LEFT JOIN ends USING (company_id, t0))"""


@query("M13_valuation_regime", f"""WITH RECURSIVE {_VALUED}, {_SOLVED} SELECT company_id, t0, basis, peg, peg_status, implied, CASE
  WHEN p0 > 0 AND p0 <= 18 AND (g0 < 0 OR (r0 < 12 AND y < 2)) THEN 'VALUE_TRAP_WARNING'
  WHEN (p0 > 65 AND (peg IS NULL OR peg > 2.5 OR g0 < 15)) OR coalesce(peg > 3, false) OR coalesce(implied > 35 AND g0 < 20, false) THEN 'OVERVALUED_EXTREME'
  WHEN r0 >= 18 AND coalesce(peg <= 1.15, false) AND percentile <= 65 AND p0 <= 38 AND peg_status <> 'HYPERGROWTH_BASE_EFFECT' THEN 'UNDERVALUED_COMPOUNDER'
  WHEN p0 > 0 AND p0 <= 16 AND y >= 6.5 AND coalesce(debt_to_equity, 0) <= 0.6 AND r0 >= 13 THEN 'DEEP_VALUE'
  WHEN r0 >= 20 AND (p0 > 35 OR coalesce(peg > 1.15 AND peg <= 2.8, false)) THEN 'QUALITY_GROWTH_PREMIUM' ELSE 'FAIR_VALUE' END AS regime FROM solved""")
def valuation_regime(spark, sf_dir):
    x = vector(spark, sf_dir).withColumns({"growth": c("pat_growth"), "sustainable": c("revenue_growth"), "percentile": F.lit(50.0), "nopat": c("ttm_ebit") * 0.75, "net_debt": -c("net_cash")})
    return engines.valuation_regime(x).select("company_id", "t0", "basis", "peg", "peg_status", "implied", "regime")


@query("F24_latent_upside", f"""WITH {FEATURES}, u AS (SELECT company_id, t0, greatest(ttm_revenue, 1) AS rev, greatest(ttm_ebit, 0.1) AS ebit, greatest(ttm_pat, 0.1) AS pat, roce, least(95, greatest(30, 40 + ascii(company_id) % 7 * 9.0)) AS used FROM features),
 a AS (SELECT *, round(ebit / rev * 100, 2) AS opm, round(greatest(used, 85) / used, 2) AS factor FROM u), b AS (SELECT *, greatest(opm, 16) AS goal FROM a),
 e AS (SELECT *, round((goal - opm) * 100, 0) AS extra, rev * factor * goal / 100 * 0.75 AS potential, greatest(0, 28 - roce) AS gap FROM b)
SELECT company_id, t0, opm, factor, extra AS extra_bps, round(potential, 4) AS potential_pat, round(potential / pat, 2) AS leverage, round(least(100, gap * 2 + extra / 50 + (factor - 1) * 100), 4) AS distance,
 CASE WHEN round(potential / pat, 2) >= 2 THEN 'EXPLOSIVE_LATENT_OPERATIONAL_LEVERAGE' WHEN round(potential / pat, 2) >= 1.4 THEN 'HEALTHY_OPERATIONAL_RUNWAY' ELSE 'NEAR_PEAK_OPERATIONAL_EFFICIENCY' END AS profile, CASE WHEN goal <= opm * 1.5 THEN 'HIGH_GROUNDED' ELSE 'MEDIUM_STRETCH' END AS confidence FROM e""")
def latent_upside(spark, sf_dir):
    x = engines.latent_upside(vector(spark, sf_dir).withColumn("utilisation", 40 + F.ascii("company_id") % 7 * 9.0))
    return x.select("company_id", "t0", "opm", "factor", "extra_bps", F.round("potential_pat", 4).alias("potential_pat"), "leverage", F.round("distance", 4).alias("distance"), "profile", "confidence")


_STAKE = "ascii(company_id) % 10 * 4.0"


@query("F27_lifecycle", f"""WITH {FEATURES}, z AS (SELECT *, ttm_capex / ttm_cfo * 100 AS reinvestment, (roce - lag(roce, 4) OVER (PARTITION BY company_id ORDER BY t0)) * 100 AS delta, {_STAKE} AS stake, (ttm_pat - ttm_capex) / ttm_pat * 40 AS payout FROM features),
 k AS (SELECT *, CASE WHEN delta < -500 AND revenue_growth < 5 AND roce < 12 THEN '8_DECLINING' WHEN revenue_growth < 10 AND payout > 35 AND market_cap > 20000 THEN '7_MATURE' WHEN market_cap < 1500 AND ttm_revenue < 300 THEN '1_EARLY_SMALL'
  WHEN pat_growth > revenue_growth * 1.4 AND roce >= 22 AND revenue_growth > 15 THEN '4_OPERATING_LEVERAGE' WHEN pat_growth > 30 AND delta > 200 THEN '3_RAPID_EARNINGS_EXPANSION' WHEN stake BETWEEN 5 AND 25 AND revenue_growth > 20 AND market_cap >= 2000 THEN '5_INSTITUTIONAL_DISCOVERY'
  WHEN pe > 35 AND revenue_growth > 25 AND roce > 25 THEN '6_RERATING' ELSE '2_SCALING' END AS stage,
  CASE WHEN market_cap IS NOT NULL THEN least(1, greatest(0, (log10(greatest(market_cap, 10)) - 2) / 3.7)) END AS scale, CASE WHEN reinvestment IS NOT NULL THEN least(1, greatest(0, reinvestment / 100)) END AS reinvesting, CASE WHEN roce IS NOT NULL THEN least(1, greatest(0, roce / 50)) END AS efficiency,
  CASE WHEN pat_growth IS NOT NULL AND revenue_growth IS NOT NULL THEN least(1, greatest(0, (round(greatest(pat_growth, 0) / greatest(revenue_growth, 1), 2) - 0.5) / 2.5)) END AS lev, stake / 50 AS discovery,
  CASE WHEN pe IS NOT NULL THEN least(1, greatest(0, (greatest(pe, 5) - 10) / 70)) END AS rerating FROM z)
SELECT company_id, t0, stage, round(scale, 4) AS scale, round(reinvesting, 4) AS reinvesting, round(efficiency, 4) AS efficiency, round(lev, 4) AS leverage, round(discovery, 4) AS discovery, round(rerating, 4) AS rerating,
 CASE WHEN lev >= 0.5 AND discovery < 0.5 AND efficiency >= 0.5 THEN 'EARLY_TO_OPERATING_LEVERAGE_INFLECTION' WHEN discovery >= 0.4 AND rerating > 0.6 THEN 'INSTITUTIONAL_RERATING_EXPANSION' WHEN scale > 0.8 AND reinvesting < 0.3 THEN 'MATURE_CASH_COW_PLATEAU' ELSE 'STABLE_COORDINATES' END AS signature FROM k""")
def lifecycle(spark, sf_dir):
    by = Window.partitionBy("company_id").orderBy("t0")
    x = vector(spark, sf_dir).withColumns({
        "ebitda_growth": c("pat_growth"), "reinvestment": c("ttm_capex") / c("ttm_cfo") * 100, "roce_delta_bps": (c("roce") - F.lag("roce", 4).over(by)) * 100, "institutional": F.ascii("company_id") % 10 * 4.0,
        "payout": (c("ttm_pat") - c("ttm_capex")) / c("ttm_pat") * 40,
    })
    x = engines.lifecycle_stage(x)
    return x.select("company_id", "t0", "stage", *_rounded(x, ("scale", "reinvesting", "efficiency", "leverage", "discovery", "rerating")), "signature")


@query("F29_displacement", f"""WITH {FEATURES}, m AS (SELECT *, avg(revenue_growth) OVER (PARTITION BY t0) AS industry FROM features WHERE revenue_growth IS NOT NULL), l AS (SELECT company_id, t0, ascii(company_id) % 5 * 10.0 AS loose, round(greatest(revenue_growth, 0) - greatest(industry, 1), 2) AS lead FROM m)
SELECT company_id, t0, lead, CASE WHEN loose >= 30 AND lead > 10 THEN 'UNORGANIZED_TO_ORGANIZED_FORMALIZATION' WHEN lead > 5 THEN 'HIGH_COST_INCUMBENT_DISPLACEMENT' ELSE 'INDUSTRY_BETA_EXPANSION' END AS mode,
 CASE WHEN lead > 15 THEN 'WIDE_MOAT_SCALE_AND_EFFICIENCY' WHEN lead > 5 THEN 'NARROW_MOAT_NICHE_LEADERSHIP' ELSE 'NO_DISCERNIBLE_MOAT' END AS moat FROM l""")
def displacement(spark, sf_dir):
    x = vector(spark, sf_dir).where("revenue_growth IS NOT NULL").withColumn("industry", F.avg("revenue_growth").over(Window.partitionBy("t0")))
    lead, mode, moat = engines.displacement(c("revenue_growth"), c("industry"), F.ascii("company_id") % 5 * 10.0)
    return x.select("company_id", "t0", lead.alias("lead"), mode.alias("mode"), moat.alias("moat"))


@query("M19_graduation_readiness", f"""WITH {FEATURES}, g AS (SELECT company_id, t0, close, sma50, high_52w, atr, coalesce(round((close - sma50) / sma50 * 100, 2), 0) AS away, coalesce(roce, 0) - 26 AS gap, 40 + coalesce(volume_acceleration, 1) * 30 AS entry FROM features WHERE close IS NOT NULL),
 r AS (SELECT *, least(99, greatest(15, round(least(40, greatest(10, entry / 75 * 40)) + CASE WHEN away BETWEEN -1.5 AND 2 THEN 30 WHEN away > 2 AND away <= 5 THEN 20 WHEN away > 5 THEN greatest(5, 25 - away * 1.5) ELSE 10 END
  + CASE WHEN gap >= 12 THEN 30 WHEN gap >= 8 THEN 25 WHEN gap > 0 THEN 15 + gap ELSE greatest(5, 15 + gap) END, 1))) AS readiness FROM g)
SELECT company_id, t0, readiness, CASE WHEN readiness >= 85 THEN 'READY' WHEN readiness >= 70 THEN 'ADVANCING' ELSE 'INCUBATING' END AS status,
 CASE WHEN readiness >= 85 THEN CASE WHEN entry >= 75 AND gap >= 8 THEN 'TIGHTNESS' WHEN away BETWEEN -1.5 AND 1.5 THEN 'ACCUMULATION_AT_MEAN' ELSE 'TIGHTNESS' END WHEN readiness >= 70 AND gap < 8 THEN 'AWAITING_VALUATION' WHEN readiness >= 70 THEN 'AWAITING_BASE' ELSE 'EARLY_BASE' END AS trigger,
 round(high_52w + greatest(atr * 0.12, close * 0.0015), 4) AS pivot FROM r""")
def graduation_readiness(spark, sf_dir):
    x = vector(spark, sf_dir).where("close IS NOT NULL").withColumns({"gap": F.coalesce("roce", F.lit(0.0)) - 26, "entry_quality": 40 + F.coalesce("volume_acceleration", F.lit(1.0)) * 30})
    return engines.graduation(x).select("company_id", "t0", "readiness", "status", "trigger", F.round("pivot", 4).alias("pivot"))


# --- statements alone ----------------------------------------------------------------------

_ONCE = FUNDAMENTALS.split(", dates AS")[0]


def _originals(spark, sf_dir):
    return s.statements(spark, sf_dir).where("period_type = 'QUARTERLY' AND vintage = 0")


@query("W22_dso_derivatives", f"""WITH {_ONCE}, q AS (SELECT company_id, period_end, receivables / revenue * 91 AS dso FROM statements WHERE period_type = 'QUARTERLY' AND vintage = 0)
SELECT company_id, period_end, round(dso, 4) AS dso, round(dso - lag(dso) OVER k, 2) AS delta, round(dso - 2 * lag(dso) OVER k + lag(dso, 2) OVER k, 2) AS delta2 FROM q WINDOW k AS (PARTITION BY company_id ORDER BY period_end)""")
def dso_derivatives(spark, sf_dir):
    """First and second difference of days of sales outstanding."""
    by = Window.partitionBy("company_id").orderBy("period_end")
    x = _originals(spark, sf_dir).withColumn("dso", f.days_outstanding(c("receivables"), c("revenue"), 91))
    delta = c("dso") - F.lag("dso").over(by)
    return x.withColumn("delta", delta).select("company_id", "period_end", F.round("dso", 4).alias("dso"), F.round("delta", 2).alias("delta"), F.round(c("delta") - F.lag("delta").over(by), 2).alias("delta2"))


_CAPITAL = f"""{_ONCE}, y AS (SELECT company_id, period_end, ebit * (1 - tax_rate) AS nopat, net_worth + total_debt - cash AS capital FROM statements WHERE period_type = 'QUARTERLY' AND vintage = 0 AND net_worth IS NOT NULL), p AS (SELECT *, nopat / capital * 400 AS roic FROM y)"""


def _capital(spark, sf_dir):
    x = _originals(spark, sf_dir).where("net_worth IS NOT NULL").withColumns({"nopat": c("ebit") * (1 - c("tax_rate")), "capital": c("net_worth") + c("total_debt") - c("cash")})
    return x.select("company_id", "period_end", "nopat", "capital", (c("nopat") / c("capital") * 400).alias("roic"))


_TRAILING = f"""{_ONCE}, y AS (SELECT company_id, period_end, CASE WHEN count(*) OVER k4 = 4 THEN sum(ebit * (1 - tax_rate)) OVER k4 END AS nopat, last_value(net_worth + total_debt - cash IGNORE NULLS) OVER k AS capital
  FROM statements WHERE period_type = 'QUARTERLY' AND vintage = 0 WINDOW k AS (PARTITION BY company_id ORDER BY period_end), k4 AS (PARTITION BY company_id ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
 p AS (SELECT *, nopat / capital * 100 AS roic FROM y WHERE nopat IS NOT NULL AND capital IS NOT NULL)"""


def _trailing(spark, sf_dir):
    """Every quarter with four quarters of operating profit after tax, and the invested capital of the newest balance sheet: all rates are annual, lags count quarters."""
    by = Window.partitionBy("company_id").orderBy("period_end")
    four, taxed = by.rowsBetween(-3, 0), c("ebit") * (1 - c("tax_rate"))
    x = _originals(spark, sf_dir).select("company_id", "period_end", F.when(F.count("*").over(four) == 4, F.sum(taxed).over(four)).alias("nopat"), F.last(c("net_worth") + c("total_debt") - c("cash"), ignorenulls=True).over(by).alias("capital"))
    return x.where("nopat IS NOT NULL AND capital IS NOT NULL").withColumn("roic", c("nopat") / c("capital") * 100)


@query("W24_incremental_roic", f"""WITH {_TRAILING}, b AS (SELECT *, row_number() OVER k AS n, {', '.join(f"coalesce(lag(nopat, {i}) OVER k, first(nopat) OVER k) AS n{i}, coalesce(lag(capital, {i}) OVER k, first(capital) OVER k) AS c{i}" for i in (4, 8, 12))} FROM p WINDOW k AS (PARTITION BY company_id ORDER BY period_end)),
 r AS (SELECT *, {', '.join(f"CASE WHEN n > 1 AND abs(capital - c{i}) >= greatest(5, c{i} * 0.05) THEN round((nopat - n{i}) / (capital - c{i}) * 100, 2) END AS roiic{i}" for i in (4, 8, 12))} FROM b)
SELECT company_id, period_end, roiic4, roiic8, roiic12, round((capital - c12) / greatest(1, c12) * 100, 4) AS deployment, CASE WHEN n = 1 THEN 'INSUFFICIENT_HISTORY' WHEN abs(capital - c12) < greatest(5, c12 * 0.05) THEN 'CAPITAL_UNCHANGED_ASSET_LIGHT' WHEN capital < c12 AND nopat > n12 THEN 'CAPITAL_EXTRACTION_EFFICIENCY' WHEN capital < c12 THEN 'BUSINESS_CONTRACTION'
 WHEN roiic12 > roic AND roiic12 > 20 THEN 'ACCELERATING_CAPITAL_EFFICIENCY' WHEN roiic12 >= 15 THEN 'HEALTHY_COMPOUNDER' WHEN roiic12 > 0 THEN 'DILUTIVE_GROWTH' ELSE 'VALUE_DESTRUCTION' END AS status FROM r""")
def incremental_roic(spark, sf_dir):
    return engines.incremental_roic(_trailing(spark, sf_dir)).select("company_id", "period_end", "roiic4", "roiic8", "roiic12", F.round("deployment", 4).alias("deployment"), "status")


@query("W25_roic_momentum", f"""WITH {_TRAILING}, b AS (SELECT *, row_number() OVER k AS n, round(roic - coalesce(lag(roic, 4) OVER k, first(roic) OVER k), 2) AS delta4, round(roic - coalesce(lag(roic, 8) OVER k, first(roic) OVER k), 2) AS delta8 FROM p WINDOW k AS (PARTITION BY company_id ORDER BY period_end))
SELECT company_id, period_end, round(roic, 4) AS roic, delta4, delta8, CASE WHEN n < 2 THEN 'FLAT_OR_INSUFFICIENT_DATA' WHEN delta4 >= 5 AND delta8 >= 8 THEN 'POWERFUL_ROIC_EXPANSION' WHEN delta4 > 1.5 THEN 'STEADY_ROIC_IMPROVEMENT' WHEN delta4 < -3 THEN 'DETERIORATING_CAPITAL_EFFICIENCY' ELSE 'STABLE_PLATEAU' END AS profile FROM b""")
def roic_momentum(spark, sf_dir):
    return engines.roic_momentum(_trailing(spark, sf_dir)).select("company_id", "period_end", F.round("roic", 4).alias("roic"), "delta4", "delta8", "profile")


@query("W23_incremental_capital", f"""WITH {_CAPITAL}, d AS (SELECT *, capital - lag(capital) OVER k AS dc, nopat - lag(nopat) OVER k AS dn FROM p WINDOW k AS (PARTITION BY company_id ORDER BY period_end))
SELECT company_id, period_end, round(CASE WHEN dc >= 10 THEN least(200, greatest(-100, dn / dc * 100)) END, 4) AS incremental, round(CASE WHEN nopat > 0 THEN dc / nopat * 100 END, 4) AS reinvested FROM d""")
def incremental_capital(spark, sf_dir):
    """Incremental return on capital employed and the reinvestment rate, from statements whose capital and profit have their own drivers."""
    by = Window.partitionBy("company_id").orderBy("period_end")
    x = _capital(spark, sf_dir).withColumns({"dc": c("capital") - F.lag("capital").over(by), "dn": c("nopat") - F.lag("nopat").over(by)})
    found = F.when(c("dc") >= 10, f.clamp(c("dn") / c("dc") * 100, -100.0, 200.0))
    return x.select("company_id", "period_end", F.round(found, 4).alias("incremental"), F.round(F.when(c("nopat") > 0, c("dc") / c("nopat") * 100), 4).alias("reinvested"))


@query("F18_economic_returns", f"""WITH {_ONCE} SELECT company_id, period_type, period_end, vintage, round(ebit * (1 - least(0.4, greatest(0, tax_rate))) / (net_worth + total_debt - cash) * 100, 4) AS roic, round(greatest(capex - depreciation * 0.9, 0), 4) AS growth_capex FROM statements WHERE net_worth + total_debt - cash > 0""")
def economic_returns(spark, sf_dir):
    """Return on invested capital and growth capital spending of every statement with a balance sheet."""
    invested = c("net_worth") + c("total_debt") - c("cash")
    x = s.statements(spark, sf_dir).where(invested > 0)
    return x.select("company_id", "period_type", "period_end", "vintage", F.round(f.economic_roic(c("ebit"), c("tax_rate"), invested), 4).alias("roic"), F.round(f.growth_capex(c("capex"), c("depreciation"), F.lit(0.9)), 4).alias("growth_capex"))
