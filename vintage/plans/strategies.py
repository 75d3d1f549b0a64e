"""Queries over strategy scans and company profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screening, strategy
from .feature_sql import FEATURES
from .fundamentals import vector
from .histories import _SEGMENT_SQL, sectors
from .registry import query
from .screening import _CATEGORY, _INDUSTRY, INDUSTRIES, D
from .setup_sql import r

c = F.col
SCAN = strategy.Strategy(rules=({"left": "rsi", "operation": "greater", "right": 45}, {"left": "close", "operation": "greater", "right": "sma50"}), near_high_pct=40.0, max_debt=1.4, favoured=("AUTOMOBILE",), clusters=("Power and energy",), excluded=("BUILDING",), limit=4)

_REGIME = "CASE month(t0) WHEN 3 THEN 'BULLISH_EXPANSION' WHEN 6 THEN 'SELECTIVE_ROTATION' WHEN 9 THEN 'DEFENSIVE_CONSOLIDATION' ELSE 'RISK_OFF' END"

_SCAN = D(f"""{FEATURES}, {_SEGMENT_SQL}, n0 AS (SELECT f.*, sector, {_INDUSTRY} AS industry, {_CATEGORY.replace('industry', f'({_INDUSTRY})')} AS category, {_REGIME} AS regime, coalesce({r('(high_52w - close) / high_52w * 100', 1)}, 0) AS away, {r('volume / vol20', 2)} AS rvol, coalesce(sma50, close) AS mean50, coalesce(sma200, close) AS mean200 FROM features f JOIN sectors USING (company_id)),
 n1 AS (SELECT * FROM n0 WHERE rsi > 45 AND close > sma50 AND close > 5 AND away <= {SCAN.near_high_pct} AND NOT coalesce(category <> 'FINANCIALS' AND {r('debt_to_equity', 2)} > {SCAN.max_debt}, false) AND sector <> 'BUILDING'),
 n2 AS (SELECT *, CASE WHEN category = 'FINANCIALS' THEN 85.0 WHEN debt_to_equity IS NULL THEN 65.0 WHEN debt_to_equity < 0.3 THEN 95.0 WHEN debt_to_equity < 0.7 THEN 85.0 WHEN debt_to_equity < 1.0 THEN 70.0 WHEN debt_to_equity < 1.5 THEN 50.0 WHEN debt_to_equity < 2.0 THEN 35.0 ELSE 20.0 END AS solid,
  CASE WHEN pe IS NULL OR pe <= 0 THEN CASE WHEN coalesce(pb, 3.0) < 2 THEN 80.0 WHEN coalesce(pb, 3.0) < 5 THEN 60.0 ELSE 40.0 END WHEN pe < 18 THEN 90.0 WHEN pe < 30 THEN 80.0 WHEN pe < 45 THEN 65.0 WHEN pe < 65 THEN 45.0 WHEN pe < 85 THEN 30.0 ELSE 15.0 END AS val, (high_52w - close) / high_52w * 100 AS off FROM n1),
 n3 AS (SELECT *, CASE WHEN ebitda_margin > 20 THEN least(100.0, solid + 5) WHEN ebitda_margin < 5 THEN greatest(10.0, solid - 10) ELSE solid END AS dur,
  least(100.0, greatest(10.0, 30 + CASE WHEN close > mean50 AND mean50 > mean200 THEN 30.0 WHEN close > mean50 THEN 15.0 ELSE 0.0 END + CASE WHEN off <= 3.5 THEN 25.0 WHEN off <= 6 THEN 18.0 WHEN off <= 12 THEN 10.0 ELSE 0.0 END
   + CASE WHEN coalesce(rvol, 1.0) >= 2.5 THEN 15.0 WHEN coalesce(rvol, 1.0) >= 1.8 THEN 10.0 WHEN coalesce(rvol, 1.0) >= 1.3 THEN 5.0 ELSE 0.0 END + CASE WHEN coalesce(rsi, 55.0) BETWEEN 52 AND 68 THEN 10.0 WHEN coalesce(rsi, 55.0) BETWEEN 48 AND 72 THEN 5.0 ELSE 0.0 END)) AS mom FROM n2),
 n4 AS (SELECT *, {r("dur * 0.30 + val * 0.25 + mom * 0.45 + CASE WHEN sector = 'AUTOMOBILE' THEN 20.0 WHEN industry = 'Power and energy' THEN 12.0 ELSE 0.0 END", 4)} AS rank_ FROM n3),
 n5 AS (SELECT *, row_number() OVER (PARTITION BY t0 ORDER BY rank_ DESC, company_id) AS place, {r('close - greatest(close * 0.035, least(close * 0.065, coalesce(atr, close * 0.03) * 1.5))', 2)} AS stop FROM n4 QUALIFY place <= {SCAN.limit}),
 n6 AS (SELECT *, {r('close - stop', 2)} AS risk FROM n5)""")


@query("M21_strategy_scan", f"""WITH {_SCAN} SELECT company_id, t0, place, rank_ AS rank, stop, {r('close + risk * 2.0::DOUBLE', 2)} AS target_1, {r('close + risk * 3.0::DOUBLE', 2)} AS target_2, {r('risk / close * 100', 1)} AS risk_pct,
 CASE regime WHEN 'BULLISH_EXPANSION' THEN 100 WHEN 'SELECTIVE_ROTATION' THEN 75 WHEN 'DEFENSIVE_CONSOLIDATION' THEN 50 ELSE 25 END AS size_pct, CASE WHEN away <= 4.5 THEN 'BASE_BREAKOUT' ELSE 'MOMENTUM_EXPANSION' END AS thesis FROM n6""")
def strategy_scan(spark, sf_dir):
    """The four best of a scan at every date, with cards; the regime of a date follows from its quarter."""
    names = F.create_map(*(F.lit(x) for kv in INDUSTRIES.items() for x in kv))
    x = vector(spark, sf_dir).join(sectors(spark, sf_dir).withColumn("industry", names[c("sector")]), "company_id")
    month = F.month("t0")
    x = screening.categories(x, "industry").withColumn("regime", F.when(month == 3, "BULLISH_EXPANSION").when(month == 6, "SELECTIVE_ROTATION").when(month == 9, "DEFENSIVE_CONSOLIDATION").otherwise("RISK_OFF"))
    return strategy.scan(x, SCAN).select("company_id", "t0", c("place").cast("long").alias("place"), "rank", "stop", "target_1", "target_2", "risk_pct", "size_pct", c("card_thesis").alias("thesis"))


_HASHED = ("revenue_growth", "pat_growth", "ebitda_margin", "pat_margin", "roce", "debt_to_equity", "pe", "pb")
_TEXT = " || '|' || ".join(f"'_{k}=' || coalesce(CAST(CAST(round({k}, 3) AS DECIMAL(38,6)) AS VARCHAR), 'null')" for k in sorted(_HASHED))


@query("M8_company_profile", f"""WITH {FEATURES}, h AS (SELECT *, sha256({_TEXT}) AS input_hash FROM features), p AS (SELECT company_id, t0, input_hash,
  least(99, greatest(15, 50 + least(50, greatest(-30, coalesce(revenue_growth, 0))) * 0.5 + least(50, greatest(-30, coalesce(pat_growth, 0))) * 0.5)) AS g, least(99, greatest(20, 30 + least(50, greatest(0, coalesce(roce, 15))) * 0.9 + least(35, coalesce(ebitda_margin, 15)) * 0.7)) AS q,
  least(95, greatest(20, CASE WHEN pe <= 0 THEN 60 WHEN pe < 12 THEN 92 WHEN pe < 20 THEN 82 WHEN pe < 35 THEN 68 WHEN pe < 60 THEN 50 WHEN pe IS NOT NULL THEN 35 ELSE 60 END + CASE WHEN pb < 2.5 THEN 5 ELSE 0 END)) AS v,
  least(99, greatest(15, 40 + (20 - abs(coalesce(rsi, 50) - 60) * 0.8) + least(20, greatest(-15, coalesce(dist_sma50, 0))) + least(15, greatest(-10, coalesce(dist_sma200, 0) * 0.5)) + (100 + coalesce(dist_high, -15)) * 0.2 + least(15, (coalesce(volume_acceleration, 1) - 1) * 15))) AS m,
  least(95, greatest(25, 85 - CASE WHEN coalesce(debt_to_equity, 0.5) > 2.5 THEN 25 WHEN coalesce(debt_to_equity, 0.5) > 1.5 THEN 12 ELSE 0 END - CASE WHEN coalesce(pat_margin, 8) < 3 THEN 15 ELSE 0 END)) AS o FROM h),
 i AS (SELECT company_id, t0, input_hash, CAST(trunc(g) AS INT) AS g, CAST(trunc(q) AS INT) AS q, CAST(trunc(v) AS INT) AS v, CAST(trunc(m) AS INT) AS m, CAST(trunc(o) AS INT) AS o FROM p)
SELECT company_id, t0, input_hash, g AS growth_score, q AS quality_score, v AS valuation_score, m AS momentum_score, o AS governance_score, CAST(least(99, greatest(20, (q * 30 + g * 25 + m * 20 + v * 15 + o * 10) // 100)) AS INT) AS conviction FROM i""")
def company_profile(spark, sf_dir):
    """A profile of every company and date, with defaults for what is missing and the digest of its inputs."""
    x = strategy.profile(vector(spark, sf_dir))
    return x.select("company_id", "t0", "input_hash", "growth_score", "quality_score", "valuation_score", "momentum_score", "governance_score", c("conviction").cast("int").alias("conviction"))
