"""Queries over data quality and forensic checks (F28 risk, F31, F32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import statements as s
from .feature_sql import FEATURES, FUNDAMENTALS
from .fundamentals import vector
from .registry import query

c = F.col
_ONCE = FUNDAMENTALS.split(", dates AS")[0]


@query("F28_forensic_risk", f"""WITH {_ONCE}, q AS (SELECT *, receivables / revenue * 91 AS dso, (revenue / lag(revenue, 4) OVER k - 1) * 100 AS sg, (receivables / lag(receivables, 4) OVER k - 1) * 100 AS dg, CASE WHEN ebitda > 0 THEN round(cfo / ebitda * 100, 1) END AS conversion
  FROM statements WHERE period_type = 'QUARTERLY' AND vintage = 0 WINDOW k AS (PARTITION BY company_id ORDER BY period_end)), d AS (SELECT *, dso - lag(dso) OVER k AS d1, dso - 2 * lag(dso) OVER k + lag(dso, 2) OVER k AS d2, coalesce(round(dg - sg, 2) > 15 AND dg > 20, false) AS divergent,
  CASE WHEN ebitda IS NULL OR ebitda <= 0 THEN CASE WHEN cfo < 0 THEN 'NEGATIVE_CFO_AND_EBITDA' ELSE 'EBITDA_NON_POSITIVE' END WHEN cfo IS NULL THEN 'CFO_DATA_MISSING' WHEN conversion >= 80 THEN 'EXCELLENT_CASH_CONVERSION' WHEN conversion >= 70 THEN 'ACCEPTABLE_CONVERSION' WHEN conversion >= 50 THEN 'LOW_CONVERSION_WARNING' ELSE 'SEVERE_EARNINGS_QUALITY_TRAP' END AS status
  FROM q WINDOW k AS (PARTITION BY company_id ORDER BY period_end)), r AS (SELECT *, least(100, CASE WHEN d2 > 10 THEN 25 WHEN d1 > 20 THEN 15 ELSE 0 END + CASE WHEN divergent THEN 35 ELSE 0 END + CASE WHEN status = 'SEVERE_EARNINGS_QUALITY_TRAP' THEN 40 WHEN status = 'LOW_CONVERSION_WARNING' THEN 15 ELSE 0 END + CASE WHEN dso > 180 THEN 15 ELSE 0 END) AS risk FROM d),
 b AS (SELECT *, risk >= 50 OR (status = 'SEVERE_EARNINGS_QUALITY_TRAP' AND NOT coalesce(dso < 65 AND NOT divergent, false)) AS breaker FROM r)
SELECT company_id, period_end, round(dso + inventories / revenue * 91 - payables / revenue * 91, 4) AS cycle, conversion, status AS conversion_status, divergent, risk, breaker,
 CASE WHEN breaker THEN 'WORKING_CAPITAL_TRAP' WHEN status = 'SEVERE_EARNINGS_QUALITY_TRAP' OR risk >= 30 OR divergent THEN 'AGGRESSIVE_RECOGNITION_RISK' WHEN risk >= 15 THEN 'MODERATE_DRIFT' ELSE 'HEALTHY' END AS regime FROM b""")
def forensic_risk(spark, sf_dir):
    x = quality.forensic_risk(s.statements(spark, sf_dir).where("period_type = 'QUARTERLY' AND vintage = 0"))
    return x.select("company_id", "period_end", F.round("cycle", 4).alias("cycle"), "conversion", "conversion_status", "divergent", "risk", "breaker", "regime")


_METRICS = ("roce", "debt_to_equity", "ebitda_margin", "pat_margin", "revenue_growth")


@query("F31_quarantine", f"""WITH {FEATURES}, chosen AS (SELECT company_id, t0, {', '.join(_METRICS)} FROM features), long AS (SELECT * FROM chosen UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(_METRICS)}))),
 k AS (SELECT *, lag(value) OVER (PARTITION BY company_id, metric ORDER BY t0) AS cross_check, month(t0) = 3 AND ascii(company_id) % 5 = 0 AS estimated, CASE WHEN ascii(company_id) % 7 = 1 THEN 'LOW_CONFIDENCE' ELSE 'HIGH_CONFIDENCE' END AS source FROM long),
 v AS (SELECT *, CASE WHEN value IS NULL THEN '' ELSE concat_ws(',', CASE WHEN estimated THEN 'ESTIMATED_INPUTS' END, CASE WHEN abs(value - cross_check) > CASE metric WHEN 'roce' THEN 15 WHEN 'debt_to_equity' THEN 0.30 WHEN 'ebitda_margin' THEN 8 WHEN 'pat_margin' THEN 5 ELSE 20 END THEN 'DIVERGENCE' END, CASE WHEN source = 'LOW_CONFIDENCE' THEN 'LOW_CONFIDENCE' END) END AS reasons FROM k)
SELECT company_id, t0, metric, reasons, CASE WHEN value IS NULL THEN 'MISSING_DATA' WHEN reasons <> '' THEN 'QUARANTINED' ELSE 'APPROVED' END AS status FROM v""")
def quarantine(spark, sf_dir):
    """Five metrics of every date, cross-checked with those of the date before."""
    from pyspark.sql import Window

    before = Window.partitionBy("company_id", "metric").orderBy("t0")
    x = vector(spark, sf_dir).select("company_id", "t0", *_METRICS).unpivot(["company_id", "t0"], list(_METRICS), "metric", "value")
    x = x.withColumns({"cross_check": F.lag("value").over(before), "estimated": (F.month("t0") == 3) & (F.ascii("company_id") % 5 == 0), "source_quality": F.when(F.ascii("company_id") % 7 == 1, "LOW_CONFIDENCE").otherwise("HIGH_CONFIDENCE")})
    return quality.quarantine(x).select("company_id", "t0", "metric", F.concat_ws(",", "reasons").alias("reasons"), "status")


@query("F32_consistency", f"""WITH {FEATURES}, k AS (SELECT *, CASE WHEN ascii(company_id) % 6 = 2 THEN latest_period - 200 ELSE latest_period END AS holding, CASE WHEN ascii(company_id) % 7 = 3 THEN 'UNKNOWN' ELSE scope END AS sc FROM features),
 v AS (SELECT company_id, t0, concat_ws(',', CASE WHEN latest_period > t0 THEN 'FUTURE_DATA' END, CASE WHEN abs(latest_period - holding) > 120 THEN 'STALE_SHAREHOLDING' END, CASE WHEN roce IS NULL THEN 'QUARANTINED_ROCE' END) AS blocking,
  concat_ws(',', CASE WHEN sc NOT IN ('CONSOLIDATED', 'STANDALONE') THEN 'INVALID_SCOPE' END, CASE WHEN abs(t0 - trading_date) > 1 THEN 'STALE_PRICE' END) AS warnings FROM k)
SELECT *, CASE WHEN blocking <> '' THEN 'QUARANTINE' WHEN warnings <> '' THEN 'PARTIAL_QUARANTINE' ELSE 'APPROVE' END AS action FROM v""")
def consistency(spark, sf_dir):
    k = F.ascii("company_id")
    x = vector(spark, sf_dir).withColumns({
        "financial_end": c("latest_period"), "shareholding_end": F.when(k % 6 == 2, F.date_sub("latest_period", 200)).otherwise(c("latest_period")), "price_date": c("trading_date"),
        "scope": F.when(k % 7 == 3, "UNKNOWN").otherwise(c("scope")), "shareholding_quality": F.lit("HIGH_CONFIDENCE"),
    })
    return quality.snapshot_consistency(x).select("company_id", "t0", F.concat_ws(",", "blocking").alias("blocking"), F.concat_ws(",", "warnings").alias("warnings"), "action")
