"""Data quality and forensic checks over feature and metric rows: quarantine, snapshot consistency, working-capital risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f

c = F.col

# Absolute divergence from a cross-check that a metric may show, and limits of ages in days.
TOLERANCES = {
    "roce": 15.0, "debt_to_equity": 0.30, "net_debt_to_equity": 0.30, "financial_debt_to_equity": 0.30, "promoter_holding": 5.0, "fii_holding": 5.0, "ebitda_margin": 8.0, "pat_margin": 5.0,
}
OTHER_TOLERANCE = 20.0
SHAREHOLDING_DAYS, PRICE_DAYS = 120, 1


def quarantine(metrics: DataFrame) -> DataFrame:
    """Status and reasons of ``metric, value, cross_check, source_quality, estimated``: a missing value is missing, estimated inputs or a divergence beyond the metric's tolerance are quarantined."""
    tolerance = F.lit(OTHER_TOLERANCE)
    for name, limit in TOLERANCES.items():
        tolerance = F.when(c("metric") == name, limit).otherwise(tolerance)
    reasons = F.array_compact(F.array(F.when(c("estimated"), "ESTIMATED_INPUTS"), F.when(F.abs(c("value") - c("cross_check")) > tolerance, "DIVERGENCE"), F.when(c("source_quality") == "LOW_CONFIDENCE", "LOW_CONFIDENCE")))
    x = metrics.withColumn("reasons", F.when(c("value").isNotNull(), reasons).otherwise(F.array().cast("array<string>")))
    return x.withColumn("status", F.when(c("value").isNull(), "MISSING_DATA").when(F.size("reasons") > 0, "QUARANTINED").otherwise("APPROVED"))


def snapshot_consistency(x: DataFrame) -> DataFrame:
    """Violations and action for ``t0, financial_end, shareholding_end, price_date, scope, roce, shareholding_quality``.

    Future statements, shareholdings far from the statements, a missing return and doubtful shareholdings block; an unknown scope and an old price do not.
    """
    age = F.abs(F.datediff("financial_end", "shareholding_end"))
    blocking = F.array_compact(F.array(
        F.when(c("financial_end") > c("t0"), "FUTURE_DATA"), F.when(age > SHAREHOLDING_DAYS, "STALE_SHAREHOLDING"), F.when(c("roce").isNull(), "QUARANTINED_ROCE"),
        F.when(c("shareholding_quality") == "LOW_CONFIDENCE", "LOW_CONFIDENCE_SHAREHOLDING"),
    ))
    warnings = F.array_compact(F.array(F.when(~c("scope").isin("CONSOLIDATED", "STANDALONE"), "INVALID_SCOPE"), F.when(F.abs(F.datediff("t0", "price_date")) > PRICE_DAYS, "STALE_PRICE")))
    x = x.withColumns({"blocking": blocking, "warnings": warnings})
    return x.withColumn("action", F.when(F.size("blocking") > 0, "QUARANTINE").when(F.size("warnings") > 0, "PARTIAL_QUARANTINE").otherwise("APPROVE"))


def _conversion_status(cfo: Column, ebitda: Column, pct: Column) -> Column:
    return (
        F.when(ebitda.isNull() | (ebitda <= 0), F.when(cfo < 0, "NEGATIVE_CFO_AND_EBITDA").otherwise("EBITDA_NON_POSITIVE")).when(cfo.isNull(), "CFO_DATA_MISSING").when(pct >= 80, "EXCELLENT_CASH_CONVERSION")
        .when(pct >= 70, "ACCEPTABLE_CONVERSION").when(pct >= 50, "LOW_CONVERSION_WARNING").otherwise("SEVERE_EARNINGS_QUALITY_TRAP")
    )


def forensic_risk(x: DataFrame, days: int = 91) -> DataFrame:
    """Working-capital audit of statements in order: days outstanding and their derivatives, receivables against revenue, cash conversion, points of risk, regime and circuit breaker.

    Columns ``company_id, period_end, receivables, inventories, payables, revenue, cfo, ebitda``; growth is against the fourth statement before.
    """
    by = Window.partitionBy("company_id").orderBy("period_end")

    def growth(name: str) -> Column:
        before = F.lag(name, 4).over(by)
        return F.when(before != 0, (c(name) / before - 1) * 100)

    x = x.withColumns({"dso": f.days_outstanding(c("receivables"), c("revenue"), days), "dio": f.days_outstanding(c("inventories"), c("revenue"), days), "dpo": f.days_outstanding(c("payables"), c("revenue"), days), "sales_growth": growth("revenue"), "debtor_growth": growth("receivables")})
    x = x.withColumns({"cycle": f.cash_cycle(c("dso"), c("dio"), c("dpo")), "delta": c("dso") - F.lag("dso").over(by)}).withColumns({"delta2": c("delta") - F.lag("delta").over(by), "divergence": F.round(c("debtor_growth") - c("sales_growth"), 2)})
    x = x.withColumn("divergent", F.coalesce((c("divergence") > 15) & (c("debtor_growth") > 20), F.lit(False))).withColumn("conversion", F.when(c("ebitda") > 0, F.round(c("cfo") / c("ebitda") * 100, 1)))
    x = x.withColumn("conversion_status", _conversion_status(c("cfo"), c("ebitda"), c("conversion")))
    severe = c("conversion_status") == "SEVERE_EARNINGS_QUALITY_TRAP"
    points = (
        F.when(c("delta2") > 10, 25).when(c("delta") > 20, 15).otherwise(0) + F.when(c("divergent"), 35).otherwise(0) + F.when(severe, 40).when(c("conversion_status") == "LOW_CONVERSION_WARNING", 15).otherwise(0)
        + F.when(c("dso") > 180, 15).otherwise(0)
    )
    prompt = F.coalesce((c("dso") < 65) & ~c("divergent"), F.lit(False))
    x = x.withColumn("risk", F.least(F.lit(100), points)).withColumn("breaker", (c("risk") >= 50) | (severe & ~prompt))
    regime = F.when(c("breaker"), "WORKING_CAPITAL_TRAP").when(severe | (c("risk") >= 30) | c("divergent"), "AGGRESSIVE_RECOGNITION_RISK").when(c("risk") >= 15, "MODERATE_DRIFT").otherwise("HEALTHY")
    return x.withColumn("regime", regime)
