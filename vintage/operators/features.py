"""The point-in-time feature vector: what was known of a company at a date.

Statements and dates lie on one timeline that carries the newest vintage of the
newest periods; bars and dates lie on another that carries the last bar. No date
meets candidates. Cadence is found and sums are taken within one partitioning
by company and date. Missing inputs stay missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeline
from . import windows as w

c = F.col
#: Version of the feature definitions.
FEATURE_VERSION = "1.0"
#: Calendar years before the date whose periods are read, by period type.
YEARS = {"QUARTERLY": 4, "ANNUAL": 6}
#: Gap between the two newest period ends, in days, beyond which reports are semi-annual.
SEMI_ANNUAL_GAP = 130


def newest_statements(statements: DataFrame, dates: DataFrame, period_type: str, limit: int, strict: bool = False) -> DataFrame:
    """For every ``(company_id, t0)`` the newest ``limit`` periods published by then, one vintage each, numbered by ``age`` from 1.

    ``strict``: only vintages whose system time ``[rec_start, rec_end)`` holds t0.
    """
    values = [k for k in statements.columns if k not in ("company_id", "period_end", "period_type")]
    bounded = F.year("period_end") >= F.year("t0") - YEARS[period_type]
    if not strict:
        x = timeline.carried_periods(statements, dates.select("company_id", "t0"), period_type, limit)
        x = x.select("company_id", "t0", F.posexplode("periods").alias("age", "p"))
        return x.select("company_id", "t0", "p.period_end", (c("age") + 1).alias("age"), *(c(f"p.{k}").alias(k) for k in values)).where(bounded)
    # Two times do not lie on one line: here a date meets the statements of its years.
    rows = statements.where(c("period_type") == period_type).withColumn("y", F.year("period_end"))
    wanted = dates.select("company_id", "t0").withColumn("y", F.explode(F.sequence(F.year("t0") - YEARS[period_type], F.year("t0"))))
    seen = wanted.join(rows, ["company_id", "y"]).where("published <= t0 AND rec_start <= t0 AND t0 < rec_end")
    latest = seen.groupBy("company_id", "t0", "period_end").agg(F.max_by(F.struct(*values), F.struct("published", "vintage")).alias("v"))
    age = F.row_number().over(Window.partitionBy("company_id", "t0").orderBy(c("period_end").desc()))
    return latest.withColumn("age", age).where(c("age") <= limit).select("company_id", "t0", "period_end", "age", "v.*")


def _capital(last_resort: bool = False) -> Column:
    """Capital employed of a statement: net worth and debt, else assets without current liabilities; null where neither is there."""
    own = F.coalesce(c("net_worth"), F.lit(0.0)) + F.coalesce(c("total_debt"), F.lit(0.0))
    out = F.when(own > 0, own).when(c("total_assets") > c("current_liabilities"), c("total_assets") - c("current_liabilities"))
    return out.when(c("total_assets") > 0, c("total_assets")) if last_resort else out


def _year_ago_capital() -> Column:
    liabilities = F.coalesce(c("current_liabilities"), F.lit(0.0))
    own = F.coalesce(c("net_worth"), F.lit(0.0)) + F.coalesce(c("total_debt"), F.lit(0.0))
    return F.when((c("total_assets") > 0) & (c("total_assets") > liabilities), c("total_assets") - liabilities).when(own > 0, own)


def at(age: int, value: Column | str) -> Column:
    return F.max(F.when(c("age") == age, c(value) if isinstance(value, str) else value))


def quarterly_state(newest: DataFrame) -> DataFrame:
    """One row per (company, t0) from its newest quarters: trailing sums, newest values, matches a year earlier."""
    group = Window.partitionBy("company_id", "t0")
    x = newest.withColumns({"e1": at(1, "period_end").over(group), "e2": at(2, "period_end").over(group)})
    x = x.withColumn("periods", F.when(F.datediff("e1", "e2") > SEMI_ANNUAL_GAP, 2).otherwise(4)).withColumns({"ce": _capital(), "ce_ago": _year_ago_capital()})
    recent = c("age") <= c("periods")

    def trailing(value: str) -> Column:
        n = F.count(F.when(recent, c(value)))
        return F.when(n > 0, F.sum(F.when(recent, c(value))) * F.max("periods") / n)

    last_year = F.year("period_end") == F.year("e1") - 1
    same_month, same_quarter = last_year & (F.month("period_end") == F.month("e1")), last_year & (F.quarter("period_end") == F.quarter("e1"))

    def year_ago(value: str) -> Column:
        return F.coalesce(F.max(F.when(same_month, c(value))), F.max(F.when(same_quarter, c(value))))

    sums = {f"ttm_{k}": trailing(k) for k in ("revenue", "ebitda", "ebit", "depreciation", "pat", "cfo", "capex", "eps")}
    newest_values = {f"q_{k}": at(1, k) for k in ("revenue", "pat", "net_worth", "total_debt", "cash", "financial_debt", "shares", "scope", "period_end")}
    return x.groupBy("company_id", "t0").agg(
        *(v.alias(k) for k, v in (sums | newest_values).items()), F.count_distinct(F.when(recent, c("scope"))).alias("scopes"), year_ago("revenue").alias("revenue_ago"), year_ago("pat").alias("pat_ago"),
        at(1, "ce").alias("q_ce"), F.min_by("ce", F.when(c("ce").isNotNull(), c("age"))).alias("older_ce"), at(5, "ce_ago").alias("q_ce_ago"), F.count("*").alias("quarters"),
    )


def annual_state(newest: DataFrame) -> DataFrame:
    x = newest.withColumn("ce", _capital(last_resort=True))
    names = ("revenue", "pat", "ebit", "ebitda", "cfo", "capex", "eps", "net_worth", "total_debt", "cash", "ce", "shares")
    return x.groupBy("company_id", "t0").agg(*(at(1, k).alias(f"a_{k}") for k in names), at(2, "ce").alias("a_ce_ago"), F.count("*").alias("years"))


def _pct(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / F.abs(b) * 100)


def fundamentals(statements: DataFrame, dates: DataFrame) -> DataFrame:
    """The statement part of the feature vector; an annual statement steps in where quarters lack cash flows, earnings per share or a balance sheet."""
    q = quarterly_state(newest_statements(statements, dates, "QUARTERLY", 8))
    x = dates.join(q, ["company_id", "t0"], "left").join(annual_state(newest_statements(statements, dates, "ANNUAL", 4)), ["company_id", "t0"], "left")
    interim = c("q_ce").isNull()  # the newest quarter has no balance sheet
    audited = interim & c("years").isNotNull()
    ce0 = F.when(~interim, c("q_ce")).when(audited, c("a_ce")).otherwise(c("older_ce"))
    ce4 = F.coalesce(F.when(audited, c("a_ce_ago")), c("q_ce_ago"))
    flows = c("ttm_cfo").isNotNull()
    worth = F.when(audited, c("a_net_worth")).otherwise(c("q_net_worth"))
    debt = F.coalesce(F.when(audited, c("a_total_debt")).otherwise(c("q_total_debt")), F.lit(0.0))
    cash = F.coalesce(F.when(audited, c("a_cash")).otherwise(c("q_cash")), F.lit(0.0))
    x = x.withColumns({"ce0": ce0, "ce4": ce4, "net_worth": worth, "debt": debt, "cash": cash, "cfo": F.when(flows, c("ttm_cfo")).otherwise(c("a_cfo"))})
    x = x.withColumn("spent", F.when(flows, F.coalesce(c("ttm_capex"), F.lit(0.0))).otherwise(c("a_capex")))
    capital = F.coalesce((c("ce0") + c("ce4")) / 2, c("ce0"))
    method = F.when(c("ce0").isNull(), "UNAVAILABLE").when(interim, "LAST_AUDITED_BS").when(c("ce4").isNull(), "SINGLE_PERIOD_CE").otherwise("PERIOD_AVERAGE_CE")
    solid = c("net_worth") > 0
    fcf = c("cfo") - F.coalesce(c("spent"), F.lit(0.0))
    return x.select(
        "company_id", "t0", c("q_period_end").alias("latest_period"), c("q_revenue").alias("latest_revenue"), c("q_pat").alias("latest_pat"), F.when(c("ttm_revenue") > 0, c("ttm_revenue")).alias("ttm_revenue"),
        "ttm_pat", "ttm_ebit", "ttm_ebitda", F.when(c("ttm_depreciation") > 0, c("ttm_depreciation")).alias("ttm_depreciation"),
        F.when(c("scopes") > 1, "MIXED").when(c("scopes") == 1, "CONSISTENT").alias("scope_flag"), c("q_scope").alias("scope"),
        F.when(c("ttm_revenue") > 0, c("ttm_ebitda") / c("ttm_revenue") * 100).alias("ebitda_margin"), F.when(c("ttm_revenue") > 0, c("ttm_pat") / c("ttm_revenue") * 100).alias("pat_margin"),
        F.when(c("revenue_ago") > 0, _pct(c("q_revenue"), c("revenue_ago"))).alias("revenue_growth"), _pct(c("q_pat"), c("pat_ago")).alias("pat_growth"),
        F.when(capital > 0, F.least(F.lit(120.0), F.greatest(F.lit(-50.0), c("ttm_ebit") / capital * 100))).alias("roce"), F.when(capital > 0, method).otherwise("UNAVAILABLE").alias("roce_method"),
        F.when(capital > 0, capital).alias("capital_employed"), "net_worth", F.when(solid, c("debt") / c("net_worth")).alias("debt_to_equity"), F.when(solid, (c("debt") - c("cash")) / c("net_worth")).alias("net_debt_to_equity"),
        F.when(solid, F.coalesce(c("q_financial_debt"), F.lit(0.0)) / c("net_worth")).alias("financial_debt_to_equity"), F.when(c("ttm_ebitda") > 0, c("debt") / c("ttm_ebitda")).alias("debt_to_ebitda"),
        (c("cash") - c("debt")).alias("net_cash"), c("cfo").alias("ttm_cfo"), c("spent").alias("ttm_capex"), fcf.alias("ttm_fcf"), F.when(c("ttm_pat") > 0, c("cfo") / c("ttm_pat")).alias("cfo_to_pat"),
        F.when(c("ttm_pat") > 0, fcf / c("ttm_pat") * 100).alias("fcf_conversion"), F.coalesce(c("ttm_eps"), c("a_eps")).alias("ttm_eps"), c("q_shares").alias("reported_shares"),
    )


def technicals(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Indicators of the last session at or before each date: windows over the bars, then bars and dates on one timeline that carries the last bar on."""
    by = w.last_bars
    x = w.extremes(w.wilder_rsi(bars), w.YEAR_BARS, high_52w=("max", "high"), low_52w=("min", "low")).withColumn("true_range", w.true_range()).withColumns({
        "bars": F.row_number().over(w.sessions()), "sma20": w.sma(20), "sma50": w.sma(50), "sma200": w.sma(200), "atr": w.atr(14), "vol20": F.avg("volume").over(by(20)), "vol50": F.when(F.row_number().over(w.sessions()) >= 50, F.avg("volume").over(by(50))), "prev_close": F.lag("close").over(w.sessions()),
    })
    seen = ("trading_date", "bars", "close", "prev_close", "volume", "vol20", "vol50", "sma20", "sma50", "sma200", "rsi", "atr", "high_52w", "low_52w")
    rows = x.select("company_id", c("trading_date").alias("at"), F.struct(*seen).alias("bar"), F.lit(None).cast("date").alias("t0"))
    marks = dates.select("company_id", c("t0").alias("at"), F.lit(None).cast(dict(rows.dtypes)["bar"]).alias("bar"), "t0")
    to_here = Window.partitionBy("company_id").orderBy("at", c("t0").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.unionByName(marks).withColumn("bar", F.last("bar", ignorenulls=True).over(to_here)).where("t0 IS NOT NULL").select("company_id", "t0", "bar.*")
    return x.where("bars >= 20").select(
        "company_id", "t0", "trading_date", "bars", "close", "prev_close", "volume", "vol20", "sma20", "sma50", "sma200", *(((c("close") - c(f"sma{k}")) / c(f"sma{k}") * 100).alias(f"dist_sma{k}") for k in (20, 50, 200)),
        "rsi", "atr", (c("atr") / c("close") * 100).alias("atr_pct"), "high_52w", "low_52w", ((c("close") - c("high_52w")) / c("high_52w") * 100).alias("dist_high"),
        ((c("close") - c("low_52w")) / c("low_52w") * 100).alias("dist_low"), F.when(F.coalesce(c("vol50"), c("vol20")) > 0, c("vol20") / F.coalesce(c("vol50"), c("vol20"))).otherwise(1.0).alias("volume_acceleration"),
    )


def feature_vector(statements: DataFrame, bars: DataFrame, dates: DataFrame) -> DataFrame:
    """All features of every (company, t0): statements, technicals, and ratios of both."""
    x = fundamentals(statements, dates).join(technicals(bars, dates), ["company_id", "t0"], "left")
    derived = F.when((c("ttm_eps") > 0) & (c("ttm_pat") > 0), F.round(c("ttm_pat") * 10_000_000 / c("ttm_eps")))
    x = x.withColumn("shares", F.coalesce(F.when(c("reported_shares") > 0, c("reported_shares")), derived)).withColumn("market_cap", c("close") * c("shares") / 10_000_000)
    pe = F.when(c("ttm_eps") > 0, c("close") / c("ttm_eps")).otherwise(F.when(c("ttm_pat") > 0, c("market_cap") / c("ttm_pat")))
    return x.withColumns({"pe": pe, "pb": F.when(c("net_worth") > 0, c("market_cap") / c("net_worth")), "fcf_yield": F.when(c("market_cap") > 0, c("ttm_fcf") / c("market_cap") * 100)}).drop("reported_shares")


def catalogue(vector: DataFrame) -> DataFrame:
    """The numeric features in long form: name, value, version, and whether it is missing."""
    names = [k for k, t in vector.dtypes if t in ("double", "int", "bigint") and k not in ("company_id", "t0")]
    long = vector.select("company_id", "t0", F.explode(F.create_map(*(e for k in names for e in (F.lit(k), c(k).cast("double"))))).alias("feature", "value"))
    return long.withColumns({"version": F.lit(FEATURE_VERSION), "missing": c("value").isNull()})
