"""Queries over research tables: states per quarter, tournaments, audits, diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import paths, pit
from ..sources import adapters as a
from .bar_windows import START
from .joins import AS_OF
from .joins import dates as filing_dates
from .registry import SQL, query
from .views import BARS, FILINGS, UNIVERSE


@query("M22_quarterly_state", f"""WITH {AS_OF}, t AS (SELECT company_id, t0, sum(revenue) FILTER (age <= 4) * 4 / count(revenue) FILTER (age <= 4) AS ttm, max(period_end) FILTER (age = 1) AS latest, max(revenue) FILTER (age = 1) AS r1, max(revenue) FILTER (age = 5) AS r5 FROM newest GROUP BY company_id, t0)
SELECT company_id, t0, latest, round(ttm, 2) AS ttm, round((r1 / r5 - 1) * 100, 4) AS yoy, CASE WHEN r5 IS NULL THEN 'SHORT' WHEN r1 > r5 THEN 'GROWING' ELSE 'SHRINKING' END AS trend FROM t""")
def quarterly_state(spark, sf_dir):
    n = pit.as_of(a.filings(spark, sf_dir), filing_dates(spark, sf_dir))
    return research_state(n).select("company_id", "t0", "latest", F.round("ttm", 2).alias("ttm"), F.round("yoy", 4).alias("yoy"), "trend")


def research_state(newest):
    """State of a company at a date from the as-of read of its newest filings: one aggregate."""
    age, r = F.col("age"), F.col("revenue")
    x = newest.groupBy("company_id", "t0").agg(
        (F.sum(F.when(age <= 4, r)) * 4 / F.count(F.when(age <= 4, r))).alias("ttm"), F.max(F.when(age == 1, F.col("period_end"))).alias("latest"), F.max(F.when(age == 1, r)).alias("r1"), F.max(F.when(age == 5, r)).alias("r5")
    )
    x = x.withColumn("yoy", (F.col("r1") / F.col("r5") - 1) * 100)
    return x.withColumn("trend", F.when(F.col("r5").isNull(), "SHORT").when(F.col("r1") > F.col("r5"), "GROWING").otherwise("SHRINKING"))


@query("W19_velocity", f"""WITH {FILINGS}, q AS (SELECT * FROM filings WHERE vintage = 0) SELECT company_id, period_end, round(revenue - lag(revenue) OVER k, 2) AS delta_1q, round(revenue - lag(revenue, 4) OVER k, 2) AS delta_1y,
  round(revenue - 2 * lag(revenue) OVER k + lag(revenue, 2) OVER k, 2) AS acceleration FROM q WINDOW k AS (PARTITION BY company_id ORDER BY period_end)""")
def velocity(spark, sf_dir):
    k = Window.partitionBy("company_id").orderBy("period_end")
    r = F.col("revenue")
    q = a.filings(spark, sf_dir).where("vintage = 0")
    return q.select(
        "company_id", "period_end", F.round(r - F.lag(r).over(k), 2).alias("delta_1q"), F.round(r - F.lag(r, 4).over(k), 2).alias("delta_1y"), F.round(r - 2 * F.lag(r).over(k) + F.lag(r, 2).over(k), 2).alias("acceleration")
    )


@query("W23_incremental_return", f"""WITH {FILINGS}, q AS (SELECT *, revenue * 1.5 AS capital, revenue * 0.2 AS ebit FROM filings WHERE vintage = 0), d AS (SELECT *, capital - lag(capital) OVER k AS dc, ebit - lag(ebit) OVER k AS de FROM q WINDOW k AS (PARTITION BY company_id ORDER BY period_end))
SELECT company_id, period_end, round(CASE WHEN dc >= 10 THEN least(200, greatest(-100, de / dc * 100)) END, 4) AS incremental FROM d""")
def incremental_return(spark, sf_dir):
    k = Window.partitionBy("company_id").orderBy("period_end")
    q = a.filings(spark, sf_dir).where("vintage = 0").withColumns({"capital": F.col("revenue") * 1.5, "ebit": F.col("revenue") * 0.2})
    q = q.withColumns({"dc": F.col("capital") - F.lag("capital").over(k), "de": F.col("ebit") - F.lag("ebit").over(k)})
    out = F.when(F.col("dc") >= 10, F.least(F.lit(200.0), F.greatest(F.lit(-100.0), F.col("de") / F.col("dc") * 100)))
    return q.select("company_id", "period_end", F.round(out, 4).alias("incremental"))


@query("W24_roiic", f"""WITH {FILINGS}, q AS (SELECT * FROM filings WHERE vintage = 0) SELECT company_id, period_end, {', '.join(f"round(revenue - coalesce(lag(revenue, {n}) OVER k, first(revenue) OVER k), 2) AS d{n}" for n in (4, 8, 12))} FROM q WINDOW k AS (PARTITION BY company_id ORDER BY period_end)""")
def roiic(spark, sf_dir):
    k = Window.partitionBy("company_id").orderBy("period_end")
    q = a.filings(spark, sf_dir).where("vintage = 0")
    return q.select("company_id", "period_end", *(F.round(F.col("revenue") - F.coalesce(F.lag("revenue", n).over(k), F.first("revenue").over(k)), 2).alias(f"d{n}") for n in (4, 8, 12)))


OUTCOMES = f"{START}, o AS (SELECT company_id, t0, max(p / p0) AS best, first(p0) AS p0 FROM pathed GROUP BY 1, 2), f AS (SELECT o.*, b.volume, b.high / b.low AS span FROM o JOIN bars b ON b.company_id = o.company_id AND b.trading_date = o.t0)"
STRATEGIES = {"by_volume": "volume", "by_span": "span", "by_price": "p0"}


@query("A14_tournament", f"WITH {BARS}, {OUTCOMES}, s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, t0, company_id, best, {v} AS score FROM f" for n, v in STRATEGIES.items()) + """), k AS (SELECT *, year(t0) AS y, row_number() OVER (PARTITION BY strategy, year(t0) ORDER BY score DESC, company_id) AS place FROM s)
SELECT strategy, count(*) AS picks, round(avg((best >= 2)::INT) * 100, 6) AS precision_2x, round(avg((best >= 5)::INT) * 100, 6) AS precision_5x FROM k WHERE place <= 10 GROUP BY strategy""")
def tournament(spark, sf_dir):
    """Strategies rank the companies of a year; the ten best are held against what became of them."""
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars)).withColumn("best", F.col("max_run") / 100 + 1)
    x = o.select("company_id", F.col("t0").alias("trading_date"), "best", "p0").join(bars, ["company_id", "trading_date"]).withColumn("span", F.col("high") / F.col("low"))
    x = x.select("company_id", F.year("trading_date").alias("y"), "best", *(F.col(v).alias(n) for n, v in STRATEGIES.items())).unpivot(["company_id", "y", "best"], list(STRATEGIES), "strategy", "score")
    place = F.row_number().over(Window.partitionBy("strategy", "y").orderBy(F.col("score").desc(), "company_id"))
    top = x.withColumn("place", place).where("place <= 10")
    return top.groupBy("strategy").agg(F.count("*").alias("picks"), *(F.round(F.avg((F.col("best") >= m).cast("int")) * 100, 6).alias(f"precision_{m}x") for m in (2, 5)))


@query("A15_early_discovery", f"""WITH {BARS}, {OUTCOMES}, k AS (SELECT *, percent_rank() OVER (PARTITION BY year(t0) ORDER BY volume) AS pr FROM f) SELECT year(t0) AS y, count(*) FILTER (best >= 2) AS winners, round(avg((pr >= 0.8)::INT) FILTER (best >= 2), 6) AS found, round(avg((pr >= 0.8)::INT), 6) AS base FROM k GROUP BY 1""")
def early_discovery(spark, sf_dir):
    """Share of later winners among the fifth with the highest volume, and that fifth's share of all."""
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars)).withColumn("win", F.col("max_run") / 100 + 1 >= 2)
    x = o.select("company_id", F.col("t0").alias("trading_date"), "win").join(bars, ["company_id", "trading_date"]).withColumn("y", F.year("trading_date"))
    x = x.withColumn("top", (F.percent_rank().over(Window.partitionBy("y").orderBy("volume")) >= 0.8).cast("int"))
    return x.groupBy("y").agg(F.count_if("win").alias("winners"), F.round(F.avg(F.when(F.col("win"), F.col("top"))), 6).alias("found"), F.round(F.avg("top"), 6).alias("base"))


@query("A16_dataset_health", f"""WITH {UNIVERSE} SELECT year(effective_from) AS y, count(*) AS members, count(*) FILTER (effective_to IS NULL) AS open, round(count(*) / (1 + (count(*) - 1) * 0.6), 6) AS effective_n FROM universe GROUP BY 1""")
def dataset_health(spark, sf_dir):
    n = F.count("*")
    return a.universe(spark, sf_dir).groupBy(F.year("effective_from").alias("y")).agg(n.alias("members"), F.count_if(F.col("effective_to").isNull()).alias("open"), F.round(n / (1 + (n - 1) * 0.6), 6).alias("effective_n"))


@query("A27_eligibility", f"""WITH {FILINGS} SELECT company_id, count(DISTINCT period_end) AS quarters, CASE WHEN count(DISTINCT period_end) >= 20 THEN 'FULL' WHEN count(DISTINCT period_end) >= 8 THEN 'PARTIAL' ELSE 'THIN' END AS depth FROM filings GROUP BY 1""")
def eligibility(spark, sf_dir):
    x = a.filings(spark, sf_dir).groupBy("company_id").agg(F.countDistinct("period_end").alias("quarters"))
    return x.withColumn("depth", F.when(F.col("quarters") >= 20, "FULL").when(F.col("quarters") >= 8, "PARTIAL").otherwise("THIN"))


@query("A28_truth_audit", """SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(k, 0) AS months, n IS NOT NULL AS present FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def truth_audit(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct(F.date_trunc("month", "o_orderdate")).alias("k"))
    zero = F.lit(0).cast("long")
    x = a.table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", F.coalesce("n", zero).alias("orders"), F.coalesce("k", zero).alias("months"), F.col("n").isNotNull().alias("present"))


@query("M24_outcome_labels", f"""WITH {BARS}, {START} SELECT company_id, t0, round(arg_max(p, i) / first(p0) - 1, 6) AS last_return, CASE WHEN max(p / p0) >= 5 THEN '5X' WHEN max(p / p0) >= 2 THEN '2X' WHEN min((p - peak) / peak) <= -0.5 THEN 'FAILED' ELSE 'NEUTRAL' END AS label FROM pathed GROUP BY company_id, t0""")
def outcome_labels(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars))
    label = F.when(F.col("bar_5x").isNotNull(), "5X").when(F.col("bar_2x").isNotNull(), "2X").when(F.col("max_drawdown") <= -50, "FAILED").otherwise("NEUTRAL")
    return o.select("company_id", "t0", F.round(F.col("p_last") / F.col("p0") - 1, 6).alias("last_return"), label.alias("label"))


@query("M25_failures", f"""WITH {BARS}, {START}, o AS (SELECT company_id, t0, min((p - peak) / peak) * 100 AS dd, max(p / p0) AS best FROM pathed GROUP BY 1, 2) SELECT company_id, t0, CASE WHEN best < 1.1 THEN 'NEVER_WORKED' WHEN best >= 2 THEN 'ROUND_TRIP' ELSE 'FADED' END AS reason FROM o WHERE dd <= -40""")
def failures(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars)).where("max_drawdown <= -40")
    best = F.col("max_run") / 100 + 1
    return o.select("company_id", "t0", F.when(best < 1.1, "NEVER_WORKED").when(F.col("bar_2x").isNotNull(), "ROUND_TRIP").otherwise("FADED").alias("reason"))


@query("M30_discovery_diagnostics", f"""WITH {BARS}, {START}, o AS (SELECT company_id, t0, min(i) FILTER (p / p0 >= 2) AS bar_2x, min((p - peak) / peak) * 100 AS dd FROM pathed GROUP BY 1, 2) SELECT count(*) AS decisions, count(bar_2x) AS doubled, round(median(bar_2x), 4) AS median_bars, round(avg(dd) FILTER (bar_2x IS NOT NULL), 6) AS mean_drawdown FROM o""")
def discovery_diagnostics(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars))
    return o.agg(F.count("*").alias("decisions"), F.count("bar_2x").alias("doubled"), F.round(F.median("bar_2x"), 4).alias("median_bars"), F.round(F.avg(F.when(F.col("bar_2x").isNotNull(), F.col("max_drawdown"))), 6).alias("mean_drawdown"))


@query("M31_counterfactual", f"""WITH {BARS}, d AS (SELECT company_id, ln(close / lag(close) OVER (PARTITION BY company_id ORDER BY trading_date)) AS r FROM bars), m AS (SELECT company_id, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(power(least(r, 0), 2))) AS down FROM d WHERE r IS NOT NULL GROUP BY 1)
SELECT company_id, n, round(mean / sd * sqrt(250), 6) AS sharpe, round(mean / nullif(down, 0) * sqrt(250), 6) AS sortino FROM m""")
def counterfactual(spark, sf_dir):
    by = Window.partitionBy("company_id").orderBy("trading_date")
    d = a.bars(spark, sf_dir).withColumn("r", F.log(F.col("close") / F.lag("close").over(by))).where("r IS NOT NULL")
    m = d.groupBy("company_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2)))).alias("down"))
    year = F.sqrt(F.lit(250.0))
    return m.select("company_id", "n", F.round(F.col("mean") / F.col("sd") * year, 6).alias("sharpe"), F.round(F.col("mean") / F.when(F.col("down") != 0, F.col("down")) * year, 6).alias("sortino"))


@query("M33_dossier", """SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS turnover, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def dossier(spark, sf_dir):
    c, o = a.table(spark, sf_dir, "customer"), a.table(spark, sf_dir, "orders")
    x = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("turnover"), F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return x.select("c_custkey", "c_name", "orders", "turnover", F.when(F.size("s") > 0, F.array_join("s", ",")).alias("statuses"))


@query("M35_feature_catalogue", """SELECT c_custkey, 'balance' AS feature, c_acctbal AS value, c_acctbal IS NULL AS missing FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey, c_nationkey IS NULL FROM customer""")
def feature_catalogue(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot(["c_custkey"], ["balance", "nation"], "feature", "value").withColumn("missing", F.col("value").isNull())


@query("S11_snapshot_all", f"""WITH {FILINGS} SELECT company_id, period_end, vintage, sha256('revenue=' || CAST(CAST(round(revenue, 2) AS DECIMAL(38,6)) AS VARCHAR) || '|vintage=' || CAST(CAST(vintage AS DECIMAL(38,6)) AS VARCHAR)) AS hash FROM filings""")
def snapshot_all(spark, sf_dir):
    """All companies and vintages. Prices have two decimals; the sum is rounded to them before it is hashed, so that the order of addition does not show."""
    from ..functions.scalars import canonical_hash

    f = a.filings(spark, sf_dir).withColumn("revenue", F.round("revenue", 2))
    return f.select("company_id", "period_end", "vintage", canonical_hash(["revenue", "vintage"]).alias("hash"))


query("S11_snapshot", SQL["S11_snapshot_all"])(snapshot_all)
