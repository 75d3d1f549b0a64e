"""Market mood per session and the rank of a strategy scan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import engines, scores
from ..operators import windows as w
from ..sources import adapters as a
from .registry import query
from .views import BARS, W, over

c = F.col

_SESSIONS = f"""{BARS}, m AS (SELECT *, close > lag(close) OVER ({W}) AS up, lag(close) OVER ({W}) AS pc, close >= max(high) OVER {over(252)} AS top, close <= min(low) OVER {over(252)} AS bottom FROM bars), s AS (
  SELECT trading_date, count(*) FILTER (up) * 100.0 / count(*) AS advancing, count(*) FILTER (top) - count(*) FILTER (bottom) AS net, stddev_samp(close) / avg(close) * 20 AS vix, count(*) FILTER (up) - count(*) FILTER (NOT up) AS tide,
    sum(CASE WHEN up THEN volume ELSE -volume END) AS flow, count(*) FILTER (top) >= 1 AS expanding, year(trading_date) * 400 + month(trading_date) * 31 + day(trading_date) AS stamp FROM m WHERE pc IS NOT NULL GROUP BY trading_date), v AS (
  SELECT *, CASE WHEN stamp % 3 <> 0 THEN 5.0 + stamp % 80 END AS long_pct, least(100, greatest(0, advancing * 0.7 + least(50, greatest(-50, net)) * 0.6)) AS b, CASE WHEN vix IS NULL THEN 50 ELSE least(100, greatest(0, 100 - (vix - 10) * 7)) END AS k,
    least(100, greatest(0, 50 + tide / 10.0 * 25)) AS p, least(100, greatest(0, 50 + flow / 50)) AS f FROM s), z AS (
  SELECT *, round(CASE WHEN long_pct IS NOT NULL THEN long_pct * 0.25 + b * 0.25 + k * 0.20 + p * 0.15 + f * 0.15 ELSE b * 0.35 + k * 0.30 + p * 0.20 + f * 0.15 END, 1) AS mood,
    CASE WHEN long_pct IS NOT NULL THEN long_pct * 0.25 + b * 0.25 + k * 0.20 + p * 0.15 + f * 0.15 ELSE b * 0.35 + k * 0.30 + p * 0.20 + f * 0.15 END AS exact FROM v)"""


@query("A20_mood_index", f"""WITH {_SESSIONS}, r AS (SELECT *, CASE WHEN mood >= 68 AND expanding THEN 'BULLISH_EXPANSION' WHEN mood >= 48 THEN 'SELECTIVE_ROTATION' WHEN mood >= 32 THEN 'DEFENSIVE_CONSOLIDATION' ELSE 'RISK_OFF_CAPITAL_PRESERVATION' END AS regime FROM z)
SELECT trading_date, regime, CASE regime WHEN 'BULLISH_EXPANSION' THEN 100.0 WHEN 'SELECTIVE_ROTATION' THEN 75.0 WHEN 'DEFENSIVE_CONSOLIDATION' THEN 50.0 ELSE 25.0 END AS risk_budget, coalesce(long_pct < 20, false) AS coiled, round(b, 4) AS breadth, round(exact, 6) AS mood FROM r""")
def mood_index(spark, sf_dir):
    """Mood, regime and risk budget of every session: breadth, new highs, spread of prices, tide and volume flow; positioning is missing on every third date."""
    bars = a.bars(spark, sf_dir).withColumns({"pc": F.lag("close").over(w.sessions()), "top": c("close") >= F.max("high").over(w.last_bars(w.YEAR_BARS)), "bottom": c("close") <= F.min("low").over(w.last_bars(w.YEAR_BARS))})
    up, n = c("close") > c("pc"), F.count("*")
    s = bars.where("pc IS NOT NULL").groupBy("trading_date").agg(
        (F.count_if(up) * 100.0 / n).alias("advancing_pct"), (F.count_if("top") - F.count_if("bottom")).alias("net_new_highs"), (F.stddev_samp("close") / F.avg("close") * 20).alias("vix"),
        ((F.count_if(up) - F.count_if(~up)) / 10).alias("spread"), F.sum(F.when(up, c("volume")).otherwise(-c("volume"))).alias("net_flow"), (F.count_if("top") >= 1).alias("expanding"),
    )
    stamp = F.year("trading_date") * 400 + F.month("trading_date") * 31 + F.dayofmonth("trading_date")
    x = engines.mood_index(s.withColumn("long_pct", F.when(stamp % 3 != 0, 5.0 + stamp % 80)))
    breadth = F.least(F.lit(100.0), F.greatest(F.lit(0.0), c("advancing_pct") * 0.7 + F.least(F.lit(50), F.greatest(F.lit(-50), c("net_new_highs"))) * 0.6))
    return x.select("trading_date", "regime", "risk_budget", "coiled", F.round(breadth, 4).alias("breadth"), F.round("exact", 6).alias("mood"))


@query("T6_scan_rank", f"""WITH {BARS}, b AS (SELECT *, avg(close) OVER {over(50)} AS mean50, avg(close) OVER {over(200)} AS mean200, max(high) OVER {over(252)} AS high_52w, volume / avg(volume) OVER {over(20)} AS rvol, row_number() OVER (PARTITION BY company_id ORDER BY trading_date DESC) AS back, CAST(regexp_extract(company_id, '[0-9]+') AS INT) AS k FROM bars),
 f AS (SELECT *, k % 7 = 0 AS fin, (k % 24) / 10.0 AS de, k % 30 AS margin, 8.0 + k * 3 AS pe, 45.0 + k AS rsi, (high_52w - close) / high_52w * 100 AS off FROM b WHERE back = 1),
 d AS (SELECT *, CASE WHEN fin THEN 85 WHEN de < 0.3 THEN 95 WHEN de < 0.7 THEN 85 WHEN de < 1.0 THEN 70 WHEN de < 1.5 THEN 50 WHEN de < 2.0 THEN 35 ELSE 20 END AS solid,
  CASE WHEN pe < 18 THEN 90 WHEN pe < 30 THEN 80 WHEN pe < 45 THEN 65 WHEN pe < 65 THEN 45 WHEN pe < 85 THEN 30 ELSE 15 END AS val,
  least(100, greatest(10, 30 + CASE WHEN close > mean50 AND mean50 > mean200 THEN 30 WHEN close > mean50 THEN 15 ELSE 0 END + CASE WHEN off <= 3.5 THEN 25 WHEN off <= 6 THEN 18 WHEN off <= 12 THEN 10 ELSE 0 END
  + CASE WHEN rvol >= 2.5 THEN 15 WHEN rvol >= 1.8 THEN 10 WHEN rvol >= 1.3 THEN 5 ELSE 0 END + CASE WHEN rsi BETWEEN 52 AND 68 THEN 10 WHEN rsi BETWEEN 48 AND 72 THEN 5 ELSE 0 END)) AS mom FROM f),
 t AS (SELECT company_id, (CASE WHEN margin > 20 THEN least(100, solid + 5) WHEN margin < 5 THEN greatest(10, solid - 10) ELSE solid END) * 0.30 + val * 0.25 + mom * 0.45 + CASE WHEN k % 4 = 0 THEN 20 WHEN k % 4 = 1 THEN 12 ELSE 0 END AS rank FROM d)
SELECT company_id, round(rank, 4) AS rank, row_number() OVER (ORDER BY rank DESC, company_id) AS place FROM t QUALIFY place <= 20""")
def scan_rank(spark, sf_dir):
    """The twenty best of a strategy scan: durability, valuation and momentum blended, and a bonus of 20 for favoured sectors or 12 for their clusters."""
    k = F.regexp_extract("company_id", "[0-9]+", 0).cast("int")
    by = w.last_bars
    x = a.bars(spark, sf_dir).withColumns({"mean50": F.avg("close").over(by(50)), "mean200": F.avg("close").over(by(200)), "high_52w": F.max("high").over(by(w.YEAR_BARS)), "rvol": c("volume") / F.avg("volume").over(by(20))})
    x = x.withColumn("back", F.row_number().over(Window.partitionBy("company_id").orderBy(c("trading_date").desc()))).where("back = 1").withColumn("k", k)
    x = x.withColumns({"financial": c("k") % 7 == 0, "debt_to_equity": (c("k") % 24) / 10.0, "operating_margin": c("k") % 30, "pe": 8.0 + c("k") * 3, "pb": F.lit(3.0), "rsi": 45.0 + c("k")})
    x = scores.durability(x).withColumn("rank", c("composite") + F.when(c("k") % 4 == 0, 20).when(c("k") % 4 == 1, 12).otherwise(0))
    best = x.select("company_id", "rank").orderBy(c("rank").desc(), "company_id").limit(20)  # a top-k report
    place = F.row_number().over(Window.orderBy(c("rank").desc(), "company_id"))
    return best.withColumn("place", place).select("company_id", F.round("rank", 4).alias("rank"), c("place").cast("long").alias("place"))
