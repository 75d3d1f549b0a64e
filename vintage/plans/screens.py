"""Queries over predicates, screens, ranking and scores (P, T, M operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import paths, ranking, scores
from ..operators import predicates as p
from ..operators import windows as w
from ..sources import adapters as a
from .bar_windows import AVERAGES, MANSFIELD, STAGE, VCP
from .registry import query
from .views import BARS, DELIVERY, LINES, W, over

FUNDAMENTALS = """fund AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal / 200 AS growth, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 150 END AS pe, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey / 8.0 END AS debt,
  c_acctbal AS net_worth, c_mktsegment = 'BUILDING' AS financial, c_acctbal / 400 AS roce, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey * 1.5 END AS margin FROM customer)"""


def fundamentals(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer")
    bal, nation, key = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    return c.select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", (bal / 200).alias("growth"), F.when(key % 7 != 0, bal / 150).alias("pe"), F.when(key % 5 != 0, nation / 8.0).alias("debt"), bal.alias("net_worth"),
        (F.col("c_mktsegment") == "BUILDING").alias("financial"), (bal / 400).alias("roce"), F.when(key % 11 != 0, nation * 1.5).alias("margin"),
    )


@query("P1_eligibility", """SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%TEST%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def eligibility(spark, sf_dir):
    c, o = a.table(spark, sf_dir, "customer"), a.table(spark, sf_dir, "orders")
    prices, filings = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey")) for s in ("F", "O"))
    return p.eligible(c.where(~F.contains("c_name", F.lit("TEST"))), "c_custkey", [prices, filings]).select("c_custkey")


SCREEN = "(growth IS NULL OR growth >= 10) AND (pe IS NULL OR pe <= 50) AND net_worth > 0 AND (financial OR debt IS NULL OR debt <= 2)"


@query("P2_threshold_screen", f"WITH {FUNDAMENTALS} SELECT c_custkey FROM fund WHERE {SCREEN}")
def threshold_screen(spark, sf_dir):
    request = p.ScreenRequest(min_growth=10, max_pe=50, max_debt=2)
    return fundamentals(spark, sf_dir).where(p.screen(request)).select("c_custkey")


@query("P4_predicates", f"WITH {FUNDAMENTALS} SELECT c_custkey FROM fund WHERE growth > 5 AND growth <= pe AND roce BETWEEN 2 AND 20 AND c_nationkey <> 3")
def predicates(spark, sf_dir):
    rules = [
        {"left": "growth", "operation": "greater", "right": 5}, {"left": "growth", "operation": "eless", "right": "pe"}, {"left": "roce", "operation": "in_range", "right": [2, 20]},
        {"left": "c_nationkey", "operation": "nequal", "right": 3},
    ]
    x = fundamentals(spark, sf_dir)
    return x.where(p.compile_rules(rules, x.columns)).select("c_custkey")


@query("P5_post_scan", f"WITH {FUNDAMENTALS} SELECT c_custkey FROM fund WHERE net_worth > 5 AND coalesce(debt, 0.5) <= 2 AND c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')")
def post_scan(spark, sf_dir):
    return fundamentals(spark, sf_dir).where((F.col("net_worth") > 5) & (F.coalesce("debt", F.lit(0.5)) <= 2) & ~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")).select("c_custkey")


@query("P6_presets", f"WITH {FUNDAMENTALS} SELECT 'quality' AS preset, count(*) AS n FROM fund WHERE (growth IS NULL OR growth >= 5) AND (pe IS NULL OR pe <= 60) AND net_worth > 0 AND (financial OR debt IS NULL OR debt <= 1) UNION ALL SELECT 'growth', count(*) FROM fund WHERE (growth IS NULL OR growth >= 20) AND (pe IS NULL OR pe <= 80) AND net_worth > 0 AND (financial OR debt IS NULL OR debt <= 3)")
def presets(spark, sf_dir):
    x = fundamentals(spark, sf_dir)
    flags = [F.count_if(p.screen(r)).alias(n) for n, r in p.PRESETS.items()]
    return x.agg(*flags).unpivot([], list(p.PRESETS), "preset", "n")


@query("P7_top_gainers", f"""WITH {BARS}, g AS (SELECT *, (close / lag(close) OVER ({W}) - 1) * 100 AS change FROM bars) SELECT company_id, trading_date, round(change, 6) AS change FROM g WHERE change >= 2.5 AND close * volume >= 250000 AND close >= 15""")
def top_gainers(spark, sf_dir):
    x = a.bars(spark, sf_dir).withColumn("change", (F.col("close") / F.lag("close").over(w.sessions()) - 1) * 100)
    return x.where(p.strong_day()).select("company_id", "trading_date", F.round("change", 6).alias("change"))


@query("P8_regime_parameters", """SELECT event_id, CASE WHEN event_type = 'error' THEN 1.5 WHEN event_type = 'purchase' THEN 1.1 ELSE 1.3 END AS min_rvol FROM events""")
def regime_parameters(spark, sf_dir):
    table = spark.createDataFrame([("error", 1.5), ("purchase", 1.1), ("click", 1.3), ("view", 1.3), ("signup", 1.3)], "kind string, min_rvol double")  # a parameter table of one row per regime
    return a.quotes(spark, sf_dir).join(F.broadcast(table), "kind", "left").select("event_id", F.coalesce("min_rvol", F.lit(1.3)).alias("min_rvol"))


@query("T1_global_order", f"WITH {FUNDAMENTALS} SELECT c_custkey, row_number() OVER (ORDER BY roce DESC, c_custkey) AS place FROM fund WHERE net_worth > 9000")
def global_order(spark, sf_dir):
    x = fundamentals(spark, sf_dir).where("net_worth > 9000")
    return p.global_places(x, [F.col("roce").desc(), F.col("c_custkey")]).select("c_custkey", "place")


@query("T2_stratified", f"""WITH {FUNDAMENTALS}, b AS (SELECT *, CASE WHEN net_worth <= 3000 THEN 'small' WHEN net_worth <= 6000 THEN 'mid' ELSE 'large' END AS bucket FROM fund), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY roce DESC, c_custkey) <= CASE bucket WHEN 'small' THEN 20 WHEN 'mid' THEN 18 ELSE 12 END AS picked FROM b)
SELECT c_custkey, bucket FROM k ORDER BY picked DESC, roce DESC, c_custkey LIMIT 50""")
def stratified(spark, sf_dir):
    """Quotas of 40, 36 and 24 % of 50; the limit is the feature."""
    n = F.col("net_worth")
    bucket = F.when(n <= 3000, "small").when(n <= 6000, "mid").otherwise("large")
    return ranking.stratified(fundamentals(spark, sf_dir), bucket, {"small": 0.4, "mid": 0.36, "large": 0.24}, [F.col("roce").desc(), F.col("c_custkey")], 50).select("c_custkey", "bucket")


@query("T4_multi_key", f"WITH {FUNDAMENTALS} SELECT c_custkey, c_nationkey FROM fund ORDER BY c_nationkey, roce DESC, c_custkey LIMIT 25")
def multi_key(spark, sf_dir):
    return fundamentals(spark, sf_dir).orderBy("c_nationkey", F.col("roce").desc(), "c_custkey").limit(25).select("c_custkey", "c_nationkey")


@query("T5_latest_per_key", f"WITH {BARS} SELECT company_id, trading_date FROM bars QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY trading_date DESC) <= 60")
def latest_per_key(spark, sf_dir):
    return ranking.latest(a.bars(spark, sf_dir), "company_id", F.col("trading_date").desc(), 60).select("company_id", "trading_date")


@query("U5_ordered_dedupe", f"WITH {LINES} SELECT company_id, min(l_orderkey) AS first_seen FROM lines GROUP BY company_id")
def ordered_dedupe(spark, sf_dir):
    li, part = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("company_id")).agg(F.min("l_orderkey").alias("first_seen"))


@query("U3_favoured_sectors", """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, c_mktsegment AS seg, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY v DESC, seg) AS k, row_number() OVER (PARTITION BY day ORDER BY v, seg) AS up FROM s)
SELECT day, string_agg(seg, ',' ORDER BY k) AS favoured FROM r WHERE k <= 4 AND up > 1 GROUP BY day""")
def favoured_sectors(spark, sf_dir):
    """Sectors of a day by turnover, without the weakest, at most four."""
    o, c = a.table(spark, sf_dir, "orders"), a.table(spark, sf_dir, "customer")
    s = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.to_date("o_orderdate").alias("day"), F.col("c_mktsegment").alias("seg")).agg(F.sum("o_totalprice").alias("v"))
    lists = s.groupBy("day").agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("m"), "seg"))).alias("k"))
    names = F.transform("k", lambda t: t["seg"])
    weakest = F.element_at(F.array_sort(F.transform("k", lambda t: F.struct((-t["m"]).alias("v"), t["seg"].alias("seg")))), 1)["seg"]
    return lists.select("day", F.array_join(F.slice(F.array_except(F.slice(names, 1, 4), F.array(weakest)), 1, 4), ",").alias("favoured")).where("favoured <> ''")


@query("M9_durability", f"""WITH {BARS}, b AS (SELECT *, avg(close) OVER {over(50)} AS mean50, avg(close) OVER {over(200)} AS mean200, max(high) OVER {over(252)} AS hi, volume / avg(volume) OVER {over(20, 1)} AS rvol, row_number() OVER ({W}) AS n FROM bars),
 s AS (SELECT company_id, trading_date, CASE WHEN n % 13 = 0 THEN 85 WHEN n % 3 = 0 THEN 65 WHEN n % 25 / 10.0 < 0.3 THEN 95 WHEN n % 25 / 10.0 < 0.7 THEN 85 WHEN n % 25 / 10.0 < 1 THEN 70 WHEN n % 25 / 10.0 < 1.5 THEN 50 WHEN n % 25 / 10.0 < 2 THEN 35 ELSE 20 END AS d,
  CASE WHEN n % 4 = 0 THEN 60 WHEN n % 90 <= 0 THEN 60 WHEN n % 90 < 18 THEN 90 WHEN n % 90 < 30 THEN 80 WHEN n % 90 < 45 THEN 65 WHEN n % 90 < 65 THEN 45 WHEN n % 90 < 85 THEN 30 ELSE 15 END AS v,
  least(100, greatest(10, 30 + CASE WHEN close > mean50 AND mean50 > mean200 THEN 30 WHEN close > mean50 THEN 15 ELSE 0 END + CASE WHEN (hi - close) / hi * 100 <= 3.5 THEN 25 WHEN (hi - close) / hi * 100 <= 6 THEN 18 WHEN (hi - close) / hi * 100 <= 12 THEN 10 ELSE 0 END
   + CASE WHEN coalesce(rvol, 1) >= 2.5 THEN 15 WHEN coalesce(rvol, 1) >= 1.8 THEN 10 WHEN coalesce(rvol, 1) >= 1.3 THEN 5 ELSE 0 END + 10)) AS m FROM b)
SELECT company_id, trading_date, round(d * 0.30 + v * 0.25 + m * 0.45, 4) AS composite FROM s""")
def durability(spark, sf_dir):
    x = a.bars(spark, sf_dir)
    n = F.row_number().over(w.sessions())
    x = x.withColumns({"n": n, "mean50": F.avg("close").over(w.last_bars(50)), "mean200": F.avg("close").over(w.last_bars(200)), "high_52w": w.year_high(), "rvol": F.col("volume") / F.avg("volume").over(w.last_bars(20, 1))})
    k = F.col("n")
    x = x.withColumns({"financial": k % 13 == 0, "debt_to_equity": F.when(k % 3 != 0, k % 25 / 10.0), "operating_margin": F.lit(10.0), "pe": F.when(k % 4 != 0, (k % 90).cast("double")), "pb": F.lit(3.0), "rsi": F.lit(55.0)})
    return scores.durability(x).select("company_id", "trading_date", F.round("composite", 4).alias("composite"))


@query("M3_frozen_factors", """WITH i AS (SELECT c_custkey, c_acctbal / 150 AS g, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey * 2.0 END AS roce, c_nationkey * 1.5 AS em, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 120 END AS pe, c_nationkey / 8.0 AS de, c_acctbal / 1000 AS pm FROM customer),
 s AS (SELECT *, CAST(trunc(least(99, greatest(15, 50 + least(50, greatest(-30, g)) * 0.5 + 5))) AS INT) AS gs, CASE WHEN roce IS NOT NULL THEN CAST(trunc(least(99, greatest(20, 30 + least(50, greatest(0, roce)) * 0.9 + least(35, em) * 0.7))) AS INT) END AS qs,
  CAST(least(95, greatest(20, CASE WHEN pe <= 0 THEN 60 WHEN pe < 12 THEN 92 WHEN pe < 20 THEN 82 WHEN pe < 35 THEN 68 WHEN pe < 60 THEN 50 WHEN pe IS NOT NULL THEN 35 ELSE 60 END)) AS INT) AS vs,
  CAST(trunc(least(95, greatest(25, 85 - CASE WHEN de > 2.5 THEN 25 WHEN de > 1.5 THEN 12 ELSE 0 END - CASE WHEN pm < 3 THEN 15 ELSE 0 END))) AS INT) AS cs FROM i)
SELECT c_custkey, gs AS growth_score, qs AS quality_score, vs AS valuation_score, cs AS governance_score, CASE WHEN qs IS NOT NULL THEN least(99, greatest(20, CAST(trunc(qs * 0.30 + gs * 0.25 + 69 * 0.20 + vs * 0.15 + cs * 0.10) AS INT))) END AS conviction FROM s""")
def frozen_factors(spark, sf_dir):
    """Prices' part is neutral here: momentum is 69 without inputs."""
    c = a.table(spark, sf_dir, "customer")
    bal, nation, key, none = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey"), F.lit(None).cast("double")
    x = c.select(
        "c_custkey", (bal / 150).alias("revenue_growth"), F.lit(10.0).alias("pat_growth"), F.when(key % 9 != 0, nation * 2.0).alias("roce"), (nation * 1.5).alias("ebitda_margin"), F.when(key % 7 != 0, bal / 120).alias("pe"), none.alias("pb"),
        (nation / 8.0).alias("debt_to_equity"), (bal / 1000).alias("pat_margin"), *(none.alias(k) for k in ("rsi", "dist_sma50", "dist_sma200", "dist_high", "volume_acceleration")),
    )
    return scores.frozen_factors(x).select("c_custkey", "growth_score", "quality_score", "valuation_score", "governance_score", "conviction")


@query("M10_continuation", f"""WITH {BARS}, {DELIVERY}, b AS (SELECT *, volume / avg(volume) OVER {over(20, 1)} AS rvol, (close / lag(close) OVER ({W}) - 1) * 100 AS change, avg(close) OVER {over(20)} AS mean, avg(high - low) OVER {over(14)} AS rng FROM bars),
 e AS (SELECT b.company_id, b.trading_date, CASE WHEN high - low <= 0.0001 THEN 0.5 ELSE least(greatest((close - low) / (high - low), 0), 1) END AS loc, CASE WHEN high - low <= 0.0001 THEN 0 ELSE greatest(high - greatest(open, close), 0) / (high - low) END AS wick, delivery_pct, rvol,
  coalesce(CASE WHEN rng > 0.01 THEN (close - mean) / rng END, 1.5) AS stretch, least(abs(abs(change) - 2), abs(abs(change) - 5), abs(abs(change) - 10), abs(abs(change) - 20)) <= 0.35 AS locked FROM b JOIN delivery USING (company_id, trading_date) WHERE change IS NOT NULL AND rvol IS NOT NULL),
 p AS (SELECT *, least(greatest(1 / (1 + exp(-((loc - 0.5) * 2 - wick * 1.5 + coalesce((delivery_pct - 45) / 30, 0) + least(greatest(rvol - 1, -1), 2) * 0.4 - least(greatest(stretch - 2.5, 0), 3) * 0.5))), 0.05), 0.95) AS raw FROM e)
SELECT company_id, trading_date, round(CASE WHEN locked THEN least(raw, 0.5) WHEN wick > 0.45 AND loc < 0.5 THEN least(raw, 0.35) ELSE raw END, 6) AS probability FROM p""")
def continuation(spark, sf_dir):
    o, h, lo, cl = (F.col(k) for k in ("open", "high", "low", "close"))
    x = a.bars(spark, sf_dir).withColumns({
        "rvol": F.col("volume") / F.avg("volume").over(w.last_bars(20, 1)), "change": (cl / F.lag("close").over(w.sessions()) - 1) * 100, "mean": F.avg("close").over(w.last_bars(20)), "rng": F.avg(h - lo).over(w.last_bars(14)),
    })
    x = x.where("change IS NOT NULL AND rvol IS NOT NULL").join(a.delivery(spark, sf_dir), ["company_id", "trading_date"])
    x = x.withColumns({"location": f.close_location(h, lo, cl), "wick": f.upper_wick(o, h, lo, cl), "stretch": f.elasticity(cl, F.col("mean"), F.col("rng")), "locked": f.circuit_locked(F.col("change"))})
    return scores.continuation(x).select("company_id", "trading_date", F.round("probability", 6).alias("probability"))


@query("M11_structure_score", f"""WITH {BARS}, {AVERAGES}, {STAGE}, {MANSFIELD}, {VCP}
SELECT s.company_id, s.trading_date, CASE WHEN s.stage IN ('STAGE_2_UPTREND', 'STAGE_2_EMERGING') THEN 50 WHEN s.stage = 'STAGE_1_ACCUMULATION' THEN 30 ELSE 0 END + CASE WHEN m.score > 10 THEN 30 WHEN m.score > 0 THEN 20 WHEN m.score > -5 THEN 10 ELSE 0 END
  + CASE WHEN v.n >= 40 AND round(coalesce(squeeze, 1), 2) <= 0.60 AND round(dry, 2) <= 0.70 THEN 20 ELSE 0 END AS technical_score, s.stage = 'STAGE_4_DECLINE' AS breaker
FROM stages s JOIN mansfield m USING (company_id, trading_date) JOIN vcp v USING (company_id, trading_date)""")
def structure_score(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    x = paths.contraction(w.stage(w.indicators(bars)))
    strength = paths.mansfield(bars).select("company_id", "trading_date", "score")
    return scores.structure_score(x.join(strength, ["company_id", "trading_date"])).select("company_id", "trading_date", "technical_score", "breaker")


@query("M36_continuation_radar", f"""WITH {BARS}, g AS (SELECT *, (close / lag(close) OVER ({W}) - 1) * 100 AS change FROM bars), k AS (SELECT * FROM g WHERE change >= 2.5 AND close >= 15)
SELECT trading_date, count(*) AS gainers, round(avg(change), 6) AS mean_change, max_by(company_id, (change, company_id)) AS leader FROM k GROUP BY trading_date""")
def continuation_radar(spark, sf_dir):
    x = a.bars(spark, sf_dir).withColumn("change", (F.col("close") / F.lag("close").over(w.sessions()) - 1) * 100).where("change >= 2.5 AND close >= 15")
    return x.groupBy("trading_date").agg(F.count("*").alias("gainers"), F.round(F.avg("change"), 6).alias("mean_change"), F.max_by("company_id", F.struct("change", "company_id")).alias("leader"))


@query("M20_screen_pipeline", f"""WITH {FUNDAMENTALS}, k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY roce DESC, c_custkey) AS place FROM fund WHERE {SCREEN})
SELECT c_nationkey, c_custkey, place, CASE WHEN roce >= 20 THEN 'strategic' WHEN growth >= 30 THEN 'swing' ELSE 'watch' END AS feed FROM k WHERE place <= 10""")
def screen_pipeline(spark, sf_dir):
    """Gates, rank per market, routing to feeds: one plan. Ten per market is the feature."""
    x = fundamentals(spark, sf_dir).where(p.screen(p.ScreenRequest(min_growth=10, max_pe=50, max_debt=2)))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("roce").desc(), "c_custkey"))
    feed = F.when(F.col("roce") >= 20, "strategic").when(F.col("growth") >= 30, "swing").otherwise("watch")
    return x.withColumn("place", place).where("place <= 10").select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"), feed.alias("feed"))
