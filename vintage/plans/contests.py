"""Queries over ranking contests and the continuation model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import continuation as model
from ..operators import passage, scores, tournament
from ..operators import windows as w
from ..sources import adapters as a
from ..sources import statements as s
from ..sources.stored import stored
from .bar_windows import TR
from .feature_sql import FEATURES
from .fundamentals import vector
from .registry import query
from .setup_sql import r
from .views import BARS, DELIVERY, MARKET, W, over

c = F.col

# --- contests ------------------------------------------------------------------------------

_REINVESTED = "least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(ttm_capex / nullif(ttm_cfo, 0) * 100, 0)))"
_GAP = "least(100.0::DOUBLE, greatest(0.0::DOUBLE, 50.0::DOUBLE - coalesce(pe, 25) + coalesce(revenue_growth, 0)))"
_TERMS = {"compounding": f"coalesce(roce, 0) * {_REINVESTED} / 100 * 0.45::DOUBLE", "return": "coalesce(roce, 0) * 0.20::DOUBLE", "room": "least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(dist_high, -15) * -1.0::DOUBLE)) * 0.10::DOUBLE", "asymmetry": f"{_GAP} * 0.25::DOUBLE"}
_SCORES = {
    "RANDOM": "CAST(('0x' || substr(sha256(company_id || '_' || CAST(t0 AS VARCHAR)), 1, 8))::BIGINT % 1000 AS DOUBLE) / 10", "SIMPLE_VALUE": "CASE WHEN pe > 0 THEN 100 / pe ELSE 0 END", "SIMPLE_QUALITY": "coalesce(roce, 0)", "SIMPLE_GROWTH": "coalesce(revenue_growth, 0)", "SIMPLE_MOMENTUM": "coalesce(dist_sma200, 0)",
    "M6_LINEAR": "coalesce(conviction, 0)::DOUBLE", "5_PILLAR_SYNTHESIS": " + ".join(_TERMS.values()), "M7_GBDT": f"coalesce(roce, 0) * {_REINVESTED} / 100 * 0.50::DOUBLE + {_GAP} * (coalesce(roce, 0) / 20) * 0.35::DOUBLE + least(20.0::DOUBLE, coalesce(ttm_capex, 0) * 0.15::DOUBLE)",
}
_ABLATIONS = {"FULL": "0.0::DOUBLE + " + " + ".join(_TERMS.values())} | {f"WITHOUT_{k.upper()}": "0.0::DOUBLE + " + " + ".join(v for n, v in _TERMS.items() if n != k) for k in _TERMS}

_FROZEN = f"""{FEATURES}, p AS (SELECT *, least(99, greatest(15, 50 + least(50, greatest(-30, coalesce(revenue_growth, 0))) * 0.5 + least(50, greatest(-30, coalesce(pat_growth, 0))) * 0.5)) AS g,
  CASE WHEN roce IS NOT NULL AND ebitda_margin IS NOT NULL THEN least(99, greatest(20, 30 + least(50, greatest(0, roce)) * 0.9 + least(35, ebitda_margin) * 0.7)) END AS q,
  least(95, greatest(20, CASE WHEN pe <= 0 THEN 60 WHEN pe < 12 THEN 92 WHEN pe < 20 THEN 82 WHEN pe < 35 THEN 68 WHEN pe < 60 THEN 50 WHEN pe IS NOT NULL THEN 35 ELSE 60 END + CASE WHEN pb < 2.5 THEN 5 ELSE 0 END)) AS v,
  least(99, greatest(15, 40 + (20 - abs(coalesce(rsi, 50) - 60) * 0.8) + least(20, greatest(-15, coalesce(dist_sma50, 0))) + least(15, greatest(-10, coalesce(dist_sma200, 0) * 0.5)) + (100 + coalesce(dist_high, -15)) * 0.2 + least(15, (coalesce(volume_acceleration, 1) - 1) * 15))) AS m,
  CASE WHEN debt_to_equity IS NOT NULL AND pat_margin IS NOT NULL THEN least(95, greatest(25, 85 - CASE WHEN debt_to_equity > 2.5 THEN 25 WHEN debt_to_equity > 1.5 THEN 12 ELSE 0 END - CASE WHEN pat_margin < 3 THEN 15 ELSE 0 END)) END AS o FROM features),
 frozen AS (SELECT * EXCLUDE (g, q, v, m, o), CASE WHEN q IS NOT NULL AND o IS NOT NULL THEN least(99, greatest(20, (CAST(trunc(q) AS INT) * 30 + CAST(trunc(g) AS INT) * 25 + CAST(trunc(m) AS INT) * 20 + CAST(trunc(v) AS INT) * 15 + CAST(trunc(o) AS INT) * 10) // 100)) END AS conviction FROM p)"""


def _ranked_sql(scored: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT company_id, t0, '{k}' AS strategy, {r(v, 4)} AS score FROM frozen" for k, v in scored.items())
    return f"{_FROZEN}, scored AS ({rows}), ranked AS (SELECT *, row_number() OVER k AS place, count(*) OVER (PARTITION BY strategy, t0) AS size, lead(score) OVER k AS next_score FROM scored WINDOW k AS (PARTITION BY strategy, t0 ORDER BY score DESC, company_id))"


def _contest_sql(scored: dict[str, str], top: int) -> str:
    hits = {n: f"coalesce((max_run >= {m})::INT, 0)" for n, m in tournament.MULTIPLES.items()}
    return f"""WITH {_ranked_sql(scored)}, runs AS (SELECT d.company_id, d.t0, max(l.close) / arg_min(l.close, l.trading_date) * 100 - 100 AS max_run FROM dates d JOIN listed l ON l.company_id = d.company_id AND l.trading_date >= d.t0 GROUP BY 1, 2),
 x AS (SELECT ranked.*, max_run FROM ranked LEFT JOIN runs USING (company_id, t0)), per AS (SELECT strategy, t0, max(size) AS size, count(*) FILTER (place <= {top}) AS picks, max(CASE WHEN place = {top} THEN (score = next_score)::INT END) AS tied,
  {', '.join(f"sum({h}) AS all_{n}, sum(CASE WHEN place <= {top} THEN {h} ELSE 0 END) AS hits_{n}" for n, h in hits.items())} FROM x GROUP BY 1, 2)
SELECT strategy, CAST(sum(picks) AS BIGINT) AS picks, count(*) AS dates, round(avg(coalesce(tied, 0)) * 100, 4) AS tied_pct, {', '.join(f'''CAST(sum(hits_{n}) AS BIGINT) AS hits_{n}, round(sum(hits_{n}) / sum(picks) * 100, 4) AS precision_{n}, round(sum(hits_{n}) / nullif(sum(picks * all_{n} / size), 0), 4) AS lift_{n},
  round((sum(hits_{n}) - sum(picks * all_{n} / size)) / nullif(sqrt(sum(CASE WHEN size > 1 THEN picks * (all_{n} / size) * (1 - all_{n} / size) * (size - picks) / (size - 1) ELSE 0 END)), 0), 3) AS z_{n}''' for n in hits)} FROM per GROUP BY strategy"""


def _contest(spark, sf_dir, scored, top):
    x = vector(spark, sf_dir)
    x = stored(x, "universe")
    outcomes = passage.starts(passage.numbered(s.listed_bars(spark, sf_dir)), x.select("company_id", "t0"))
    out = tournament.contest(tournament.ranked(x, scored), outcomes, top)
    digits = {k: 3 if k.startswith("z_") else 4 for k in out.columns if k.startswith(("tied", "precision", "lift", "z_"))}
    return out.select(*(F.round(k, digits[k]).alias(k) if k in digits else c(k) for k in out.columns))


@query("W28_strategy_ranks", f"WITH {_ranked_sql(_SCORES)} SELECT company_id, t0, strategy, score, place FROM ranked")
def strategy_ranks(spark, sf_dir):
    """Eight strategies rank the whole universe of every date."""
    x = tournament.ranked(vector(spark, sf_dir), tournament.strategies())
    return x.select("company_id", "t0", "strategy", "score", c("place").cast("long").alias("place"))


@query("A14_tournament_top20", _contest_sql(_SCORES, 20))
def tournament_top20(spark, sf_dir):
    """Precision of the twenty best, lift and z value against permuted scores, and dates that ties decided."""
    return _contest(spark, sf_dir, tournament.strategies(), 20)


@query("A14_tournament_top5", _contest_sql(_SCORES, 5))
def tournament_top5(spark, sf_dir):
    return _contest(spark, sf_dir, tournament.strategies(), 5)


@query("M32_pillar_ablation", _contest_sql(_ABLATIONS, 8))
def pillar_ablation(spark, sf_dir):
    """The pillar score with all terms, and without each."""
    return _contest(spark, sf_dir, tournament.ablations(), 8)


# --- continuation --------------------------------------------------------------------------

_INPUT = f"""{BARS}, {DELIVERY}, {TR}, {MARKET}, mk AS (SELECT trading_date, (close / lag(close) OVER (ORDER BY trading_date) - 1) * 100 AS market_change FROM market),
 b0 AS (SELECT company_id, trading_date, open, high, low, close, volume, (close / pc - 1) * 100 AS change, {r(f'volume / avg(volume) OVER {over(20, 1)}', 2)} AS rvol, avg(close) OVER {over(20)} AS mean, avg(true_range) OVER {over(14)} AS atr, avg(close) OVER {over(50)} AS mean50, avg(close) OVER {over(200)} AS mean200,
   max(high) OVER {over(252)} AS high_52w, avg(volume) OVER {over(250)} * 40 AS floating FROM ranged),
 dl AS (SELECT *, lag(delivery_pct) OVER ({W}) AS d1, lag(delivery_pct, 2) OVER ({W}) AS d2 FROM delivery),
 breadth AS (SELECT trading_date, 100.0::DOUBLE * count(*) FILTER (change > 0) / count(*) AS cmmi FROM b0 WHERE change IS NOT NULL GROUP BY trading_date),
 i0 AS (SELECT b0.*, delivery_pct, CASE WHEN delivery_pct > d1 AND d1 > d2 THEN 'STAIRCASE_ACCUMULATION' WHEN delivery_pct < d1 AND d1 < d2 THEN 'DISTRIBUTION_CHURN' ELSE 'STABLE_DELIVERY' END AS trajectory, CASE WHEN floating > 1000 AND delivery_qty > 0 THEN delivery_qty / floating * 100 END AS fsar, cmmi, market_change,
   least(100.0::DOUBLE, greatest(10.0::DOUBLE, 30 + CASE WHEN close > mean50 AND mean50 > mean200 THEN 30 WHEN close > mean50 THEN 15 ELSE 0 END + CASE WHEN (high_52w - close) / high_52w * 100 <= 3.5 THEN 25 WHEN (high_52w - close) / high_52w * 100 <= 6 THEN 18 WHEN (high_52w - close) / high_52w * 100 <= 12 THEN 10 ELSE 0 END
    + CASE WHEN coalesce(rvol, 1) >= 2.5 THEN 15 WHEN coalesce(rvol, 1) >= 1.8 THEN 10 WHEN coalesce(rvol, 1) >= 1.3 THEN 5 ELSE 0 END + 10)) AS momentum
  FROM b0 JOIN dl USING (company_id, trading_date) JOIN breadth USING (trading_date) JOIN mk USING (trading_date) WHERE change IS NOT NULL),
 i1 AS (SELECT *, CASE WHEN high - low <= 0.0001 THEN 0.5 ELSE least(greatest((close - low) / (high - low), 0), 1) END AS clv, CASE WHEN high - low <= 0.0001 THEN 0 ELSE greatest(high - greatest(open, close), 0) / (high - low) END AS wick, coalesce(CASE WHEN mean <> 0 AND atr > 0.01 THEN (close - mean) / atr END, 1.5) AS ier, coalesce(delivery_pct, 0) AS dlv, coalesce(rvol, 1.0) AS rv, (high_52w - close) / high_52w * 100 AS away,
   coalesce((high - close) / high <= 0.0015 AND ((high - low) / close <= 0.004 OR least(abs(abs(change) - 2), abs(abs(change) - 5), abs(abs(change) - 10), abs(abs(change) - 20)) <= 0.35) AND change >= 1.9, false) AS locked FROM i0)"""


def _d(text: str) -> str:
    from .screening import D

    return D(text)


_POINTS = _d(f"""i2 AS (SELECT *, [
  CASE WHEN clv >= 0.90 THEN {r('8.0 + (clv - 0.90) / 0.10 * 3.0', 1)} WHEN clv >= 0.70 THEN {r('3.0 + (clv - 0.70) / 0.20 * 5.0', 1)} WHEN clv < 0.40 THEN -{r('6.0 + (0.40 - clv) / 0.40 * 8.0', 1)} ELSE 0.0 END,
  CASE WHEN wick < 0.05 THEN 3.0 WHEN wick >= 0.35 THEN -16.0 WHEN wick >= 0.15 THEN -{r('(wick - 0.15) / 0.20 * 8.0', 1)} END,
  CASE WHEN dlv >= 60 THEN {r('(10.0 + least(4.0, (dlv - 60.0) * 0.15)) * 1.0', 1)} WHEN dlv >= 45 THEN {r('(6.0 + (dlv - 45.0) / 15.0 * 4.0) * 1.0', 1)} WHEN dlv >= 35 THEN {r('(2.0 + (dlv - 35.0) / 10.0 * 4.0) * 1.0', 1)} WHEN dlv >= 22 THEN {r('(dlv - 22.0) / 13.0 * 2.0 * 1.0', 1)} WHEN dlv > 0 AND dlv < 18 THEN -{r('(8.0 + (18.0 - dlv) / 18.0 * 8.0) * 1.0', 1)} WHEN dlv = 0 THEN -5.0 END,
  CASE trajectory WHEN 'STAIRCASE_ACCUMULATION' THEN 5.0 WHEN 'DISTRIBUTION_CHURN' THEN -8.0 END,
  CASE WHEN fsar >= 1 AND dlv >= 35 THEN {r('least(5.0, 2.5 + fsar * 1.5)', 1)} WHEN fsar >= 0.5 AND dlv >= 30 THEN 2.5 WHEN fsar >= 1 AND dlv < 20 AND dlv > 0 THEN -8.0 END,
  CASE WHEN rv >= 3 THEN {r('4.0 + least(4.0, (rv - 3.0) * 0.8)', 1)} WHEN rv >= 1.5 THEN {r('(rv - 1.5) / 1.5 * 4.0', 1)} WHEN rv < 1 THEN -{r('(1.0 - rv) * 6.0', 1)} END,
  CASE WHEN ier > 4.5 THEN -14.0 WHEN ier > 3 THEN -{r('(ier - 3.0) * 5.0', 1)} WHEN ier BETWEEN 0.8 AND 2.2 THEN 2.0 END,
  {r('(60.0 - 50.0) / 50.0 * 3.0 + (momentum - 50.0) / 50.0 * 4.0', 1)}, CASE WHEN away <= 3 THEN 6.0 WHEN away > 20 THEN -6.0 END] AS points FROM i1),
 i3 AS (SELECT *, {r('50.0 + coalesce(points[1], 0.0) + coalesce(points[2], 0.0) + coalesce(points[3], 0.0) + coalesce(points[4], 0.0) + coalesce(points[5], 0.0) + coalesce(points[6], 0.0) + coalesce(points[7], 0.0) + coalesce(points[8], 0.0) + coalesce(points[9], 0.0)', 1)} AS score FROM i2),
 i4 AS (SELECT *, least(92.0, greatest(10.0, {r('1 / (1 + exp(-((score - 50.0) / 20.0))) * 100', 1)})) AS base, {r('least(1.10, greatest(0.80, 1.0 + ((cmmi - 50.0) / 100.0 * 0.5 + coalesce(market_change, 0.0) / 10.0 * 0.5) * 1.0))', 3)} AS multiplier FROM i3),
 i5 AS (SELECT *, least(92.0, greatest(10.0, {r('base * multiplier', 1)})) AS p FROM i4)""")


@query("M10_continuation_verdicts", f"""WITH {_INPUT}, {_POINTS} SELECT company_id, trading_date, score, multiplier, CASE WHEN (dlv > 0 AND dlv < 18) OR wick >= 0.35 THEN least(42, p) WHEN locked THEN p WHEN dlv = 0 OR ier > 4.5 THEN least(58, p) ELSE p END AS probability, len(list_filter(points, lambda x: x IS NOT NULL)) AS factors,
 round(list_min(list_filter(points, lambda x: x IS NOT NULL)), 1) AS worst, locked, CASE WHEN (dlv > 0 AND dlv < 18) OR wick >= 0.35 THEN 'RETAIL_TRAP_FADE_RISK' WHEN locked THEN 'CIRCUIT_LOCKED_ILLIQUID' WHEN dlv = 0 OR ier > 4.5 THEN 'PULLBACK_ACCUMULATION' WHEN p >= 75 THEN 'GAP_AND_GO_CANDIDATE' WHEN p >= 60 THEN 'PULLBACK_ACCUMULATION' WHEN p >= 45 THEN 'RANGE_BOUND_DIGESTION' ELSE 'RETAIL_TRAP_FADE_RISK' END AS verdict FROM i5""")
def continuation_verdicts(spark, sf_dir):
    """Evidence, probability under market drag and verdict of every session, with the number of factors and the worst of them."""
    bars = a.bars(spark, sf_dir)
    by, one = w.sessions(), w.last_bars
    x = w.extremes(bars.withColumn("true_range", w.true_range()), w.YEAR_BARS, high_52w=("max", "high")).withColumns({
        "change": (c("close") / F.lag("close").over(by) - 1) * 100, "rvol": model.half_up(c("volume") / F.avg("volume").over(one(20, 1)), 2), "mean": F.avg("close").over(one(20)), "atr": w.atr(14), "mean50": F.avg("close").over(one(50)), "mean200": F.avg("close").over(one(200)),
        "floating": F.avg("volume").over(one(250)) * 40,
    })
    days = Window.orderBy("trading_date")  # one row a session
    market = a.benchmark_bars(bars).withColumn("market_change", (c("close") / F.lag("close").over(days) - 1) * 100).select("trading_date", "market_change")
    x = x.where("change IS NOT NULL")
    breadth = x.groupBy("trading_date").agg((100.0 * F.count_if(c("change") > 0) / F.count("*")).alias("cmmi"))
    d = a.delivery(spark, sf_dir)
    d1, d2 = F.lag("delivery_pct").over(by), F.lag("delivery_pct", 2).over(by)
    trajectory = F.when((c("delivery_pct") > d1) & (d1 > d2), "STAIRCASE_ACCUMULATION").when((c("delivery_pct") < d1) & (d1 < d2), "DISTRIBUTION_CHURN").otherwise("STABLE_DELIVERY")
    x = x.join(d.withColumn("trajectory", trajectory).select("company_id", "trading_date", "delivery_pct", "delivery_qty", "trajectory"), ["company_id", "trading_date"]).join(breadth, "trading_date").join(market, "trading_date")
    x = scores.durability(x.withColumns({"financial": F.lit(False), "debt_to_equity": F.lit(None).cast("double"), "operating_margin": F.lit(10.0), "pe": F.lit(None).cast("double"), "pb": F.lit(3.0), "rsi": F.lit(55.0)})).drop("durability")
    none = F.lit(None)
    x = x.withColumns({"fsar": model.f.float_absorption(c("delivery_qty"), c("floating")), "durability": none.cast("double"), "sector_state": none.cast("string"), "beta": none.cast("double"), "week_change": none.cast("double")})
    x = model.continuation(x, "YEARLY")
    return x.select("company_id", "trading_date", "score", "multiplier", "probability", F.size("factors").cast("long").alias("factors"), F.round(F.array_min("factors.points"), 1).alias("worst"), "locked", "verdict")
