"""Queries over the windows of daily bars (W operators) and forward outcomes of bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import paths, recurrence
from ..operators import windows as w
from ..sources import adapters as a
from .registry import SQL, query
from .views import ACTIONS, BARS, DELIVERY, FILINGS, MARKET, W, over

KEY = ("company_id", "trading_date")


def rounded(df, *columns: str, digits: int = 4):
    return df.select(*KEY, *(F.round(c, digits).alias(c) for c in columns))


@query("W1_sma", f"""WITH {BARS}, x AS (
  SELECT *, row_number() OVER ({W}) AS n, avg(close) OVER {over(20)} AS a20, avg(close) OVER {over(50)} AS a50, avg(close) OVER {over(200)} AS a200 FROM bars)
SELECT company_id, trading_date, round(CASE WHEN n >= 20 THEN a20 END, 4) AS sma20, round(CASE WHEN n >= 50 THEN a50 END, 4) AS sma50,
  round(CASE WHEN n >= 200 THEN a200 END, 4) AS sma200, round(CASE WHEN n >= 50 THEN (close - a50) / a50 * 100 END, 4) AS dist_sma50 FROM x""")
def sma(spark, sf_dir):
    out = a.bars(spark, sf_dir).withColumns({"sma20": w.sma(20), "sma50": w.sma(50), "sma200": w.sma(200)})
    return rounded(out.withColumn("dist_sma50", w.pct_from(F.col("sma50"))), "sma20", "sma50", "sma200", "dist_sma50")


TR = f"""tr AS (SELECT *, row_number() OVER ({W}) AS n, lag(close) OVER ({W}) AS pc FROM bars), ranged AS (
  SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range FROM tr)"""


@query("W2_atr", f"""WITH {BARS}, {TR}
SELECT company_id, trading_date, round(avg(true_range) OVER {over(14)}, 4) AS atr14, round(avg(true_range) OVER {over(14)} / close * 100, 4) AS atr_pct FROM ranged""")
def atr(spark, sf_dir):
    out = a.bars(spark, sf_dir).withColumn("true_range", w.true_range()).withColumn("atr14", w.atr(14))
    return rounded(out.withColumn("atr_pct", F.col("atr14") / F.col("close") * 100), "atr14", "atr_pct")


#: Smoothing is linear: the seed and every later change of the slice count with a power of 13/14.
RSI = f"""WITH {BARS}, k AS (SELECT p.company_id, p.trading_date, b.close - lag(b.close) OVER o AS change, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY p.company_id, p.trading_date) - 1 AS n
  FROM bars p JOIN bars b ON b.company_id = p.company_id AND b.trading_date BETWEEN p.trading_date - 400 AND p.trading_date WINDOW o AS (PARTITION BY p.company_id, p.trading_date ORDER BY b.trading_date)),
 g AS (SELECT company_id, trading_date, max(n) AS n, coalesce(sum(f * greatest(change, 0)), 0) AS gain, coalesce(sum(f * greatest(-change, 0)), 0) AS loss
  FROM (SELECT *, CASE WHEN i = 0 THEN NULL WHEN i <= 14 THEN power(13.0 / 14, greatest(n - 14, 0)) / 14 ELSE power(13.0 / 14, n - i) / 14 END AS f FROM k) GROUP BY 1, 2)
SELECT company_id, trading_date, round(CASE WHEN n < 14 THEN 50.0 WHEN loss = 0 THEN CASE WHEN gain = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + gain / loss) END, 4) AS rsi14 FROM g"""


@query("W3_wilder_rsi_all", RSI)
@query("W3_wilder_rsi", RSI)
def wilder_rsi(spark, sf_dir):
    """Every bar of every company."""
    return rounded(w.wilder_rsi(a.bars(spark, sf_dir)).withColumnRenamed("rsi", "rsi14"), "rsi14")


@query("W4_year_range", f"""WITH {BARS} SELECT company_id, trading_date, round(max(high) OVER {over(252)}, 6) AS high_252, round(min(low) OVER {over(252)}, 6) AS low_252,
  round((close - max(close) OVER {over(250)}) / max(close) OVER {over(250)} * 100, 6) AS dist_high FROM bars""")
def year_range(spark, sf_dir):
    out = w.extremes(w.extremes(a.bars(spark, sf_dir), w.YEAR_BARS, high_252=("max", "high"), low_252=("min", "low")), w.YEAR_CLOSES, top=("max", "close"))
    return rounded(out.withColumn("dist_high", w.pct_from(F.col("top"))), "high_252", "low_252", "dist_high", digits=6)


@query("W5_volume_ratios", f"""WITH {BARS} SELECT company_id, trading_date, round(avg(volume) OVER {over(20)} / avg(volume) OVER {over(50)}, 10) AS acceleration,
  round(volume / avg(volume) OVER {over(20, 1)}, 10) AS rvol, round(avg(volume) OVER {over(5)} / avg(volume) OVER {over(40)}, 10) AS dry_up FROM bars""")
def volume_ratios(spark, sf_dir):
    x = w.indicators(a.bars(spark, sf_dir))
    x = x.withColumns({"acceleration": F.col("vol20") / F.col("vol50"), "rvol": F.col("volume") / F.col("vol20_before"), "dry_up": F.col("vol5") / F.col("vol40")})
    return rounded(x, "acceleration", "rvol", "dry_up", digits=10)


AVERAGES = f"""avgs AS (SELECT *, row_number() OVER ({W}) AS n, avg(close) OVER {over(50)} AS a50, avg(close) OVER {over(150)} AS a150, avg(close) OVER {over(200)} AS a200,
  max(close) OVER {over(250)} AS hi, min(close) OVER {over(250)} AS lo FROM bars), known AS (SELECT *, CASE WHEN n >= 50 THEN a50 END AS s50,
  CASE WHEN n >= 150 THEN a150 END AS s150, CASE WHEN n >= 200 THEN a200 END AS s200 FROM avgs), sloped AS (SELECT *, lag(s200, 20) OVER ({W}) AS before FROM known)"""


@query("W6_sma200_slope", f"""WITH {BARS}, {AVERAGES} SELECT company_id, trading_date,
  CASE WHEN n >= 220 THEN s200 > before WHEN n >= 200 THEN close > s200 ELSE false END AS rising FROM sloped""")
def sma200_slope(spark, sf_dir):
    x = w.indicators(a.bars(spark, sf_dir))
    rising = F.when(F.col("n") >= 220, F.col("sma200") > F.col("sma200_before")).when(F.col("n") >= 200, F.col("close") > F.col("sma200")).otherwise(False)
    return x.select(*KEY, rising.alias("rising"))


MANSFIELD = f"""{MARKET}, rs AS (SELECT b.company_id, b.trading_date, b.close / m.close AS rs FROM bars b JOIN market m USING (trading_date)),
  mansfield AS (SELECT *, CASE WHEN row_number() OVER ({W}) >= 50 THEN (rs / avg(rs) OVER {over(50)} - 1) * 100 END AS score FROM rs)"""


@query("W7_mansfield", f"""WITH {BARS}, {MANSFIELD} SELECT company_id, trading_date, round(score, 4) AS score,
  CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score > 10 THEN 'LEADER' WHEN score > 0 THEN 'OUTPERFORMER' WHEN score > -5 THEN 'IN_LINE' ELSE 'LAGGARD' END AS status
  FROM mansfield""")
def mansfield(spark, sf_dir):
    return paths.mansfield(a.bars(spark, sf_dir)).select(*KEY, F.round("score", 4).alias("score"), "status")


VCP = f"""vcp AS (SELECT *, row_number() OVER ({W}) AS n,
  (max(high) OVER {over(10)} - min(low) OVER {over(10)}) / nullif(max(high) OVER {over(30, 10)} - min(low) OVER {over(30, 10)}, 0) AS squeeze,
  avg(volume) OVER {over(5)} / avg(volume) OVER {over(40)} AS dry FROM bars)"""


@query("W8_contraction", f"""WITH {BARS}, {VCP} SELECT company_id, trading_date, round(squeeze, 4) AS squeeze, round(dry, 4) AS dry_up,
  n >= 40 AND round(coalesce(squeeze, 1), 2) <= 0.60 AND round(dry, 2) <= 0.70 AS contracted FROM vcp WHERE n >= 40""")
def contraction(spark, sf_dir):
    x = paths.contraction(w.indicators(a.bars(spark, sf_dir))).where("n >= 40")
    return x.select(*KEY, F.round("squeeze", 4).alias("squeeze"), F.round("dry_up", 4).alias("dry_up"), "contracted")


@query("W9_atr_contraction_all", f"""WITH {BARS}, {TR}, ratios AS (SELECT *, avg(true_range) OVER {over(10)} / nullif(avg(true_range) OVER {over(30)}, 0) AS ratio FROM ranged)
SELECT s.company_id, s.trading_date, round(s.ratio, 4) AS ratio, CASE WHEN s.n < 45 OR count(h.ratio) = 0 THEN 50.0 ELSE round(count(*) FILTER (h.ratio <= round(s.ratio, 2)) * 100.0 / count(h.ratio), 9) END AS percentile
FROM ratios s LEFT JOIN ratios h ON h.company_id = s.company_id AND h.n >= 30 AND h.n < s.n AND h.n % 3 = 0 GROUP BY s.company_id, s.trading_date, s.n, s.ratio""")
def atr_contraction_all(spark, sf_dir):
    """Every bar of every company; 50 for the first 44."""
    return _contraction(spark, sf_dir)


query("W9_atr_contraction", SQL["W9_atr_contraction_all"])(atr_contraction_all)


def _contraction(spark, sf_dir):
    x = w.indicators(a.bars(spark, sf_dir)).withColumn("ratio", F.col("atr10") / F.when(F.col("atr30") != 0, F.col("atr30")))
    x = paths.contraction_percentile(x)
    return x.select(*KEY, F.round("ratio", 4).alias("ratio"), F.round("percentile", 9).alias("percentile"))


@query("W10_accumulation", f"""WITH {BARS}, m AS (SELECT *, lag(close) OVER ({W}) AS pc, avg(volume) OVER {over(40)} AS v40, row_number() OVER ({W}) AS n FROM bars)
SELECT a.company_id, a.trading_date, sum(b.volume) FILTER (b.close >= b.pc) AS up_volume, sum(b.volume) FILTER (b.close < b.pc) AS down_volume,
  count(*) FILTER (b.close >= b.pc) AS up_days, count(*) FILTER (b.close < b.pc AND b.volume > 1.3 * a.v40) AS distribution_days
FROM m a JOIN m b ON b.company_id = a.company_id AND b.n BETWEEN a.n - 18 AND a.n AND b.pc IS NOT NULL GROUP BY ALL""")
def accumulation(spark, sf_dir):
    x = paths.accumulation(w.indicators(a.bars(spark, sf_dir))).where("n > 1")
    return x.select(*KEY, "up_volume", "down_volume", "up_days", "distribution_days")


@query("W11_close_location", f"""WITH {BARS} SELECT company_id, trading_date, round(avg((close - low) / greatest(0.01, high - low)) OVER {over(5)} * 100, 4) AS location FROM bars""")
def close_location(spark, sf_dir):
    place = (F.col("close") - F.col("low")) / F.greatest(F.lit(0.01), F.col("high") - F.col("low"))
    return rounded(a.bars(spark, sf_dir).withColumn("location", F.avg(place).over(w.last_bars(5)) * 100), "location")


START = f"""numbered AS (SELECT *, row_number() OVER ({W}) AS n FROM bars), anchors AS (SELECT company_id, min(trading_date) AS t0 FROM bars GROUP BY company_id, year(trading_date)),
  forward AS (SELECT k.company_id, k.t0, b.trading_date, b.close AS p, row_number() OVER (PARTITION BY k.company_id, k.t0 ORDER BY b.trading_date) - 1 AS i
  FROM anchors k JOIN bars b ON b.company_id = k.company_id AND b.trading_date >= k.t0),
  pathed AS (SELECT *, first(p) OVER (PARTITION BY company_id, t0 ORDER BY i) AS p0, max(p) OVER (PARTITION BY company_id, t0 ORDER BY i) AS peak FROM forward)"""


@query("W12_drawdown", f"""WITH {BARS}, {START} SELECT company_id, t0, round(min((p - peak) / peak) * 100, 4) AS max_drawdown, round(max(p / p0 - 1) * 100, 4) AS max_run,
  count(*) AS bars FROM pathed GROUP BY company_id, t0""")
def drawdown(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    out = paths.outcomes(bars, paths.year_anchors(bars))
    return out.select("company_id", "t0", F.round("max_drawdown", 4).alias("max_drawdown"), F.round("max_run", 4).alias("max_run"), "bars")


@query("W13_offset_prices", f"""WITH {BARS} SELECT company_id, trading_date, {', '.join(f"round(lead(close, {k}) OVER ({W}) / close - 1, 6) AS r{k}" for k in (1, 5, 20, 60, 120, 252, 504, 756))} FROM bars""")
def offset_prices(spark, sf_dir):
    ahead = (1, 5, 20, 60, 120, 252, 504, 756)
    out = a.bars(spark, sf_dir).withColumns({f"r{k}": F.lead("close", k).over(w.sessions()) / F.col("close") - 1 for k in ahead})
    return rounded(out, *(f"r{k}" for k in ahead), digits=6)


_MILESTONES = {"up": 1.2, "2x": 2, "5x": 5, "10x": 10}


@query("W14_first_passage", f"""WITH {BARS}, {START} SELECT company_id, t0, {', '.join(f"min(i) FILTER (p >= {m} * p0) AS bar_{n}, min(trading_date) FILTER (p >= {m} * p0) AS date_{n}, round(arg_min(p, i) FILTER (p >= {m} * p0), 6) AS price_{n}" for n, m in _MILESTONES.items())},
  min((p - peak) / peak) <= -0.5 AND count(*) FILTER (p >= 2 * p0) = 0 AS failed FROM pathed GROUP BY company_id, t0""")
def first_passage(spark, sf_dir):
    """First bar, date and price at 1.2, 2, 5 and 10 times the start price; failed: fell by half and never doubled."""
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars))
    return o.select("company_id", "t0", *(c for n in _MILESTONES for c in (f"bar_{n}", f"date_{n}", F.round(f"price_{n}", 6).alias(f"price_{n}"))), "failed")


@query("W15_low_before_milestone", f"""WITH {BARS}, {START}, hit AS (SELECT company_id, t0, min(i) FILTER (p / p0 >= 1.2) AS hit_at FROM pathed GROUP BY company_id, t0)
SELECT company_id, t0, round(min(p) FILTER (i < hit_at), 6) AS low_before FROM pathed JOIN hit USING (company_id, t0) GROUP BY company_id, t0""")
def low_before_milestone(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    return paths.low_before(bars, paths.year_anchors(bars), 1.2).select("company_id", "t0", F.round("low_before", 6).alias("low_before"))


@query("W16_path_vector", f"""WITH {BARS}, {START} SELECT company_id, t0, count(*) AS bars, round(sum(p * (i + 1)), 3) AS weighted FROM forward WHERE i < 253 GROUP BY company_id, t0""")
def path_vector(spark, sf_dir):
    """The vector itself is an array; the query reports its length and its sum weighted by position."""
    bars = a.bars(spark, sf_dir)
    out = paths.path_vectors(bars, paths.year_anchors(bars), 253)
    weighted = F.aggregate(F.zip_with("path", F.sequence(F.lit(1), F.size("path")), lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)
    return out.select("company_id", "t0", F.size("path").cast("long").alias("bars"), F.round(weighted, 3).alias("weighted"))


@query("W17_wealth", f"""WITH {BARS}, pays AS (SELECT *, CASE WHEN month(trading_date) <> month(lag(trading_date) OVER ({W})) THEN close * 0.01 ELSE 0 END AS dividend FROM bars)
SELECT company_id, trading_date, round(1000 / first(close) OVER ({W}) * exp(sum(ln(1 + dividend / close)) OVER ({W})) * close, 3) AS reinvested,
  round(1000 / first(close) OVER ({W}) * (close + sum(dividend) OVER ({W})), 3) AS cash FROM pays""")
def wealth(spark, sf_dir):
    """A dividend of 1 % of the close on the first session of every month but the first."""
    bars = a.bars(spark, sf_dir)
    new_month = F.month("trading_date") != F.month(F.lag("trading_date").over(w.sessions()))
    out = paths.wealth(bars.withColumn("dividend", F.when(new_month, F.col("close") * 0.01).otherwise(0.0)), 1000.0)
    return rounded(out, "reinvested", "cash", digits=3)


@query("W18_reverse_factor", f"""WITH {BARS}, {ACTIONS} SELECT company_id, ex_date, power(0.5, count(*) OVER (PARTITION BY company_id ORDER BY ex_date DESC)) AS factor FROM actions""")
def reverse_factor(spark, sf_dir):
    return paths.reverse_factors(a.actions(a.bars(spark, sf_dir))).select("company_id", "ex_date", "factor")


@query("W26_delivery_velocity", f"""WITH {BARS}, {DELIVERY}, s AS (SELECT trading_date, dense_rank() OVER (ORDER BY trading_date) AS session FROM (SELECT DISTINCT trading_date FROM delivery)),
 d AS (SELECT * FROM delivery JOIN s USING (trading_date)), v AS (SELECT company_id, trading_date, session, delivery_pct,
  count(*) OVER k AS present, first(delivery_pct) OVER k AS pct0, first(session) OVER k AS s0 FROM d WINDOW k AS (PARTITION BY company_id ORDER BY session RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT company_id, trading_date, present, round(CASE WHEN session > s0 THEN (delivery_pct - pct0) / (session - s0) END, 4) AS velocity FROM v""")
def delivery_velocity(spark, sf_dir):
    out = paths.delivery_velocity(a.delivery(spark, sf_dir))
    return out.select(*KEY, "present", F.round("velocity", 4).alias("velocity"))


@query("W27_keep_latest", f"""WITH {BARS} SELECT company_id, max(trading_date) AS trading_date, arg_max(close, trading_date) AS close FROM bars GROUP BY company_id""")
def keep_latest(spark, sf_dir):
    last = Window.partitionBy("company_id").orderBy(F.col("trading_date").desc())
    return a.bars(spark, sf_dir).withColumn("r", F.row_number().over(last)).where("r = 1").select(*KEY, "close")


@query("W29_expansion", f"""WITH {BARS}, {TR} SELECT company_id, trading_date, round((high - low) / avg(true_range) OVER {over(20)}, 4) AS expansion,
  round(close / ((high + low + close) / 3) - 1, 6) + 0.0 AS vwap_gap, round(min(low) OVER {over(20)}, 6) AS support FROM ranged""")
def expansion(spark, sf_dir):
    x = w.indicators(a.bars(spark, sf_dir))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return x.select(*KEY, F.round((F.col("high") - F.col("low")) / F.col("atr20"), 4).alias("expansion"), (F.round(F.col("close") / typical - 1, 6) + 0.0).alias("vwap_gap"), F.round("low20", 6).alias("support"))


STAGE = """staged AS (SELECT *, CASE WHEN n >= 220 THEN s200 > before ELSE close > s200 END AS rising, round((close - lo) / lo * 100, 1) AS dl, round((close - hi) / hi * 100, 1) AS dh FROM sloped),
  stages AS (SELECT *, CASE WHEN s200 IS NOT NULL THEN CASE WHEN close > s50 AND s50 > s150 AND s150 > s200 AND rising AND dl >= 25 AND dh >= -25 THEN 'STAGE_2_UPTREND'
    WHEN close < s50 AND (s150 < s200 OR close < s200) THEN 'STAGE_4_DECLINE' WHEN close > s200 AND NOT (close > s50 AND s50 > s150 AND s150 > s200) THEN 'STAGE_1_ACCUMULATION'
    ELSE 'STAGE_3_TOPPING' END WHEN close > s50 THEN 'STAGE_2_EMERGING' ELSE 'UNCERTAIN_STRUCTURE' END AS stage FROM staged)"""


@query("W32_stage", f"""WITH {BARS}, {AVERAGES}, {STAGE} SELECT company_id, trading_date, stage FROM stages""")
def stage(spark, sf_dir):
    return w.stage(w.indicators(a.bars(spark, sf_dir))).select(*KEY, "stage")


TEMPLATE = """template AS (SELECT *, (CASE WHEN s200 IS NOT NULL THEN close > s150 AND close > s200 ELSE coalesce(close > s50, false) END)::INT + (s200 IS NULL OR s150 > s200)::INT
  + (CASE WHEN n >= 220 THEN s200 > before WHEN s200 IS NOT NULL THEN close > s200 ELSE false END)::INT
  + (CASE WHEN s200 IS NOT NULL THEN s50 > s150 AND s50 > s200 ELSE coalesce(close > s50, false) END)::INT + coalesce(close > s50, true)::INT
  + ((close - lo) / lo * 100 >= 25)::INT + ((close - hi) / hi * 100 >= -25)::INT AS criteria FROM sloped)"""


@query("W33_trend_template", f"""WITH {BARS}, {AVERAGES}, {TEMPLATE} SELECT company_id, trading_date, criteria, criteria >= 5 AS template_passed FROM template""")
def trend_template(spark, sf_dir):
    return w.trend_template(w.indicators(a.bars(spark, sf_dir))).select(*KEY, "criteria", "template_passed")


@query("W34_wick_trap", f"""WITH {BARS}, k AS (SELECT *, row_number() OVER ({W}) AS n, max(high) OVER {over(20)} AS pivot FROM bars)
SELECT a.company_id, a.trading_date, bool_or(b.high >= a.pivot * 0.992 AND (b.high - b.close) / greatest(0.01, b.high - b.low) >= 0.35
  AND (b.close - b.low) / greatest(0.01, b.high - b.low) < 0.5) AS trapped,
  round(max(CASE WHEN b.high >= a.pivot * 0.992 THEN (b.high - b.close) / greatest(0.01, b.high - b.low) ELSE 0 END), 4) AS wick
FROM k a JOIN k b ON a.company_id = b.company_id AND b.n BETWEEN a.n - 2 AND a.n GROUP BY ALL""")
def wick_trap(spark, sf_dir):
    x = paths.wick_trap(w.indicators(a.bars(spark, sf_dir)), F.col("high20"))
    return x.select(*KEY, "trapped", F.round("wick", 4).alias("wick"))


@query("W35_percentile_all", f"""WITH {BARS} SELECT a.company_id, a.trading_date, round(count(*) FILTER (b.close < a.close) * 1.0 / greatest(count(*) - 1, 1), 9) AS percentile
FROM bars a JOIN bars b ON a.company_id = b.company_id AND b.trading_date BETWEEN a.trading_date - 1095 AND a.trading_date GROUP BY a.company_id, a.trading_date""")
def percentile_all(spark, sf_dir):
    """Every session of every company."""
    return paths.trailing_percentile(a.bars(spark, sf_dir), F.lit(True), 1095).select(*KEY, F.round("percentile", 9).alias("percentile"))


query("W35_percentile", SQL["W35_percentile_all"])(percentile_all)


YOY = f"""{FILINGS}, q AS (SELECT * FROM filings WHERE vintage = 0), yoy AS (SELECT c.company_id, c.period_end, c.revenue, p.revenue AS prior,
  (c.revenue / nullif(p.revenue, 0) - 1) * 100 AS growth FROM q c LEFT JOIN q p ON p.company_id = c.company_id AND year(p.period_end) = year(c.period_end) - 1
  AND month(p.period_end) = month(c.period_end))"""


@query("W20_earnings_acceleration", f"""WITH {YOY} SELECT company_id, period_end, round(growth, 4) AS growth,
  round(growth - lag(growth) OVER (PARTITION BY company_id ORDER BY period_end), 4) AS acceleration FROM yoy""")
def earnings_acceleration(spark, sf_dir):
    from ..operators import pit

    x = pit.year_over_year(a.filings(spark, sf_dir).where("vintage = 0"))
    quarters = Window.partitionBy("company_id").orderBy("period_end")
    return x.select("company_id", "period_end", F.round("growth", 4).alias("growth"), F.round(F.col("growth") - F.lag("growth").over(quarters), 4).alias("acceleration"))


@query("W21_second_derivative", f"""WITH {YOY}, k AS (SELECT *, count(growth) OVER o AS known, lag(growth, 1) OVER o AS g1, lag(growth, 2) OVER o AS g2 FROM yoy WINDOW o AS (PARTITION BY company_id ORDER BY period_end))
SELECT company_id, period_end, CASE WHEN known >= 6 THEN 'YOY' WHEN known = 5 THEN 'HYBRID' WHEN known >= 3 THEN 'SEQUENTIAL' ELSE 'NONE' END AS method,
  round(CASE WHEN known >= 3 THEN growth - 2 * g1 + g2 END, 4) AS second FROM k""")
def second_derivative(spark, sf_dir):
    from ..operators import pit

    x = pit.year_over_year(a.filings(spark, sf_dir).where("vintage = 0"))
    q = Window.partitionBy("company_id").orderBy("period_end")
    known = F.count("growth").over(q.rowsBetween(Window.unboundedPreceding, 0))
    second = F.col("growth") - 2 * F.lag("growth", 1).over(q) + F.lag("growth", 2).over(q)
    x = x.withColumn("known", known).withColumn("second", F.when(F.col("known") >= 3, second))
    method = F.when(F.col("known") >= 6, "YOY").when(F.col("known") == 5, "HYBRID").when(F.col("known") >= 3, "SEQUENTIAL").otherwise("NONE")
    return x.select("company_id", "period_end", method.alias("method"), F.round("second", 4).alias("second"))


@query("W31_cadence", f"""WITH {FILINGS}, q AS (SELECT DISTINCT company_id, period_end FROM filings), g AS (SELECT company_id, period_end - lag(period_end) OVER (PARTITION BY company_id ORDER BY period_end) AS gap, period_end FROM q)
SELECT company_id, arg_max(gap, period_end) AS last_gap, arg_max(gap, period_end) > 130 AS semi_annual FROM g GROUP BY company_id""")
def cadence(spark, sf_dir):
    from ..operators import pit

    return pit.cadence(a.filings(spark, sf_dir)).select("company_id", F.col("last_gap").cast("long").alias("last_gap"), "semi_annual")


@query("W30_scd2", f"""WITH {FILINGS}, v AS (SELECT *, lag(revenue) OVER k AS prior FROM filings WINDOW k AS (PARTITION BY company_id, period_end ORDER BY published)),
 changed AS (SELECT * FROM v WHERE prior IS NULL OR abs(revenue - prior) >= 0.01)
SELECT company_id, period_end, published AS rec_start, coalesce(lead(published) OVER (PARTITION BY company_id, period_end ORDER BY published), DATE '9999-12-31') AS rec_end,
  round(revenue, 2) AS revenue FROM changed""")
def scd2(spark, sf_dir):
    from ..operators import pit

    out = pit.scd2(a.filings(spark, sf_dir), ["company_id", "period_end"], "published", ["revenue"])
    return out.select("company_id", "period_end", "rec_start", "rec_end", F.round("revenue", 2).alias("revenue"))


@query("near_high_screen", f"""WITH {BARS}, {TR}, {AVERAGES}, joined AS (SELECT s.*, avg(true_range) OVER (PARTITION BY s.company_id ORDER BY s.trading_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr14
  FROM sloped s JOIN ranged r USING (company_id, trading_date)), latest AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY trading_date DESC) = 1)
SELECT company_id, trading_date, round(close, 4) AS close, round((close - hi) / hi * 100, 4) AS dist_high, round(atr14, 4) AS atr14 FROM latest
WHERE close > s50 ORDER BY (close - hi) / hi DESC, company_id LIMIT 20""")
def near_high_screen(spark, sf_dir):
    """The 20 companies nearest their yearly high in an uptrend, on their last session; the limit is the feature."""
    x = w.indicators(a.bars(spark, sf_dir))
    last = Window.partitionBy("company_id").orderBy(F.col("trading_date").desc())
    x = x.withColumn("dist", w.pct_from(F.col("high_52w"))).withColumn("r", F.row_number().over(last)).where("r = 1 AND close > sma50")
    top = x.orderBy(F.col("dist").desc(), "company_id").limit(20)
    return top.select(*KEY, F.round("close", 4).alias("close"), F.round("dist", 4).alias("dist_high"), F.round("atr14", 4).alias("atr14"))


@query("W36_wilder_history", f"""WITH RECURSIVE {BARS}, {TR}, seq AS (SELECT company_id, trading_date, n, true_range AS tr, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, avg(true_range) OVER {over(14)} AS simple FROM ranged),
 w AS (SELECT company_id, 15::BIGINT AS n, avg(tr) AS atr, avg(gain) AS up, avg(loss) AS down FROM seq WHERE n BETWEEN 2 AND 15 GROUP BY company_id HAVING count(*) = 14
  UNION ALL SELECT w.company_id, s.n, (w.atr * 13 + s.tr) / 14, (w.up * 13 + s.gain) / 14, (w.down * 13 + s.loss) / 14 FROM w JOIN seq s ON s.company_id = w.company_id AND s.n = w.n + 1)
SELECT company_id, trading_date, round(atr, 4) AS atr, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi, round((simple - atr) / atr * 100, 3) AS simple_delta_pct FROM w JOIN seq USING (company_id, n)""")
def wilder_history(spark, sf_dir):
    """Wilder's range and strength over whole histories, and by how much the simple 14-bar mean range differs; bars behind the seed."""
    bars = a.bars(spark, sf_dir)
    x = recurrence.whole_history(bars).where("atr IS NOT NULL")
    simple = bars.withColumn("true_range", w.true_range()).withColumn("simple", w.atr(14)).select(*KEY, "simple")
    x = x.join(simple, list(KEY)).withColumn("simple_delta_pct", (F.col("simple") - F.col("atr")) / F.col("atr") * 100)
    return x.select(*KEY, F.round("atr", 4).alias("atr"), F.round("rsi", 4).alias("rsi"), F.round("simple_delta_pct", 3).alias("simple_delta_pct"))
