"""Queries over setups, trades and their statistics (A operators, M12, M27 to M29, J20)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import calibration as cal
from ..operators import joins as j
from ..operators import paths, setups
from ..operators import windows as w
from ..sources import adapters as a
from .bar_windows import START
from .registry import query
from .setup_sql import AUDIT, CANDIDATES, TRADES, walk
from .views import BARS, LINES, MARKET, W


def audited(spark, sf_dir):
    bars = a.calm_bars(spark, sf_dir)
    return setups.audit(paths.accumulation(w.indicators(bars)).join(setups.market_regime(a.benchmark_bars(bars)), "trading_date"))


def labelled(spark, sf_dir, optimistic=False):
    x = audited(spark, sf_dir)
    bars = a.calm_bars(spark, sf_dir).withColumn("n", F.row_number().over(w.sessions()))
    return setups.label(setups.candidates(x), bars, optimistic)


def trades(spark, sf_dir):
    return setups.take(labelled(spark, sf_dir))


def rounds(x, *columns, digits=4):
    return [F.round(c, digits).alias(c) for c in columns]


@query("M12_swing_audit", f"""WITH {AUDIT} SELECT company_id, trading_date, setup, quality, status, pivot_ AS pivot, stop, t1, t2, risk_pct, reward, readiness FROM audited WHERE rn > 30""")
def swing_audit(spark, sf_dir):
    return audited(spark, sf_dir).where("n > 30").select("company_id", "trading_date", "setup", "quality", "status", "pivot", "stop", "t1", "t2", "risk_pct", "reward", "readiness")


@query("M28_candidates", f"WITH {AUDIT}, {CANDIDATES} SELECT company_id, t0, entry_n, round(entry, 4) AS entry, stop, t1, setup FROM entries")
def candidates(spark, sf_dir):
    return setups.candidates(audited(spark, sf_dir)).select("company_id", "t0", F.col("entry_n").cast("long").alias("entry_n"), F.round("entry", 4).alias("entry"), "stop", "t1", "setup")


LABELS = "SELECT company_id, t0, result AS outcome, days, round(exit, 6) AS exit, both_ AS ambiguous, hit AS hit_t1, round(mfe, 4) AS mfe, round(mae, 4) AS mae, round(r, 6) AS r FROM labelled"


def _labels(x):
    return x.select("company_id", "t0", "outcome", F.col("days").cast("long").alias("days"), F.round("exit", 6).alias("exit"), "ambiguous", "hit_t1", *rounds(x, "mfe", "mae"), F.round("r", 6).alias("r"))


@query("M27_barrier_labels", f"WITH RECURSIVE {AUDIT}, {CANDIDATES}, {walk(False)} {LABELS}")
def barrier_labels(spark, sf_dir):
    return _labels(labelled(spark, sf_dir))


@query("M27_barrier_labels_optimistic", f"WITH RECURSIVE {AUDIT}, {CANDIDATES}, {walk(True)} {LABELS}")
def barrier_labels_optimistic(spark, sf_dir):
    return _labels(labelled(spark, sf_dir, True))


@query("M29_universe_replay", f"WITH RECURSIVE {TRADES} SELECT company_id, t0, setup, result AS outcome, round(r, 6) AS r FROM trades")
def universe_replay(spark, sf_dir):
    return trades(spark, sf_dir).select("company_id", "t0", "setup", "outcome", F.round("r", 6).alias("r"))


METRICS = """count(*) AS n, count(*) FILTER (hit) AS wins, avg(hit::INT) * 100 AS win_rate, avg((contains(result, 'STOPPED_OUT'))::INT) * 100 AS stop_rate,
  sum(greatest(pnl_pct, 0)) / greatest(0.1, abs(sum(least(pnl_pct, 0)))) AS profit_factor, avg(r) AS mean_r, avg(mfe) AS mfe, avg(mae) AS mae"""
WILSON_LOW = "greatest((wins / n::DOUBLE + power(1.95996, 2) / (2 * n) - 1.95996 * sqrt((wins / n::DOUBLE) * (1 - wins / n::DOUBLE) / n + power(1.95996, 2) / (4.0 * n * n))) / (1 + power(1.95996, 2) / n), 0) * 100"
SHOWN = ("win_rate", "stop_rate", "profit_factor", "mean_r", "mfe", "mae")
SHOWN_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SHOWN)


@query("A2_trade_metrics", f"WITH RECURSIVE {TRADES}, m AS (SELECT setup, {METRICS} FROM trades GROUP BY setup) SELECT setup, n, wins, {SHOWN_SQL} FROM m")
def trade_metrics(spark, sf_dir):
    x = trades(spark, sf_dir).groupBy("setup").agg(*cal.trade_metrics())
    return x.select("setup", "n", "wins", *rounds(x, *SHOWN, digits=6))


@query("A3_hierarchy", f"""WITH RECURSIVE {TRADES}, m AS (SELECT setup, quality, regime, grouping_id(setup, quality, regime) AS level, {METRICS} FROM trades GROUP BY GROUPING SETS ((setup), (setup, quality), (setup, quality, regime)))
SELECT setup, quality, regime, n, wins, round(mean_r, 6) AS mean_r FROM m WHERE n >= CASE level WHEN 3 THEN 3 WHEN 1 THEN 4 ELSE 5 END""")
def hierarchy(spark, sf_dir):
    return cal.hierarchy(trades(spark, sf_dir)).select("setup", "quality", "regime", "n", "wins", F.round("mean_r", 6).alias("mean_r"))


@query("A4_marginals", f"""WITH RECURSIVE {TRADES}, b AS (SELECT *, CASE WHEN readiness >= 85 THEN '85+' WHEN readiness >= 75 THEN '75-84' WHEN readiness >= 65 THEN '65-74' WHEN readiness >= 55 THEN '55-64' ELSE '<55' END AS bin FROM trades)
SELECT bin, setup, quality, count(*) AS n, round(avg(r), 6) AS mean_r FROM b GROUP BY GROUPING SETS ((bin), (setup), (quality))""")
def marginals(spark, sf_dir):
    x = trades(spark, sf_dir).withColumn("bin", f.readiness_bin(F.col("readiness")))
    return x.groupingSets([["bin"], ["setup"], ["quality"]], "bin", "setup", "quality").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_r"))


@query("A5_wilson", f"""WITH RECURSIVE {TRADES}, m AS (SELECT regime, {METRICS} FROM trades GROUP BY regime) SELECT regime, n, round({WILSON_LOW}, 4) AS wilson_low, CASE WHEN n >= 400 THEN 'ROBUST' WHEN n >= 150 THEN 'SOLID' WHEN n >= 20 THEN 'EARLY' ELSE 'INSUFFICIENT' END AS tier FROM m""")
def wilson(spark, sf_dir):
    x = cal.with_derived(trades(spark, sf_dir).groupBy("regime").agg(*cal.trade_metrics()), F.lit(0.0))
    return x.select("regime", "n", F.round("wilson_low", 4).alias("wilson_low"), "tier")


@query("A7_brier", """WITH p AS (SELECT quality AS y, least(n_chars / 5000.0, 1.0) AS p FROM labels JOIN documents USING (doc_id)), m AS (SELECT count(*) AS n, avg(power(p - y, 2)) AS brier, avg(y) AS base FROM p)
SELECT n, round(brier, 8) AS brier, round(base * (1 - base), 8) AS base_brier, round((1 - brier / (base * (1 - base))) * 100, 6) AS skill_pct FROM m""")
def brier(spark, sf_dir):
    x = cal.brier(predictions(spark, sf_dir))
    return x.select("n", F.round("brier", 8).alias("brier"), F.round("base_brier", 8).alias("base_brier"), F.round("skill_pct", 6).alias("skill_pct"))


def predictions(spark, sf_dir):
    labels, docs = a.table(spark, sf_dir, "labels"), a.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"))


@query("A8_reliability", """WITH p AS (SELECT quality AS y, least(n_chars / 5000.0, 1.0) AS p FROM labels JOIN documents USING (doc_id))
SELECT CAST(least(floor(p * 10), 9) AS INT) AS bucket, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS frequency FROM p GROUP BY 1""")
def reliability(spark, sf_dir):
    x = cal.reliability(predictions(spark, sf_dir))
    return x.select("bucket", "n", *rounds(x, "mean_p", "frequency", digits=8))


@query("A9_execution_modes", f"""WITH RECURSIVE {AUDIT}, {CANDIDATES}, {walk(False)} SELECT CASE WHEN both_ THEN 'ambiguous' ELSE 'clear' END AS kind, count(*) AS n, round(avg(r), 6) AS mean_r FROM labelled GROUP BY 1""")
def execution_modes(spark, sf_dir):
    x = labelled(spark, sf_dir)
    return x.groupBy(F.when(F.col("ambiguous"), "ambiguous").otherwise("clear").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_r"))


@query("A10_excursions", f"""WITH RECURSIVE {AUDIT}, {CANDIDATES}, {walk(False)}, x AS (SELECT e.company_id, e.signal_n, e.setup, max((b.high - e.entry) / e.entry * 100) FILTER (b.rn <= e.entry_n + 5) AS m5, max((b.high - e.entry) / e.entry * 100) AS m45
  FROM entries e JOIN nb b ON b.company_id = e.company_id AND b.rn BETWEEN e.entry_n + 1 AND e.entry_n + 45 GROUP BY ALL) SELECT setup, count(*) AS n, round(avg(m5), 6) AS mfe_5, round(avg(m45), 6) AS mfe_45 FROM x GROUP BY setup""")
def excursions(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("setup").agg(F.count("*").alias("n"), F.round(F.avg("mfe_5"), 6).alias("mfe_5"), F.round(F.avg("mfe_45"), 6).alias("mfe_45"))


FOLDS = [("fold1", "1997-12-31", "1998-12-31"), ("fold2", "1998-12-31", "1999-12-31"), ("fold3", "1999-12-31", "2000-12-31")]


@query("A12_walk_forward", f"""WITH RECURSIVE {TRADES}, k AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in FOLDS)}) AS t(fold, is_end, oos_end)), x AS (SELECT fold, CASE WHEN t0 <= is_end THEN 'IS' ELSE 'OOS' END AS side, r FROM trades JOIN k ON t0 <= oos_end)
SELECT fold, count(*) FILTER (side = 'IS') AS is_n, count(*) FILTER (side = 'OOS') AS oos_n, round(avg(r) FILTER (side = 'IS'), 6) AS is_r, round(avg(r) FILTER (side = 'OOS'), 6) AS oos_r,
  round(CASE WHEN avg(r) FILTER (side = 'IS') > 0 THEN avg(r) FILTER (side = 'OOS') / avg(r) FILTER (side = 'IS') END, 4) AS kept FROM x GROUP BY fold""")
def walk_forward(spark, sf_dir):
    folds = spark.createDataFrame(FOLDS, "fold string, is_end string, oos_end string")
    x = trades(spark, sf_dir).join(F.broadcast(folds), F.col("t0") <= F.to_date("oos_end"))
    inside = F.col("t0") <= F.to_date("is_end")
    out = x.groupBy("fold").agg(F.count_if(inside).alias("is_n"), F.count_if(~inside).alias("oos_n"), F.avg(F.when(inside, F.col("r"))).alias("is_r"), F.avg(F.when(~inside, F.col("r"))).alias("oos_r"))
    out = out.withColumn("kept", F.when(F.col("is_r") > 0, F.col("oos_r") / F.col("is_r")))
    return out.select("fold", "is_n", "oos_n", *rounds(out, "is_r", "oos_r", digits=6), F.round("kept", 4).alias("kept"))


FILTERS = {"baseline": "true", "trend": "readiness >= 60", "quality": "quality = 'HEALTHY_CONTRACTION'", "regime": "regime <> 'BEAR_DEFENSIVE'", "all": "readiness >= 60 AND quality = 'HEALTHY_CONTRACTION' AND regime <> 'BEAR_DEFENSIVE'"}


@query("A13_ablation", f"WITH RECURSIVE {TRADES}, v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, r FROM trades WHERE {v}" for k, v in FILTERS.items()) + """), m AS (SELECT variant, count(*) AS n, avg(r) AS mean_r FROM v GROUP BY variant)
SELECT variant, n, round(mean_r, 6) AS mean_r, round(mean_r - (SELECT mean_r FROM m WHERE variant = 'baseline'), 6) AS delta FROM m""")
def ablation(spark, sf_dir):
    variants = F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in FILTERS.items()))
    x = trades(spark, sf_dir).withColumn("variant", F.explode(F.array_compact(variants))).groupBy("variant").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"))
    base = F.max(F.when(F.col("variant") == "baseline", F.col("mean_r"))).over(Window.partitionBy(F.lit(1)))  # five rows
    return x.select("variant", "n", F.round("mean_r", 6).alias("mean_r"), F.round(F.col("mean_r") - base, 6).alias("delta"))


@query("J20_fallback", f"""WITH RECURSIVE {TRADES}, l3 AS (SELECT setup, quality, regime, count(*) AS n, avg(r) AS v FROM trades GROUP BY ALL), l2 AS (SELECT setup, quality, count(*) AS n, avg(r) AS v FROM trades GROUP BY ALL), l1 AS (SELECT setup, count(*) AS n, avg(r) AS v FROM trades GROUP BY ALL)
SELECT e.company_id, e.t0, round(coalesce(l3.v, l2.v, l1.v, 0.13), 6) AS mean_r, CASE WHEN l3.v IS NOT NULL THEN 'SETUP_QUALITY_REGIME' WHEN l2.v IS NOT NULL THEN 'SETUP_QUALITY' WHEN l1.v IS NOT NULL THEN 'SETUP' ELSE 'PRIOR' END AS level FROM entries e
LEFT JOIN l3 ON l3.setup = e.setup AND l3.quality = e.quality AND l3.regime = e.regime AND l3.n >= 5 LEFT JOIN l2 ON l2.setup = e.setup AND l2.quality = e.quality AND l2.n >= 4 LEFT JOIN l1 ON l1.setup = e.setup AND l1.n >= 3""")
def fallback(spark, sf_dir):
    t = trades(spark, sf_dir)
    keys = [("SETUP_QUALITY_REGIME", ["setup", "quality", "regime"], 5), ("SETUP_QUALITY", ["setup", "quality"], 4), ("SETUP", ["setup"], 3)]
    levels = [(n, t.groupBy(*k).agg(F.count("*").alias("n"), F.avg("r").alias("mean_r")), k, least) for n, k, least in keys]
    out = j.fallback_lookup(setups.candidates(audited(spark, sf_dir)), levels, "mean_r", 0.13)
    return out.select("company_id", "t0", F.round("mean_r", 6).alias("mean_r"), "level")


SHARES = "shares AS (SELECT s_nationkey, s_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query("A17_concentration", f"""WITH {SHARES}, p AS (SELECT *, v / sum(v) OVER (PARTITION BY s_nationkey) * 100 AS share, row_number() OVER (PARTITION BY s_nationkey ORDER BY v DESC) AS k FROM shares), m AS (SELECT s_nationkey, sum(share * share) AS hhi, sum(share) FILTER (k <= 3) AS cr3, count(*) AS n FROM p GROUP BY 1)
SELECT s_nationkey, round(hhi, 4) AS hhi, round(cr3, 4) AS cr3, n, CASE WHEN hhi >= 2500 THEN 'CONCENTRATED' WHEN hhi >= 1500 THEN 'MODERATE' ELSE 'FRAGMENTED' END AS regime FROM m""")
def concentration(spark, sf_dir):
    li, su = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "supplier")
    shares = li.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v")).join(su, F.col("l_suppkey") == su.s_suppkey)
    x = cal.concentration(shares, "s_nationkey", "v")
    return x.select("s_nationkey", *rounds(x, "hhi", "cr3"), "n", "regime")


@query("A18_pricing_power", """WITH m AS (SELECT l_suppkey, avg(l_discount) AS mean, stddev_samp(l_discount) AS sd, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n, round(mean, 8) AS mean, round(sd / nullif(mean, 0), 6) AS cv FROM m WHERE n >= 3""")
def pricing_power(spark, sf_dir):
    m = a.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("sd"), F.count("*").alias("n")).where("n >= 3")
    return m.select("l_suppkey", "n", F.round("mean", 8).alias("mean"), F.round(F.col("sd") / F.when(F.col("mean") != 0, F.col("mean")), 6).alias("cv"))


@query("A19_breadth", f"""WITH {BARS}, c AS (SELECT *, lag(close) OVER ({W}) AS pc, max(high) OVER (PARTITION BY company_id ORDER BY trading_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi FROM bars)
SELECT trading_date, count(*) FILTER (close > pc) AS advances, count(*) FILTER (close < pc) AS declines, count(*) FILTER (close >= hi) AS new_highs, round(count(*) FILTER (close > pc) * 100.0 / nullif(count(pc), 0), 4) AS advancing_pct FROM c GROUP BY 1""")
def breadth(spark, sf_dir):
    x = a.bars(spark, sf_dir).withColumns({"pc": F.lag("close").over(w.sessions()), "hi": w.year_high()})
    up, known = F.count_if(F.col("close") > F.col("pc")), F.count("pc")
    return x.groupBy("trading_date").agg(
        up.alias("advances"), F.count_if(F.col("close") < F.col("pc")).alias("declines"), F.count_if(F.col("close") >= F.col("hi")).alias("new_highs"), F.round(up * 100 / F.when(known > 0, known), 4).alias("advancing_pct")
    )


@query("A21_sector_rotation", f"""WITH {BARS}, {MARKET}, m AS (SELECT *, close / lag(close, 1) OVER (ORDER BY trading_date) - 1 AS m1, close / lag(close, 30) OVER (ORDER BY trading_date) - 1 AS m30 FROM market),
 c AS (SELECT *, close / lag(close, 1) OVER ({W}) - 1 AS r1, close / lag(close, 30) OVER ({W}) - 1 AS r30 FROM bars) SELECT company_id, trading_date, CASE WHEN r30 > m30 AND r1 > m1 THEN 'LEADING' WHEN r30 > m30 THEN 'WEAKENING' WHEN r1 > m1 THEN 'IMPROVING' ELSE 'LAGGING' END AS quadrant
FROM c JOIN m USING (trading_date) WHERE r30 IS NOT NULL AND m30 IS NOT NULL""")
def sector_rotation(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    days = Window.orderBy("trading_date")  # one row per session
    market = a.benchmark_bars(bars).withColumns({"m1": F.col("close") / F.lag("close", 1).over(days) - 1, "m30": F.col("close") / F.lag("close", 30).over(days) - 1}).drop("close")
    x = bars.withColumns({"r1": F.col("close") / F.lag("close", 1).over(w.sessions()) - 1, "r30": F.col("close") / F.lag("close", 30).over(w.sessions()) - 1}).join(market, "trading_date").where("r30 IS NOT NULL AND m30 IS NOT NULL")
    long, short = F.col("r30") > F.col("m30"), F.col("r1") > F.col("m1")
    return x.select("company_id", "trading_date", F.when(long & short, "LEADING").when(long, "WEAKENING").when(short, "IMPROVING").otherwise("LAGGING").alias("quadrant"))


@query("A22_funnel", """SELECT count(*) AS universe, count(*) FILTER (c_acctbal > 0) AS solvent, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 15) AS in_region, count(*) FILTER (c_acctbal > 5000 AND c_nationkey < 15) AS final FROM customer""")
def funnel(spark, sf_dir):
    """All stages as flags of one pass."""
    c = a.table(spark, sf_dir, "customer")
    stages = {"solvent": "c_acctbal > 0", "in_region": "c_acctbal > 0 AND c_nationkey < 15", "final": "c_acctbal > 5000 AND c_nationkey < 15"}
    return c.agg(F.count("*").alias("universe"), *(F.count_if(F.expr(v)).alias(k) for k, v in stages.items()))


@query("A24_correlations", f"""WITH {BARS}, x AS (SELECT company_id, volume AS a, high / low AS b FROM bars), k AS (SELECT *, rank() OVER (PARTITION BY company_id ORDER BY a) + (count(*) OVER (PARTITION BY company_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY company_id ORDER BY b) + (count(*) OVER (PARTITION BY company_id, b) - 1) / 2.0 AS rb FROM x)
SELECT company_id, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM k GROUP BY 1""")
def correlations(spark, sf_dir):
    x = a.bars(spark, sf_dir).select("company_id", F.col("volume").alias("a"), (F.col("high") / F.col("low")).alias("b"))
    out = cal.rank_correlation(x, "a", "b", "company_id")
    return out.select("company_id", *rounds(out, "pearson", "spearman", digits=6), "n")


@query("A25_missingness", """SELECT lang, count(*) AS n, round(avg((text IS NULL OR length(text) < 50)::INT + (source IS NULL)::INT) / 2 * 100, 6) AS missing_pct FROM documents GROUP BY lang""")
def missingness(spark, sf_dir):
    d = a.table(spark, sf_dir, "documents")
    gaps = (F.col("text").isNull() | (F.length("text") < 50)).cast("int") + F.col("source").isNull().cast("int")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(gaps) / 2 * 100, 6).alias("missing_pct"))


@query("A30_distinct_keys", f"WITH {LINES} SELECT DISTINCT company_id, trading_date FROM lines")
def distinct_keys(spark, sf_dir):
    return a.bars(spark, sf_dir).select("company_id", "trading_date").distinct()


@query("A29_separation", f"""WITH {BARS}, {START}, o AS (SELECT company_id, t0, max(p / p0) >= 1.5 AS winner, first(p0) AS p0 FROM pathed GROUP BY 1, 2), g AS (SELECT o.*, b.volume, b.high / b.low AS span FROM o JOIN bars b ON b.company_id = o.company_id AND b.trading_date = o.t0)
SELECT 'volume' AS feature, round(avg(volume) FILTER (winner), 6) AS winners, round(avg(volume) FILTER (NOT winner), 6) AS others FROM g UNION ALL SELECT 'span', round(avg(span) FILTER (winner), 6), round(avg(span) FILTER (NOT winner), 6) FROM g""")
def separation(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars)).withColumn("winner", F.col("max_run") / 100 + 1 >= 1.5)
    g = o.select("company_id", F.col("t0").alias("trading_date"), "winner").join(bars, ["company_id", "trading_date"]).withColumn("span", F.col("high") / F.col("low"))
    long = g.unpivot(["winner"], ["volume", "span"], "feature", "value")
    return long.groupBy("feature").agg(F.round(F.avg(F.when(F.col("winner"), F.col("value"))), 6).alias("winners"), F.round(F.avg(F.when(~F.col("winner"), F.col("value"))), 6).alias("others"))
