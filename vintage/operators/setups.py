"""Swing setups for every bar at once, and trades that follow from them.

``audit`` derives a setup from the window columns of a bar: geometry, pivot,
stop, targets, actionability and the readiness score. ``candidates`` applies the
entry gates, ``label`` walks at most 45 later bars of a candidate in one fold,
``take`` keeps the candidates that one account could have traded. No step looks
at more than a company's bars, and no Python runs on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import passage
from .windows import sessions, last_bars, pct_from, trend_template

# Fixed values of the entry gates, the walk and the cool-down.
MAX_RISK_PCT, MIN_REWARD, WATCH_BARS = 8.5, 1.7, 3
HORIZON, COOL_DOWN, WARM_UP, LEAST_BARS = 45, 5, 40, 50
HORIZONS = (1, 3, 5, 10, 20, 45)
#: Stop after the first target, as a multiple of the entry.
FREE_ROLL = 1.002


def half_up(x: Column, digits: int) -> Column:
    """Decimal rounding by floor, the same on every engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def market_regime(benchmark: DataFrame) -> DataFrame:
    """``trading_date, regime`` from the benchmark's close and means."""
    one = Window.orderBy("trading_date")  # one row per session
    n = F.row_number().over(one)
    b = benchmark.withColumns({"n": n, "m50": F.avg("close").over(one.rowsBetween(-49, 0)), "m200": F.avg("close").over(one.rowsBetween(-199, 0))})
    long = F.when(F.col("n") >= 200, F.col("m200")).otherwise(F.col("m50"))
    rule = F.when((F.col("close") > F.col("m50")) & (F.col("m50") > long), "BULL_MOMENTUM").when(F.col("close") > long, "BULL_CORRECTION").otherwise("BEAR_DEFENSIVE")
    return b.select("trading_date", F.when(F.col("n") >= 50, rule).otherwise("BULL_MOMENTUM").alias("regime"))


def audit(x: DataFrame) -> DataFrame:
    """Setup columns for bars of :func:`.windows.indicators` that have a column ``regime``."""
    c = F.col
    price, atr = c("close"), F.coalesce("atr10", c("close") * 0.02)
    x = trend_template(x)
    x = x.withColumns({
        "dist50": F.coalesce(half_up(pct_from(c("sma50")), 1), F.lit(0.0)), "dist_high": half_up(pct_from(c("high_52w")), 1),
        "squeeze": F.coalesce(half_up(c("atr10") / F.when(c("atr30") > 0, c("atr30")), 2), F.lit(1.0)), "dry_up": F.coalesce(half_up(c("vol5") / F.when(c("vol40") > 0, c("vol40")), 2), F.lit(1.0)),
        "base_pos": (price - c("low30")) / F.greatest(F.lit(0.1), c("high30") - c("low30")), "holding": c("low5") >= c("low30") * 0.985, "atr": atr,
        "buffer": half_up(F.greatest(atr * 0.12, price * 0.0015), 2),
    })
    healthy = (c("base_pos") >= 0.45) & c("holding") & (c("dist50") >= -2)
    quality = F.when(healthy, "HEALTHY_CONTRACTION").when(~c("holding") | (c("dist50") < -4), "DANGEROUS_CONTRACTION").otherwise("NEUTRAL_CONTRACTION")
    x = x.withColumn("quality", quality)
    near_mean = c("sma50").isNotNull() & c("dist50").between(-2.5, 2.5) & (c("sma50") > F.coalesce("sma200", F.lit(0.0)))
    tight = (c("squeeze") <= 0.75) & (c("dry_up") <= 0.75) & (c("quality") == "HEALTHY_CONTRACTION")
    setup = F.when(tight, "VCP_CONTRACTION_BREAKOUT").when(near_mean, "50EMA_PULLBACK").when(c("dist_high") >= -4, "52W_HIGH_BREAKOUT").otherwise("BASE_CONSOLIDATION")
    x = x.withColumn("setup", setup)

    def by_setup(vcp: Column, pullback: Column, high: Column, base: Column) -> Column:
        return F.when(c("setup") == "VCP_CONTRACTION_BREAKOUT", vcp).when(c("setup") == "50EMA_PULLBACK", pullback).when(c("setup") == "52W_HIGH_BREAKOUT", high).otherwise(base)

    x = x.withColumn("raw_pivot", by_setup(c("high8"), c("high3"), half_up(c("high_52w"), 2), c("high20"))).withColumn("first_pivot", half_up(c("raw_pivot") + c("buffer"), 2))
    recent = F.collect_list(F.struct("high", "low", "close")).over(last_bars(3))

    def spread(b: Column) -> Column:
        return F.greatest(F.lit(0.01), b["high"] - b["low"])

    traps = F.filter("recent", lambda b: (b["high"] >= c("raw_pivot") * 0.992) & ((b["high"] - b["close"]) / spread(b) >= 0.35) & ((b["close"] - b["low"]) / spread(b) < 0.5))
    x = x.withColumn("recent", recent).withColumn("trap_high", F.array_max(F.transform(traps, lambda b: b["high"]))).drop("recent")
    trapped = half_up(F.greatest(c("raw_pivot"), c("trap_high")) + c("buffer"), 2)
    x = x.withColumn("pivot", F.when(c("trap_high").isNotNull(), F.greatest(c("first_pivot"), trapped)).otherwise(c("first_pivot")))
    floor = by_setup(c("low8"), c("low5"), c("low20"), c("low20")) - half_up(0.05 * c("atr"), 2)
    stop = F.least(c("pivot") - half_up(0.5 * c("atr"), 2), F.greatest(floor, c("pivot") - half_up(2.0 * c("atr"), 2)))
    x = x.withColumn("stop", half_up(stop, 2)).withColumn("risk_pct", half_up((c("pivot") - c("stop")) / c("pivot") * 100, 2))
    depth = F.greatest(c("atr") * 2, c("pivot") - c("low30"))
    below = price < half_up(c("high_52w"), 2) * 0.97
    t1 = F.when(below, F.least(half_up(c("high_52w"), 2), half_up(c("pivot") + F.greatest(depth * 0.85, 1.8 * c("atr")), 2))).otherwise(half_up(c("pivot") + F.greatest(depth, 2 * c("atr")), 2))
    t2 = F.when(below, half_up(c("pivot") + F.greatest(depth * 1.5, 3.2 * c("atr")), 2)).otherwise(half_up(c("pivot") + F.greatest(depth * 1.618, 4 * c("atr")), 2))
    x = x.withColumns({"t1": t1, "t2": t2})
    x = x.withColumn("reward", half_up(F.greatest(F.lit(0.1), c("t1") - c("pivot")) / F.greatest(F.lit(0.1), c("pivot") - c("stop")), 2))
    x = x.withColumn("distance", half_up((price - c("pivot")) / c("pivot") * 100, 2))
    failed = (c("high3") >= F.least("first_pivot", "pivot")) & (price < F.greatest("first_pivot", "pivot") * 0.985)
    status = (
        F.when(failed, "FAILED_SETUP").when(c("distance") < -2.5, "CONSTRUCTING_BASE").when(c("distance") <= 0, "TRIGGER_WATCH").when(c("distance") <= 2.5, "ACTIONABLE_BUY")
        .when(c("distance") <= 5, "LATE_BUY_ZONE").otherwise("EXTENDED")
    )
    x = x.withColumn("status", status)
    return x.withColumn("readiness", _readiness(x))


def _readiness(x: DataFrame) -> Column:
    """Entry quality 35 %, tape 30 %, volume 20 %, reward 15 %; each part from 0 to 100."""
    c = F.col
    tightness = F.least(F.lit(40.0), (1 - F.least(F.lit(1.0), c("squeeze"))) * 80)
    tightness = F.when(c("quality") == "HEALTHY_CONTRACTION", F.least(F.lit(40.0), tightness + 5)).otherwise(tightness)
    near = F.when(c("status").isin("TRIGGER_WATCH", "ACTIONABLE_BUY"), 30.0).when(c("status") == "CONSTRUCTING_BASE", 20.0).otherwise(10.0)
    entry = half_up(tightness + F.least(F.lit(30.0), (1 - F.least(F.lit(1.0), c("dry_up"))) * 60) + near, 1)
    tape = F.least(F.lit(100.0), 50 + F.when(c("template_passed"), 30).otherwise(0) + F.when(c("dist50") > 0, 10).otherwise(0) + F.when(c("dist_high") >= -15, 10).otherwise(0))
    up = F.coalesce("up_volume", F.lit(0.0))
    down = F.coalesce("down_volume", F.lit(0.0))
    asymmetry = F.least(F.lit(50.0), half_up(up / F.greatest(F.lit(1.0), down), 2) / 2 * 50)
    quiet = F.greatest(F.lit(0.0), F.least(F.lit(50.0), (1 - F.least(F.lit(1.2), c("dry_up"))) * 65) - F.least(F.lit(20.0), c("distribution_days") * 5))
    volume = half_up(asymmetry + quiet, 1)
    reward = half_up(F.least(F.lit(100.0), F.greatest(F.lit(15.0), c("reward") / 2.5 * 75)), 1)
    return half_up(entry * 0.35 + tape * 0.30 + volume * 0.20 + reward * 0.15, 1)


def candidates(x: DataFrame) -> DataFrame:
    """Entries from audited bars: at once where actionable, or within the next bars that reach the pivot before the stop is touched."""
    total = F.count("*").over(Window.partitionBy("company_id"))
    x = x.withColumn("total", total)
    ahead = [F.struct(*(F.lead(k, i).over(sessions()).alias(k) for k in ("high", "low", "open")), F.lit(i).alias("i")) for i in range(1, WATCH_BARS + 1)]
    x = x.withColumn("ahead", F.array(*ahead))
    x = x.withColumns({"reached": F.try_element_at(F.filter("ahead", lambda b: b["high"] >= F.col("pivot")), F.lit(1)), "touched": F.try_element_at(F.filter("ahead", lambda b: b["low"] <= F.col("stop")), F.lit(1))})
    watch = (F.col("status") == "TRIGGER_WATCH") & F.col("reached").isNotNull() & (F.col("touched").isNull() | (F.col("reached")["i"] < F.col("touched")["i"]))
    gates = (F.col("n") > WARM_UP) & (F.col("total") >= LEAST_BARS) & (F.col("n") <= F.col("total") - COOL_DOWN) & (F.col("risk_pct") <= MAX_RISK_PCT) & (F.col("risk_pct") > 0) & (F.col("reward") >= MIN_REWARD)
    now = F.col("status") == "ACTIONABLE_BUY"
    x = x.where(gates & (now | watch))
    return x.select(
        "company_id", F.col("trading_date").alias("t0"), F.when(now, F.col("n")).otherwise(F.col("n") + F.col("reached")["i"]).alias("entry_n"),
        F.when(now, F.col("close")).otherwise(F.greatest(F.col("pivot"), F.col("reached")["open"])).alias("entry"), "stop", "t1", "t2", "setup", "quality", "regime", "readiness", F.col("n").alias("signal_n"),
    )


def label(entries: DataFrame, bars: DataFrame, optimistic: bool = False) -> DataFrame:
    """Outcome of each entry over the bars behind it: what is touched first, trailing after the first target, excursions.

    An entry meets the one or two blocks of 64 bars that hold its path, by an
    equi-join; the walk over the path is one fold. Where a bar touches both stop
    and target, the stop counts first unless ``optimistic``.
    """
    keys = entries.columns
    rows = bars.select("company_id", F.col("n").alias("i"), "open", "high", "low", "close")
    x = passage.spans(entries.withColumn("i", F.col("entry_n")), rows, HORIZON, "open", "high", "low", "close", after=1).where(F.size("path") > 0)
    entry, stop = F.col("entry"), F.col("stop")
    unit = F.greatest(F.lit(0.01), entry - stop)
    none = F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("d"), F.lit(False).alias("done"), F.lit(False).alias("hit"), stop.alias("trail"), F.lit(None).cast("double").alias("exit"), F.lit("EXPIRED").alias("outcome"), F.lit(False).alias("both"),
        none.alias("days_t1"), none.alias("days_stop"), none.alias("exit_d"), F.lit(0.0).alias("mfe"), F.lit(0.0).alias("mae"), F.lit(0.0).alias("full_mfe"), F.lit(False).alias("r1"), F.lit(False).alias("r2"), F.lit(False).alias("r3"),
    )

    def step(s: Column, bar: Column) -> Column:
        live = ~s["done"]
        d = s["d"] + 1
        up, down = (bar["high"] - entry) / entry * 100, (bar["low"] - entry) / entry * 100
        stopped = live & (bar["low"] <= s["trail"])
        first = live & (bar["high"] >= F.col("t1")) & ~s["hit"]
        both = stopped & first
        takes = first & (~stopped | F.lit(optimistic))
        stops = stopped & ~(both & F.lit(optimistic))
        hit = s["hit"] | takes
        wins = live & ~stops & hit & (bar["high"] >= F.col("t2"))
        outcome = F.when(stops, F.when(s["hit"], "T1_HIT_TRAILED_OUT").otherwise("STOPPED_OUT")).when(wins, "T2_HIT").otherwise(s["outcome"])
        out = F.when(stops, F.least(s["trail"], bar["open"])).when(wins, F.col("t2")).otherwise(s["exit"])
        ends = stops | wins

        def reach(name: str, k: int) -> Column:
            return (s[name] | (live & (bar["high"] >= half_up(entry + k * unit, 2)))).alias(name)

        return F.struct(
            d.alias("d"), (s["done"] | ends).alias("done"), hit.alias("hit"), F.when(takes, F.greatest(s["trail"], half_up(entry * FREE_ROLL, 2))).otherwise(s["trail"]).alias("trail"), out.alias("exit"), outcome.alias("outcome"),
            (s["both"] | both).alias("both"), F.when(takes, d).otherwise(s["days_t1"]).alias("days_t1"), F.when(stops, d).otherwise(s["days_stop"]).alias("days_stop"), F.when(ends, d).otherwise(s["exit_d"]).alias("exit_d"),
            F.when(live, F.greatest(s["mfe"], up)).otherwise(s["mfe"]).alias("mfe"), F.when(live, F.least(s["mae"], down)).otherwise(s["mae"]).alias("mae"), F.greatest(s["full_mfe"], up).alias("full_mfe"),
            reach("r1", 1), reach("r2", 2), reach("r3", 3),
        )

    x = x.withColumn("s", F.aggregate("path", start, step))
    out = F.coalesce("s.exit", F.element_at("path", -1)["close"])
    outcome = F.when(F.col("s.done"), F.col("s.outcome")).when(F.col("s.hit"), "T1_HIT_EXPIRED").otherwise("EXPIRED")
    pnl = (out - entry) / entry * 100
    excursions = [F.array_max(F.transform(F.slice("path", 1, h), lambda b: (b["high"] - entry) / entry * 100)).alias(f"mfe_{h}") for h in HORIZONS]
    return x.select(
        *keys, out.alias("exit"), outcome.alias("outcome"), F.coalesce("s.exit_d", F.size("path")).alias("days"), (F.col("entry_n") + F.coalesce("s.exit_d", F.size("path"))).alias("exit_n"), F.col("s.hit").alias("hit_t1"),
        F.col("s.both").alias("ambiguous"), "s.days_t1", "s.days_stop", "s.mfe", "s.mae", F.col("s.full_mfe").alias("mfe_full"), "s.r1", "s.r2", "s.r3", pnl.alias("pnl_pct"), ((out - entry) / unit).alias("r"), *excursions,
    )


def take(labelled: DataFrame) -> DataFrame:
    """Trades that do not overlap: after an exit, signals wait for the cool-down. One fold over a company's candidates."""
    rest = [c for c in labelled.columns if c not in ("company_id", "signal_n", "exit_n")]
    lists = labelled.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("signal_n", "exit_n", *rest))).alias("cs"))
    none = F.filter("cs", lambda t: F.lit(False))
    start = F.struct(F.lit(-COOL_DOWN - 1).cast("int").alias("last"), none.alias("taken"))

    def step(s: Column, t: Column) -> Column:
        free = t["signal_n"] > s["last"] + COOL_DOWN
        return F.struct(F.when(free, t["exit_n"].cast("int")).otherwise(s["last"]).alias("last"), F.when(free, F.concat(s["taken"], F.array(t))).otherwise(s["taken"]).alias("taken"))

    chosen = lists.select("company_id", F.explode(F.aggregate("cs", start, step, lambda s: s["taken"])).alias("t"))
    return chosen.select("company_id", "t.*").select(*labelled.columns)
