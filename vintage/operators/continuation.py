"""Whether a strong session goes on: evidence in points with a breakdown, a calibrated probability, market drag and overriding rules.

The breakdown is an array of ``struct<name, points, status>``; the score is 50
plus its sum. Columns: ``open, high, low, close, change, rvol, mean, atr,
delivery_pct`` (0 or null: not reported), ``trajectory, fsar, durability,
momentum, rsi, week_change, high_52w, sector_state, cmmi, market_change, beta``;
what is null takes part as the neutral default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f
from .setups import half_up

c = F.col


def _or(name: str, default: float) -> Column:
    return F.coalesce(c(name), F.lit(default))


def _factors(horizon: str, provisional: bool) -> list[tuple[str, list[tuple[Column, Column, str]]]]:
    """Name and ordered cases (condition, points, status) of each factor; the first case that holds counts."""
    clv, wick, dlv, rvol, ier = c("location"), c("wick"), c("delivered"), _or("rvol", 1.0), c("stretch")
    trust = 0.85 if provisional else 1.0
    p = lambda x: half_up(x, 1)
    n = F.lit
    out = [
        ("CLOSE", [(clv >= 0.90, p(8.0 + (clv - 0.90) / 0.10 * 3.0), "BULLISH"), (clv >= 0.70, p(3.0 + (clv - 0.70) / 0.20 * 5.0), "BULLISH"), (clv < 0.40, -p(6.0 + (0.40 - clv) / 0.40 * 8.0), "BEARISH"), (n(True), n(0.0), "NEUTRAL")]),
        ("WICK", [(wick < 0.05, n(3.0), "BULLISH"), (wick >= 0.35, n(-16.0), "TRAP_WARNING"), (wick >= 0.15, -p((wick - 0.15) / 0.20 * 8.0), "CAUTION")]),
        ("DELIVERY", [
            (dlv >= 60, p((10.0 + F.least(n(4.0), (dlv - 60.0) * 0.15)) * trust), "INSTITUTIONAL"), (dlv >= 45, p((6.0 + (dlv - 45.0) / 15.0 * 4.0) * trust), "BULLISH"), (dlv >= 35, p((2.0 + (dlv - 35.0) / 10.0 * 4.0) * trust), "BULLISH"),
            (dlv >= 22, p((dlv - 22.0) / 13.0 * 2.0 * trust), "NEUTRAL"), ((dlv > 0) & (dlv < 18), -p((8.0 + (18.0 - dlv) / 18.0 * 8.0) * trust), "RETAIL_CHURN"), (dlv == 0, n(-5.0), "PENDING"),
        ]),
        ("TRAJECTORY", [(c("trajectory") == "STAIRCASE_ACCUMULATION", n(5.0), "ACCUMULATION"), (c("trajectory") == "DISTRIBUTION_CHURN", n(-8.0), "DISTRIBUTION")]),
        ("FLOAT", [((c("fsar") >= 1) & (dlv >= 35), p(F.least(n(5.0), 2.5 + c("fsar") * 1.5)), "SUPPLY_SQUEEZE"), ((c("fsar") >= 0.5) & (dlv >= 30), n(2.5), "BULLISH"), ((c("fsar") >= 1) & (dlv < 20) & (dlv > 0), n(-8.0), "TRAP_WARNING")]),
        ("VOLUME", [(rvol >= 3, p(4.0 + F.least(n(4.0), (rvol - 3.0) * 0.8)), "BULLISH"), (rvol >= 1.5, p((rvol - 1.5) / 1.5 * 4.0), "BULLISH"), (rvol < 1, -p((1.0 - rvol) * 6.0), "BEARISH")]),
        ("STRETCH", [(ier > 4.5, n(-14.0), "EXHAUSTION"), (ier > 3, -p((ier - 3.0) * 5.0), "CAUTION"), (ier.between(0.8, 2.2), n(2.0), "BASE")]),
        ("QUALITY", [(n(True), p((_or("durability", 60.0) - 50.0) / 50.0 * 3.0 + (_or("momentum", 60.0) - 50.0) / 50.0 * 4.0), "QUALITY")]),
        ("SECTOR", [(c("sector_state") == "LEADING", n(3.0), "SECTOR_TAILWIND"), (c("sector_state") == "IMPROVING", n(1.5), "SECTOR_ACCUMULATION"), (c("sector_state") == "LAGGING", n(-3.0), "SECTOR_HEADWIND")]),
    ]
    away = (c("high_52w") - c("close")) / c("high_52w") * 100
    if horizon == "WEEKLY":
        out += [("FATIGUE", [(c("rsi") >= 85, n(-8.0), "OVERBOUGHT")]), ("SURGE", [((c("week_change") >= 35) & (dlv < 30) & (dlv > 0), n(-10.0), "VULNERABLE")])]
    if horizon == "YEARLY":
        out += [("PEAK", [(away <= 3, n(6.0), "BASE_BREAKOUT"), (away > 20, n(-6.0), "OVERHEAD_SUPPLY")])]
    return out


def continuation(x: DataFrame, horizon: str = "TODAY", provisional: bool = False) -> DataFrame:
    """``x`` plus ``factors, score, multiplier, probability, locked, verdict``."""
    x = x.withColumns({
        "location": f.close_location(c("high"), c("low"), c("close")), "wick": f.upper_wick(c("open"), c("high"), c("low"), c("close")), "stretch": f.elasticity(c("close"), c("mean"), c("atr")), "delivered": _or("delivery_pct", 0.0),
        "locked": F.coalesce(((c("high") - c("close")) / c("high") <= 0.0015) & (((c("high") - c("low")) / c("close") <= 0.004) | f.circuit_locked(c("change"))) & (c("change") >= 1.9), F.lit(False)),
    })
    entries = []
    for name, cases in _factors(horizon, provisional):
        case = None
        for condition, points, status in cases:
            entry = F.struct(F.lit(name).alias("name"), points.cast("double").alias("points"), F.lit(status).alias("status"))
            case = F.when(condition, entry) if case is None else case.when(condition, entry)
        entries.append(case)
    x = x.withColumn("factors", F.array_compact(F.array(*entries)))
    x = x.withColumn("score", half_up(F.aggregate("factors", F.lit(50.0), lambda s, e: s + e["points"]), 1))
    base = f.clamp(half_up(f.logistic((c("score") - 50.0) / 20.0) * 100, 1), 10.0, 92.0)
    drag = ((c("cmmi") - 50.0) / 100.0 * 0.5 + _or("market_change", 0.0) / 10.0 * 0.5) * f.clamp(_or("beta", 1.0), 0.4, 2.0)
    x = x.withColumn("multiplier", F.coalesce(half_up(f.clamp(1.0 + drag, 0.80, 1.10), 3), F.lit(1.0)))
    p = F.when(c("cmmi").isNotNull(), f.clamp(half_up(base * c("multiplier"), 1), 10.0, 92.0)).otherwise(base)
    x = x.withColumn("raw_probability", p)
    churn, trap, pending, far = (c("delivered") > 0) & (c("delivered") < 18), c("wick") >= 0.35, c("delivered") == 0, c("stretch") > 4.5
    p = c("raw_probability")
    verdict = (
        F.when(churn | trap, "RETAIL_TRAP_FADE_RISK").when(c("locked"), "CIRCUIT_LOCKED_ILLIQUID").when(pending | far, "PULLBACK_ACCUMULATION").when(p >= 75, "GAP_AND_GO_CANDIDATE").when(p >= 60, "PULLBACK_ACCUMULATION").when(p >= 45, "RANGE_BOUND_DIGESTION")
        .otherwise("RETAIL_TRAP_FADE_RISK")
    )
    capped = F.when(churn | trap, F.least(F.lit(42.0), p)).when(c("locked"), p).when(pending | far, F.least(F.lit(58.0), p)).otherwise(p)
    return x.withColumns({"probability": capped, "verdict": verdict}).drop("raw_probability", "delivered")
