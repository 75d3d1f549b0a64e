"""A strategy scan: compiled predicates, gates, ranking by durability, value and momentum with a sector bonus, and trade cards sized by the market's regime."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from . import scores
from .predicates import compile_rules
from .setups import half_up

c = F.col
# Share of the capital that a regime allows, in percent, and bonus of a favoured sector or its cluster.
SIZES = {"BULLISH_EXPANSION": 100, "SELECTIVE_ROTATION": 75, "DEFENSIVE_CONSOLIDATION": 50}
PRESERVED, FAVOURED_BONUS, CLUSTER_BONUS, LEAST_PRICE = 25, 20.0, 12.0, 5.0


@dataclass(frozen=True)
class Strategy:
    """What to look for; ``rules`` as in :func:`.predicates.compile_rules`."""

    rules: tuple[dict, ...] = ()
    near_high_pct: float = 25.0
    max_debt: float = 1.5
    favoured: tuple[str, ...] = ()
    clusters: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    intraday: bool = False
    limit: int = 10


def scan(x: DataFrame, strategy: Strategy) -> DataFrame:
    """The best of each date with their cards; columns of the feature vector and ``category, sector, industry, regime``.

    What is not known passes: only a known debt beyond the limit, a known sector that is excluded, or a known distance stop a company.
    """
    away = half_up((c("high_52w") - c("close")) / c("high_52w") * 100, 1)
    x = x.withColumn("away", F.coalesce(away, F.lit(0.0)))
    if strategy.rules:
        x = x.where(compile_rules(list(strategy.rules), x.columns))
    debt = (c("category") != "FINANCIALS") & (half_up(c("debt_to_equity"), 2) > strategy.max_debt)
    barred = F.coalesce(c("sector").isin(*strategy.excluded), F.lit(False)) if strategy.excluded else F.lit(False)
    x = x.where((c("close") > LEAST_PRICE) & (c("away") <= strategy.near_high_pct) & ~F.coalesce(debt, F.lit(False)) & ~barred)
    x = x.withColumns({"financial": c("category") == "FINANCIALS", "operating_margin": c("ebitda_margin"), "mean50": F.coalesce("sma50", "close"), "mean200": F.coalesce("sma200", "close"), "rvol": half_up(c("volume") / c("vol20"), 2)})
    x = scores.durability(x)
    bonus = F.when(c("sector").isin(*strategy.favoured) if strategy.favoured else F.lit(False), FAVOURED_BONUS).when(c("industry").isin(*strategy.clusters) if strategy.clusters else F.lit(False), CLUSTER_BONUS).otherwise(0.0)
    x = x.withColumn("rank", half_up(c("composite") + bonus, 4))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("t0").orderBy(F.desc("rank"), "company_id"))).where(c("place") <= strategy.limit)
    return cards(x, strategy.intraday)


def cards(x: DataFrame, intraday: bool) -> DataFrame:
    """Stop from the average range within a band of the price, targets at two and three risks, size by regime, thesis."""
    low, high, ranges = (0.008, 0.020, 0.8) if intraday else (0.035, 0.065, 1.5)
    atr = F.coalesce("atr", c("close") * 0.03)
    x = x.withColumn("stop", half_up(c("close") - between(atr * ranges, c("close") * low, c("close") * high), 2)).withColumn("risk", half_up(c("close") - c("stop"), 2))
    size = F.lit(PRESERVED)
    for regime, share in SIZES.items():
        size = F.when(c("regime") == regime, share).otherwise(size)
    breakout = F.when(F.lit(intraday), "GAP_AND_VOLUME").when(c("away") <= 4.5, "BASE_BREAKOUT").otherwise("MOMENTUM_EXPANSION")
    return x.withColumns({
        "target_1": half_up(c("close") + c("risk") * 2.0, 2), "target_2": half_up(c("close") + c("risk") * 3.0, 2), "risk_pct": half_up(c("risk") / c("close") * 100, 1), "size_pct": size, "card_thesis": breakout,
    })


def between(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def profile(vector: DataFrame) -> DataFrame:
    """The frozen factor score with defaults for what is missing, and a digest of its inputs: a profile for every company."""
    filled = {"ebitda_margin": 15.0, "pat_margin": 8.0, "roce": 15.0, "debt_to_equity": 0.5, "revenue_growth": 0.0, "pat_growth": 0.0}
    names = ["revenue_growth", "pat_growth", "ebitda_margin", "pat_margin", "roce", "debt_to_equity", "pe", "pb"]
    x = vector.withColumns({f"_{k}": F.round(k, 3) for k in names})
    x = x.withColumn("input_hash", f.canonical_hash([f"_{k}" for k in names])).drop(*(f"_{k}" for k in names))
    return scores.frozen_factors(x.withColumns({k: F.coalesce(c(k), F.lit(v)) for k, v in filled.items()}))
