"""Ranking strategies against what became of their picks.

Every strategy scores the same universe at every date; the best of each date are
held against outcomes. Chance is not simulated: if scores were permuted among
the companies of a date, hits would be hypergeometric, so that their mean and
variance follow from the date's size and base rate, and a strategy's hits give a
z value. Ties are reported: where the last pick and the first one left out have
equal scores, the order of ids decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from . import scores
from .setups import half_up

c = F.col
TOP, MULTIPLES = 20, {"2x": 100.0, "5x": 400.0, "10x": 900.0}


def _or(name: str, default: float) -> Column:
    return F.coalesce(c(name), F.lit(default))


def pillar_terms() -> dict[str, Column]:
    """The weighted terms of the pillar score: compounding, return, room to grow, asymmetry of price and growth."""
    roce, reinvested = _or("roce", 0.0), clamp(F.coalesce(c("ttm_capex") / F.when(c("ttm_cfo") != 0, c("ttm_cfo")) * 100, F.lit(0.0)), 0.0, 100.0)
    gap = clamp(50.0 - _or("pe", 25.0) + _or("revenue_growth", 0.0), 0.0, 100.0)
    return {"compounding": roce * reinvested / 100 * 0.45, "return": roce * 0.20, "room": clamp(_or("dist_high", -15.0) * -1.0, 0.0, 100.0) * 0.10, "asymmetry": gap * 0.25}


def strategies() -> dict[str, Column]:
    """Eight scores over the feature vector and its frozen factor score; higher is better, what is not known scores 0."""
    roce, reinvested = _or("roce", 0.0), clamp(F.coalesce(c("ttm_capex") / F.when(c("ttm_cfo") != 0, c("ttm_cfo")) * 100, F.lit(0.0)), 0.0, 100.0)
    gap = clamp(50.0 - _or("pe", 25.0) + _or("revenue_growth", 0.0), 0.0, 100.0)
    chance = F.conv(F.substring(F.sha2(F.concat_ws("_", "company_id", c("t0").cast("string")), 256), 1, 8), 16, 10).cast("long") % 1000 / 10.0
    terms = pillar_terms()
    return {
        "RANDOM": chance, "SIMPLE_VALUE": F.when(c("pe") > 0, 100 / c("pe")).otherwise(0.0), "SIMPLE_QUALITY": roce, "SIMPLE_GROWTH": _or("revenue_growth", 0.0), "SIMPLE_MOMENTUM": _or("dist_sma200", 0.0),
        "M6_LINEAR": _or("conviction", 0.0).cast("double"), "5_PILLAR_SYNTHESIS": terms["compounding"] + terms["return"] + terms["room"] + terms["asymmetry"],
        "M7_GBDT": roce * reinvested / 100 * 0.50 + gap * (roce / 20) * 0.35 + F.least(F.lit(20.0), _or("ttm_capex", 0.0) * 0.15),
    }


def ablations() -> dict[str, Column]:
    """The pillar score, and that score without each of its terms."""
    terms = pillar_terms()
    whole = lambda left: sum((v for k, v in terms.items() if k != left), F.lit(0.0))
    return {"FULL": whole(None)} | {f"WITHOUT_{k.upper()}": whole(k) for k in terms}


def ranked(vector: DataFrame, scored: dict[str, Column]) -> DataFrame:
    """``company_id, t0, strategy, score, place, size``: the whole universe of each date, ranked by each strategy."""
    x = scores.frozen_factors(vector)
    x = x.select("company_id", "t0", *(half_up(v, 4).alias(k) for k, v in scored.items())).unpivot(["company_id", "t0"], list(scored), "strategy", "score")
    by = Window.partitionBy("strategy", "t0").orderBy(F.desc("score"), "company_id")
    return x.withColumns({"place": F.row_number().over(by), "size": F.count("*").over(Window.partitionBy("strategy", "t0")), "next_score": F.lead("score").over(by)})


def contest(ranked: DataFrame, outcomes: DataFrame, top: int = TOP) -> DataFrame:
    """Per strategy: picks, hits, precision, expected hits and z value under permuted scores, lift over the base rate, share of dates decided by ties; ``outcomes(company_id, t0, max_run)``.

    Companies without an outcome are ranked and picked like the others and count as no hit.
    """
    x = ranked.join(outcomes.select("company_id", "t0", "max_run"), ["company_id", "t0"], "left")
    hit = {n: F.coalesce((c("max_run") >= m).cast("int"), F.lit(0)) for n, m in MULTIPLES.items()}
    picked = c("place") <= top
    dates = x.groupBy("strategy", "t0").agg(
        F.max("size").alias("size"), F.count_if(picked).alias("picks"), F.max(F.when(c("place") == top, (c("score") == c("next_score")).cast("int"))).alias("tied"),
        *(F.sum(v).alias(f"all_{n}") for n, v in hit.items()), *(F.sum(F.when(picked, v).otherwise(0)).alias(f"hits_{n}") for n, v in hit.items()),
    )
    share = {n: c(f"all_{n}") / c("size") for n in MULTIPLES}
    spread = lambda n: F.when(c("size") > 1, c("picks") * share[n] * (1 - share[n]) * (c("size") - c("picks")) / (c("size") - 1)).otherwise(0.0)
    total = dates.groupBy("strategy").agg(
        F.sum("picks").alias("picks"), F.count("*").alias("dates"), F.avg(F.coalesce("tied", F.lit(0))).alias("tied"), *(F.sum(f"hits_{n}").alias(f"hits_{n}") for n in MULTIPLES),
        *(F.sum(c("picks") * share[n]).alias(f"expected_{n}") for n in MULTIPLES), *(F.sum(spread(n)).alias(f"variance_{n}") for n in MULTIPLES),
    )
    columns = [k for n in MULTIPLES for k in (
        c(f"hits_{n}"), (c(f"hits_{n}") / c("picks") * 100).alias(f"precision_{n}"), (c(f"hits_{n}") / F.when(c(f"expected_{n}") > 0, c(f"expected_{n}"))).alias(f"lift_{n}"),
        ((c(f"hits_{n}") - c(f"expected_{n}")) / F.when(c(f"variance_{n}") > 0, F.sqrt(f"variance_{n}"))).alias(f"z_{n}"),
    )]
    return total.select("strategy", "picks", "dates", (c("tied") * 100).alias("tied_pct"), *columns)
