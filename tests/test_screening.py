"""Stages, gates, choice and verdicts on rows made for each branch."""

import pytest

from vintage.operators import continuation, screening, tournament

BASE = {
    "company_id": "a", "t0": "2020-01-01", "category": "ASSET_LIGHT_GROWTH", "net_worth": 100.0, "close": 95.0, "high_52w": 100.0, "sma50": 90.0, "sma200": 80.0, "market_cap": 1000.0, "roce": 20.0, "ttm_pat": 15.0, "debt_to_equity": 0.5, "revenue_growth": 20.0, "pe": 20.0,
}


def frame(spark, rows):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in BASE.items())
    return spark.createDataFrame([tuple((BASE | r)[k] for k in BASE) for r in rows], schema)


def test_each_gate_stops_what_it_names(spark):
    request = screening.Screen(max_market_cap=50_000.0, max_pe=40.0, stage_2_only=True)
    cases = {
        None: {}, "NO_BALANCE_SHEET": {"net_worth": None}, "INSOLVENT": {"net_worth": -1.0}, "NO_PRICE": {"close": None}, "NO_SHARES": {"market_cap": None}, "FAR_FROM_HIGH": {"high_52w": 200.0}, "NOT_IN_UPTREND": {"sma50": None}, "LEVERAGE": {"debt_to_equity": 4.5},
        "TOO_SMALL": {"market_cap": 10.0}, "TOO_LARGE": {"market_cap": 60_000.0}, "LOW_QUALITY": {"roce": None}, "DEBT": {"debt_to_equity": 2.0}, "LOW_GROWTH": {"revenue_growth": 5.0}, "HIGH_PE": {"pe": 41.0},
    }
    rows = [{"company_id": str(k)} | v for k, v in cases.items()]
    rows += [{"company_id": "bank", "category": "FINANCIALS", "debt_to_equity": 8.0, "roce": None, "ttm_pat": 16.0}, {"company_id": "unknown", "revenue_growth": None, "pe": None, "debt_to_equity": None}]
    got = {r.company_id: (r.gate, r.rank) for r in screening.prescreen(frame(spark, rows), request).collect()}
    assert all(got[str(k)][0] == k for k in cases) and got["bank"][0] is None and got["unknown"][0] is None  # what is not known stops nobody
    assert got["None"][1] == pytest.approx(64.0 * 0.4 + 82.5 * 0.35 + 85.0 * 0.25, abs=0.051) and got["bank"][1] == pytest.approx(80 * 0.4 + 80 * 0.35 + 85 * 0.25, abs=0.051)


def test_the_choice_keeps_each_size_and_fills_up(spark):
    rows = [{"company_id": f"s{i:02}", "market_cap": 1_000.0 + i} for i in range(20)] + [{"company_id": "m", "market_cap": 9_000.0, "roce": 16.0}, {"company_id": "l", "market_cap": 90_000.0, "roce": 15.0}, {"company_id": "out", "roce": 1.0}]
    x = screening.prescreen(frame(spark, rows), screening.Screen())
    chosen = [r.company_id for r in screening.stratified(x, 5).where("chosen").collect()]
    assert sorted(chosen) == ["l", "m", *(f"s{i:02}" for i in range(8))]  # ten places: 4 + 1 + 1 by size, the rest by rank


def test_attrition_counts_each_stage_once(spark):
    x = spark.createDataFrame([("2020-01-01", s) for s in [1, 1, 2, 3, 4, 4, 4, 4]] + [("2020-02-01", 1)], "t0 string, stage_reached int")
    got = {r.t0: tuple(r)[1:] for r in screening.attrition(x).collect()}
    assert got == {"2020-01-01": (8, 6, 5, 4, 25.0, 16.67, 20.0), "2020-02-01": (1, 0, 0, 0, 100.0, 0.0, 0.0)}


def test_permuted_scores_have_no_lift(spark):
    """With the whole universe picked, hits equal their expectation; a perfect score has the greatest z value, and ties are seen."""
    ranked = spark.createDataFrame([(str(i), "d", s, v, p + 1, 10, n) for s, vs in {"perfect": [10 - i for i in range(10)], "flat": [1] * 10}.items() for p, (i, v) in enumerate(sorted(enumerate(vs), key=lambda e: (-e[1], e[0]))) for n in [sorted(vs, reverse=True)[p + 1] if p < 9 else None]],
                                   "company_id string, t0 string, strategy string, score int, place int, size int, next_score int")
    outcomes = spark.createDataFrame([(str(i), "d", 500.0 if i < 3 else 0.0) for i in range(10)], "company_id string, t0 string, max_run double")
    got = {r.strategy: r for r in tournament.contest(ranked, outcomes, 3).collect()}
    assert got["perfect"].hits_5x == 3 and got["perfect"].lift_5x == pytest.approx(1 / 0.3) and got["perfect"].hits_10x == 0 and got["perfect"].z_10x is None
    assert got["perfect"].z_5x == pytest.approx((3 - 0.9) / (3 * 0.3 * 0.7 * 7 / 9) ** 0.5) and (got["perfect"].tied_pct, got["flat"].tied_pct) == (0.0, 100.0)
    whole = {r.strategy: r for r in tournament.contest(ranked, outcomes, 10).collect()}
    assert whole["flat"].lift_2x == pytest.approx(1.0) and whole["flat"].z_2x is None


QUIET = {
    "open": 100.0, "high": 110.0, "low": 100.0, "close": 107.0, "change": 3.0, "rvol": 1.2, "mean": 100.0, "atr": 5.0, "delivery_pct": 50.0, "trajectory": "STABLE_DELIVERY", "fsar": None, "durability": None, "momentum": None, "rsi": 60.0, "week_change": 0.0, "high_52w": 110.0,
    "sector_state": None, "cmmi": None, "market_change": 0.0, "beta": 1.0,
}


def test_overriding_rules_cap_the_probability(spark):
    cases = {
        "quiet": {}, "churn": {"delivery_pct": 10.0}, "wick": {"high": 130.0}, "locked": {"high": 107.0, "change": 5.0, "low": 106.9, "open": 107.0}, "pending": {"delivery_pct": None}, "stretched": {"mean": 60.0}, "best": {"close": 110.0, "delivery_pct": 90.0, "rvol": 6.0, "trajectory": "STAIRCASE_ACCUMULATION", "fsar": 2.0},
        "drag": {"cmmi": 10.0, "market_change": -3.0},
    }
    schema = "name string, " + ", ".join(f"{k} {'string' if k in ('trajectory', 'sector_state') else 'double'}" for k in QUIET)
    x = spark.createDataFrame([(n, *(QUIET | v).values()) for n, v in cases.items()], schema)
    got = {r["name"]: r for r in continuation.continuation(x).collect()}
    verdicts = {n: r.verdict for n, r in got.items()}
    assert verdicts["churn"] == verdicts["wick"] == "RETAIL_TRAP_FADE_RISK" and max(got["churn"].probability, got["wick"].probability) <= 42
    assert verdicts["locked"] == "CIRCUIT_LOCKED_ILLIQUID" and verdicts["pending"] == verdicts["stretched"] == "PULLBACK_ACCUMULATION" and max(got["pending"].probability, got["stretched"].probability) <= 58
    assert verdicts["best"] == "GAP_AND_GO_CANDIDATE" and got["best"].probability <= 92
    assert got["drag"].multiplier == 0.80 and got["drag"].probability < got["quiet"].probability
    for r in got.values():  # the breakdown adds up to the score
        assert r.score == pytest.approx(50 + sum(f.points for f in r.factors), abs=0.051) and len({f.name for f in r.factors}) == len(r.factors)


def test_missing_data_guard(spark):
    row = {"category": "ASSET_LIGHT_GROWTH", "company_name": "Co", "roce": 20.0, "roe": 18.0, "net_margin": 10.0, "debt_to_equity": 0.5, "opm": 20.0, "sales_growth": 20.0, "pe": 30.0, "fcf": -5.0, "cash": 10.0, "debt": 20.0, "dso": 40.0}
    cases = {
        "grower": {}, "weak": {"sales_growth": 3.0, "roce": 8.0, "roe": 9.0}, "thin": {"cash": 1.0, "debt_to_equity": 1.5}, "cash": {"fcf": 1.0}, "unknown": {"fcf": None}, "bank": {"category": "FINANCIALS"}, "bare bank": {"category": "FINANCIALS", "roe": None, "net_margin": None},
        "poor": {"roce": None, "pe": None, "sales_growth": None}, "small": {"company_name": "An SME"},
    }
    schema = "name string, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in row.items())
    got = {r["name"]: r for r in screening.missing_data_guard(spark.createDataFrame([(n, *(row | v).values()) for n, v in cases.items()], schema)).collect()}
    assert {n: r.fcf_status for n, r in got.items()} == {
        "grower": "GROWTH_REINVESTMENT", "weak": "FCF_RISK", "thin": "FCF_RISK", "cash": "CASH_GENERATIVE", "unknown": "DATA_UNAVAILABLE", "bank": "EXEMPT_FINANCIAL", "bare bank": "EXEMPT_FINANCIAL", "poor": "FCF_RISK", "small": "GROWTH_REINVESTMENT",
    }
    assert got["weak"].fcf_reasons == ["RETURNS", "GROWTH"] and got["thin"].fcf_reasons == ["SOLVENCY"]
    assert (got["bank"].effective_quality, got["bare bank"].effective_quality, got["poor"].effective_quality, got["bank"].effective_solvency) == (18.0, 15.0, 18.0, 1.0)
    assert (got["poor"].rating, got["small"].rating, got["grower"].rating) == ("LIMITED_DATA", "SME_CLOUD_PROXY", "FULL_OHLCV")
    assert got["grower"].provenance["roce"].quality == "CROSS_CHECKED" and got["poor"].provenance["pe"].quality == "MISSING" and got["bank"].provenance["debt_to_equity"].quality == "PROXY"
