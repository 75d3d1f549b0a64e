"""First passages, spans and whole-history smoothing against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vintage.operators import passage, paths, recurrence

BARS = "company_id string, trading_date date, open double, high double, low double, close double, volume double"


def history(rng, company, n, gap=1):
    day, p, out = dt.date(2010, 1, 4), 100.0, []
    for _ in range(n):
        p = max(0.5, p * (1 + rng.uniform(-0.06, 0.063)))
        high, low = p * (1 + rng.random() * 0.02), p * (1 - rng.random() * 0.02)
        out.append((company, day, p, high, low, p, 10.0))
        day += dt.timedelta(rng.choice([1, 1, 1, 3]) * gap)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return history(rng, "A", 5000) + history(rng, "B", 300, 9) + history(rng, "C", 1) + history(rng, "D", 64) + history(rng, "E", 65)


@pytest.fixture(scope="module")
def bars(spark, rows):
    return spark.createDataFrame(rows, BARS)


def test_outcomes_equal_a_loop_over_the_path(spark, rows, bars, monkeypatch):
    monkeypatch.setattr(passage, "FAN", 8)  # three full levels within the test's histories
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[5]))
    rng = random.Random(4)
    anchors = [(c, by[c][k][0] + dt.timedelta(shift)) for c in by for k in {0, len(by[c]) - 1, *(rng.randrange(len(by[c])) for _ in range(12))} for shift in (0, 1)]
    anchors = sorted(set(anchors)) + [("Z", dt.date(2010, 1, 4)), ("A", dt.date(2000, 1, 1))]
    got = {(r.company_id, r.t0): r for r in paths.outcomes(bars, spark.createDataFrame(anchors, "company_id string, t0 date")).collect()}
    seen = 0
    for c, t in anchors:
        path = [(d, p) for d, p in by.get(c, []) if d >= t]
        if not path:
            assert (c, t) not in got
            continue
        seen += 1
        r, p0 = got[c, t], path[0][1]
        peak, worst = 0.0, 0.0
        for _, p in path:
            peak = max(peak, p)
            worst = min(worst, (p - peak) / peak * 100)
        assert (r.bars, r.p0, r.p_last) == (len(path), p0, path[-1][1]) and r.max_drawdown == pytest.approx(worst) and r.max_run == pytest.approx((max(p for _, p in path) / p0 - 1) * 100)
        for name, m in (("up", 1.2), ("2x", 2.0), ("5x", 5.0), ("10x", 10.0)):
            hit = next((i for i, (_, p) in enumerate(path) if p >= m * p0), None)
            assert r[f"bar_{name}"] == hit
            if hit is not None:
                assert (r[f"date_{name}"], r[f"price_{name}"], r[f"low_{name}"]) == (path[hit][0], path[hit][1], min(p for _, p in path[:hit]))
    assert seen == len(got) > 40


def test_spans_are_the_bars_behind(spark, rows, bars):
    numbered = passage.numbered(bars)
    starts = spark.createDataFrame([("A", i, f"s{i}") for i in (0, 40, 63, 64, 4990, 4999)] + [("C", 0, "c")], "company_id string, i int, path string")
    closes = [r[5] for r in rows if r[0] == "A"]
    starts = starts.withColumnRenamed("path", "name")
    got = {r["name"]: r["ps"] for r in passage.spans(starts, numbered, 45, "p", after=1).select("name", F.col("path.p").alias("ps")).collect()}
    for i in (0, 40, 63, 64, 4990, 4999):
        assert got[f"s{i}"] == closes[i + 1 : i + 46]
    assert got["c"] == []


@pytest.mark.parametrize("days", [16, 100, 1024])
def test_whole_history_smoothing_equals_a_loop(rows, bars, days):
    got = {(r.company_id, r.trading_date): (r.atr, r.rsi) for r in recurrence.whole_history(bars, days=days).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for c, own in by.items():
        atr = up = down = None
        seeds = []
        for before, now in zip([None, *own], own, strict=False):
            if before:
                change = now[5] - before[5]
                x = (max(now[3] - now[4], abs(now[3] - before[5]), abs(now[4] - before[5])), max(change, 0.0), max(-change, 0.0))
                if atr is None:
                    seeds.append(x)
                    if len(seeds) == 14:
                        atr, up, down = (sum(s[k] for s in seeds) / 14 for k in range(3))
                else:
                    atr, up, down = ((s * 13 + v) / 14 for s, v in zip((atr, up, down), x, strict=True))
            want = (None, None) if atr is None else (atr, 100.0 if down == 0 else 100 - 100 / (1 + up / down))
            have = got[c, now[1]]
            assert (have[0] is None) == (want[0] is None) and (want[0] is None or have == pytest.approx(want, rel=1e-9))
