"""Small fixed inputs for windows, as-of reads, joins, labels and functions."""

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from vintage.functions import scalars as f
from vintage.operators import calibration, joins, paths, pit, ranking, setups
from vintage.operators import windows as w
from vintage.sources import parsers

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, company="A", start=DAY):
    rows = [(company, start + dt.timedelta(days=i), c, c * 1.01, c * 0.99, float(c), 100.0 + i) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "company_id string, trading_date date, open double, high double, low double, close double, volume double")


def one(df, column):
    return [r[column] for r in df.collect()]


def test_sma_is_null_until_enough_bars(spark):
    x = bars(spark, [1, 2, 3, 4]).withColumn("s", w.sma(3)).orderBy("trading_date")
    assert one(x, "s") == [None, None, 2.0, 3.0]


def test_true_range_has_no_first_value(spark):
    x = bars(spark, [10, 12]).withColumn("t", w.true_range()).orderBy("trading_date")
    first, second = one(x, "t")
    assert first is None and second == pytest.approx(12.12 - 10)


def test_rsi_matches_a_plain_loop(spark):
    closes = [100 + 7 * math.sin(i) + i * 0.3 for i in range(60)]
    x = w.wilder_rsi(bars(spark, closes)).withColumnRenamed("rsi", "r").orderBy("trading_date")
    deltas = [b - a for a, b in zip(closes, closes[1:], strict=False)]
    gain, loss = sum(max(d, 0) for d in deltas[:14]) / 14, sum(max(-d, 0) for d in deltas[:14]) / 14
    for d in deltas[14:]:
        gain, loss = (gain * 13 + max(d, 0)) / 14, (loss * 13 + max(-d, 0)) / 14
    got = one(x, "r")
    assert got[13] == 50.0 and got[-1] == pytest.approx(100 - 100 / (1 + gain / loss), abs=1e-9)


def test_flat_prices_have_neutral_rsi_and_rising_ones_the_highest(spark):
    def last(closes):
        x = w.wilder_rsi(bars(spark, closes)).withColumnRenamed("rsi", "r").orderBy("trading_date")
        return one(x, "r")[-1]

    assert last([5] * 30) == 50.0 and last(range(1, 31)) == 100.0


FILINGS = "company_id string, period_end date, published date, vintage int, revenue double"


def filings(spark):
    d = dt.date
    rows = [("A", d(2020, 3, 31), d(2020, 5, 15), 0, 100.0), ("A", d(2020, 3, 31), d(2020, 11, 1), 1, 90.0), ("A", d(2020, 6, 30), d(2020, 8, 14), 0, 120.0)]
    return spark.createDataFrame(rows, FILINGS)


@pytest.mark.parametrize(("t0", "expected"), [("2020-05-14", []), ("2020-05-15", [100.0]), ("2020-10-31", [120.0, 100.0]), ("2020-11-01", [120.0, 90.0])])
def test_as_of_sees_only_what_was_published(spark, t0, expected):
    dates = spark.createDataFrame([("A", dt.date.fromisoformat(t0))], "company_id string, t0 date")
    assert one(pit.as_of(filings(spark), dates).orderBy("age"), "revenue") == expected


def test_future_filings_change_nothing(spark):
    dates = spark.createDataFrame([("A", dt.date(2020, 9, 1))], "company_id string, t0 date")
    poison = spark.createDataFrame([("A", dt.date(2020, 6, 30), dt.date(2021, 1, 1), 2, 1e9)], FILINGS)
    a, b = pit.as_of(filings(spark), dates), pit.as_of(filings(spark).unionByName(poison), dates)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_trailing_sum_scales_for_missing_periods(spark):
    dates = spark.createDataFrame([("A", dt.date(2020, 12, 1))], "company_id string, t0 date")
    assert pit.trailing_sum(pit.as_of(filings(spark), dates)).first().ttm == pytest.approx((90 + 120) * 2)


def test_versions_close_when_the_next_opens(spark):
    rows = pit.scd2(filings(spark), ["company_id", "period_end"], "published", ["revenue"]).orderBy("period_end", "rec_start").collect()
    assert [str(r.rec_end) for r in rows] == ["2020-11-01", "9999-12-31", "9999-12-31"]


def test_price_as_of_in_both_directions(spark):
    b = bars(spark, [1, 2, 3]).where("trading_date <> '2020-01-02'")
    points = spark.createDataFrame([("A", dt.date(2020, 1, 2))], "company_id string, at date")
    assert pit.price_as_of(points, b, "at").first().price == 1.0
    assert pit.price_as_of(points, b, "at", forward=True).first().price == 3.0


def test_membership_is_closed_at_both_ends(spark):
    u = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2020, 6, 30)), (2, dt.date(2020, 3, 1), None)], "company_id long, effective_from date, effective_to date")
    dates = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in ("2020-01-01", "2020-06-30", "2020-07-01")], "t0 date")
    got = {(str(r.t0), r.company_id) for r in joins.members_at(u, dates).collect()}
    assert got == {("2020-01-01", 1), ("2020-06-30", 1), ("2020-06-30", 2), ("2020-07-01", 2)}


@pytest.mark.parametrize("same", [True, False])
def test_purging_leaves_no_overlap(spark, same):
    rows = [(i, i % 3, DAY + dt.timedelta(days=20 * i), DAY + dt.timedelta(days=20 * i + 30)) for i in range(30)]
    x = spark.createDataFrame(rows, "observation_id long, company_id long, label_start date, label_end date")
    train, test = x.where("observation_id < 20"), x.where("observation_id >= 18")
    kept = joins.purge(train, test, same)
    hit = {a[0] for a in rows[:20] for b in rows[18:] if (not same or a[1] == b[1]) and a[2] < b[3] and b[2] < a[3]}
    assert {r.observation_id for r in kept.collect()} == set(range(20)) - hit
    assert joins.fold_overlap(kept, test).isEmpty()


def test_split_adjustment_leaves_the_ex_date_alone(spark):
    b = bars(spark, [100, 100, 50, 50])
    actions = spark.createDataFrame([("A", dt.date(2020, 1, 3), 0.5)], "company_id string, ex_date date, factor double")
    x = joins.adjusted_bars(b, actions).orderBy("trading_date")
    assert one(x, "close") == [50.0] * 4 and one(x, "volume")[0] == 200.0
    assert one(joins.adjusted_bars(b, actions, "2020-01-02").orderBy("trading_date"), "close") == [100.0, 100.0, 50.0, 50.0]


def test_outcomes_of_a_path(spark):
    b = bars(spark, [100, 150, 75, 220])
    row = paths.outcomes(b, paths.year_anchors(b)).first()
    assert row.max_drawdown == pytest.approx(-50) and row.bar_2x == 3 and row.bar_up == 1 and row.failed is False


def test_wealth_reinvests(spark):
    b = bars(spark, [100, 110]).withColumn("dividend", F.when(F.col("close") > 100, 11.0).otherwise(0.0))
    last = paths.wealth(b, 1000.0).orderBy(F.col("trading_date").desc()).first()
    assert last.reinvested == pytest.approx(10 * 1.1 * 110) and last.cash == pytest.approx(10 * 121)


def entry(spark, **change):
    row = {"company_id": "A", "signal_n": 1, "entry_n": 1, "entry": 100.0, "stop": 95.0, "t1": 110.0, "t2": 120.0} | change
    return spark.createDataFrame([tuple(row.values())], "company_id string, signal_n int, entry_n int, entry double, stop double, t1 double, t2 double")


def walk(spark, ohlc, optimistic=False, **change):
    rows = [("A", i + 2, *map(float, b)) for i, b in enumerate(ohlc)]
    b = spark.createDataFrame(rows, "company_id string, n int, open double, high double, low double, close double")
    return setups.label(entry(spark, **change), b, optimistic).first()


def test_same_bar_ambiguity(spark):
    both = [(100, 111, 94, 100), (100, 101, 99, 100)]
    assert walk(spark, both).outcome == "STOPPED_OUT" and walk(spark, both).ambiguous
    assert walk(spark, both, True).hit_t1


def test_gap_below_the_stop_exits_at_the_open(spark):
    assert walk(spark, [(90, 91, 89, 90)]).exit == 90.0


def test_trailing_after_the_first_target(spark):
    row = walk(spark, [(100, 111, 99, 110), (110, 112, 99, 100)])
    assert row.outcome == "T1_HIT_TRAILED_OUT" and row.exit == pytest.approx(100.2) and row.days_t1 == 1


def test_excursion_stops_counting_at_the_exit(spark):
    row = walk(spark, [(100, 102, 94, 95), (95, 150, 95, 150)])
    assert row.mfe == pytest.approx(2) and row.mfe_full == pytest.approx(50)


def test_trades_do_not_overlap(spark):
    x = spark.createDataFrame([("A", 1, 10), ("A", 12, 20), ("A", 16, 30), ("A", 40, 41)], "company_id string, signal_n int, exit_n int")
    assert sorted(one(setups.take(x), "signal_n")) == [1, 16, 40]


def test_capped_allocation_is_the_greedy_rule(spark):
    rows = [("s", float(100 - i), i) for i in range(6)]
    got = ranking.capped_allocation(spark.createDataFrame(rows, "sector string, conviction double, id int"), ["sector"], "conviction", "id", 5.0, 18.0)
    assert [r.weight for r in got.orderBy("id").collect()] == [5.0, 5.0, 5.0, 3.0]


def test_wilson_bounds(spark):
    low, high = f.wilson(F.lit(22.0), F.lit(84.0))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert row.low == pytest.approx(18.0, abs=0.1) and row.high == pytest.approx(36.5, abs=0.1)


def test_implied_growth_recovers_the_growth_of_a_value(spark):
    x = spark.range(1).select(f.implied_growth(F.lit(100.0), f._present_value(F.lit(100.0), F.lit(12.5))).alias("g"), f.implied_growth(F.lit(-1.0), F.lit(10.0)).alias("none")).first()
    assert x.g == pytest.approx(12.5, abs=1e-3) and x.none is None


def test_implied_growth_of_many_rows_equals_a_plain_loop(spark):
    """Early and late stops, both ends and nulls in one batch; 200,000 rows took a minute as a fold."""

    def plain(cash, value):
        def gap(g):
            q = (1 + g / 100) / 1.12
            return cash * ((10 if abs(q - 1) < 1e-12 else q * (1 - q**10) / (1 - q)) + q**10 * 1.05 / (0.12 - 0.05)) - value

        if cash is None or value is None or cash <= 0 or value <= 0:
            return None
        lo, hi = -50.0, 200.0
        if gap(lo) >= 0 or gap(hi) <= 0:
            return lo if gap(lo) >= 0 else hi
        for _ in range(60):
            mid = (lo + hi) / 2
            if abs(gap(mid)) < 0.01:
                return mid
            lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
        return (lo + hi) / 2

    flows = [None, -1.0, 0.0, 0.001, 0.7, 3.0, 1234.5, 9e6]
    pairs = [(c, v) for c in flows for v in (None, -5.0, 0.0, *(c * m for m in (0.5, 2, 11.3, 15, 60, 5000, 10**6) if c))]
    x = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, cash double, value double").withColumn("g", f.implied_growth(F.col("cash"), F.col("value")))
    got = {r.i: r.g for r in x.collect()}
    for i, p in enumerate(pairs):
        assert got[i] == (None if plain(*p) is None else pytest.approx(plain(*p), abs=1e-9)), p
    began = time.monotonic()
    cash = F.col("id") % 997 + 100.5
    assert spark.range(0, 200_000, 1, 2).select(F.count_if(f.implied_growth(cash, cash * (5 + F.col("id") % 60)).between(-50, 200))).first()[0] == 200_000
    assert time.monotonic() - began < 15


def test_keywords_change_the_case_of_a_text_once(spark):
    """First class in order, counts of words, null texts; no lambda, in which a whole text would be lowered or raised anew for every word."""
    texts = ["Audited financial results, q1 and dividend", "the fda and a SHOW cause", "esop", "an order for a new plant", "plain", "", None, "Fraud, fraud and growth", "growth secured, fraud", "5-YEAR plan", "cfo resigns; capex", "order worth Rs. 1,250.5 cr"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    (kind, weight), (event, materiality, size) = f.filing_class(t), f.event_of(t)
    good, bad = f.contradictions(F.array(t), F.array(t)), f.direction(t, F.lit(20.0))
    x = x.select("i", kind.alias("kind"), weight.alias("weight"), event.alias("event"), materiality.alias("materiality"), size.alias("size"), bad.alias("direction"), f.track(F.lit("DIVIDEND"), t).alias("track"), good.alias("both"))
    got = x.orderBy("i").collect()
    other = "GENERAL_CORPORATE_DISCLOSURE"
    assert [r.kind for r in got] == ["EARNINGS_RESULT", "REGULATORY_ACTION", "ESOP_ALLOTMENT", "CAPACITY_EXPANSION", other, other, other, other, other, other, "CAPACITY_EXPANSION", "ORDER_WIN"]
    assert [r.weight for r in got] == ["HIGH", "HIGH", "LOW", "HIGH", "LOW", "LOW", "LOW", "LOW", "LOW", "LOW", "HIGH", "HIGH"]
    assert [r.event for r in got] == ["OTHER"] * 3 + ["CAPEX"] + ["OTHER"] * 6 + ["CAPEX", "ORDER_WIN"] and [r.materiality for r in got] == [0.5] * 3 + [0.8] + [0.5] * 6 + [0.8, 0.75]
    assert not any(r.both for r in got) and [r.size for r in got] == [None] * 11 + [12_505_000_000.0]
    assert [r.direction for r in got] == [0.5, -1.0, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0, 1.0, 0.5, 0.5, 0.5] and [r.track for r in got] == ["TACTICAL"] * 3 + ["STRUCTURAL"] + ["TACTICAL"] * 5 + ["STRUCTURAL"] + ["TACTICAL"] * 2
    assert "lambda" not in x.drop("both")._jdf.queryExecution().optimizedPlan().toString()


def test_crore_values(spark):
    x = spark.createDataFrame([("Rs. 1,200.5 Crore order",), ("USD 50 Mn deal",), ("nothing",), (None,)], "t string").select(f.crore_value(F.col("t")).alias("v"))
    assert one(x, "v") == [1200.5, 420.0, None, None]


def test_hash_ignores_column_order(spark):
    x = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    a, b = x.select(f.canonical_hash(["a", "b"]).alias("h")).first().h, x.select(f.canonical_hash(["b", "a"]).alias("h")).first().h
    assert a == b and len(a) == 64


def test_market_concentration(spark):
    x = calibration.concentration(spark.createDataFrame([("g", 50.0), ("g", 30.0), ("g", 20.0)], "g string, v double"), "g", "v").first()
    assert x.hhi == pytest.approx(3800) and x.cr3 == pytest.approx(100)


def test_delivery_file_with_padded_headers(spark, tmp_path):
    text = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER\n"
    text += "AAA, EQ, 01-Jan-2024, 10, 10, 12, 9, 11, 11, 11, 1000, 250, 5, 600, 60\nBBB, GS, 01-Jan-2024, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, -, -\nCCC, BE, 01-Jan-2024, 5, 5, 6, 4, 5, 5, 5, 10, 1, 1, -, -\n"
    (tmp_path / "sec_01012024.csv").write_text(text)
    rows = parsers.delivery_files(spark, str(tmp_path)).orderBy("company_id").collect()
    assert [r.company_id for r in rows] == ["AAA", "CCC"] and rows[0].turnover_cr == 2.5 and rows[1].delivery_qty == 0 and str(rows[0].trading_date) == "2024-01-01"


def test_statement_tables_and_aliases(spark):
    html = "<table><tr><th></th><th>Mar 2023</th><th>Mar 2024</th></tr><tr><td>Sales +</td><td>1,000</td><td>1,200</td></tr><tr><td>Net Profit</td><td>10</td><td>12</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    long = parsers.statement_tables(pages)
    got = parsers.normalised_statements(long, {"revenue": ("revenue", "sales"), "pat": ("net profit",)}).orderBy("period").collect()
    assert [(r.period, r.revenue, r.pat) for r in got] == [("Mar 2023", 1000.0, 10.0), ("Mar 2024", 1200.0, 12.0)]


def test_corporate_action_subjects(spark):
    x = spark.createDataFrame([("Bonus 1:1",), ("Face value split from Rs 10 to Rs 2",), ("AGM",)], "subject string")
    assert [(r.action, r.factor) for r in parsers.corporate_actions(x).collect()] == [("BONUS", 0.5), ("SPLIT", 0.2), ("OTHER", 1.0)]
