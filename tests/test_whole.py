"""Queries that return every row where the query of the shorter name is thinned like its SQL."""

import math
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from vintage.sources import adapters

SMALL = "/root/testdata/sf0.001"


def rows(frame, keys):
    """Rows as tuples in the order of their keys; numbers as floats, dates as text."""
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, (str, bool)) else str(v)[:19].removesuffix(" 00:00:00")

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist()), key=lambda r: tuple(str(r[columns.index(k)]) for k in keys))


def agrees(spark, name, keys, sf_dir=SMALL):
    """The number of rows, each of which agrees with the SQL."""
    import duckdb

    tables = duckdb.connect()
    for t in "customer part orders lineitem documents".split():
        tables.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = rows(entry.queries()[name](spark, sf_dir).toPandas(), keys), rows(tables.execute(entry.oracle_sql()[name]).df(), keys)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=2e-4) for x, y in zip(g, w, strict=True)), (g, w)
    return len(got)


def test_rsi_of_every_bar_matches_a_plain_loop(spark):
    closes = defaultdict(list)
    for b in adapters.bars(spark, SMALL).orderBy("trading_date").collect():
        closes[b.company_id].append((b.trading_date, b.close))
    got = {(r.company_id, r.trading_date): r.rsi14 for r in entry.queries()["W3_wilder_rsi_all"](spark, SMALL).collect()}
    assert len(got) == sum(map(len, closes.values()))
    for company, series in closes.items():
        for i in range(0, len(series), 1 if company == min(closes) else 7):
            c = [p for d, p in series[: i + 1] if (series[i][0] - d).days <= 400]
            deltas = [y - x for x, y in zip(c, c[1:], strict=False)]
            want = 50.0
            if len(deltas) >= 14:
                gain, loss = sum(max(d, 0) for d in deltas[:14]) / 14, sum(max(-d, 0) for d in deltas[:14]) / 14
                for d in deltas[14:]:
                    gain, loss = (gain * 13 + max(d, 0)) / 14, (loss * 13 + max(-d, 0)) / 14
                want = 100 - 100 / (1 + gain / loss) if loss else 100.0 if gain else 50.0
            assert got[company, series[i][0]] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("name", ["W9_atr_contraction_all", "W35_percentile_all"])
def test_every_bar_is_reported(spark, name):
    assert agrees(spark, name, ["company_id", "trading_date"]) == adapters.bars(spark, SMALL).count()


@pytest.mark.parametrize(("name", "keys"), [
    ("F22_implied_growth_all", ["o_orderkey"]),
    ("S11_snapshot_all", ["company_id", "period_end", "vintage"]),
    ("J15_absorbed_all", ["company_id", "happened"]),
])
def test_no_company_or_key_is_left_out(spark, name, keys):
    n = agrees(spark, name, keys)
    filings = adapters.filings(spark, SMALL)
    whole = {"F22": adapters.table(spark, SMALL, "orders"), "S11": filings, "J15": filings.select("company_id", "period_end").distinct()}
    assert n == whole[name[:3]].count()
