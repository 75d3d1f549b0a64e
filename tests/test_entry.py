"""The registered queries: names, SQL counterparts, and independence from the optional text operators."""

import subprocess
import sys

import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    code = "import sys; sys.modules['vintage.llm'] = None; from vintage.plans import catalogue; assert catalogue.queries(); print(len(catalogue.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 50


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if pd.isna(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, (str, bool)) else str(v)[:19].removesuffix(" 00:00:00")


def rows(frame):
    """Rows as tuples, ordered by what is not a fraction."""
    values = [tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()]
    return sorted(values, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


@pytest.fixture(scope="module")
def tables():
    import duckdb

    out = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


VALUES = (
    "near_high_screen", "J1_bitemporal_as_of", "A19_breadth", "W33_trend_template", "J1_strict_system_time", "M1_feature_vector", "M4_longterm", "M5_swing", "M13_valuation_regime", "F24_latent_upside", "F27_lifecycle",
    "W22_dso_derivatives", "W24_incremental_roic", "W25_roic_momentum", "A20_mood_index", "T6_scan_rank", "W3_wilder_rsi", "F6_event_parser", "F7_filing_class", "F38_regime", "P4_predicates", "U4_metamorphic",
    "W12_drawdown", "W14_first_passage", "W16_path_vector", "W36_wilder_history", "W4_year_range", "W20_acceleration_vector", "M23_historical_replay", "A27_replay_eligibility", "J16_substring_lookup", "J16_theme_of_text", "F25_market_of_segment",
    "J23_nearest_preceding", "J23_nearest_either_side", "R2_baskets", "R6_usable", "S22_bar_merge", "S14_truth_log", "M20_staged_screen", "F30_missing_data_guard", "M10_continuation_verdicts", "A14_tournament_top5", "U4_future_blind", "M27_barrier_labels",
)


@pytest.mark.parametrize("name", VALUES)
def test_query_agrees_with_its_sql(spark, tables, name):
    """All values, not only their number; a result is never empty."""
    got, want = entry.queries()[name](spark, SMALL).toPandas(), tables.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for g, w in zip(rows(got), rows(want), strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=2e-4) for x, y in zip(g, w, strict=True)), (g, w)
