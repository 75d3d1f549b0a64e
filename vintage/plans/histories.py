"""Queries over replayed histories, lookups by text and tolerance reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, replay, timeline
from ..sources import adapters as a
from ..sources import statements as s
from ..sources.stored import stored
from .fundamentals import _rounded, vector
from .feature_sql import FEATURES
from .registry import query
from .views import CALM, FILINGS

c = F.col

# --- lookups by text -----------------------------------------------------------------------

#: Keys in order of precedence, with ties: texts hold several of them, some keys hold others.
THEMES = (
    (0, "widget", "WIDGETS"), (1, "red", "COLOURED"), (2, "gear", "GEARS"), (3, "ring", "RINGS"), (4, "small", "SIZED"), (5, "small ring", "SMALL RINGS"), (6, "e", "ANY"), (7, "on", "SYLLABLES"), (8, "the an", "PHRASES"), (9, "tion", "SYLLABLES"),
)
_THEMES = "themes(place, word, theme) AS (VALUES " + ", ".join(f"({p}, '{k}', '{t}')" for p, k, t in THEMES) + ")"


def _themes(spark):
    return spark.createDataFrame(THEMES, "place int, word string, theme string")


@query("J16_substring_lookup", f"""WITH {_THEMES} SELECT p_partkey, p_name, word, theme FROM (SELECT p_partkey, p_name, word, theme, row_number() OVER (PARTITION BY p_partkey ORDER BY upper(p_name) <> upper(word), place, word) AS k FROM part LEFT JOIN themes ON contains(upper(p_name), upper(word))) WHERE k = 1""")
def substring_lookup(spark, sf_dir):
    """The first theme whose word equals a part's name, or else is a part of it."""
    return lookup.first_contained(a.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _themes(spark), "word", "place").select("p_partkey", "p_name", "word", "theme")


@query("J16_theme_of_text", f"""WITH {_THEMES} SELECT doc_id, word, theme FROM (SELECT doc_id, word, theme, row_number() OVER (PARTITION BY doc_id ORDER BY upper(trim(text)) <> upper(word), place DESC, word) AS k FROM documents LEFT JOIN themes ON contains(upper(trim(text)), upper(word))) WHERE k = 1""")
def theme_of_text(spark, sf_dir):
    """The same over whole documents, with the reverse precedence."""
    themes = _themes(spark).withColumn("place", -c("place"))
    return lookup.first_contained(a.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", themes, "word", "place").select("doc_id", "word", "theme")


_SEGMENT_SQL = "segments AS (SELECT CAST(c_nationkey AS VARCHAR) AS company_id, c_mktsegment AS sector, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY c_nationkey, c_mktsegment), sectors AS (SELECT company_id, sector FROM segments WHERE k = 1)"
_WORDS = [(i, w, m) for i, (m, ws) in enumerate(lookup.MARKET_WORDS) for w in ws]
_MARKETS = (
    "words(place, word, named) AS (VALUES " + ", ".join(f"({i}, '{w}', '{m}')" for i, w, m in _WORDS) + "), companies(symbol, listed) AS (VALUES " + ", ".join(f"('{n}', '{m}')" for m, ns in lookup.MARKET_COMPANIES for n in ns.split())
    + "), sizes(market, niche_tam, macro_tam) AS (VALUES " + ", ".join(f"('{m}', {n}::DOUBLE, {t}::DOUBLE)" for m, n, t in lookup.MARKETS) + ")"
)


def _market_of(table: str) -> str:
    """SQL: rows of ``table(company_id, sector)`` with their market."""
    return f"""{_MARKETS}, named AS (SELECT company_id, sector, coalesce(listed, (SELECT arg_min(named, (place, word)) FROM words WHERE contains(upper(trim(sector)), word)), '{lookup.OTHER_MARKET}') AS market FROM {table} LEFT JOIN companies ON symbol = upper(trim(company_id))), marketed AS (SELECT company_id, market, niche_tam, macro_tam FROM named JOIN sizes USING (market))"""


def sectors(spark, sf_dir):
    """A nation's sector: the market segment of most of its customers."""
    n = a.table(spark, sf_dir, "customer").groupBy(c("c_nationkey").cast("string").alias("company_id"), c("c_mktsegment").alias("sector")).count()
    return n.groupBy("company_id").agg(F.min_by("sector", F.struct(-c("count"), "sector")).alias("sector"))


_HURDLE = """target AS (SELECT *, floor(greatest(market_cap, 10) * 10 * 100 + 0.5) / 100 AS target_cap FROM sized), pats AS (SELECT *, floor(target_cap / 28 * 100 + 0.5) / 100 AS needed_pat FROM target), turnovers AS (SELECT *, floor(needed_pat / 0.12::DOUBLE * 100 + 0.5) / 100 AS needed_revenue FROM pats), hurdle AS (
  SELECT *, floor(needed_revenue / niche_tam * 100 * 100 + 0.5) / 100 AS needed_niche_pct, floor(needed_revenue / macro_tam * 100 * 100 + 0.5) / 100 AS needed_macro_pct, coalesce(floor(ttm_revenue / niche_tam * 100 * 100 + 0.5) / 100, 0) AS niche_pct FROM turnovers), feasible AS (
  SELECT *, CASE WHEN needed_niche_pct <= 15 THEN 'HIGH_FEASIBILITY_RUNWAY' WHEN needed_niche_pct <= 35 THEN 'STRETCH_TARGET' WHEN needed_macro_pct <= 15 THEN 'REQUIRES_ADJACENT_EXPANSION' ELSE 'MATHEMATICALLY_ABSURD' END AS feasibility FROM hurdle)"""


@query("F25_market_of_segment", f"WITH spots AS (SELECT c_name AS company_id, c_mktsegment AS sector FROM customer UNION ALL SELECT s_name, CASE s_suppkey % 4 WHEN 0 THEN 'Retail Banks' WHEN 1 THEN 'mining & STEEL' WHEN 2 THEN NULL ELSE 'Biotech devices' END FROM supplier UNION ALL SELECT CASE r_regionkey WHEN 0 THEN ' dixon ' WHEN 1 THEN 'LT' ELSE r_name END, 'Software' FROM region), {_market_of('spots')} SELECT company_id, market, niche_tam, macro_tam FROM marketed")
def market_of_segment(spark, sf_dir):
    """Symbols first, then words of the sector in order, then the general market."""
    spots = a.table(spark, sf_dir, "customer").select(c("c_name").alias("company_id"), c("c_mktsegment").alias("sector"))
    k = c("s_suppkey") % 4
    spots = spots.unionAll(a.table(spark, sf_dir, "supplier").select("s_name", F.when(k == 0, "Retail Banks").when(k == 1, "mining & STEEL").when(k == 3, "Biotech devices")))
    r = c("r_regionkey")
    spots = spots.unionAll(a.table(spark, sf_dir, "region").select(F.when(r == 0, " dixon ").when(r == 1, "LT").otherwise(c("r_name")), F.lit("Software")))
    return lookup.markets(spots, "company_id", "sector").select("company_id", "market", "niche_tam", "macro_tam")


@query("F25_tenfold_hurdle", f"WITH {FEATURES}, {_SEGMENT_SQL}, {_market_of('sectors')}, sized AS (SELECT t0, f.company_id, market, niche_tam, macro_tam, market_cap, ttm_revenue FROM features f JOIN marketed USING (company_id)), {_HURDLE} SELECT company_id, t0, market, needed_revenue, needed_niche_pct, needed_macro_pct, niche_pct, CASE WHEN needed_revenue <= coalesce(ttm_revenue, 0) * 2.5 THEN 'WITHIN_EXISTING_RUNWAY' ELSE 'REQUIRES_SUBSTANTIAL_GREENFIELD_CAPEX' END AS capacity, feasibility FROM feasible")
def tenfold_hurdle(spark, sf_dir):
    x = vector(spark, sf_dir).select("company_id", "t0", "market_cap", "ttm_revenue").join(sectors(spark, sf_dir), "company_id")
    x = lookup.tenfold_hurdle(lookup.markets(x, "company_id", "sector"))
    return x.select("company_id", "t0", "market", "needed_revenue", "needed_niche_pct", "needed_macro_pct", "niche_pct", "capacity", "feasibility")


# --- nearest within a tolerance ------------------------------------------------------------

_NEAR = f"""WITH {FILINGS}, q AS (SELECT DISTINCT company_id, period_end + CASE WHEN month(period_end) % 2 = 0 THEN 0 ELSE 20 END AS want FROM filings), b AS (SELECT company_id, period_end, revenue FROM filings WHERE vintage = 0 AND quarter(period_end) IN (2, 4)),
 p AS (SELECT q.company_id, want, period_end, revenue, abs(want - period_end) AS gap, row_number() OVER (PARTITION BY q.company_id, want ORDER BY abs(want - period_end), period_end) AS k FROM q JOIN b ON b.company_id = q.company_id AND {{side}} AND abs(want - period_end) <= {{days}})
SELECT q.company_id, q.want, p.period_end AS found, round(p.revenue, 2) AS revenue FROM q LEFT JOIN p ON p.company_id = q.company_id AND p.want = q.want AND k = 1"""


def _nearest(spark, sf_dir, days, preceding_only):
    f = a.filings(spark, sf_dir)
    want = f.select("company_id", F.date_add("period_end", F.when(F.month("period_end") % 2 == 0, 0).otherwise(20)).alias("want")).distinct()
    known = f.where((c("vintage") == 0) & F.quarter("period_end").isin(2, 4)).select("company_id", "period_end", "revenue")
    return timeline.nearest_within(want, known, "want", "period_end", days, preceding_only).select("company_id", "want", "found", F.round("revenue", 2).alias("revenue"))


@query("J23_nearest_preceding", _NEAR.format(side="b.period_end <= want", days=100))
def nearest_preceding(spark, sf_dir):
    return _nearest(spark, sf_dir, 100, True)


@query("J23_nearest_either_side", _NEAR.format(side="true", days=75))
def nearest_either_side(spark, sf_dir):
    return _nearest(spark, sf_dir, 75, False)


@query("J23_exact", _NEAR.format(side="true", days=0))
def nearest_exact(spark, sf_dir):
    return _nearest(spark, sf_dir, 0, False)


# --- replay --------------------------------------------------------------------------------

_QUARTERS = """ord AS (SELECT company_id, period_end, row_number() OVER (PARTITION BY company_id ORDER BY period_end) AS k, count(*) OVER (PARTITION BY company_id) AS n FROM (SELECT DISTINCT company_id, period_end FROM statements WHERE period_type = 'QUARTERLY')),
 reading AS (SELECT company_id, CAST(period_end + INTERVAL 45 DAY AS DATE) AS t0 FROM ord WHERE k >= 5 AND n >= 8), versions AS (
 SELECT r.t0, q.*, row_number() OVER (PARTITION BY r.company_id, r.t0, q.period_end ORDER BY q.published DESC, q.vintage DESC) AS v FROM reading r JOIN statements q ON q.company_id = r.company_id AND q.published <= r.t0 AND q.period_type = 'QUARTERLY'),
 aged AS (SELECT *, row_number() OVER (PARTITION BY company_id, t0 ORDER BY period_end DESC) - 1 AS k, count(*) OVER (PARTITION BY company_id, t0) AS held FROM versions WHERE v = 1 QUALIFY k < 8)"""


def _yoy(k: int, name: str) -> str:
    """SQL column of the growth of the k-th newest period: the period a year before by month, quarter, or four back."""
    base = f"coalesce(max(CASE WHEN b.k = {k} THEN m.{name} END), max(CASE WHEN b.k = {k} THEN q.{name} END), max(CASE WHEN b.k = {k + 4} THEN b.{name} END))"
    mine = f"max(CASE WHEN b.k = {k} THEN b.{name} END)"
    return f"CASE WHEN {base} IS NOT NULL THEN CASE WHEN abs({base}) < 0.1 THEN 0 ELSE round(({mine} - {base}) / abs({base}) * 100, 2) END END"


def _newest(name: str) -> str:
    return f"arg_min(b.{name}, b.k) FILTER (b.{name} IS NOT NULL)"


_STATE = f"""{_QUARTERS}, state AS (SELECT b.company_id, b.t0, count(*) AS held, max(b.published) AS source_published, max(b.period_end) AS source_period_end, {', '.join(f"coalesce(sum(b.{n}) FILTER (b.k < 4), 0) AS ttm_{n}" for n in ('revenue', 'ebit', 'pat'))},
  {_newest('net_worth')} AS net_worth, coalesce({_newest('total_debt')}, 0) AS debt, coalesce({_newest('cash')}, 0) AS cash, {_newest('shares')} AS shares, coalesce(max(CASE WHEN b.k = 0 THEN b.depreciation END), 0) AS depreciation, coalesce(max(CASE WHEN b.k = 0 THEN b.capex END), 0) AS capex,
  {', '.join(f"CASE WHEN count(*) >= 6 THEN {_yoy(k, n)} END AS {n}{k}" for n in ('revenue', 'ebit') for k in (0, 1))}, {', '.join(f"CASE WHEN count(*) >= {6 if k < 2 else 5 + k} THEN {_yoy(k, 'pat')} END AS pat{k}" for k in range(4))},
  CASE WHEN count(*) >= 6 THEN round(max(CASE WHEN b.k = 0 THEN b.ebit / greatest(0.1, b.revenue) * 100 END), 2) - round(max(CASE WHEN b.k = 4 THEN b.ebit / greatest(0.1, b.revenue) * 100 END), 2) END AS margin_change
  FROM aged b LEFT JOIN aged m ON m.company_id = b.company_id AND m.t0 = b.t0 AND year(m.period_end) = year(b.period_end) - 1 AND month(m.period_end) = month(b.period_end)
   LEFT JOIN aged q ON q.company_id = b.company_id AND q.t0 = b.t0 AND year(q.period_end) = year(b.period_end) - 1 AND quarter(q.period_end) = quarter(b.period_end) GROUP BY b.company_id, b.t0),
 accel AS (SELECT *, round(revenue0 - revenue1, 2) AS ra, round(ebit0 - ebit1, 2) AS ea, round(pat0 - pat1, 2) AS pa, round(pat1 - pat2, 2) AS a1, round(pat2 - pat3, 2) AS a2 FROM state),
 moved AS (SELECT *, coalesce((pa > 5 AND ra > 0) OR (ea > 8 AND round(margin_change, 2) > 1), false) AS accelerating, CASE WHEN pa > 0 THEN CASE WHEN a1 > 0 THEN CASE WHEN a2 > 0 THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END AS persistence,
  CASE WHEN pa IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN pa >= 15 AND ra >= 10 AND round(margin_change, 2) > 1.5 THEN 'ACCELERATING_EARNINGS_EXPLOSION' WHEN pa > 5 AND ra > 0 THEN 'STEADY_ACCELERATION' WHEN pa >= -5 AND pat0 >= 20 THEN 'HIGH_PLATEAU_COMPOUNDING' WHEN pa < -10 THEN 'DECELERATING_SLOWDOWN' ELSE 'NORMAL_FLUCTUATION' END AS acceleration_status FROM accel)"""

_ONLY = FEATURES.split(", dates AS")[0]


@query("W20_acceleration_vector", f"WITH {_ONLY}, {_STATE} SELECT company_id, t0, ra AS revenue_acceleration, ea AS ebit_acceleration, pa AS pat_acceleration, round(margin_change, 2) AS margin_change, accelerating, persistence, acceleration_status FROM moved")
def acceleration_vector(spark, sf_dir):
    """Earnings acceleration of every company at every reading date, from the vintages known then."""
    rows = s.statements(spark, sf_dir)
    x = replay.acceleration(timeline.carried_periods(rows, replay.reading_dates(rows), "QUARTERLY", 8))
    return x.select("company_id", "t0", "revenue_acceleration", "ebit_acceleration", "pat_acceleration", "margin_change", "accelerating", "persistence", "acceleration_status")


def replayed(spark, sf_dir):
    rows = stored(s.statements(spark, sf_dir), "statements")
    return rows, replay.replay(rows, stored(s.listed_bars(spark, sf_dir), "bars"), sectors(spark, sf_dir))


_PRICED = f"""{_ONLY}, {_STATE}, {s.LISTED}, closes AS (SELECT m.*, (SELECT arg_max(close, trading_date) FROM listed l WHERE l.company_id = m.company_id AND l.trading_date BETWEEN m.t0 - 30 AND m.t0) AS price FROM moved m), {_SEGMENT_SQL}, {_market_of('sectors')},
 sized AS (SELECT c.*, market, niche_tam, macro_tam, coalesce(round(price * CASE WHEN shares > 0 THEN shares END / 10000000, 2), net_worth, 0) AS market_cap FROM closes c JOIN marketed USING (company_id)), {_HURDLE}, lenses AS (
 SELECT *, CASE WHEN ttm_pat > 0 AND market_cap > 0 THEN round(market_cap / greatest(0.1, ttm_pat), 1) END AS pe, CASE WHEN coalesce(net_worth, 0) + debt - cash > 0 THEN round(ttm_ebit * 0.75 / (coalesce(net_worth, 0) + debt - cash) * 100, 2) END AS roic,
  least(greatest(0, capex), greatest(0.1, depreciation) * 1.06) AS maintained FROM feasible), spent AS (SELECT *, greatest(0, round(greatest(0, capex) - maintained, 2)) AS growth_capex FROM lenses), rated AS (
 SELECT *, round(growth_capex / greatest(1, ttm_ebit * 0.75) * 100, 2) AS reinvestment, round(greatest(coalesce(revenue0, 15), 0) - 12, 2) AS lead FROM spent), future AS (
 SELECT r.company_id, r.t0, l.trading_date, l.close, first(l.close) OVER o AS p0, max(l.close) OVER o AS peak FROM reading r JOIN listed l ON l.company_id = r.company_id AND l.trading_date >= r.t0 WINDOW o AS (PARTITION BY r.company_id, r.t0 ORDER BY l.trading_date)), became AS (
 SELECT company_id, t0, count(*) AS bars, max((close / p0 - 1) * 100) AS run, min((close - peak) / peak * 100) AS fall, max(trading_date) AS label_end, (arg_max(close, trading_date) - any_value(p0)) / greatest(0.1, any_value(p0)) AS gain FROM future GROUP BY company_id, t0 HAVING count(*) >= 30)"""


@query("M23_historical_replay", f"""WITH {_PRICED} SELECT r.company_id, r.t0, source_period_end, source_published, round(ttm_revenue, 4) AS ttm_revenue, round(ttm_pat, 4) AS ttm_pat, round(market_cap, 2) AS market_cap, roic, growth_capex, reinvestment, market, feasibility, acceleration_status,
  CASE WHEN lead > 10 THEN 'UNORGANIZED_TO_ORGANIZED_FORMALIZATION' WHEN lead > 5 THEN 'HIGH_COST_INCUMBENT_DISPLACEMENT' ELSE 'INDUSTRY_BETA_EXPANSION' END AS displacement,
  CASE WHEN coalesce(roic, 15) >= 20 AND accelerating THEN 80 WHEN coalesce(roic, 15) >= 15 OR accelerating THEN 65 ELSE 45 END AS score, CASE WHEN coalesce(roic, 15) >= 20 AND accelerating THEN 'CONVICTION_BUY' WHEN coalesce(roic, 15) >= 15 OR accelerating THEN 'ACCUMULATE_ON_DIPS' ELSE 'WATCHLIST' END AS verdict,
  label_end, CAST(label_end - r.t0 AS INT) AS elapsed_days, round(gain * 100, 2) AS wealth_return, round(run, 3) AS max_run, round(fall, 3) AS max_drawdown, CASE WHEN run >= 900 THEN '10X' WHEN run >= 400 THEN '5X' WHEN run >= 100 THEN '2X' END AS event,
  CASE WHEN run >= 100 THEN 'EVENT_OBSERVED' WHEN bars >= 756 THEN 'MATURE' WHEN bars IS NOT NULL THEN 'RIGHT_CENSORED' END AS censoring FROM rated r LEFT JOIN became b ON b.company_id = r.company_id AND b.t0 = r.t0""")
def historical_replay(spark, sf_dir):
    """Every quarter's snapshot from the vintages known 45 days after its end, its verdict and its outcome."""
    _, x = replayed(spark, sf_dir)
    return x.select(
        "company_id", "t0", "source_period_end", "source_published", "ttm_revenue", "ttm_pat", F.round("market_cap", 2).alias("market_cap"), "roic", "growth_capex", "reinvestment", "market", "feasibility", "acceleration_status", "displacement", "score", "verdict",
        "label_end", "elapsed_days", "wealth_return", *_rounded(x, ("max_run", "max_drawdown"), 3), "event", "censoring",
    )


@query("A27_replay_eligibility", f"""WITH {_ONLY}, {_QUARTERS}, n AS (SELECT company_id, count(DISTINCT period_end) AS quarters FROM statements WHERE period_type = 'QUARTERLY' GROUP BY 1), d AS (SELECT company_id, count(DISTINCT t0) AS snapshots FROM aged GROUP BY 1)
SELECT company_id, quarters, coalesce(snapshots, 0) AS snapshots, round(least(100, quarters / 40.0 * 100) * 0.5 + 50, 2) AS completeness, CASE WHEN quarters < 8 THEN 'QUARANTINED_INSUFFICIENT_FINANCIALS' WHEN quarters >= 16 THEN 'FULLY_ELIGIBLE' ELSE 'PARTIALLY_ELIGIBLE' END AS status, quarters >= 6 AS live, quarters >= 12 AND coalesce(snapshots, 0) >= 4 AS training FROM n LEFT JOIN d USING (company_id)""")
def replay_eligibility(spark, sf_dir):
    rows = s.statements(spark, sf_dir)
    dates = replay.reading_dates(rows)
    return replay.eligibility(rows, timeline.carried_periods(rows, dates, "QUARTERLY", 8).where(F.size("periods") > 0))


# --- nothing from the future ---------------------------------------------------------------

T0 = "2000-06-30"


@query("U4_future_blind", f"""WITH {CALM}, {s.LISTED}, k AS (SELECT *, row_number() OVER o AS n, CASE WHEN lag(close) OVER o IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END AS tr FROM listed WHERE trading_date <= DATE '{T0}' WINDOW o AS (PARTITION BY company_id ORDER BY trading_date)),
 m AS (SELECT company_id, trading_date, n, close, avg(close) OVER (PARTITION BY company_id ORDER BY trading_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma50, avg(tr) OVER (PARTITION BY company_id ORDER BY trading_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr, max(high) OVER (PARTITION BY company_id ORDER BY trading_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high_52w FROM k)
SELECT company_id, trading_date, round(close, 5) AS close, round(CASE WHEN n >= 50 THEN sma50 END, 5) AS sma50, round(atr, 5) AS atr, round(high_52w, 5) AS high_52w, CAST(0 AS BIGINT) AS differ FROM m WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY trading_date DESC) = 1""")
def future_blind(spark, sf_dir):
    """Technical features at a date, computed while every later bar is poisoned and strange companies are added; ``differ`` counts those that the poison moves. The SQL has never seen a later bar."""
    from ..operators import features

    bars = stored(s.listed_bars(spark, sf_dir), "bars")
    late = c("trading_date") > F.lit(T0).cast("date")
    poisoned = bars.withColumns({k: F.when(late, c(k) * 1000 + 7).otherwise(c(k)) for k in ("open", "high", "low", "close", "volume")})
    more = poisoned.unionByName(bars.withColumn("company_id", F.concat(F.lit("poison "), "company_id"))).unionByName(bars.where(late).withColumn("trading_date", F.date_add("trading_date", 5000)))
    dates = bars.select("company_id").distinct().withColumn("t0", F.lit(T0).cast("date"))
    clean, seen = features.technicals(bars.where(~late), dates), features.technicals(more, dates)
    names = [k for k in clean.columns if k not in ("company_id", "t0")]
    both = seen.join(clean.select("company_id", *(c(k).alias(f"clean_{k}") for k in names)), "company_id")
    differ = sum(((~c(k).eqNullSafe(c(f"clean_{k}"))).cast("long") for k in names), F.lit(0).cast("long"))
    return both.select("company_id", "trading_date", *(F.round(k, 5).alias(k) for k in ("close", "sma50", "atr", "high_52w")), differ.alias("differ"))
