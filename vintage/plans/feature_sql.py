"""The feature vector as SQL: chained common tables up to ``features``, one row per company and date."""

from ..sources.statements import DATES, LISTED, STATEMENTS
from .views import CALM, W, over

_SUMS = ("revenue", "ebitda", "ebit", "depreciation", "pat", "cfo", "capex", "eps")
_OWN = "coalesce(net_worth, 0) + coalesce(total_debt, 0)"


def newest(name: str, kind: str, years: int, limit: int) -> str:
    return f"""{name}_all AS (
  SELECT d.t0, s.*, row_number() OVER (PARTITION BY d.company_id, d.t0, s.period_end ORDER BY s.published DESC, s.vintage DESC) AS version
  FROM dates d JOIN statements s ON s.company_id = d.company_id AND s.published <= d.t0 WHERE s.period_type = '{kind}' AND year(s.period_end) >= year(d.t0) - {years}), {name} AS (
  SELECT *, row_number() OVER (PARTITION BY company_id, t0 ORDER BY period_end DESC) AS age FROM {name}_all WHERE version = 1 QUALIFY age <= {limit})"""


def trailing(k: str) -> str:
    return f"sum({k}) FILTER (age <= periods) * max(periods) / count({k}) FILTER (age <= periods) AS ttm_{k}"


def year_ago(k: str) -> str:
    last = "year(period_end) = year(e1) - 1 AND"
    return f"coalesce(max({k}) FILTER ({last} month(period_end) = month(e1)), max({k}) FILTER ({last} quarter(period_end) = quarter(e1))) AS {k}_ago"


_ANNUAL = ("revenue", "pat", "ebit", "ebitda", "cfo", "capex", "eps", "net_worth", "total_debt", "cash", "ce", "shares")

FUNDAMENTALS = f"""{STATEMENTS}, {DATES}, {newest('nq', 'QUARTERLY', 4, 8)}, {newest('na', 'ANNUAL', 6, 4)}, gaps AS (
  SELECT *, max(CASE WHEN age = 1 THEN period_end END) OVER g AS e1, max(CASE WHEN age = 2 THEN period_end END) OVER g AS e2,
    CASE WHEN {_OWN} > 0 THEN {_OWN} WHEN total_assets > current_liabilities THEN total_assets - current_liabilities END AS ce,
    CASE WHEN total_assets > 0 AND total_assets > coalesce(current_liabilities, 0) THEN total_assets - coalesce(current_liabilities, 0) WHEN {_OWN} > 0 THEN {_OWN} END AS ce_ago
  FROM nq WINDOW g AS (PARTITION BY company_id, t0)), paced AS (SELECT *, CASE WHEN e1 - e2 > 130 THEN 2 ELSE 4 END AS periods FROM gaps), quarter_state AS (
  SELECT company_id, t0, {', '.join(trailing(k) for k in _SUMS)}, {', '.join(f"max(CASE WHEN age = 1 THEN {k} END) AS q_{k}" for k in ('revenue', 'pat', 'net_worth', 'total_debt', 'cash', 'financial_debt', 'shares', 'scope', 'period_end', 'ce'))},
    count(DISTINCT scope) FILTER (age <= periods) AS scopes, {year_ago('revenue')}, {year_ago('pat')}, arg_min(ce, age) FILTER (ce IS NOT NULL) AS older_ce, max(CASE WHEN age = 5 THEN ce_ago END) AS q_ce_ago
  FROM paced GROUP BY company_id, t0), annual_ce AS (
  SELECT *, CASE WHEN {_OWN} > 0 THEN {_OWN} WHEN total_assets > current_liabilities THEN total_assets - current_liabilities WHEN total_assets > 0 THEN total_assets END AS ce FROM na), annual_state AS (
  SELECT company_id, t0, {', '.join(f"max(CASE WHEN age = 1 THEN {k} END) AS a_{k}" for k in _ANNUAL)}, max(CASE WHEN age = 2 THEN ce END) AS a_ce_ago, count(*) AS years FROM annual_ce GROUP BY company_id, t0), merged AS (
  SELECT *, CASE WHEN q_ce IS NOT NULL THEN q_ce WHEN years IS NOT NULL THEN a_ce ELSE older_ce END AS ce0, coalesce(CASE WHEN q_ce IS NULL THEN a_ce_ago END, q_ce_ago) AS ce4,
    CASE WHEN q_ce IS NULL AND years IS NOT NULL THEN a_net_worth ELSE q_net_worth END AS net_worth, coalesce(CASE WHEN q_ce IS NULL AND years IS NOT NULL THEN a_total_debt ELSE q_total_debt END, 0) AS debt,
    coalesce(CASE WHEN q_ce IS NULL AND years IS NOT NULL THEN a_cash ELSE q_cash END, 0) AS cash, CASE WHEN ttm_cfo IS NOT NULL THEN ttm_cfo ELSE a_cfo END AS cfo,
    CASE WHEN ttm_cfo IS NOT NULL THEN coalesce(ttm_capex, 0) ELSE a_capex END AS spent
  FROM dates LEFT JOIN quarter_state USING (company_id, t0) LEFT JOIN annual_state USING (company_id, t0)), invested AS (
  SELECT *, CASE WHEN ce4 IS NULL THEN ce0 ELSE (ce0 + ce4) / 2 END AS capital, cfo - coalesce(spent, 0) AS fcf FROM merged), fundamentals AS (
  SELECT company_id, t0, q_period_end AS latest_period, q_revenue AS latest_revenue, q_pat AS latest_pat, CASE WHEN ttm_revenue > 0 THEN ttm_revenue END AS ttm_revenue, ttm_pat, ttm_ebit, ttm_ebitda,
    CASE WHEN ttm_depreciation > 0 THEN ttm_depreciation END AS ttm_depreciation, CASE WHEN scopes > 1 THEN 'MIXED' WHEN scopes = 1 THEN 'CONSISTENT' END AS scope_flag, q_scope AS scope,
    CASE WHEN ttm_revenue > 0 THEN 100 * ttm_ebitda / ttm_revenue END AS ebitda_margin, CASE WHEN ttm_revenue > 0 THEN 100 * ttm_pat / ttm_revenue END AS pat_margin,
    CASE WHEN revenue_ago > 0 THEN 100 * (q_revenue - revenue_ago) / abs(revenue_ago) END AS revenue_growth, CASE WHEN pat_ago <> 0 THEN 100 * (q_pat - pat_ago) / abs(pat_ago) END AS pat_growth,
    CASE WHEN capital > 0 THEN least(120, greatest(-50, 100 * ttm_ebit / capital)) END AS roce,
    CASE WHEN capital > 0 THEN CASE WHEN q_ce IS NULL THEN 'LAST_AUDITED_BS' WHEN ce4 IS NULL THEN 'SINGLE_PERIOD_CE' ELSE 'PERIOD_AVERAGE_CE' END ELSE 'UNAVAILABLE' END AS roce_method,
    CASE WHEN capital > 0 THEN capital END AS capital_employed, net_worth, CASE WHEN net_worth > 0 THEN debt / net_worth END AS debt_to_equity, CASE WHEN net_worth > 0 THEN (debt - cash) / net_worth END AS net_debt_to_equity,
    CASE WHEN net_worth > 0 THEN coalesce(q_financial_debt, 0) / net_worth END AS financial_debt_to_equity, CASE WHEN ttm_ebitda > 0 THEN debt / ttm_ebitda END AS debt_to_ebitda, cash - debt AS net_cash,
    cfo AS ttm_cfo, spent AS ttm_capex, fcf AS ttm_fcf, CASE WHEN ttm_pat > 0 THEN cfo / ttm_pat END AS cfo_to_pat, CASE WHEN ttm_pat > 0 THEN 100 * fcf / ttm_pat END AS fcf_conversion,
    coalesce(ttm_eps, a_eps) AS ttm_eps, q_shares AS reported_shares
  FROM invested)"""

_S = W
TECHNICALS = f"""{LISTED}, seen AS (
  SELECT *, row_number() OVER ({_S}) AS bars, lag(close) OVER ({_S}) AS prev_close, CASE WHEN lag(close) OVER ({_S}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({_S})), abs(low - lag(close) OVER ({_S}))) END AS tr FROM listed), measured AS (
  SELECT *, {', '.join(f"CASE WHEN bars >= {k} THEN avg(close) OVER {over(k)} END AS sma{k}" for k in (20, 50, 200))}, avg(tr) OVER {over(14)} AS atr, max(high) OVER {over(252)} AS high_52w, min(low) OVER {over(252)} AS low_52w,
    avg(volume) OVER {over(20)} AS vol20, CASE WHEN bars >= 50 THEN avg(volume) OVER {over(50)} END AS vol50 FROM seen), points AS (
  SELECT d.company_id, d.t0, m.* EXCLUDE (company_id) FROM dates d ASOF JOIN measured m ON m.company_id = d.company_id AND m.trading_date <= d.t0), slices AS (
  SELECT p.company_id, p.t0, b.close, row_number() OVER k - 1 AS i, b.close - lag(b.close) OVER k AS change, count(*) OVER (PARTITION BY p.company_id, p.t0) - 1 AS n
  FROM points p JOIN listed b ON b.company_id = p.company_id AND b.trading_date BETWEEN p.trading_date - 400 AND p.trading_date WINDOW k AS (PARTITION BY p.company_id, p.t0 ORDER BY b.trading_date)), smoothed AS (
  SELECT company_id, t0, max(n) AS n, sum(g * greatest(change, 0)) AS gain, sum(g * greatest(-change, 0)) AS loss
  FROM (SELECT *, CASE WHEN i <= 14 THEN power(13.0 / 14, greatest(n - 14, 0)) / 14 ELSE power(13.0 / 14, n - i) / 14 END AS g FROM slices WHERE i > 0) GROUP BY company_id, t0), technicals AS (
  SELECT company_id, t0, trading_date, bars, close, prev_close, volume, vol20, sma20, sma50, sma200, {', '.join(f"(close / sma{k} - 1) * 100 AS dist_sma{k}" for k in (20, 50, 200))},
    CASE WHEN s.n < 14 THEN 50 WHEN loss = 0 THEN CASE WHEN gain = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + gain / loss) END AS rsi, atr, atr / close * 100 AS atr_pct, high_52w, low_52w,
    (close / high_52w - 1) * 100 AS dist_high, (close / low_52w - 1) * 100 AS dist_low, CASE WHEN coalesce(vol50, vol20) > 0 THEN vol20 / coalesce(vol50, vol20) ELSE 1 END AS volume_acceleration
  FROM points LEFT JOIN smoothed s USING (company_id, t0) WHERE bars >= 20)"""

FEATURES = f"""{CALM}, {FUNDAMENTALS}, {TECHNICALS}, joined AS (
  SELECT *, coalesce(CASE WHEN reported_shares > 0 THEN reported_shares END, CASE WHEN ttm_eps > 0 AND ttm_pat > 0 THEN round(ttm_pat * 10000000 / ttm_eps) END) AS shares FROM fundamentals LEFT JOIN technicals USING (company_id, t0)), features AS (
  SELECT * EXCLUDE (reported_shares), close * shares / 10000000 AS market_cap, CASE WHEN ttm_eps > 0 THEN close / ttm_eps WHEN ttm_pat > 0 THEN close * shares / 10000000 / ttm_pat END AS pe,
    CASE WHEN net_worth > 0 THEN close * shares / 10000000 / net_worth END AS pb, CASE WHEN close * shares > 0 THEN ttm_fcf / (close * shares / 10000000) * 100 END AS fcf_yield FROM joined)"""
