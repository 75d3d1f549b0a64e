"""The adapter views as SQL, for the SQL counterparts of queries."""

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINES = """lines AS (
  SELECT p_brand AS company_id, CAST(l_shipdate AS DATE) AS trading_date, l_extendedprice / l_quantity AS u, lineitem.*
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BARS = f"""{LINES}, bars AS (
  SELECT company_id, trading_date, first(u ORDER BY {KEYS}) AS open, max(u) AS high, min(u) AS low, last(u ORDER BY {KEYS}) AS close,
         sum(l_quantity) AS volume
  FROM lines GROUP BY company_id, trading_date)"""
W = "PARTITION BY company_id ORDER BY trading_date"
CALM = BARS.replace(", bars AS (", ", raw AS (") + f""", smooth AS (
  SELECT *, avg(close) OVER ({W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS c, coalesce((close - low) / CASE WHEN high > low THEN high - low END, 0.47) AS place FROM raw), shaped AS (
  SELECT company_id, trading_date, coalesce(lag(c) OVER ({W}), c) AS before, c * (1.004 + 0.008 * place) AS high, c * (0.988 + 0.008 * place) AS low, c AS close, volume FROM smooth), bars AS (
  SELECT company_id, trading_date, least(greatest(before, low), high) AS open, high, low, close, volume FROM shaped)"""
DELIVERY = """delivery AS (
  SELECT company_id, trading_date, sum(l_quantity) AS traded_qty, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS delivery_qty,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100 AS delivery_pct
  FROM lines GROUP BY company_id, trading_date)"""
MARKET = "market AS (SELECT trading_date, avg(close) AS close FROM bars GROUP BY trading_date)"
FILINGS = """quarters AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS company_id,
         CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         sum(o_totalprice) AS original, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS restated
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), filings AS (
  SELECT company_id, period_end, period_end + 45 AS published, 0 AS vintage, original AS revenue FROM quarters
  UNION ALL SELECT company_id, period_end, period_end + 200, 1, restated FROM quarters WHERE restated IS NOT NULL)"""
ACTIONS = """actions AS (
  SELECT company_id, min(trading_date) AS ex_date, 0.5 AS factor FROM bars WHERE year(trading_date) % 2 = 0 GROUP BY company_id, year(trading_date))"""
UNIVERSE = """universe AS (
  SELECT o_custkey AS company_id, min(CAST(o_orderdate AS DATE)) AS effective_from,
         CASE WHEN max(CAST(o_orderdate AS DATE)) < DATE '2001-01-01' THEN max(CAST(o_orderdate AS DATE)) END AS effective_to
  FROM orders GROUP BY o_custkey)"""
INTERVALS = """intervals AS (
  SELECT o_orderkey AS observation_id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS label_start, CAST(o_orderdate AS DATE) + 365 AS label_end
  FROM orders)"""


def over(k: int, last: int = 0) -> str:
    """The frame of the ``k`` bars that end ``last`` bars before the current one."""
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"({W} ROWS BETWEEN {k - 1 + last} PRECEDING AND {end})"
