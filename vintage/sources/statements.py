"""Bitemporal statements of companies, a view of the generated tables.

The view is stated once, in SQL that Spark and DuckDB both run: one join of
lines with their orders and customers, one partial aggregation per company and
quarter, and projections of it. Every field has its own driver, so that ratios
differ from company to company. As in practice, interim quarters have no balance
sheet, some companies report cash flows, earnings per share or shares only once
a year, and half of the companies restate their quarters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters

CELLS = """cells AS (
  SELECT CAST(c_nationkey AS INT) AS nation, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
    sum(l_extendedprice) / 9973.31 AS x, sum(l_extendedprice * l_discount) / 9973.31 AS d, sum(l_extendedprice * l_tax) / 9973.31 AS t, sum(l_quantity) AS q, CAST(count(*) AS INT) AS n,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / 9973.31 AS r, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) / 9973.31 AS f
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

STATEMENTS = f"""{CELLS}, whole AS (
  SELECT nation, CAST(nation AS STRING) AS company_id, period_end, x AS revenue, 2.2 * d + t AS ebitda, q * 0.00457131 AS depreciation, 0.2 + 0.001 * (n % 97) AS tax_rate,
    n * 100003.0 AS shares, t * 2.53 AS cfo, q * 0.00613417 AS capex, r * 1.6 AS total_debt, f * 4.1 AS net_worth, t * 3.3 AS current_liabilities, d * 1.2 AS cash,
    r * 0.53 AS receivables, f * 0.31 AS inventories, t * 2.1 AS payables, r * 0.9 AS financial_debt, CASE WHEN n % 5 = 0 THEN 'STANDALONE' ELSE 'CONSOLIDATED' END AS scope
  FROM cells), earned AS (
  SELECT *, ebitda - depreciation AS ebit, (ebitda - depreciation - total_debt * 0.021) * (1 - tax_rate) AS pat, net_worth + total_debt + current_liabilities AS total_assets FROM whole), quarterly AS (
  SELECT company_id, 'QUARTERLY' AS period_type, period_end, 0 AS vintage, scope, revenue, ebitda, depreciation, ebit, pat,
    CASE WHEN nation % 4 <> 1 THEN pat * 10000000 / shares END AS eps, CASE WHEN nation % 3 <> 0 THEN cfo END AS cfo, CASE WHEN nation % 3 <> 0 THEN capex END AS capex,
    CASE WHEN quarter(period_end) % 2 = 0 THEN total_assets END AS total_assets, CASE WHEN quarter(period_end) % 2 = 0 THEN current_liabilities END AS current_liabilities,
    CASE WHEN quarter(period_end) % 2 = 0 THEN net_worth END AS net_worth, CASE WHEN quarter(period_end) % 2 = 0 THEN total_debt END AS total_debt,
    CASE WHEN quarter(period_end) % 2 = 0 THEN cash END AS cash, CASE WHEN quarter(period_end) % 2 = 0 THEN financial_debt END AS financial_debt,
    CASE WHEN nation % 5 <> 2 THEN shares END AS shares, receivables, inventories, payables, tax_rate
  FROM earned), annual AS (
  SELECT company_id, 'ANNUAL' AS period_type, max(period_end) AS period_end, 0 AS vintage, max(CASE WHEN quarter(period_end) = 4 THEN scope END) AS scope, sum(revenue) AS revenue, sum(ebitda) AS ebitda,
    sum(depreciation) AS depreciation, sum(ebit) AS ebit, sum(pat) AS pat, sum(pat) * 10000000 / max(CASE WHEN quarter(period_end) = 4 THEN shares END) AS eps, sum(cfo) AS cfo, sum(capex) AS capex,
    max(CASE WHEN quarter(period_end) = 4 THEN total_assets END) AS total_assets, max(CASE WHEN quarter(period_end) = 4 THEN current_liabilities END) AS current_liabilities,
    max(CASE WHEN quarter(period_end) = 4 THEN net_worth END) AS net_worth, max(CASE WHEN quarter(period_end) = 4 THEN total_debt END) AS total_debt, max(CASE WHEN quarter(period_end) = 4 THEN cash END) AS cash,
    max(CASE WHEN quarter(period_end) = 4 THEN financial_debt END) AS financial_debt, max(CASE WHEN quarter(period_end) = 4 THEN shares END) AS shares,
    max(CASE WHEN quarter(period_end) = 4 THEN receivables END) AS receivables, max(CASE WHEN quarter(period_end) = 4 THEN inventories END) AS inventories,
    max(CASE WHEN quarter(period_end) = 4 THEN payables END) AS payables, max(CASE WHEN quarter(period_end) = 4 THEN tax_rate END) AS tax_rate
  FROM earned GROUP BY company_id, year(period_end) HAVING count(*) = 4), restated AS (
  SELECT company_id, period_type, period_end, 1 AS vintage, scope, revenue * 1.03 AS revenue, ebitda * 0.98 AS ebitda, depreciation, ebit * 0.97 AS ebit, pat * 0.96 AS pat, eps * 0.96 AS eps, cfo, capex,
    total_assets, current_liabilities, net_worth, total_debt, cash, financial_debt, shares, receivables, inventories, payables, tax_rate
  FROM quarterly WHERE CAST(company_id AS INT) % 2 = 0), statements AS (
  SELECT *, CAST(period_end + INTERVAL 45 DAY AS DATE) AS published FROM quarterly UNION ALL SELECT *, CAST(period_end + INTERVAL 200 DAY AS DATE) FROM restated
  UNION ALL SELECT *, CAST(period_end + INTERVAL 60 DAY AS DATE) FROM annual)"""

#: The dates at which features are read: 75 days behind the end of every quarter.
DATES = "dates AS (SELECT DISTINCT company_id, CAST(period_end + INTERVAL 75 DAY AS DATE) AS t0 FROM statements)"


def statements(spark: SparkSession, sf_dir: str, split: int = 1) -> DataFrame:
    """Quarterly and annual statements with their vintages and dates of publication; amounts in crore, shares in units. ``split``: so many companies a nation, by customer."""
    names = ("lineitem", "orders", "customer")
    text = f"WITH {STATEMENTS} SELECT * FROM statements"
    if split > 1:
        text = text.replace("CAST(c_nationkey AS INT) AS nation", f"CAST(c_nationkey * {split} + c_custkey % {split} AS INT) AS nation")
    for n in names:
        text = text.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(text, **{n: adapters.table(spark, sf_dir, n) for n in names})


def reading_dates(rows: DataFrame) -> DataFrame:
    return rows.select("company_id", F.date_add("period_end", 75).alias("t0")).distinct()


def listed_bars(spark: SparkSession, sf_dir: str, split: int = 1) -> DataFrame:
    """Daily bars of the same companies: the n-th brand stands for the n-th nation, and so do their parts."""
    brand = F.regexp_extract("company_id", "[0-9]+", 0).cast("int") - 1
    part = F.regexp_extract("company_id", "[.]([0-9]+)", 1).cast("int") if split > 1 else F.lit(0)
    return adapters.calm_bars(spark, sf_dir, split).withColumn("company_id", (brand * split + part).cast("string"))


LISTED = "listed AS (SELECT CAST(CAST(regexp_extract(company_id, '[0-9]+') AS INT) - 1 AS VARCHAR) AS company_id, trading_date, open, high, low, close, volume FROM bars)"
