"""Queries over the scalar functions (F operators) and text-shaped sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as f
from ..sources import adapters as a
from .registry import SQL, query
from .views import BARS, DELIVERY, FILINGS, W, over

DOCS = "documents"
TYPES = "[" + ", ".join(f"'{t}'" for t in a.EVENT_TYPES) + "]"
NEWS = f"""news AS (SELECT doc_id, text AS headline, {TYPES}[doc_id % 16 + 1] AS event_type, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published FROM documents)"""
WEIGHT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in f.TYPE_WEIGHTS.items()) + f" ELSE {f.OTHER_WEIGHT} END"


def _hits(words, text="lower(headline)"):
    return " + ".join(f"contains({text}, '{w}')::INT" for w in words)


DIRECTION = f"CASE WHEN ({_hits(f.NEGATIVE)}) > ({_hits(f.POSITIVE)}) THEN -1.0 WHEN ({_hits(f.POSITIVE)}) > 0 THEN 1.0 WHEN ({WEIGHT}) >= 70 THEN 1.0 ELSE 0.5 END"
TRACK = "CASE WHEN event_type IN ('" + "', '".join(f.STRUCTURAL_TYPES) + f"') OR ({_hits(f.STRUCTURAL_WORDS)}) > 0 THEN 'STRUCTURAL' ELSE 'TACTICAL' END"
NOW = "TIMESTAMP '2024-02-15 00:00:00'"


@query("F1_crore_value", f"""WITH {NEWS}, t AS (SELECT doc_id, 'Rs. ' || (doc_id * 37 % 1900 + 100) || CASE WHEN doc_id % 3 = 0 THEN ',500.25 Crore ' WHEN doc_id % 3 = 1 THEN ' lakh, USD 12.5 Mn ' ELSE ' ' END || headline AS text FROM news),
 n AS (SELECT doc_id, regexp_extract(text, '(?i)(?:Rs\\.?|₹|INR)?\\s*([\\d,]+(?:\\.\\d+)?)\\s*(?:Cr|Crore|Crores)', 1) AS c, regexp_extract(text, '(?i)(?:\\$|USD)\\s*([\\d,]+(?:\\.\\d+)?)\\s*(?:Mn|Million)', 1) AS u FROM t)
SELECT doc_id, coalesce(try_cast(replace(c, ',', '') AS DOUBLE), round(try_cast(replace(u, ',', '') AS DOUBLE) * 8.4, 2)) AS crore FROM n""")
def crore_value(spark, sf_dir):
    news = a.announcements(spark, sf_dir)
    tail = F.when(F.col("doc_id") % 3 == 0, ",500.25 Crore ").when(F.col("doc_id") % 3 == 1, " lakh, USD 12.5 Mn ").otherwise(" ")
    text = F.concat(F.lit("Rs. "), (F.col("doc_id") * 37 % 1900 + 100).cast("string"), tail, F.col("headline"))
    return news.select("doc_id", f.crore_value(text).alias("crore"))


@query("F2_direction", f"WITH {NEWS} SELECT doc_id, ({_hits(f.POSITIVE)}) AS positive, ({_hits(f.NEGATIVE)}) AS negative, {DIRECTION} AS direction FROM news")
def direction(spark, sf_dir):
    text = F.lower("headline")
    return a.announcements(spark, sf_dir).select(
        "doc_id", f.hits(text, f.POSITIVE).alias("positive"), f.hits(text, f.NEGATIVE).alias("negative"), f.direction(F.col("headline"), f.type_weight(F.col("event_type"))).alias("direction")
    )


@query("F3_materiality", f"""WITH {NEWS} SELECT doc_id, round(least(greatest(({WEIGHT}) * (CASE WHEN doc_id % 100 >= 50 THEN 2.0 WHEN doc_id % 100 >= 20 THEN 1.5 WHEN doc_id % 100 >= 5 THEN 1.0 ELSE 0.6 END) * ({DIRECTION}), -100), 100), 3) AS score FROM news""")
def materiality(spark, sf_dir):
    news = a.announcements(spark, sf_dir).withColumn("value", (F.col("doc_id") % 100).cast("double"))
    return news.select("doc_id", F.round(f.materiality(F.col("event_type"), F.col("headline"), F.col("value"), F.lit(100.0)), 3).alias("score"))


@query("F4_track", f"WITH {NEWS} SELECT doc_id, {TRACK} AS track FROM news")
def track(spark, sf_dir):
    return a.announcements(spark, sf_dir).select("doc_id", f.track(F.col("event_type"), F.col("headline")).alias("track"))


@query("F5_decay", f"""WITH {NEWS}, s AS (SELECT doc_id, ({WEIGHT}) * ({DIRECTION}) AS raw, {TRACK} = 'STRUCTURAL' AS structural, greatest(date_diff('second', published, {NOW}) / 3600.0, 0) AS hours FROM news),
 d AS (SELECT *, raw * exp(-ln(2) / CASE WHEN structural THEN 2160 ELSE 48 END * hours) AS decayed FROM s)
SELECT doc_id, round(decayed, 4) AS decayed, CASE WHEN hours <= 24 THEN 'NEW_ACTIVE' WHEN hours > CASE WHEN structural THEN 4320 ELSE 168 END
  OR abs(round(decayed, 1)) < abs(raw) * CASE WHEN structural THEN 0.15 ELSE 0.08 END THEN CASE WHEN structural THEN 'ABSORBED_INTO_FINANCIALS' ELSE 'ABSORBED_INTO_PRICE' END ELSE 'DECAYING' END AS status FROM d""")
def decay(spark, sf_dir):
    news = a.announcements(spark, sf_dir)
    kind, headline = F.col("event_type"), F.col("headline")
    hours = F.greatest(F.timestamp_diff("SECOND", F.col("published"), F.lit("2024-02-15 00:00:00").cast("timestamp")) / 3600, F.lit(0.0))
    x = news.select("doc_id", (f.type_weight(kind) * f.direction(headline, f.type_weight(kind))).alias("raw"), (f.track(kind, headline) == "STRUCTURAL").alias("structural"), hours.alias("hours"))
    x = x.withColumn("decayed", f.decay(F.col("raw"), F.col("hours"), F.col("structural")))
    return x.select("doc_id", F.round("decayed", 4).alias("decayed"), f.lifecycle(F.col("decayed"), F.col("raw"), F.col("hours"), F.col("structural")).alias("status"))


@query("F7_filing_class", f"""WITH {NEWS}, u AS (SELECT doc_id, upper(headline) AS h FROM news) SELECT doc_id, CASE {' '.join(f"WHEN {' OR '.join(f"contains(h, '{w}')" for w in words)} THEN '{kind}'" for kind, _, words in f.FILING_CLASSES)} ELSE 'GENERAL_CORPORATE_DISCLOSURE' END AS class,
  CASE {' '.join(f"WHEN {' OR '.join(f"contains(h, '{w}')" for w in words)} THEN '{weight}'" for _, weight, words in f.FILING_CLASSES)} ELSE 'LOW' END AS weight FROM u""")
def filing_class(spark, sf_dir):
    kind, weight = f.filing_class(F.col("headline"))
    return a.announcements(spark, sf_dir).select("doc_id", kind.alias("class"), weight.alias("weight"))


_EVENT = {kind: " OR ".join(f"contains(h, '{w}')" for w in words) for kind, _, words in f.EVENT_WORDS}


@query("F6_event_parser", f"""WITH {NEWS}, u AS (SELECT doc_id, lower(headline) || ' of rs. ' || doc_id || ',' || (100 + doc_id % 900) || '.5 crore' || CASE doc_id % 4 WHEN 0 THEN ' received order' WHEN 1 THEN ' new plant' WHEN 2 THEN ' cfo resigns' ELSE '' END AS h FROM news)
SELECT doc_id, CASE {' '.join(f"WHEN {words} THEN '{kind}'" for kind, words in _EVENT.items())} ELSE 'OTHER' END AS event, CASE {' '.join(f"WHEN {' OR '.join(f"contains(h, '{w}')" for w in words)} THEN {m}" for _, m, words in f.EVENT_WORDS)} ELSE 0.5 END AS materiality,
  CASE WHEN {_EVENT['ORDER_WIN']} THEN CAST(replace(nullif(regexp_extract(h, '(?:rs\\.?|inr|worth)\\s*(\\d+(?:,\\d+)*(?:\\.\\d+)?)\\s*(?:cr|crore)', 1), ''), ',', '') AS DOUBLE) * 10000000 END AS order_size FROM u""")
def event_parser(spark, sf_dir):
    """Announcements with an amount behind them, parsed for orders, capital spending and changes of management."""
    k = F.col("doc_id")
    tail = F.when(k % 4 == 0, " received order").when(k % 4 == 1, " new plant").when(k % 4 == 2, " cfo resigns").otherwise("")
    text = F.concat("headline", F.lit(" of Rs. "), k.cast("string"), F.lit(","), (100 + k % 900).cast("string"), F.lit(".5 Crore"), tail)
    kind, materiality, size = f.event_of(text)
    return a.announcements(spark, sf_dir).select("doc_id", kind.alias("event"), materiality.alias("materiality"), size.alias("order_size"))


@query("F9_board_status", f"""WITH {NEWS}, m AS (SELECT doc_id, CAST(published AS DATE) AS meeting FROM news) SELECT doc_id, meeting - DATE '2024-01-20' AS days, CASE WHEN meeting - DATE '2024-01-20' < 0 THEN 'COMPLETED' WHEN meeting - DATE '2024-01-20' <= 3 THEN 'IMMINENT' ELSE 'SCHEDULED' END AS status,
  DATE '2024-01-20' - meeting < 2 AS blackout FROM m""")
def board_status(spark, sf_dir):
    meeting, today = F.to_date("published"), F.lit("2024-01-20").cast("date")
    return a.announcements(spark, sf_dir).select("doc_id", F.datediff(meeting, today).cast("long").alias("days"), f.board_status(meeting, today).alias("status"), f.blackout(meeting, today).alias("blackout"))


@query("F10_censoring", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'EVENT_OBSERVED' WHEN CAST(o_orderdate AS DATE) + 1095 <= DATE '2001-08-01' THEN 'HORIZON_COMPLETED_NO_EVENT' ELSE 'RIGHT_CENSORED' END AS censoring FROM orders""")
def censoring(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", f.censoring(F.to_date("o_orderdate"), 3, F.lit("2001-08-01").cast("date"), F.col("o_orderstatus") == "F").alias("censoring"))


@query("P10_partition", """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1997-12-31' THEN 'DEVELOPMENT' WHEN CAST(o_orderdate AS DATE) <= DATE '1999-12-31' THEN 'VALIDATION'
  WHEN CAST(o_orderdate AS DATE) <= DATE '2001-06-30' THEN 'LOCKED_OOS' ELSE 'OUT_OF_BOUNDS' END AS partition FROM orders""")
def partition(spark, sf_dir):
    """The partitions' ends are moved to the years that the orders have."""
    ends = ("1997-12-31", "1999-12-31", "2001-06-30")
    return a.table(spark, sf_dir, "orders").select("o_orderkey", f.partition_of(F.to_date("o_orderdate"), ends).alias("partition"))


@query("F12_canonical_hash", """SELECT o_orderkey, sha256('o_custkey=' || CAST(CAST(o_custkey AS DECIMAL(38,6)) AS VARCHAR) || '|o_orderkey=' || CAST(CAST(o_orderkey AS DECIMAL(38,6)) AS VARCHAR) || '|o_totalprice=' || CAST(CAST(o_totalprice AS DECIMAL(38,6)) AS VARCHAR)) AS hash FROM orders""")
def canonical_hash(spark, sf_dir):
    return a.table(spark, sf_dir, "orders").select("o_orderkey", f.canonical_hash(["o_totalprice", "o_orderkey", "o_custkey"]).alias("hash"))


@query("F13_candle", f"""WITH {BARS}, {DELIVERY}, r AS (SELECT b.*, avg(close) OVER {over(20)} AS mean, avg(high - low) OVER {over(14)} AS range14 FROM bars b)
SELECT company_id, trading_date, round(CASE WHEN high - low <= 0.0001 THEN 0.5 ELSE least(greatest((close - low) / (high - low), 0), 1) END, 6) AS location,
  round(CASE WHEN high - low <= 0.0001 THEN 0 ELSE greatest(high - greatest(open, close), 0) / (high - low) END, 6) AS wick,
  round(CASE WHEN delivery_qty > 0 THEN delivery_qty / 50000.0 * 100 END, 6) AS absorption, round(coalesce(CASE WHEN range14 > 0.01 THEN (close - mean) / range14 END, 1.5), 4) AS elasticity
FROM r JOIN delivery USING (company_id, trading_date)""")
def candle(spark, sf_dir):
    from ..operators import windows as w

    x = a.bars(spark, sf_dir).withColumns({"mean": F.avg("close").over(w.last_bars(20)), "range14": F.avg(F.col("high") - F.col("low")).over(w.last_bars(14))})
    x = x.join(a.delivery(spark, sf_dir), ["company_id", "trading_date"])
    o, h, lo, c = (F.col(k) for k in ("open", "high", "low", "close"))
    return x.select(
        "company_id", "trading_date", F.round(f.close_location(h, lo, c), 6).alias("location"), F.round(f.upper_wick(o, h, lo, c), 6).alias("wick"),
        F.round(f.float_absorption(F.col("delivery_qty"), F.lit(50000.0)), 6).alias("absorption"), F.round(f.elasticity(c, F.col("mean"), F.col("range14")), 4).alias("elasticity"),
    )


@query("F14_logistic", """WITH q AS (SELECT event_id, value AS score, CASE WHEN event_type <> 'error' THEN 20.0 + event_id % 61 END AS mood, (event_id % 41 - 20) / 10.0 AS index_change, 0.2 + (event_id % 23) / 10.0 AS beta FROM events),
 p AS (SELECT *, least(92, greatest(10, 100 / (1 + exp(-(score - 50) / 20)))) AS raw, CASE WHEN mood IS NULL THEN 1 ELSE least(1.10, greatest(0.80, 1 + ((mood - 50) / 100 * 0.5 + index_change / 10 * 0.5) * least(2.0, greatest(0.4, beta)))) END AS factor FROM q)
SELECT event_id, round(least(92, greatest(10, raw * factor)), 6) AS probability, round(factor, 6) AS factor FROM p""")
def logistic(spark, sf_dir):
    """Probability of scores in percent between 10 and 92, moved by mood and index change as far as the beta lets them; where the mood is missing, unmoved."""
    k = F.col("event_id")
    x = a.quotes(spark, sf_dir).withColumns({"mood": F.when(F.col("kind") != "error", 20.0 + k % 61), "index_change": (k % 41 - 20) / 10.0, "beta": 0.2 + (k % 23) / 10.0})
    probability, factor = f.macro_probability(F.col("price"), F.col("mood"), F.col("index_change"), F.col("beta"))
    return x.select("event_id", F.round(probability, 6).alias("probability"), F.round(factor, 6).alias("factor"))


@query("F15_circuit", f"""WITH {BARS}, c AS (SELECT *, (close / lag(close) OVER ({W}) - 1) * 100 AS change FROM bars) SELECT company_id, trading_date,
  least(abs(abs(change) - 2), abs(abs(change) - 5), abs(abs(change) - 10), abs(abs(change) - 20)) <= 0.35 AS locked FROM c WHERE change IS NOT NULL""")
def circuit(spark, sf_dir):
    from ..operators import windows as w

    x = a.bars(spark, sf_dir).withColumn("change", (F.col("close") / F.lag("close").over(w.sessions()) - 1) * 100).where("change IS NOT NULL")
    return x.select("company_id", "trading_date", f.circuit_locked(F.col("change")).alias("locked"))


@query("F16_bracket", f"""WITH {BARS}, r AS (SELECT *, avg(high - low) OVER {over(14)} AS rng FROM bars) SELECT company_id, trading_date, round(close - 1.5 * rng, 6) AS stop, round(close + 3 * rng, 6) AS target_2r, round(close + 4.5 * rng, 6) AS target_3r FROM r""")
def bracket(spark, sf_dir):
    from ..operators import windows as w

    x = a.bars(spark, sf_dir).withColumn("rng", F.avg(F.col("high") - F.col("low")).over(w.last_bars(14)))
    return x.select("company_id", "trading_date", *(F.round(F.col("close") + k * F.col("rng"), 6).alias(n) for k, n in ((-1.5, "stop"), (3.0, "target_2r"), (4.5, "target_3r"))))


@query("F17_position", f"WITH {BARS} SELECT company_id, trading_date, CAST(floor(least(10000 / nullif(greatest(close - low, 0), 0), 200000 / close)) AS BIGINT) AS shares FROM bars")
def position(spark, sf_dir):
    x = a.bars(spark, sf_dir)
    return x.select("company_id", "trading_date", f.position_size(F.lit(1_000_000.0), F.col("close"), F.col("low")).cast("long").alias("shares"))


@query("F18_economics", f"""WITH {FILINGS} SELECT company_id, period_end, vintage, round(CASE WHEN revenue > 0 THEN revenue * 0.2 * (1 - 0.25) / (revenue * 1.5) * 100 END, 6) AS roic,
  round(greatest(revenue * 0.1 - revenue * 0.05 * 1.2, 0), 3) AS growth_capex FROM filings""")
def economics(spark, sf_dir):
    r = F.col("revenue")
    return a.filings(spark, sf_dir).select(
        "company_id", "period_end", "vintage", F.round(f.economic_roic(r * 0.2, F.lit(0.25), r * 1.5), 6).alias("roic"), F.round(f.growth_capex(r * 0.1, r * 0.05, F.lit(1.2)), 3).alias("growth_capex")
    )


@query("F21_valuation", f"""WITH {BARS}, g AS (SELECT *, (close / lag(close, 250) OVER ({W}) - 1) * 100 AS growth, close / (min(low) OVER {over(20)}) * 15 AS pe FROM bars)
SELECT company_id, trading_date, round(CASE WHEN pe > 0 AND growth > 0 THEN pe / CASE WHEN growth > 60 THEN 30 ELSE greatest(growth, 5) END END, 6) AS peg, round(volume / (close * 1000) * 100, 6) AS fcf_yield FROM g""")
def valuation(spark, sf_dir):
    from ..operators import windows as w

    x = a.bars(spark, sf_dir).withColumns({"growth": (F.col("close") / F.lag("close", 250).over(w.sessions()) - 1) * 100, "pe": F.col("close") / F.min("low").over(w.last_bars(20)) * 15})
    return x.select("company_id", "trading_date", F.round(f.peg(F.col("pe"), F.col("growth"), F.lit(30.0)), 6).alias("peg"), F.round(f.fcf_yield(F.col("volume"), F.col("close") * 1000), 6).alias("fcf_yield"))


@query("F22_implied_growth_all", """WITH RECURSIVE o AS (SELECT o_orderkey, o_totalprice / 100 AS cash, o_totalprice / 100 * (5 + o_orderkey % 60) AS value FROM orders),
 b AS (SELECT o_orderkey, cash, value, 1 AS step, -50.0::DOUBLE AS lo, 200.0::DOUBLE AS hi, false AS done FROM o UNION ALL
  SELECT o_orderkey, cash, value, step + 1, CASE WHEN done THEN lo WHEN hit OR gap < 0 THEN mid ELSE lo END, CASE WHEN done THEN hi WHEN hit OR gap >= 0 THEN mid ELSE hi END, done OR hit
  FROM (SELECT *, abs(gap) < 0.01 AS hit FROM (SELECT *, cash * (CASE WHEN abs(q - 1) < 1e-12 THEN 10 ELSE q * (1 - power(q, 10)) / (1 - q) END + power(q, 10) * 1.05 / (0.12 - 0.05)) - value AS gap
   FROM (SELECT *, (lo + hi) / 2 AS mid, (1 + (lo + hi) / 200) / 1.12 AS q FROM b WHERE step <= 60))))
SELECT o_orderkey, round((lo + hi) / 2, 4) AS implied FROM b WHERE step = 61""")
def implied_growth_all(spark, sf_dir):
    """Every order stands for a company."""
    return _implied(a.table(spark, sf_dir, "orders"))


query("F22_implied_growth", SQL["F22_implied_growth_all"])(implied_growth_all)


def _implied(orders):
    cash = F.col("o_totalprice") / 100
    return orders.select("o_orderkey", F.round(f.implied_growth(cash, cash * (5 + F.col("o_orderkey") % 60)), 4).alias("implied"))


@query("F23_expectations", """SELECT c_custkey, CASE WHEN gap >= 10 THEN 'DEEPLY_UNDERVALUED' WHEN gap >= 3 THEN 'UNDERVALUED' WHEN gap > -3 THEN 'FAIR' WHEN gap > -10 THEN 'DEMANDING' ELSE 'EXTREME' END AS regime
  FROM (SELECT c_custkey, c_acctbal / 500 - c_nationkey AS gap FROM customer)""")
def expectations(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey", f.expectations_regime(F.col("c_acctbal") / 500, F.col("c_nationkey").cast("double")).alias("regime"))


@query("F26_runway", """SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 AND s_nationkey > 0 AND 20000 > s_acctbal THEN ln(20000 / s_acctbal) / ln(1 + s_nationkey / 100) ELSE 0 END, 6) AS years FROM supplier""")
def runway(spark, sf_dir):
    return a.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(f.runway_years(F.lit(20000.0), F.col("s_acctbal"), F.col("s_nationkey") / 100), 6).alias("years"))


@query("F33_trade_costs", """WITH t AS (SELECT o_orderkey, greatest(o_totalprice, 100) AS buy, greatest(greatest(o_totalprice, 100) * (1 + (o_custkey % 41 - 20) / 100.0), 0) AS sell, o_orderkey % 2 = 0 AS dlv FROM orders),
 s AS (SELECT *, CASE WHEN dlv THEN 0.001 * (buy + sell) + 0.00015 * buy ELSE 0.00025 * sell + 0.00003 * buy END AS tax, (0.0000345 + 0.000001) * (buy + sell) AS fees, least(20, 0.0005 * buy) + least(20, 0.0005 * sell) AS brk,
  CASE WHEN dlv AND sell > 0 THEN 15.93 ELSE 0 END AS dp FROM t)
SELECT o_orderkey, round(tax + fees + brk + 0.18 * (brk + fees) + dp, 8) AS statutory, round((buy + sell) * 0.15 / 100, 8) AS slippage,
  round((sell - buy - (tax + fees + brk + 0.18 * (brk + fees) + dp) - (buy + sell) * 0.15 / 100) / buy * 100, 6) AS net_pct FROM s""")
def trade_costs(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    costs = f.trade_costs(F.col("o_totalprice"), (F.col("o_custkey") % 41 - 20).cast("double"), F.col("o_orderkey") % 2 == 0)
    return o.select("o_orderkey", costs.alias("c")).select("o_orderkey", F.round("c.statutory", 8).alias("statutory"), F.round("c.slippage", 8).alias("slippage"), F.round("c.net_pct", 6).alias("net_pct"))


@query("F34_market_impact", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 + CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END * 0.005 * sqrt(l_quantity / 500)), 6) AS executed FROM lineitem""")
def market_impact(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "N", 1).otherwise(-1)
    return a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(f.market_impact(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(500.0), side), 6).alias("executed"))


EXPOSURE = """e AS (SELECT c_custkey, c_mktsegment, greatest(c_acctbal, 0) / sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey) * 100 AS stock_pct,
  sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey, c_mktsegment) / sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey) * 100 AS sector_pct FROM customer)"""


@query("F35_compliance", f"""WITH {EXPOSURE} SELECT c_custkey, CASE WHEN stock_pct > 5 THEN 'RESIZE_STOCK' WHEN sector_pct > 20 THEN 'RESIZE_SECTOR' WHEN c_custkey % 11 > 5 THEN 'RESIZE_LIQUIDITY' ELSE 'APPROVED' END AS status FROM e""")
def compliance(spark, sf_dir):
    """A nation's customers are a portfolio, segments its sectors."""
    from pyspark.sql import Window

    c = a.table(spark, sf_dir, "customer").withColumn("v", F.greatest("c_acctbal", F.lit(0.0)))
    whole, sector = Window.partitionBy("c_nationkey"), Window.partitionBy("c_nationkey", "c_mktsegment")
    total = F.sum("v").over(whole)
    status = f.compliance(F.lit(0.0), F.lit(False), F.col("v") / total * 100, F.sum("v").over(sector) / total * 100, (F.col("c_custkey") % 11).cast("double"))
    return c.select("c_custkey", status.alias("status"))


@query("F36_allocation", """WITH w AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, 5.0 AS cap FROM customer WHERE c_acctbal >= 0),
 r AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w)
SELECT c_custkey, least(5.0, 20.0 - used) AS weight FROM r WHERE least(5.0, 20.0 - used) > 0.5""")
def allocation(spark, sf_dir):
    """Greedy by conviction: 5 % a stock, 20 % a sector; a running sum per sector stands for the loop."""
    from ..operators import ranking

    c = a.table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return ranking.capped_allocation(c, ["c_nationkey", "c_mktsegment"], "c_acctbal", "c_custkey", 5.0, 20.0).select("c_custkey", "weight")


@query("F38_regime", """WITH q AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN 8 + value / 5 END AS vix, CASE WHEN event_id % 7 <> 0 THEN 60 + event_id % 45 END AS crude FROM events)
SELECT event_id, CASE WHEN vix IS NULL AND crude IS NULL THEN 'DATA_OFFLINE_UNKNOWN' WHEN vix < 14 AND (crude IS NULL OR crude < 85) THEN 'BULLISH_EXPANSION' WHEN vix > 18 OR crude > 95 THEN 'RISK_OFF_CORRECTION' ELSE 'NEUTRAL_CONSOLIDATION' END AS regime FROM q""")
def regime(spark, sf_dir):
    vix, crude = F.when(F.col("kind") != "error", 8 + F.col("price") / 5), F.when(F.col("event_id") % 7 != 0, 60 + F.col("event_id") % 45)
    return a.quotes(spark, sf_dir).select("event_id", f.macro_regime(vix, crude).alias("regime"))


@query("F39_readiness_bin", "SELECT c_custkey, CASE WHEN s >= 85 THEN '85+' WHEN s >= 75 THEN '75-84' WHEN s >= 65 THEN '65-74' WHEN s >= 55 THEN '55-64' ELSE '<55' END AS bin FROM (SELECT c_custkey, c_acctbal / 100 AS s FROM customer)")
def readiness_bin(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey", f.readiness_bin(F.col("c_acctbal") / 100).alias("bin"))


@query("F40_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def dates(spark, sf_dir):
    """Order dates written in four forms and read back."""
    o = a.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    return o.select("o_orderkey", f.mixed_date(text).alias("day"))


@query("S15_symbols", """WITH t AS (SELECT doc_id, string_split_regex(upper(replace(text, 'ß', 'ss')), '[^A-Z]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
 f AS (SELECT doc_id, word, min(pos) AS pos FROM u WHERE length(word) BETWEEN 3 AND 5 AND word NOT IN ('THE', 'AND', 'FOR', 'WITH') GROUP BY doc_id, word)
SELECT doc_id, word AS symbol, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM f""")
def symbols(spark, sf_dir):
    """Distinct symbol-like words of a headline in order of appearance."""
    from ..sources import parsers

    return parsers.symbols(a.table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "symbol", F.col("place").cast("long").alias("place"))


@query("S17_publication_lag", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 4 = 0 THEN 60 ELSE 45 END END AS published, o_orderstatus <> 'F' AS estimated FROM orders""")
def publication_lag(spark, sf_dir):
    from ..sources import parsers

    day = F.to_date("o_orderdate")
    o = a.table(spark, sf_dir, "orders").select("o_orderkey", day.alias("period_end"), F.when(F.col("o_orderstatus") == "F", day).alias("published"), (F.col("o_orderkey") % 4 == 0).alias("annual"))
    return parsers.publication_dates(o).select("o_orderkey", "published", "estimated")


#: Every seventh bar is spoilt in one of five ways, so that each rule has something to find.
SPOILT = f"""k AS (SELECT *, row_number() OVER ({W}) % 35 AS k FROM bars), spoilt AS (SELECT company_id, trading_date, CASE k WHEN 7 THEN high * 1.1 WHEN 14 THEN low * 0.9 ELSE open END AS open, CASE k WHEN 21 THEN low * 0.9 ELSE high END AS high, low,
  CASE k WHEN 28 THEN low * 0.5 ELSE close END AS close, CASE k WHEN 0 THEN -volume ELSE volume END AS volume FROM k)"""


@query("S10_validation", f"""WITH {BARS}, {SPOILT} SELECT company_id, trading_date, CASE WHEN high < low THEN 'LOW_ABOVE_HIGH' WHEN high < open OR high < close THEN 'HIGH_BELOW_OPEN_OR_CLOSE' WHEN low > open OR low > close THEN 'LOW_ABOVE_OPEN_OR_CLOSE' WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END AS reason FROM spoilt""")
def validation(spark, sf_dir):
    from ..operators import windows as w
    from ..sources import parsers

    x = a.bars(spark, sf_dir).withColumn("k", F.row_number().over(w.sessions()) % 35)
    k, low = F.col("k"), F.col("low")
    x = x.select(
        "company_id", "trading_date", F.when(k == 7, F.col("high") * 1.1).when(k == 14, low * 0.9).otherwise(F.col("open")).alias("open"), F.when(k == 21, low * 0.9).otherwise(F.col("high")).alias("high"), "low",
        F.when(k == 28, low * 0.5).otherwise(F.col("close")).alias("close"), F.when(k == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )
    return x.select("company_id", "trading_date", parsers.candle_fault().alias("reason"))


@query("S10_balance_validation", """WITH c AS (SELECT c_custkey, greatest(c_acctbal, 1) AS w, c_nationkey * 10.0 AS l, c_custkey % 9 AS k FROM customer), b AS (SELECT c_custkey, w, l, CASE k WHEN 3 THEN (w + l) * 1.2 ELSE (w + l) * 1.01 END AS assets, w * 0.2 AS ebit, w * 0.05 AS dep, w * 0.25 * CASE k WHEN 5 THEN 1.5 ELSE 1 END AS ebitda,
  w * 0.3 AS cfo, w * 0.1 AS capex, w * 0.2 * CASE k WHEN 7 THEN 0.5 ELSE 1 END AS fcf FROM c)
SELECT c_custkey, CASE WHEN abs(assets - w - l) > 0.05 * greatest(abs(assets), 1) THEN 'ASSETS_DO_NOT_BALANCE' WHEN abs(ebitda - ebit - dep) > 0.05 * greatest(abs(ebitda), 1) THEN 'EBITDA_MISMATCH' WHEN abs(fcf - cfo + capex) > 0.05 * greatest(abs(fcf), 1) THEN 'FREE_CASH_FLOW_MISMATCH' END AS reason FROM b""")
def balance_validation(spark, sf_dir):
    """Three identities of a statement, each broken in one customer of nine."""
    from ..sources import parsers

    k, own = F.col("c_custkey") % 9, F.greatest(F.col("c_acctbal"), F.lit(1.0))
    x = a.table(spark, sf_dir, "customer").select(
        "c_custkey", own.alias("net_worth"), (F.col("c_nationkey") * 10.0).alias("total_liabilities"), ((own + F.col("c_nationkey") * 10.0) * F.when(k == 3, 1.2).otherwise(1.01)).alias("total_assets"), (own * 0.2).alias("ebit"),
        (own * 0.05).alias("depreciation"), (own * 0.25 * F.when(k == 5, 1.5).otherwise(1.0)).alias("ebitda"), (own * 0.3).alias("operating_cash_flow"), (own * 0.1).alias("capex"), (own * 0.2 * F.when(k == 7, 0.5).otherwise(1.0)).alias("free_cash_flow"),
    )
    return x.select("c_custkey", parsers.balance_fault().alias("reason"))


@query("S16_event_dimension", f"""WITH {NEWS} SELECT doc_id, CASE WHEN event_type IN ('ORDER_WIN', 'CONTRACT_AWARD') THEN 'growth' WHEN event_type IN ('CREDIT_RATING_UPGRADE', 'CREDIT_RATING_DOWNGRADE', 'PLEDGE_INCREASE') THEN 'solvency'
  WHEN event_type IN ('MANAGEMENT_CHANGE', 'REGULATORY_ACTION', 'LITIGATION') THEN 'governance' ELSE 'other' END AS dimension FROM news""")
def event_dimension(spark, sf_dir):
    from ..sources import parsers

    return parsers.event_dimension(a.announcements(spark, sf_dir)).select("doc_id", "dimension")


@query("S21_sessions", f"""WITH {BARS}, d AS (SELECT DISTINCT trading_date FROM bars) SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) AS age FROM d ORDER BY trading_date DESC LIMIT 30""")
def sessions(spark, sf_dir):
    """The latest 30 market sessions; the limit is the feature."""
    from ..sources import parsers

    return parsers.latest_sessions(a.bars(spark, sf_dir), 30).select("trading_date", F.col("age").cast("long").alias("age"))


@query("S9_action_class", f"""WITH {BARS}, s AS (SELECT DISTINCT company_id, year(trading_date) AS y FROM bars), t AS (SELECT company_id, y, CASE y % 3 WHEN 0 THEN 'Bonus 1:' || (y % 4 + 1) WHEN 1 THEN 'Face value split from Rs 10 to Rs ' || (y % 5 + 1) ELSE 'Interim dividend Rs 5' END AS subject FROM s)
SELECT company_id, y, CASE WHEN contains(lower(subject), 'bonus') THEN 'BONUS' WHEN contains(lower(subject), 'split') THEN 'SPLIT' WHEN contains(lower(subject), 'dividend') THEN 'DIVIDEND' ELSE 'OTHER' END AS action,
 CASE WHEN contains(lower(subject), 'bonus') THEN 1 / (1 + 1 / (y % 4 + 1)) WHEN contains(lower(subject), 'split') THEN (y % 5 + 1) / 10 ELSE 1 END AS factor FROM t""")
def action_class(spark, sf_dir):
    from ..sources import parsers

    y = F.col("y")
    s = a.bars(spark, sf_dir).select("company_id", F.year("trading_date").alias("y")).distinct()
    subject = F.when(y % 3 == 0, F.concat(F.lit("Bonus 1:"), (y % 4 + 1).cast("string"))).when(y % 3 == 1, F.concat(F.lit("Face value split from Rs 10 to Rs "), (y % 5 + 1).cast("string"))).otherwise("Interim dividend Rs 5")
    return parsers.corporate_actions(s.withColumn("subject", subject)).select("company_id", "y", "action", "factor")
