"""Queries over as-of, interval and event joins (J, U operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import paths, pit
from ..operators import windows as w
from ..sources import adapters as a
from .registry import SQL, query
from .views import ACTIONS, BARS, FILINGS, INTERVALS, MARKET, UNIVERSE, W

T0S = "t0s AS (SELECT DISTINCT company_id, CAST(period_end + 100 AS DATE) AS t0 FROM filings)"
AS_OF = f"""{FILINGS}, {T0S}, seen AS (SELECT t.t0, f.* FROM t0s t JOIN filings f ON f.company_id = t.company_id AND f.published <= t.t0),
 one AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY company_id, t0, period_end ORDER BY published DESC, vintage DESC) = 1),
 newest AS (SELECT *, dense_rank() OVER (PARTITION BY company_id, t0 ORDER BY period_end DESC) AS age FROM one)"""


def dates(spark, sf_dir):
    return a.filings(spark, sf_dir).select("company_id", F.date_add("period_end", 100).alias("t0")).distinct()


@query("J1_bitemporal_as_of", f"WITH {AS_OF} SELECT company_id, t0, period_end, CAST(age AS INT) AS age, vintage, round(revenue, 2) AS revenue FROM newest WHERE age <= 8")
def bitemporal_as_of(spark, sf_dir):
    return pit.as_of(a.filings(spark, sf_dir), dates(spark, sf_dir)).select("company_id", "t0", "period_end", "age", "vintage", F.round("revenue", 2).alias("revenue"))


@query("J2_price_backward", f"""WITH {BARS}, p AS (SELECT DISTINCT company_id, CAST(date_trunc('month', trading_date) + INTERVAL 14 DAY AS DATE) AS at_date FROM bars)
SELECT p.company_id, p.at_date, b.trading_date AS price_date, round(b.close, 6) AS price FROM p ASOF LEFT JOIN bars b ON b.company_id = p.company_id AND b.trading_date <= p.at_date""")
def price_backward(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    points = bars.select("company_id", F.date_add(F.trunc("trading_date", "month"), 14).alias("at_date")).distinct()
    return pit.price_as_of(points, bars, "at_date").select("company_id", "at_date", "price_date", F.round("price", 6).alias("price"))


@query("J3_price_forward", f"""WITH {BARS}, k AS (SELECT company_id, min(trading_date) AS t0 FROM bars GROUP BY company_id, year(trading_date)), h AS (SELECT k.*, unnest([90, 180, 365, 730, 1095]) AS days FROM k)
SELECT h.company_id, h.t0, h.days, b.trading_date AS price_date, round(b.close, 6) AS price FROM h ASOF LEFT JOIN bars b ON b.company_id = h.company_id AND b.trading_date >= h.t0 + h.days""")
def price_forward(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    points = paths.year_anchors(bars).withColumn("days", F.explode(F.array(*(F.lit(d) for d in (90, 180, 365, 730, 1095))))).withColumn("target", F.date_add("t0", F.col("days")))
    return pit.price_as_of(points, bars, "target", forward=True).select("company_id", "t0", "days", "price_date", F.round("price", 6).alias("price"))


@query("J4_two_sided_as_of", f"""WITH {FILINGS}, p AS (SELECT DISTINCT company_id, period_end AS q, period_end + 60 AS pub FROM filings)
SELECT p.company_id, p.q, max(f.period_end) AS period_end, round(arg_max(f.revenue, (f.period_end, f.published)), 2) AS revenue FROM p JOIN filings f ON f.company_id = p.company_id AND f.period_end <= p.q AND f.published <= p.pub GROUP BY p.company_id, p.q""")
def two_sided_as_of(spark, sf_dir):
    filings = a.filings(spark, sf_dir)
    p = filings.select("company_id", F.col("period_end").alias("q"), F.date_add("period_end", 60).alias("pub")).distinct()
    x = p.join(filings, "company_id").where("period_end <= q AND published <= pub")
    out = x.groupBy("company_id", "q").agg(F.max_by(F.struct("period_end", "revenue"), F.struct("period_end", "published")).alias("v"))
    return out.select("company_id", "q", "v.period_end", F.round("v.revenue", 2).alias("revenue"))


@query("J5_members_at", f"""WITH {UNIVERSE}, d AS (SELECT unnest([DATE '1996-06-30', DATE '1998-06-30', DATE '2000-12-31', DATE '2001-08-01']) AS t0)
SELECT t0, count(*) AS members FROM universe JOIN d ON effective_from <= t0 AND (effective_to IS NULL OR effective_to >= t0) GROUP BY t0""")
def members_at(spark, sf_dir):
    d = spark.sql("SELECT explode(array(date'1996-06-30', date'1998-06-30', date'2000-12-31', date'2001-08-01')) t0")
    return j.members_at(a.universe(spark, sf_dir), d).groupBy("t0").agg(F.count("*").alias("members"))


@query("J6_purge_same_company", f"""WITH {INTERVALS}, tr AS (SELECT * FROM intervals WHERE observation_id % 2 = 0), te AS (SELECT * FROM intervals WHERE observation_id % 2 = 1 AND label_start >= DATE '2000-01-01')
SELECT observation_id FROM tr WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.company_id = tr.company_id AND tr.label_start < te.label_end AND te.label_start < tr.label_end)""")
def purge_same_company(spark, sf_dir):
    x = a.label_intervals(spark, sf_dir)
    return j.purge(x.where("observation_id % 2 = 0"), x.where("observation_id % 2 = 1 AND label_start >= '2000-01-01'"), True).select("observation_id")


@query("J6_purge_global", f"""WITH {INTERVALS}, tr AS (SELECT * FROM intervals WHERE observation_id % 2 = 0), te AS (SELECT min(label_start) AS s, max(label_end) AS e FROM intervals WHERE observation_id % 2 = 1 AND label_start >= DATE '2000-01-01')
SELECT observation_id FROM tr, te WHERE NOT (label_start < e AND s < label_end)""")
def purge_global(spark, sf_dir):
    x = a.label_intervals(spark, sf_dir)
    return j.purge(x.where("observation_id % 2 = 0"), x.where("observation_id % 2 = 1 AND label_start >= '2000-01-01'"), False).select("observation_id")


@query("J7_fold_overlap", f"""WITH {INTERVALS} SELECT a.observation_id FROM intervals a WHERE a.observation_id % 2 = 0 AND EXISTS (SELECT 1 FROM intervals b WHERE b.observation_id % 2 = 1 AND b.company_id = a.company_id AND a.label_start < b.label_end AND b.label_start < a.label_end)""")
def fold_overlap(spark, sf_dir):
    x = a.label_intervals(spark, sf_dir)
    return j.fold_overlap(x.where("observation_id % 2 = 0"), x.where("observation_id % 2 = 1")).select("observation_id")


@query("J8_split_adjusted", f"""WITH {BARS}, {ACTIONS} SELECT b.company_id, b.trading_date, round(b.close * power(0.5, count(x.ex_date)), 10) AS close, round(b.volume / power(0.5, count(x.ex_date)), 4) AS volume
FROM bars b LEFT JOIN actions x ON x.company_id = b.company_id AND b.trading_date < x.ex_date AND x.ex_date <= DATE '2000-06-30' GROUP BY b.company_id, b.trading_date, b.close, b.volume""")
def split_adjusted(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    return j.adjusted_bars(bars, a.actions(bars), "2000-06-30").select("company_id", "trading_date", F.round("close", 10).alias("close"), F.round("volume", 4).alias("volume"))


@query("J9_benchmark_alignment", f"WITH {BARS}, {MARKET} SELECT company_id, trading_date, round(b.close / m.close, 8) AS ratio FROM bars b JOIN market m USING (trading_date)")
def benchmark_alignment(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    market = a.benchmark_bars(bars).withColumnRenamed("close", "m")
    return bars.join(market, "trading_date").select("company_id", "trading_date", F.round(F.col("close") / F.col("m"), 8).alias("ratio"))


@query("J10_session_pairs", f"""WITH {BARS}, s AS (SELECT trading_date, lead(trading_date) OVER (ORDER BY trading_date) AS next_date FROM (SELECT DISTINCT trading_date FROM bars))
SELECT b.company_id, b.trading_date, round((n.open / b.close - 1) * 100, 6) AS gap, round((n.high / b.close - 1) * 100, 6) AS mfe, round((n.low / b.close - 1) * 100, 6) AS mae, round((n.close / b.close - 1) * 100, 6) AS ret
FROM bars b JOIN s USING (trading_date) JOIN bars n ON n.company_id = b.company_id AND n.trading_date = s.next_date""")
def session_pairs(spark, sf_dir):
    return j.session_pairs(a.bars(spark, sf_dir)).select("company_id", "trading_date", *(F.round(c, 6).alias(c) for c in ("gap", "mfe", "mae", "ret")))


@query("J11_waterfall", f"""WITH {FILINGS}, q AS (SELECT company_id, period_end, max(revenue) FILTER (vintage = 1 AND month(period_end) <> 3) AS restated, max(revenue) FILTER (vintage = 0) AS original FROM filings GROUP BY 1, 2)
SELECT company_id, period_end, round(coalesce(restated, original), 2) AS revenue, CASE WHEN restated IS NOT NULL THEN 'restated' ELSE 'original' END AS source FROM q""")
def waterfall(spark, sf_dir):
    from ..sources import parsers

    f = a.filings(spark, sf_dir).withColumn("key", F.concat_ws("|", "company_id", "period_end"))
    keys = f.select("key", "company_id", "period_end").distinct()
    sources = [("restated", f.where("vintage = 1 AND month(period_end) <> 3")), ("original", f.where("vintage = 0"))]
    return parsers.with_confidence(keys, sources, "key", "revenue").select("company_id", "period_end", F.round("revenue", 2).alias("revenue"), "source")


@query("J12_year_over_year", f"""WITH {FILINGS}, q AS (SELECT * FROM filings WHERE vintage = 0) SELECT c.company_id, c.period_end, round(p.revenue, 2) AS prior, round((c.revenue / p.revenue - 1) * 100, 4) AS growth
FROM q c LEFT JOIN q p ON p.company_id = c.company_id AND year(p.period_end) = year(c.period_end) - 1 AND month(p.period_end) = month(c.period_end)""")
def year_over_year(spark, sf_dir):
    return pit.year_over_year(a.filings(spark, sf_dir).where("vintage = 0")).select("company_id", "period_end", F.round("prior", 2).alias("prior"), F.round("growth", 4).alias("growth"))


@query("J13_prior_year_window", f"""WITH {FILINGS}, q AS (SELECT * FROM filings WHERE vintage = 0) SELECT c.company_id, c.period_end, max(p.period_end) AS prior_end FROM q c JOIN q p ON p.company_id = c.company_id AND c.period_end - p.period_end BETWEEN 300 AND 420 GROUP BY 1, 2""")
def prior_year_window(spark, sf_dir):
    q = a.filings(spark, sf_dir).where("vintage = 0")
    p = q.select("company_id", F.col("period_end").alias("prior_end"))
    return q.join(p, "company_id").where(F.datediff("period_end", "prior_end").between(300, 420)).groupBy("company_id", "period_end").agg(F.max("prior_end").alias("prior_end"))


@query("J15_absorbed_all", f"""WITH {FILINGS}, e AS (SELECT DISTINCT company_id, period_end + 10 AS happened FROM filings)
SELECT e.company_id, e.happened, count(f.published) AS later, count(f.published) >= 2 AS absorbed FROM e LEFT JOIN filings f ON f.company_id = e.company_id AND f.published > e.happened GROUP BY 1, 2""")
def absorbed_all(spark, sf_dir):
    """One event ten days after the end of every quarter that has a filing of any vintage."""
    f = a.filings(spark, sf_dir)
    return _absorbed(f, f.select("company_id", "period_end").distinct())


query("J15_absorbed", SQL["J15_absorbed_all"])(absorbed_all)


def _absorbed(f, filed):
    e = filed.select("company_id", F.date_add("period_end", 10).alias("happened"))
    x = e.join(f.select(F.col("company_id").alias("c"), "published"), (F.col("company_id") == F.col("c")) & (F.col("published") > F.col("happened")), "left")
    return x.groupBy("company_id", "happened").agg(F.count("published").alias("later")).withColumn("absorbed", F.col("later") >= 2)


@query("J16_dimension_lookup", """SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookup(spark, sf_dir):
    c, n, r = (a.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("J17_reconcile", f"""WITH {BARS}, o AS (SELECT company_id, trading_date, close * (1 + (day(trading_date) % 5) * 0.004) AS b FROM bars WHERE day(trading_date) <> 7), p AS (SELECT company_id, trading_date, close AS a FROM bars WHERE day(trading_date) <> 9),
 x AS (SELECT company_id, trading_date, a, b, abs(a - b) / a * 100 AS off FROM p FULL JOIN o USING (company_id, trading_date))
SELECT company_id, trading_date, round(coalesce(a, b), 6) AS close, CASE WHEN b IS NULL THEN 'PRIMARY_ONLY' WHEN a IS NULL THEN 'SECONDARY_ONLY' WHEN off <= 0.5 THEN 'VERIFIED' WHEN off <= 1.5 THEN 'MINOR' ELSE 'DIVERGENT' END AS status FROM x""")
def reconcile(spark, sf_dir):
    bars, day = a.bars(spark, sf_dir), F.dayofmonth("trading_date")
    other = bars.where(day != 7).withColumn("close", F.col("close") * (1 + (day % 5) * 0.004))
    return j.reconcile(bars.where(day != 9), other, ["company_id", "trading_date"], "close").select("company_id", "trading_date", F.round("close", 6).alias("close"), "status")


@query("J21_latest_later", f"""WITH {FILINGS}, s AS (SELECT DISTINCT company_id, period_end AS t0 FROM filings) SELECT s.company_id, s.t0, max(f.period_end) AS last_end FROM s JOIN filings f ON f.company_id = s.company_id AND f.period_end > s.t0 GROUP BY 1, 2""")
def latest_later(spark, sf_dir):
    f = a.filings(spark, sf_dir)
    s = f.select("company_id", F.col("period_end").alias("t0")).distinct()
    return s.join(f, "company_id").where("period_end > t0").groupBy("company_id", "t0").agg(F.max("period_end").alias("last_end"))


@query("J22_trailing_known", f"""WITH {FILINGS}, q AS (SELECT company_id, period_end, CASE WHEN quarter(period_end) IN (2, 4) THEN revenue END AS v FROM filings WHERE vintage = 0)
SELECT company_id, period_end, round(last_value(v IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY period_end), 2) AS known FROM q""")
def trailing_known(spark, sf_dir):
    q = a.filings(spark, sf_dir).where("vintage = 0").withColumn("v", F.when(F.quarter("period_end").isin(2, 4), F.col("revenue")))
    known = F.last("v", ignorenulls=True).over(Window.partitionBy("company_id").orderBy("period_end"))
    return q.select("company_id", "period_end", F.round(known, 2).alias("known"))


@query("J23_tolerance_as_of", f"""WITH {FILINGS}, b AS (SELECT company_id, period_end, revenue FROM filings WHERE vintage = 0 AND quarter(period_end) IN (2, 4)), q AS (SELECT company_id, period_end AS want FROM filings WHERE vintage = 0)
SELECT q.company_id, q.want, max(b.period_end) AS found FROM q LEFT JOIN b ON b.company_id = q.company_id AND q.want - b.period_end BETWEEN 0 AND 100 GROUP BY 1, 2""")
def tolerance_as_of(spark, sf_dir):
    q = a.filings(spark, sf_dir).where("vintage = 0")
    b = q.where(F.quarter("period_end").isin(2, 4)).select(F.col("company_id").alias("c"), F.col("period_end").alias("found"))
    near = (F.col("company_id") == F.col("c")) & F.datediff("period_end", "found").between(0, 100)
    return q.join(b, near, "left").groupBy("company_id", F.col("period_end").alias("want")).agg(F.max("found").alias("found"))


@query("A1_trailing_sum", f"""WITH {AS_OF} SELECT company_id, t0, round(sum(revenue) * 4 / count(revenue), 2) AS ttm, count(revenue) AS periods FROM newest WHERE age <= 4 GROUP BY company_id, t0""")
def trailing_sum(spark, sf_dir):
    out = pit.trailing_sum(pit.as_of(a.filings(spark, sf_dir), dates(spark, sf_dir)))
    return out.select("company_id", "t0", F.round("ttm", 2).alias("ttm"), "periods")


@query("U1_common_dates", f"WITH {BARS} SELECT trading_date FROM bars WHERE company_id = 'Brand#1' INTERSECT SELECT trading_date FROM bars WHERE company_id = 'Brand#2'")
def common_dates(spark, sf_dir):
    bars = a.bars(spark, sf_dir)
    return bars.where("company_id = 'Brand#1'").select("trading_date").intersect(bars.where("company_id = 'Brand#2'").select("trading_date"))


@query("U4_metamorphic", f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({W}) AS n FROM bars) SELECT company_id, count(*) AS bars, count(*) FILTER (n >= 20) AS means, CAST(0 AS BIGINT) AS differ FROM n GROUP BY company_id""")
def metamorphic(spark, sf_dir):
    """Per company, its bars, those with a mean, and the means that change when bars of other companies are added: there are none."""
    bars = a.bars(spark, sf_dir)
    more = bars.unionByName(bars.withColumn("company_id", F.concat(F.lit("poison "), F.col("company_id"))).withColumn("close", F.col("close") * 100))

    def means(x, name):
        return x.withColumn(name, w.sma(20)).where("company_id NOT LIKE 'poison%'").select("company_id", "trading_date", name)

    both = means(bars, "s").join(means(more, "t"), ["company_id", "trading_date"], "full")
    return both.groupBy("company_id").agg(F.count("*").alias("bars"), F.count("s").alias("means"), F.count_if(~F.col("s").eqNullSafe(F.col("t"))).alias("differ"))


@query("S12_upsert", f"""WITH {FILINGS} SELECT company_id, period_end, round(arg_max(revenue, published), 2) AS revenue FROM filings GROUP BY company_id, period_end""")
def upsert(spark, sf_dir):
    """Old rows and new ones united, the latest per key kept."""
    f = a.filings(spark, sf_dir)
    merged = f.where("vintage = 0").unionByName(f.where("vintage = 1"))
    newest = merged.groupBy("company_id", "period_end").agg(F.max_by("revenue", "published").alias("revenue"))
    return newest.select("company_id", "period_end", F.round("revenue", 2).alias("revenue"))


@query("S7_new_members", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')""")
def new_members(spark, sf_dir):
    from ..sources import parsers

    have = a.table(spark, sf_dir, "orders").where("o_orderdate < '1995-06-01'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return parsers.new_members(a.table(spark, sf_dir, "customer"), have, "c_custkey").select("c_custkey")
