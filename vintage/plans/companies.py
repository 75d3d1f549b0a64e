"""Queries over functions of companies and quotes, and logs of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import scores
from ..sources import adapters as a
from .registry import query
from .views import BARS, W


@query("F8_contradictions", """SELECT c_custkey, (c_acctbal > 3000 AND c_nationkey % 3 = 0)::INT + (c_custkey % 2 = 0 AND c_nationkey < 10)::INT AS found FROM customer""")
def contradictions(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer")
    good = F.array_compact(F.array(F.when(F.col("c_acctbal") > 3000, "Strong liquidity"), F.when(F.col("c_custkey") % 2 == 0, "attractive valuation")))
    bad = F.array_compact(F.array(F.when(F.col("c_nationkey") % 3 == 0, "stock is ILLIQUID"), F.when(F.col("c_nationkey") < 10, "expensive valuation")))
    return c.select("c_custkey", F.size(f.contradictions(good, bad)).alias("found"))


@query("F11_terminal_recovery", "SELECT p_partkey, round((p_size * 2.0 + p_size * 1.5 - p_retailprice) / p_retailprice * 100, 6) AS terminal_return FROM part")
def terminal_recovery(spark, sf_dir):
    size = F.col("p_size")
    return a.table(spark, sf_dir, "part").select("p_partkey", F.round(f.terminal_return(F.col("p_retailprice"), size * 2.0, size * 1.5), 6).alias("terminal_return"))


@query("F20_reinvestment", """SELECT c_custkey, round((c_nationkey * 40 + greatest(c_acctbal, 0)) / greatest(c_custkey, 1) * 100, 4) AS rate, CASE WHEN (c_nationkey * 40 + greatest(c_acctbal, 0)) / greatest(c_custkey, 1) * 100 > 70 THEN 'AGGRESSIVE_EXPANSION'
  WHEN (c_nationkey * 40 + greatest(c_acctbal, 0)) / greatest(c_custkey, 1) * 100 >= 30 THEN 'BALANCED_COMPOUNDER' ELSE 'CASH_DISTRIBUTOR' END AS posture FROM customer""")
def reinvestment(spark, sf_dir):
    rate, posture = f.reinvestment(F.col("c_nationkey") * 40.0, F.col("c_acctbal"), F.col("c_custkey").cast("double"))
    return a.table(spark, sf_dir, "customer").select("c_custkey", F.round(rate, 4).alias("rate"), posture.alias("posture"))


@query("F28_cash_cycle", """SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 20000 * 365 END + CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey * 100 / 15000.0 * 365 ELSE 0 END - c_nationkey * 50 / 15000.0 * 365, 9) AS cycle FROM customer""")
def cash_cycle(spark, sf_dir):
    nation = F.col("c_nationkey")
    dso, dpo = f.days_outstanding(F.col("c_acctbal"), F.lit(20000.0)), f.days_outstanding(nation * 50.0, F.lit(15000.0))
    dio = f.days_outstanding(F.when(F.col("c_custkey") % 5 != 0, nation * 100.0), F.lit(15000.0))
    return a.table(spark, sf_dir, "customer").select("c_custkey", F.round(f.cash_cycle(dso, dio, dpo), 9).alias("cycle"))


@query("F37_quote_labels", f"""WITH {BARS}, g AS (SELECT *, (open / lag(close) OVER ({W}) - 1) * 100 AS gap FROM bars) SELECT company_id, trading_date, CASE WHEN gap >= 4.5 THEN 'EXHAUSTION_GAP_WARNING' WHEN gap >= 0.5 THEN 'GAP_AND_GO' WHEN gap >= -1.5 THEN 'FLAT_OPEN_SURGE' ELSE 'GAP_DOWN_REVERSAL' END AS gap_type FROM g WHERE gap IS NOT NULL""")
def quote_labels(spark, sf_dir):
    from ..operators import windows as w

    x = a.bars(spark, sf_dir).withColumn("gap", (F.col("open") / F.lag("close").over(w.sessions()) - 1) * 100).where("gap IS NOT NULL")
    return x.select("company_id", "trading_date", f.gap_character(F.col("gap")).alias("gap_type"))


@query("F37_session_phase", "SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) < 615 THEN 'OPENING_RANGE_WINDOW' WHEN hour(ts) * 60 + minute(ts) < 810 THEN 'MIDDAY_CHOP_ZONE' ELSE 'AFTERNOON_TREND_RUN' END AS phase FROM events")
def session_phase(spark, sf_dir):
    return a.quotes(spark, sf_dir).select("event_id", f.session_phase(F.hour("ts") * 60 + F.minute("ts")).alias("phase"))


@query("J14_prediction_log", "SELECT d.doc_id, n_chars, quality, CASE WHEN quality IS NULL THEN 'PENDING' WHEN (n_chars > 1000) = (quality = 1) THEN 'RIGHT' ELSE 'WRONG' END AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def prediction_log(spark, sf_dir):
    """Predictions (long texts are good) with the outcome, where there is one; the status is derived, never stored."""
    d, labels = a.table(spark, sf_dir, "documents"), a.table(spark, sf_dir, "labels").select("doc_id", "quality")
    right = (F.col("n_chars") > 1000) == (F.col("quality") == 1)
    x = d.select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return x.withColumn("status", F.when(F.col("quality").isNull(), "PENDING").when(right, "RIGHT").otherwise("WRONG"))


@query("M37_graduation_board", """WITH g AS (SELECT c_custkey, c_acctbal / 100 * 0.4 + c_nationkey * 4 * 0.3 + c_custkey % 100 * 0.3 AS graduation FROM customer WHERE c_acctbal / 100 >= 70) SELECT c_custkey, round(graduation, 6) AS graduation, CASE WHEN graduation >= 85 THEN 'READY' WHEN graduation >= 65 THEN 'NEAR' ELSE 'WAIT' END AS board FROM g""")
def graduation_board(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("potential"), (F.col("c_nationkey") * 4.0).alias("technical_score"), (F.col("c_custkey") % 100).cast("double").alias("readiness"))
    return scores.graduation(c.where("potential >= 70")).select("c_custkey", F.round("graduation", 6).alias("graduation"), "board")


@query("A23_radar_summary", "SELECT event_type, count(*) AS n, count(*) FILTER (value >= 50) AS strong, round(avg(value), 8) AS mean_value FROM events GROUP BY 1")
def radar_summary(spark, sf_dir):
    return a.quotes(spark, sf_dir).groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"), F.count_if(F.col("price") >= 50).alias("strong"), F.round(F.avg("price"), 8).alias("mean_value"))
