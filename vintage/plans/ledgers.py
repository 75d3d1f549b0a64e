"""Queries over sinks: snapshots, merged bars, predictions and their outcomes, calibration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import canonical_hash
from ..operators import paths
from ..sources import adapters as a
from ..sources import sinks
from ..sources.stored import shared_folder
from .bar_windows import START
from .feature_sql import FEATURES
from .fundamentals import vector
from .registry import query
from .views import BARS

c = F.col
#: Features of a decision snapshot.
FROZEN = ("ttm_revenue", "ttm_pat", "ebitda_margin", "revenue_growth", "roce", "debt_to_equity", "ttm_fcf", "pe", "pb", "close", "sma200", "rsi")

_TEXT = " || '|' || ".join(f"'{k}=' || coalesce(CAST(CAST({k} AS DECIMAL(38,6)) AS VARCHAR), 'null')" for k in sorted(FROZEN))


@query("S11_decision_snapshots", f"""WITH {FEATURES}, r AS (SELECT company_id, t0, {', '.join(f"round({k}, 3) AS {k}" for k in FROZEN)} FROM features), m AS (SELECT *, {' + '.join(f"({k} IS NULL)::INT" for k in FROZEN)} AS missing FROM r)
SELECT company_id, t0, sha256({_TEXT}) AS dataset_hash, round(missing / {len(FROZEN)}.0 * 100, 2) AS missingness_pct, round(100 - round(missing / {len(FROZEN)}.0 * 100, 2), 2) AS quality_score, CAST(year(t0) AS VARCHAR) AS batch FROM m""")
def decision_snapshots(spark, sf_dir):
    """Snapshots of the feature vector, appended year by year to a table and read back; one batch is sent twice and counts once."""
    path = shared_folder(spark, "snapshots")
    x = vector(spark, sf_dir).select("company_id", "t0", *(F.round(k, 3).alias(k) for k in FROZEN))
    x = sinks.with_quality(x, list(FROZEN)).withColumn("dataset_hash", canonical_hash(list(FROZEN)))
    x.write.parquet(f"{path}/source")
    x = spark.read.schema(x.schema).parquet(f"{path}/source")
    years = [r[0] for r in x.select(F.year("t0")).distinct().orderBy(F.year("t0")).collect()]
    for year in [*years, years[-1]] if years else []:
        sinks.append_snapshot(x.where(F.year("t0") == year), f"{path}/table", str(year))
    return sinks.read_snapshots(spark, f"{path}/table", x.schema).select("company_id", "t0", "dataset_hash", "missingness_pct", "quality_score", "batch")


@query("S22_bar_merge", f"""WITH {BARS}, late AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trading_date DESC) AS k FROM bars), fresh AS (SELECT company_id, trading_date, close * 1.01 AS close, volume FROM late WHERE k <= 30 AND ascii(right(company_id, 1)) % 2 = 0
  UNION ALL SELECT company_id, trading_date + 1, close, volume FROM late WHERE k = 1)
SELECT coalesce(f.company_id, b.company_id) AS company_id, coalesce(f.trading_date, b.trading_date) AS trading_date, round(coalesce(f.close, b.close), 8) AS close, coalesce(f.volume, b.volume) AS volume FROM bars b FULL JOIN fresh f ON f.company_id = b.company_id AND f.trading_date = b.trading_date""")
def bar_merge(spark, sf_dir):
    """Refreshed symbols replace their last thirty bars and add one; the refresh is sent twice."""
    from pyspark.sql import Window

    path = shared_folder(spark, "bars")
    columns = ["company_id", "trading_date", "close", "volume"]
    bars = a.bars(spark, sf_dir).select(*columns)
    sinks.merge(bars, path, "initial", ["company_id", "trading_date"], [], buckets=8)
    held = sinks.read_merged(spark, path, bars.schema)
    k = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("trading_date")))
    late = held.withColumn("k", k)
    fresh = late.where((c("k") <= 30) & (F.ascii(F.right("company_id", F.lit(1))) % 2 == 0)).withColumn("close", c("close") * 1.01).select(*columns)
    fresh = fresh.unionByName(late.where("k = 1").withColumn("trading_date", F.date_add("trading_date", 1)).select(*columns))
    for _ in range(2):
        sinks.merge(fresh, path, "refresh", ["company_id", "trading_date"], [], buckets=8)
    return sinks.read_merged(spark, path, bars.schema).select("company_id", "trading_date", F.round("close", 8).alias("close"), "volume")


@query("S14_truth_log", f"""WITH {BARS}, {START}, o AS (SELECT company_id, t0, any_value(p0) AS arrival, min(trading_date) FILTER (p >= 2 * p0) AS hit, min(i) FILTER (p >= 2 * p0) AS days FROM pathed GROUP BY 1, 2)
SELECT sha256(company_id || '|' || CAST(t0 AS VARCHAR)) AS prediction_id, company_id, t0, round(arrival, 4) AS arrival_price, CASE WHEN hit IS NOT NULL THEN 'RESOLVED' ELSE 'PENDING' END AS status, hit AS resolved_at, days AS holding_bars FROM o""")
def truth_log(spark, sf_dir):
    """Predictions of every year's first session and what resolved them: both appended, the status follows from the join."""
    path = shared_folder(spark, "truth")
    bars = a.bars(spark, sf_dir)
    o = paths.outcomes(bars, paths.year_anchors(bars)).withColumn("prediction_id", F.sha2(F.concat_ws("|", "company_id", c("t0").cast("string")), 256))
    o.write.parquet(f"{path}/source")
    o = spark.read.schema(o.schema).parquet(f"{path}/source")
    predictions = o.select("prediction_id", "company_id", "t0", c("p0").alias("arrival_price"))
    resolved = o.where("bar_2x IS NOT NULL").select("prediction_id", c("date_2x").alias("resolved_at"), c("bar_2x").alias("holding_bars"))
    sinks.append_snapshot(predictions, f"{path}/predictions", "all")
    for part in (0, 1, 1):
        sinks.append_snapshot(resolved.where(F.pmod(F.xxhash64("prediction_id"), F.lit(2)) == part), f"{path}/outcomes", f"part{part}")
    known = sinks.read_snapshots(spark, f"{path}/predictions", predictions.schema).drop("batch")
    found = sinks.read_snapshots(spark, f"{path}/outcomes", resolved.schema).drop("batch")
    return sinks.reconcile_predictions(known, found).withColumn("arrival_price", F.round("arrival_price", 4))


@query("S13_calibration_table", """WITH t AS (SELECT l_returnflag AS setup, l_linestatus AS regime, count(*) AS n, round(avg(l_discount), 6) AS rate FROM lineitem GROUP BY 1, 2) SELECT setup, regime, n, rate FROM t""")
def calibration_table(spark, sf_dir):
    """A table of conditional rates, saved as JSON and loaded again."""
    t = a.table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("setup"), c("l_linestatus").alias("regime")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("rate"))
    path = shared_folder(spark, "calibration")
    sinks.save_calibration(t, path)
    return sinks.load_calibration(spark, path, t.schema)
