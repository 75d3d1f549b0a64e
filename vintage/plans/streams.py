"""Batch queries of the streaming operators; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as a
from ..sources.stored import shared_folder
from ..streaming import basket, radar
from .registry import query


@query("R1_microstructure", """WITH q AS (SELECT event_id, value AS price, user_id % 97 + 1 AS buy, event_id % 89 + 1 AS sell, event_type = 'error' AS synthetic, 40.0 AS average FROM events), s AS (SELECT *, (buy - sell)::DOUBLE / (buy + sell) AS imbalance, (price / average - 1) * 100 AS delta FROM q)
SELECT event_id, round(imbalance, 6) AS imbalance, CASE WHEN synthetic THEN 'NO_DEPTH' WHEN imbalance > 0.3 AND delta > 0 THEN 'BUY_PRESSURE' WHEN imbalance < -0.3 AND delta < 0 THEN 'SELL_PRESSURE' ELSE 'NEUTRAL' END AS signal FROM s""")
def microstructure(spark, sf_dir):
    q = a.quotes(spark, sf_dir).select(
        "event_id", "price", (F.col("symbol") % 97 + 1).cast("double").alias("buy_qty"), (F.col("event_id") % 89 + 1).cast("double").alias("sell_qty"), (F.col("kind") == "error").alias("synthetic"), F.lit(40.0).alias("average"),
        F.lit(40.0).alias("open"), F.lit(39.0).alias("prev_close"),
    )
    return radar.microstructure(q).select("event_id", F.round("imbalance", 6).alias("imbalance"), "signal")


@query("R2_latest", "SELECT user_id AS symbol, max(ts) AS ts, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1")
def latest(spark, sf_dir):
    return radar.latest_per_symbol(a.quotes(spark, sf_dir))


@query("R6_staleness", "SELECT user_id AS symbol, round(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31 00:00:00') / 60.0, 0) >= 0 AS known, count(*) AS ticks FROM events GROUP BY 1")
def staleness(spark, sf_dir):
    t = a.quotes(spark, sf_dir)
    x = radar.with_staleness(radar.latest_per_symbol(t), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    n = t.groupBy("symbol").agg(F.count("*").alias("ticks"))
    return x.join(n, "symbol").select("symbol", (F.round("age_minutes", 0) >= 0).alias("known"), "ticks")


@query("R7_session", """WITH l AS (SELECT event_id, ts + INTERVAL '5 hours 30 minutes' AS t FROM events) SELECT event_id, isodow(t) <= 5 AND hour(t) * 60 + minute(t) BETWEEN 555 AND 930 AS in_session FROM l""")
def session(spark, sf_dir):
    return a.quotes(spark, sf_dir).select("event_id", radar.in_session().alias("in_session"))


@query("R8_bars_from_ticks", "SELECT user_id AS symbol, date_trunc('day', ts)::TIMESTAMP AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2")
def bars_from_ticks(spark, sf_dir):
    return radar.bars_from_ticks(a.quotes(spark, sf_dir))


@query("R9_deduplicated", "SELECT event_id, user_id AS symbol FROM (SELECT DISTINCT event_id, user_id FROM events)")
def deduplicated(spark, sf_dir):
    t = a.quotes(spark, sf_dir)
    return radar.deduplicated(t.unionByName(t)).select("event_id", "symbol")


#: Desks that watch, each with a basket of its own; an error event takes its symbol out.
DESKS = 40


def desk_quotes(events):
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % DESKS).alias("desk"), F.col("user_id").alias("symbol"), F.col("value").alias("price"), (F.col("event_type") == "error").alias("removes"))


_BASKET = f"""WITH RECURSIVE q AS (SELECT event_id % {DESKS} AS desk, user_id AS symbol, ts, event_id, value AS price, event_type = 'error' AS removes, row_number() OVER (PARTITION BY event_id % {DESKS} ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT DISTINCT desk, 0::BIGINT AS n, []::STRUCT(s BIGINT, t TIMESTAMP, p DOUBLE)[] AS held FROM q UNION ALL
  SELECT w.desk, q.n, CASE WHEN removes THEN list_filter(held, lambda x: x.s <> symbol) WHEN list_contains(list_transform(held, lambda x: x.s), symbol) THEN list_transform(held, lambda x: CASE WHEN x.s = symbol THEN {{'s': symbol, 't': ts::TIMESTAMP, 'p': price}} ELSE x END)
   WHEN len(held) >= 8 THEN list_append(held[2:], {{'s': symbol, 't': ts::TIMESTAMP, 'p': price}}) ELSE list_append(held, {{'s': symbol, 't': ts::TIMESTAMP, 'p': price}}) END FROM w JOIN q ON q.desk = w.desk AND q.n = w.n + 1),
 f AS (SELECT desk, unnest(held) AS h FROM w QUALIFY row_number() OVER (PARTITION BY desk ORDER BY n DESC) = 1)
SELECT desk, h.s AS symbol, h.t AS ts, h.p AS price, epoch_ms(h.t) + 1800000 > (SELECT epoch_ms(max(ts)::TIMESTAMP) - 600000 FROM events) AS usable FROM f"""


@query("R2_baskets", _BASKET)
def baskets(spark, sf_dir):
    """Runs the stateful stream over all events and returns what the desks' baskets hold, and what has not turned stale."""
    basket.configure(spark)
    schema = a.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, since the table may be one file
    return basket.baskets(basket.run_to_end(basket.basket_changes(desk_quotes(events)), shared_folder(spark, "radar")))


@query("R6_usable", "WITH l AS (SELECT user_id AS symbol, max(ts)::TIMESTAMP AS ts, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1), n AS (SELECT max(ts)::TIMESTAMP AS now FROM events) SELECT symbol, price, round(date_diff('second', date_trunc('second', ts), date_trunc('second', now)) / 60.0, 0) AS age_minutes, epoch(now) - epoch(ts) <= 1800 AS usable FROM l, n")
def usable(spark, sf_dir):
    """Newest quote of every symbol, its age at the newest event of all, and whether it may still be served."""
    t = a.quotes(spark, sf_dir)
    now = t.agg(F.max("ts").alias("now"))
    x = radar.latest_per_symbol(t).crossJoin(F.broadcast(now))  # one row
    age = (F.unix_timestamp("now") - F.unix_timestamp("ts")) / 60
    fresh = F.unix_micros("now") - F.unix_micros("ts") <= radar.STALE_MINUTES * 60_000_000
    return x.select("symbol", "price", F.round(age, 0).alias("age_minutes"), fresh.alias("usable"))
