"""Streams over the event files give what the batch gives."""

import pytest

from vintage.plans import streams
from vintage.sources import adapters as a
from vintage.streaming import radar

SF = "/root/testdata/sf0.001"


def ticks(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    return raw.selectExpr("event_id", "cast(ts as timestamp) ts", "user_id symbol", "value price", "event_type kind")


def run(spark, df, name, mode):
    stream = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    stream.processAllAvailable()
    stream.stop()
    return spark.table(name)


@pytest.mark.parametrize(("name", "build", "batch", "mode"), [
    ("bars", radar.bars_from_ticks, streams.bars_from_ticks, "complete"), ("latest", radar.latest_per_symbol, streams.latest, "complete"),
])
def test_stream_equals_batch(spark, name, build, batch, mode):
    got, want = run(spark, build(ticks(spark)), name, mode), batch(spark, SF)
    got = got.select(*want.columns)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_drops_repeated_events(spark):
    t = ticks(spark)
    got = run(spark, radar.deduplicated(t.unionByName(t)), "dedup", "append")
    assert got.count() == a.quotes(spark, SF).count()


def desk_rows(rng, n):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(minutes=i * 3 + rng.randrange(3)), i % 3, rng.randrange(14), float(i), rng.random() < 0.1) for i in range(n)]


def replayed(rows, size, watermark):
    """The baskets after all rows, and which of them are stale at the watermark."""
    held = {}
    for event, ts, desk, symbol, price, removes in sorted(rows, key=lambda r: (r[1], r[0])):
        basket = held.setdefault(desk, {})
        if removes:
            basket.pop(symbol, None)
            continue
        if symbol not in basket and len(basket) >= size:
            del basket[next(iter(basket))]
        basket[symbol] = (ts, price)
    return {(d, s, ts, p, int(ts.timestamp() * 1000) + 1_800_000 > watermark) for d, b in held.items() for s, (ts, p) in b.items()}


def test_basket_radar_goes_on_after_a_restart(spark):
    """Three runs over growing input with one checkpoint: every change once, and the baskets that one run over all gives."""
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from vintage.sources.stored import shared_folder
    from vintage.streaming import basket

    basket.configure(spark)
    rng, schema = random.Random(5), "event_id long, ts timestamp, desk long, symbol long, price double, removes boolean"
    rows = desk_rows(rng, 300)
    folder = shared_folder(spark, "radar-test")
    source = spark.createDataFrame(rows, schema)
    for k, part in enumerate((rows[:100], rows[100:180], [*rows[180:], (9_000, rows[0][1], 0, 3, 1.0, False)])):  # at last a quote that comes hours late
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/source/part{k}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/source/*")
        changes = basket.run_to_end(basket.basket_changes(stream), f"{folder}/out")
    watermark = int(max(r[1] for r in rows).timestamp() * 1000) - 600_000
    got = {(r.desk, r.symbol, r.ts, r.price, r.usable) for r in basket.baskets(changes).collect()}
    assert got == replayed(rows, basket.BASKET, watermark) and {g[4] for g in got} == {True, False}
    assert changes.groupBy("desk", "seq").count().where("count > 1").isEmpty()
    statuses = {r[0] for r in changes.select("status").distinct().collect()}
    assert statuses == {"LIVE", "STALE", "EVICTED", "REMOVED"} and source.count() == 300
    assert changes.where(F.col("event_id") == 9_000).isEmpty() and dt.datetime.now() > rows[0][1]
