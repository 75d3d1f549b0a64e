"""A radar that keeps state: baskets of eight symbols a desk, their newest quotes, and timers that make them stale.

One arbitrary-state operator per desk. A quote of a symbol that the basket lacks
puts it in, behind the others; a ninth symbol drives the oldest out, whatever
was quoted last. A later quote replaces an earlier one, an earlier one that comes late does not. Thirty
minutes of event time after its newest quote a symbol turns stale and may no
longer be served; the next quote makes it live again. Every change is one row with the desk's
running number, so that the newest row of a symbol is its state and a sink that
only appends holds the whole history. State is eight entries a desk; rows of a
desk within a micro-batch are put in order of event time.

The session needs the RocksDB state store (:func:`configure`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .radar import STALE_MINUTES

BASKET = 8
#: How late a quote may come.
LATENESS = "10 minutes"
LIVE, STALE, EVICTED, REMOVED = "LIVE", "STALE", "EVICTED", "REMOVED"
CHANGES = "desk long, symbol long, seq long, status string, ts timestamp, event_id long, price double"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class BasketRadar(StatefulProcessor):
    def __init__(self, size: int = BASKET, stale_minutes: int = STALE_MINUTES):
        self.size, self.stale_ms = size, stale_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "symbol long", "place long, ts_us long, event_id long, price double, status string")
        self.counters = handle.getValueState("counters", "seq long, place long")

    def _load(self) -> tuple[dict[int, list], int, int]:
        seq, place = self.counters.get() if self.counters.exists() else (0, 0)
        return {int(k[0]): list(v) for k, v in self.entries.iterator()}, seq, place

    def _save(self, before: dict[int, list], after: dict[int, list], seq: int, place: int) -> None:
        for symbol in before.keys() - after.keys():
            self.entries.removeKey((symbol,))
        for symbol, entry in after.items():
            if before.get(symbol) != entry:
                self.entries.updateValue((symbol,), tuple(entry))
        self.counters.update((seq, place))

    def _due(self, entry: list) -> int:
        return entry[1] // 1000 + self.stale_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        quotes = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        before, seq, place = self._load()
        basket, changes = {k: list(v) for k, v in before.items()}, []

        def changed(symbol: int, entry: list, status: str) -> None:
            nonlocal seq
            seq += 1
            changes.append((int(key[0]), symbol, seq, status, entry[1], entry[2], entry[3]))

        for ts, event, symbol, price, gone in zip(quotes.ts.astype("datetime64[us]").astype("int64"), quotes.event_id, quotes.symbol, quotes.price, quotes.removes, strict=True):
            symbol, entry = int(symbol), basket.get(int(symbol))
            if gone:
                if entry:
                    changed(symbol, basket.pop(symbol), REMOVED)
                continue
            if entry and (entry[1], entry[2]) >= (int(ts), int(event)):
                continue  # a newer quote is known
            if not entry and len(basket) >= self.size:
                oldest = min(basket, key=lambda s: basket[s][0])
                changed(oldest, basket.pop(oldest), EVICTED)
            if not entry:
                place += 1
            basket[symbol] = [entry[0] if entry else place, int(ts), int(event), float(price), LIVE]
            changed(symbol, basket[symbol], LIVE)
        timers = {self._due(e) for e in before.values() if e[4] == LIVE}, {self._due(e) for e in basket.values() if e[4] == LIVE}
        for due in timers[0] - timers[1]:
            self.handle.deleteTimer(due)
        for due in timers[1] - timers[0]:
            self.handle.registerTimer(due)
        self._save(before, basket, seq, place)
        yield self._frame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        before, seq, place = self._load()
        basket, changes = {k: list(v) for k, v in before.items()}, []
        for symbol, entry in sorted(basket.items()):
            if entry[4] == LIVE and self._due(entry) <= due:
                entry[4] = STALE
                seq += 1
                changes.append((int(key[0]), symbol, seq, STALE, entry[1], entry[2], entry[3]))
        self._save(before, basket, seq, place)
        yield self._frame(changes)

    def _frame(self, changes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(changes, columns=["desk", "symbol", "seq", "status", "ts", "event_id", "price"])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        return out

    def close(self) -> None:
        pass


def basket_changes(quotes: DataFrame, size: int = BASKET, stale_minutes: int = STALE_MINUTES, lateness: str = LATENESS) -> DataFrame:
    """Stream of changes for a stream ``event_id, ts, desk, symbol, price, removes``."""
    rows = quotes.select("event_id", "ts", "desk", "symbol", "price", "removes").withWatermark("ts", lateness)
    return rows.groupBy("desk").transformWithStateInPandas(BasketRadar(size, stale_minutes), CHANGES, "Append", "EventTime")


def baskets(changes: DataFrame) -> DataFrame:
    """What the baskets hold after the given changes: ``desk, symbol, ts, price, usable``."""
    newest = F.row_number().over(Window.partitionBy("desk", "symbol").orderBy(F.desc("seq")))
    x = changes.withColumn("k", newest).where("k = 1").where(F.col("status").isin(LIVE, STALE))
    return x.select("desk", "symbol", "ts", "price", (F.col("status") == LIVE).alias("usable"))


def run_to_end(changes: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all that is there and returns the changes written to ``folder``; called again with the same folder it goes on where it stopped."""
    query = changes.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return changes.sparkSession.read.schema(CHANGES).parquet(f"{folder}/changes")
