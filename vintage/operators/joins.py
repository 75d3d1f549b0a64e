"""Interval and event joins. Every range is the condition of a hash join on a key: the company, or a year or month that both sides touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def members_at(universe: DataFrame, dates: DataFrame) -> DataFrame:
    """Members at each date: intervals closed at both ends, an open end is null.

    Memberships meet dates by year; only the first and the last date come to the driver.
    """
    low, high = dates.agg(F.min("t0"), F.max("t0")).first()
    start, end = F.col("effective_from"), F.col("effective_to")
    touching = universe.where((start <= F.lit(high)) & (end.isNull() | ((end >= F.lit(low)) & (end >= start))))
    years = F.sequence(F.year(F.greatest(start, F.lit(low))), F.year(F.least(F.coalesce(end, F.lit(high)), F.lit(high))))
    d = dates.select("t0").distinct().withColumn("_y", F.year("t0"))
    return touching.withColumn("_y", F.explode(years)).join(d, "_y").where((start <= F.col("t0")) & (end.isNull() | (end >= F.col("t0")))).drop("_y")


def islands(intervals: DataFrame) -> DataFrame:
    """Union of half-open intervals as disjoint ones, built from day counts, so that no task sees all rows."""
    days = intervals.select(F.col("label_start").alias("d"), F.lit(1).alias("s")).unionAll(intervals.select(F.col("label_end"), F.lit(-1))).groupBy("d").agg(F.sum("s").alias("s"))
    order = Window.orderBy("d")
    running = days.withColumn("open", F.sum("s").over(order))  # one row per distinct day
    edges = running.withColumn("before", F.coalesce(F.lag("open").over(order), F.lit(0)))
    starts = edges.where("open > 0 AND before = 0").select(F.col("d").alias("island_start"))
    ends = edges.where("open = 0 AND before > 0").select(F.col("d").alias("island_end"))
    n = F.row_number()
    return starts.withColumn("k", n.over(Window.orderBy("island_start"))).join(ends.withColumn("k", n.over(Window.orderBy("island_end"))), "k").drop("k")


def _months(start: Column, end: Column) -> Column:
    """First days of the months of a half-open interval."""
    return F.sequence(F.trunc(start, "month"), F.trunc(F.date_sub(end, 1), "month"), F.expr("interval 1 month"))


def purge(train: DataFrame, test: DataFrame, same_company: bool) -> DataFrame:
    """Training rows whose label interval overlaps no test interval (of the same company)."""
    if same_company:
        t = test.select(F.col("company_id").alias("_c"), F.col("label_start").alias("_s"), F.col("label_end").alias("_e"))
        return train.join(t, (F.col("company_id") == F.col("_c")) & (F.col("label_start") < F.col("_e")) & (F.col("_s") < F.col("label_end")), "left_anti")
    # Both sides by the months that they touch; islands are disjoint, so that a month has few of them.
    merged = islands(test).withColumn("_m", F.explode(_months(F.col("island_start"), F.col("island_end"))))
    spans = train.select("observation_id", "label_start", "label_end").where("label_start < label_end").withColumn("_m", F.explode(_months(F.col("label_start"), F.col("label_end"))))
    hit = spans.join(merged, "_m").where("label_start < island_end AND island_start < label_end").select("observation_id").distinct()
    return train.join(hit, "observation_id", "left_anti").select(*train.columns)


def fold_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows that overlap a test interval of their company: must be none after purging."""
    t = test.select(F.col("company_id").alias("_c"), F.col("label_start").alias("_s"), F.col("label_end").alias("_e"))
    return train.join(t, (F.col("company_id") == F.col("_c")) & (F.col("label_start") < F.col("_e")) & (F.col("_s") < F.col("label_end")), "left_semi")


def adjusted_bars(bars: DataFrame, actions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Split-adjusted bars: prices times the product of the factors of later actions up to the as-of date, volume divided by it.

    Actions and bars share one timeline per company; a reverse running product replaces the range join.
    """
    known = actions if as_of is None else actions.where(F.col("ex_date") <= as_of)
    marks = known.select("company_id", F.col("ex_date").alias("trading_date"), F.lit(0).alias("is_bar"), F.col("factor"))
    rows = bars.withColumn("is_bar", F.lit(1)).withColumn("factor", F.lit(1.0)).unionByName(marks, allowMissingColumns=True)
    # later first; on the ex-date itself the bar comes before the mark and so stays untouched by it
    later = Window.partitionBy("company_id").orderBy(F.col("trading_date").desc(), F.col("is_bar").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("adjustment", F.product("factor").over(later)).where("is_bar = 1")
    prices = {c: F.coalesce(F.col(c), F.col("close")) * F.col("adjustment") for c in ("open", "high", "low", "close")}
    return x.withColumns(prices | {"volume": F.col("volume") / F.col("adjustment")}).drop("is_bar", "factor")


def session_pairs(bars: DataFrame) -> DataFrame:
    """Each bar with the company's bar of the market's next session: gap, best and worst move, close return."""
    days = bars.select("trading_date").distinct()
    nxt = days.withColumn("next_date", F.lead("trading_date").over(Window.orderBy("trading_date")))
    after = bars.select("company_id", F.col("trading_date").alias("next_date"), *(F.col(c).alias(f"next_{c}") for c in ("open", "high", "low", "close")))
    x = bars.join(nxt, "trading_date").join(after, ["company_id", "next_date"])
    c = F.col("close")
    return x.select(
        "company_id", "trading_date", "next_date", ((F.col("next_open") / c - 1) * 100).alias("gap"), ((F.col("next_high") / c - 1) * 100).alias("mfe"),
        ((F.col("next_low") / c - 1) * 100).alias("mae"), ((F.col("next_close") / c - 1) * 100).alias("ret"), ((F.col("next_high") / F.col("next_open") - 1) * 100).alias("run"),
    )


def reconcile(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two providers: the primary's value wins, the status says by how much they differ."""
    x = primary.select(*keys, F.col(value).alias("a")).join(secondary.select(*keys, F.col(value).alias("b")), keys, "full")
    off = F.abs(F.col("a") - F.col("b")) / F.when(F.col("a") != 0, F.col("a")) * 100
    status = F.when(F.col("b").isNull(), "PRIMARY_ONLY").when(F.col("a").isNull(), "SECONDARY_ONLY").when(off <= 0.5, "VERIFIED").when(off <= 1.5, "MINOR").otherwise("DIVERGENT")
    return x.select(*keys, F.coalesce("a", "b").alias(value), off.alias("divergence"), status.alias("status"))


def fallback_lookup(rows: DataFrame, levels: list[tuple[str, DataFrame, list[str], int]], value: str, prior: float) -> DataFrame:
    """Value from the most specific level with enough observations, with the level's name; the prior where none has.

    Levels are aggregates over fixed value lists and therefore small.
    """
    out, found = rows, F.lit(None)
    chosen = []
    for name, table, keys, least in levels:
        out = out.join(table.where(F.col("n") >= least).select(*keys, F.struct(F.col(value).alias("value"), F.lit(name).alias("level")).alias(f"_{name}")), keys, "left")
        chosen.append(F.col(f"_{name}"))
    found = F.coalesce(*chosen, F.struct(F.lit(prior).alias("value"), F.lit("PRIOR").alias("level")))
    return out.withColumn(value, found["value"]).withColumn("level", found["level"]).drop(*(f"_{n}" for n, *_ in levels))
