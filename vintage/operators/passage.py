"""First passage to price levels and outcomes of decision dates, without meeting an anchor with its later bars.

A company's closes form a tree of fixed fan-out: blocks of 64 bars, groups of 64
blocks, and one list of groups per company. A node is one row that holds, in order, its
children's lows and highs. A question "when is level L reached first after bar
i, and how low before?" climbs from bar i through at most three nodes and
descends through at most two, each an equi-join with exactly one row on the
other side; within a node it looks at 64 numbers. Drawdown, run and length of a
path need no search: they are running aggregates over a company's bars in
falling order of date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Children of a node.
FAN = 64


def numbered(bars: DataFrame) -> DataFrame:
    """``company_id, trading_date, p, i``: closes with a bar's number from 0."""
    i = F.row_number().over(Window.partitionBy("company_id").orderBy("trading_date")) - 1
    return bars.select("company_id", "trading_date", F.col("close").alias("p"), i.alias("i"))


def block_of(i: str | Column) -> Column:
    return F.floor((F.col(i) if isinstance(i, str) else i) / FAN).cast("int")


def blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """``company_id, block, bars``: 64 consecutive bars as an array of ``struct<i, columns>``."""
    return rows.groupBy("company_id", block_of("i").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("bars"))


class Levels:
    """The tree over numbered closes."""

    def __init__(self, rows: DataFrame):
        self.blocks = blocks(rows, "p", "trading_date")
        ends = lambda k, low, high: F.struct(F.col(k).alias("at"), low.alias("low"), high.alias("high"))
        block = self.blocks.select("company_id", "block", ends("block", F.array_min("bars.p"), F.array_max("bars.p")).alias("child"))
        self.groups = block.groupBy("company_id", block_of("block").alias("group")).agg(F.array_sort(F.collect_list("child")).alias("children"))
        group = self.groups.select("company_id", ends("group", F.array_min("children.low"), F.array_max("children.high")).alias("child"))
        self.tops = group.groupBy("company_id").agg(F.array_sort(F.collect_list("child")).alias("tops"))


def _search(array: Column, high: Column, low: Column, start: Column, level: Column) -> tuple[Column, Column]:
    """Place (from 0) of the first child at or after ``start`` that reaches the level, null if none; and the lowest low before it."""
    rest = F.slice(high, start + 1, F.size(array))
    place = F.nullif(F.array_position(F.transform(rest, lambda h: h >= level), F.lit(True)), F.lit(0).cast("long"))
    lowest = F.array_min(F.slice(low, start + 1, F.coalesce(place - 1, F.size(array).cast("long")).cast("int")))
    return (start + place - 1).cast("int"), lowest


def first_passages(questions: DataFrame, levels: Levels) -> DataFrame:
    """``questions`` (with ``company_id, i, level``) plus ``hit`` (number of the first bar at or after ``i`` that reaches the level, else null),
    ``hit_date``, ``hit_price`` and ``low_before`` (lowest close from bar ``i`` to the bar before, or to the end)."""
    q = questions.select("company_id", "i", "level", F.struct(*questions.columns).alias("own")).withColumns({"block": block_of("i"), "group": block_of(block_of("i"))})
    level = F.col("level")
    least = lambda a, b: F.least(F.col(a), b)  # noqa: E731  skips nulls

    # Up: the rest of the own block, of the own group of blocks, of the company.
    x = q.join(levels.blocks, ["company_id", "block"])
    place, low = _search(F.col("bars"), F.col("bars.p"), F.col("bars.p"), F.col("i") % FAN, level)
    x = x.withColumns({"found": place, "low": low}).drop("bars")
    x = x.join(levels.groups, ["company_id", "group"])
    done = F.col("found").isNotNull()
    place, low = _search(F.col("children"), F.col("children.high"), F.col("children.low"), F.col("block") % FAN + 1, level)
    next_block = F.when(done, F.col("block")).when(place.isNotNull(), F.col("group") * FAN + place)
    x = x.withColumns({"low": F.when(done, F.col("low")).otherwise(least("low", low)), "next_block": next_block}).drop("children")
    x = x.join(levels.tops, "company_id")
    done = F.col("next_block").isNotNull()
    place, low = _search(F.col("tops"), F.col("tops.high"), F.col("tops.low"), F.col("group") + 1, level)
    x = x.withColumns({"low": F.when(done, F.col("low")).otherwise(least("low", low)), "next_group": F.when(~done, place)}).drop("tops")

    # Down: into the group that was found, then into the block. Questions that need no step meet their own node again, so that no join has null keys.
    groups = levels.groups.withColumnRenamed("group", "to_group")
    x = x.withColumn("to_group", F.coalesce("next_group", "group")).join(groups, ["company_id", "to_group"])
    place, low = _search(F.col("children"), F.col("children.high"), F.col("children.low"), F.lit(0), level)
    inside = F.col("next_group").isNotNull()
    x = x.withColumns({"low": F.when(inside, least("low", low)).otherwise(F.col("low")), "next_block": F.coalesce("next_block", F.when(inside, F.col("next_group") * FAN + place))}).drop("children")
    last = levels.blocks.withColumnRenamed("block", "to_block")
    x = x.withColumn("to_block", F.coalesce("next_block", "block")).join(last, ["company_id", "to_block"])
    place, low = _search(F.col("bars"), F.col("bars.p"), F.col("bars.p"), F.lit(0), level)
    inside = F.col("next_block").isNotNull() & F.col("found").isNull()
    x = x.withColumns({"found": F.coalesce("found", F.when(inside, place)), "low_before": F.when(inside, least("low", low)).otherwise(F.col("low"))})
    bar = F.get("bars", F.col("found"))
    return x.select("own.*", bar["i"].alias("hit"), bar["trading_date"].alias("hit_date"), bar["p"].alias("hit_price"), "low_before")


def starts(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per decision date the first bar at or after it, with what running aggregates know of the path from there:
    ``company_id, t0, i, p0, bars, max_drawdown, max_run, p_last``. Dates without a later bar are left out."""
    marks = rows.select("company_id", "trading_date", "p", "i", F.lit(None).cast("date").alias("t0")).unionByName(
        anchors.select("company_id", F.col("t0").alias("trading_date"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("int").alias("i"), "t0")
    )
    # From the last bar backwards: a date comes after the bar of its day, and all frames are running ones.
    back = Window.partitionBy("company_id").orderBy(F.desc("trading_date"), F.col("t0").isNotNull())
    x = marks.withColumns({"bars": F.count("p").over(back), "top": F.max("p").over(back), "low": F.min("p").over(back), "p_last": F.first("p", ignorenulls=True).over(back), "own": F.last(F.when(F.col("p").isNotNull(), F.struct("i", "p")), ignorenulls=True).over(back)})
    # The fall from a bar to the lowest later close; the deepest of them is the drawdown.
    x = x.withColumn("fall", F.min((F.col("low") - F.col("p")) / F.col("p")).over(back))
    x = x.where("t0 IS NOT NULL AND own IS NOT NULL")
    p0 = F.col("own.p")
    return x.select("company_id", "t0", F.col("own.i").alias("i"), p0.alias("p0"), "bars", (F.col("fall") * 100).alias("max_drawdown"), ((F.col("top") / p0 - 1) * 100).alias("max_run"), "p_last")


def spans(starts: DataFrame, rows: DataFrame, length: int, *columns: str, after: int = 0) -> DataFrame:
    """``starts`` plus ``path``: the ``length`` bars from ``after`` bars behind bar ``i`` on, as structs of ``i`` and the columns.

    A start meets the few blocks that hold its bars, by an equi-join on company and block.
    """
    first, last = F.col("i") + after, F.col("i") + after + length - 1
    asked = starts.withColumn("_start", F.struct(*starts.columns)).select("company_id", "_start", first.alias("_first"), last.alias("_last"), F.explode(F.sequence(block_of(first), block_of(last))).alias("block"))
    x = asked.join(blocks(rows, *columns), ["company_id", "block"])
    near = F.filter("bars", lambda b: b["i"].between(F.col("_first"), F.col("_last")))
    x = x.groupBy("company_id", "_start").agg(F.array_sort(F.flatten(F.collect_list(near))).alias("path"))
    return x.select("_start.*", "path")
