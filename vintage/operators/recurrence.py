"""Linear recurrences over a company's whole history as a parallel scan.

A smoothing s(i) = a(i) * s(i-1) + b(i) is an affine map per bar, and affine maps
compose. Histories are cut into blocks of calendar time, each a partition of its
own. Within a block the composition of its first k maps is a running sum with
powers as weights; the composition over a whole block is one row. A fold over the
few block rows of a company gives every block the value it starts from, and each
bar applies its own composition to it. No task and no list holds the bars of a
whole history.

Wilder's smoothing takes the mean of the first ``period`` values as its seed. As
a recurrence: a = 1 and b = x / period up to the seed, a = (period - 1) / period behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Calendar days of a block; the powers within it stay far inside a double's range for up to 4,000 bars.
BLOCK_DAYS = 1_024


def _block(order: str, days: int) -> Column:
    return F.floor(F.datediff(F.col(order), F.lit("1970-01-01")) / days).cast("int")


def _carried(summary: DataFrame, start: Column, step, names: list[str]) -> DataFrame:
    """``company_id, block`` and, as ``names``, the state before each block: a fold of ``step`` over a company's block rows in order."""
    lists = summary.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("block", *[c for c in summary.columns if c not in ("company_id", "block")]))).alias("rows"))
    before = F.struct(F.lit(0).alias("block"), start.alias("state"))
    fold = F.struct(start.alias("state"), F.filter(F.array(before), lambda b: F.lit(False)).alias("out"))
    states = F.aggregate("rows", fold, lambda s, r: F.struct(step(s["state"], r).alias("state"), F.concat(s["out"], F.array(F.struct(r["block"].alias("block"), s["state"].alias("state")))).alias("out")), lambda s: s["out"])
    x = lists.select("company_id", F.explode(states).alias("b"))
    return x.select("company_id", "b.block", *(F.col(f"b.state.{n}").alias(n) for n in names))


def sequenced(bars: DataFrame, days: int = BLOCK_DAYS) -> DataFrame:
    """``bars`` plus ``block``, the number ``i`` of a bar from 1 and ``before``, the close of the bar before it (null on the first), by blocks."""
    own = Window.partitionBy("company_id", "block").orderBy("trading_date")
    x = bars.withColumn("block", _block("trading_date", days))
    summary = x.groupBy("company_id", "block").agg(F.count("*").alias("n"), F.max_by("close", "trading_date").alias("last"))
    zero = F.struct(F.lit(0).cast("long").alias("bars_before"), F.lit(None).cast("double").alias("close_before"))
    carried = _carried(summary, zero, lambda s, r: F.struct((s["bars_before"] + r["n"]).alias("bars_before"), r["last"].alias("close_before")), ["bars_before", "close_before"])
    x = x.join(carried, ["company_id", "block"])
    return x.withColumns({"i": F.col("bars_before") + F.row_number().over(own), "before": F.coalesce(F.lag("close").over(own), "close_before")}).drop("bars_before", "close_before")


def wilder(x: DataFrame, values: dict[str, str], period: int = 14) -> DataFrame:
    """``x`` of :func:`sequenced` plus, for each ``name: column`` of ``values``, Wilder's smoothing of the column over the whole history.

    The first bar has no value (columns are changes from the bar before); results are null before the seed is full.
    """
    keep = (period - 1) / period
    own = Window.partitionBy("company_id", "block").orderBy("trading_date")
    to_here, whole = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("company_id", "block")
    # Exponent of the decay: bars behind the seed. Counted from the block's start, so that powers stay small.
    k = F.greatest(F.col("i") - 1 - period, F.lit(0))
    x = x.withColumn("_k", k)
    x = x.withColumn("_e", F.col("_k") - F.min("_k").over(whole))
    pieces = {f"_sum_{n}": F.sum(F.coalesce(F.col(c), F.lit(0.0)) / period * F.pow(F.lit(1 / keep), F.col("_e"))).over(to_here) for n, c in values.items()}
    x = x.withColumns(pieces)
    # A block's map sends its start value s to keep**decay * s + shift. Its first bar may itself decay.
    first_decays = F.when((F.min("i") - 1) > period, 1).otherwise(0)
    summary = x.groupBy("company_id", "block").agg((F.max("_e") + first_decays).alias("decay"), F.max("_e").alias("own"), *(F.max_by(f"_sum_{n}", "i").alias(n) for n in values))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in values))
    step = lambda s, r: F.struct(*((F.pow(F.lit(keep), r["decay"]) * s[n] + F.pow(F.lit(keep), r["own"]) * r[n]).alias(n) for n in values))
    carried = _carried(summary, zero, step, list(values))
    carried = carried.select("company_id", "block", *(F.col(n).alias(f"_start_{n}") for n in values))
    x = x.join(carried, ["company_id", "block"])
    decays = F.when(F.first(F.col("i") - 1 > period).over(to_here), 1).otherwise(0)
    x = x.withColumn("_decay", F.col("_e") + decays)
    out = {n: F.when(F.col("i") - 1 >= period, F.pow(F.lit(keep), F.col("_decay")) * F.col(f"_start_{n}") + F.pow(F.lit(keep), F.col("_e")) * F.col(f"_sum_{n}")) for n in values}
    x = x.withColumns(out)
    return x.drop("_k", "_e", "_decay", *(f"_sum_{n}" for n in values), *(f"_start_{n}" for n in values))


def whole_history(bars: DataFrame, period: int = 14, days: int = BLOCK_DAYS) -> DataFrame:
    """``company_id, trading_date, i, close`` and Wilder's ``atr`` and ``rsi`` over the whole history, on every bar; null before the seed is full."""
    x = sequenced(bars, days)
    change, before = F.col("close") - F.col("before"), F.col("before")
    x = x.withColumns({
        "true_range": F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))),
        "gain": F.greatest(change, F.lit(0.0)), "loss": F.greatest(-change, F.lit(0.0)),
    })
    x = x.withColumns({c: F.when(before.isNotNull(), F.col(c)) for c in ("gain", "loss")})
    x = wilder(x, {"atr": "true_range", "up": "gain", "down": "loss"}, period)
    rsi = F.when(F.col("down") == 0, 100.0).when(F.col("down").isNotNull(), 100 - 100 / (1 + F.col("up") / F.col("down")))
    return x.select("company_id", "trading_date", "i", "close", "true_range", "atr", rsi.alias("rsi"))
