"""Bar windows: every function gives a Column over one shared window of a company's sessions.

All of them use the same partitioning and order, so that Spark sorts the bars
once for any number of indicators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def sessions():
    """The window of a company's sessions in order; made where it is used, since a window needs a session."""
    return Window.partitionBy("company_id").orderBy("trading_date")


#: Sessions of a year, by highs and lows and by closes.
YEAR_BARS, YEAR_CLOSES = 252, 250


def last_bars(k: int, before: int = 0):
    """Window of the ``k`` bars that end ``before`` bars before the current one."""
    return sessions().rowsBetween(-(k - 1 + before), -before)


def full(k: int, value: Column) -> Column:
    """``value`` where the company has at least ``k`` bars so far, else null."""
    return F.when(F.row_number().over(sessions()) >= k, value)


def sma(k: int, value: str = "close") -> Column:
    return full(k, F.avg(value).over(last_bars(k)))


def pct_from(level: Column, value: str = "close") -> Column:
    return (F.col(value) - level) / level * 100


def true_range() -> Column:
    """Null on a company's first bar: there is no close before it."""
    before = F.lag("close").over(sessions())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(k: int, true_range: str = "true_range") -> Column:
    """Simple mean of the last ``k`` true ranges, of as many as there are at first."""
    return F.avg(true_range).over(last_bars(k))


#: Sessions of a block: powers of the smoothing stay within a double's range over one.
BLOCK = 4_096


def wilder_rsi(bars: DataFrame, period: int = 14, days: int = 400) -> DataFrame:
    """``bars`` with ``rsi``: relative strength with Wilder's smoothing, begun anew at the first bar of a slice of calendar days.

    Smoothing is linear: a change k bars back counts with the k-th power of 13/14,
    the first 14 changes of the slice with their mean instead. Running sums, plain
    and weighted by powers of the bar's number, give both by subtraction at the
    slice's start. The start itself is carried: a bar leaves a mark on the day on which it drops
    out of the slice, with the sums that hold from the next bar on, and the last mark before a bar
    is its slice's start. All frames are running ones: work is linear in the bars, however long the slice.
    Powers begin anew in every block; a slice, which has to be shorter than a block, meets two at most.
    """
    keep = (period - 1) / period
    by = sessions()
    to_here = by.rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("close") - F.lag("close").over(by)
    x = bars.withColumns({"_i": F.row_number().over(by) - 1, "_change": F.coalesce(change, F.lit(0.0)), "_day": F.datediff("trading_date", F.lit("1990-01-01"))})
    x = x.withColumns({"_e": F.col("_i") % BLOCK, "_b": F.floor(F.col("_i") / BLOCK), "_gain": F.greatest("_change", F.lit(0.0)), "_loss": F.greatest(-F.col("_change"), F.lit(0.0))})
    own = Window.partitionBy("company_id", "_b").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(1 / keep), F.col("_e"))
    x = x.withColumns({f"_s{n}": F.sum(F.col(f"_{n}") * power).over(own) for n in ("gain", "loss")})
    x = x.withColumns({f"_c{n}": F.sum(f"_{n}").over(to_here) for n in ("gain", "loss")} | {f"_l{n}": F.lag(f"_s{n}").over(by) for n in ("gain", "loss")})
    x = x.withColumns({f"_p{n}": F.last(F.when(F.col("_e") == 0, F.col(f"_l{n}")), ignorenulls=True).over(to_here) for n in ("gain", "loss")})

    def start(first: int) -> Column:
        """The sums of a slice that begins ``first`` bars ahead: at its first bar and at the end of its seed."""
        at = lambda name, k: F.lead(name, k).over(by) if k else F.col(name)
        return F.struct(
            (F.col("_i") + first).alias("f"), *(at(f"_c{n}", first).alias(f"c{n}") for n in ("gain", "loss")), *(at(f"_c{n}", first + period).alias(f"seed{n}") for n in ("gain", "loss")), *(at(f"_s{n}", first + period).alias(f"s{n}") for n in ("gain", "loss")),
            at("_b", first + period).alias("b"),
        )

    x = x.withColumns({"_next": start(1), "_zero": start(0)})
    nothing = F.lit(None).cast(dict(x.dtypes)["_next"])
    mark = lambda day, kind, what: F.struct(day.alias("day"), F.lit(kind).alias("kind"), what.alias("start"))
    marks = F.array_compact(F.array(F.when(F.col("_i") == 0, mark(F.col("_day"), 0, F.col("_zero"))), mark(F.col("_day"), 1, nothing), mark(F.col("_day") + days + 1, 0, F.col("_next"))))
    x = x.withColumn("_mark", F.explode(marks)).drop("_next", "_zero").select("*", F.col("_mark.day").alias("_at"), F.col("_mark.kind").alias("_kind"), F.col("_mark.start").alias("_from")).drop("_mark")
    carried = Window.partitionBy("company_id").orderBy("_at", "_kind", "_i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_from", F.last("_from", ignorenulls=True).over(carried)).where("_kind = 1")
    n = F.col("_i") - F.col("_from.f")

    def smoothed(name: str) -> Column:
        here, seed_end = F.col(f"_s{name}"), F.col(f"_from.s{name}")
        same = here - seed_end
        crossed = here + F.pow(F.lit(keep), F.lit(BLOCK)) * (F.col(f"_p{name}") - seed_end)
        tail = F.when(F.col("_from.b") == F.col("_b"), same).otherwise(crossed) * F.pow(F.lit(keep), F.col("_e"))
        seed = (F.col(f"_from.seed{name}") - F.col(f"_from.c{name}")) * F.pow(F.lit(keep), n - period)
        return (tail + seed) / period

    x = x.withColumns({"_n": n, "_up": smoothed("gain"), "_down": smoothed("loss")})
    rsi = F.when(F.col("_n") < period, 50.0).when(F.col("_down") <= 0, F.when(F.col("_up") <= 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))
    return x.select(*bars.columns, rsi.alias("rsi"))


def extremes(x: DataFrame, k: int, **columns: tuple[str, str]) -> DataFrame:
    """``x`` plus, per ``name=("max" or "min", column)``, the extreme of the last ``k`` bars (of as many as there are at first).

    Bars are cut into blocks of ``k``. The last k bars are the end of one block and the beginning of the next, so that an extreme
    is that of a running one from the block's end backwards, k - 1 bars ago, and of a running one from the block's beginning:
    the work per bar does not depend on ``k``.
    """
    which = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    n = F.row_number().over(sessions()) - 1
    x = x.withColumn("_block", F.floor(n / k))
    running = lambda order: Window.partitionBy("company_id", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    there, back = running(F.asc("trading_date")), running(F.desc("trading_date"))
    x = x.withColumns({f"_back_{name}": which[kind][0](column).over(back) for name, (kind, column) in columns.items()})
    x = x.withColumns({name: which[kind][0](column).over(there) for name, (kind, column) in columns.items()})
    x = x.withColumns({name: which[kind][1](F.col(name), F.lag(f"_back_{name}", k - 1).over(sessions())) for name, (kind, _) in columns.items()})  # of a null and a value the value
    return x.drop("_block", *(f"_back_{name}" for name in columns))


def year_high() -> Column:
    return F.max("high").over(last_bars(YEAR_BARS))


def year_low() -> Column:
    return F.min("low").over(last_bars(YEAR_BARS))


def indicators(bars: DataFrame) -> DataFrame:
    """The bars with the columns that setups, scores and screens read. One sort serves all of them."""
    n = F.row_number().over(sessions())
    out = extremes(bars, YEAR_CLOSES, high_52w=("max", "close"), low_52w=("min", "close"))
    out = out.withColumn("n", n).withColumn("true_range", true_range()).withColumn("sma50", sma(50)).withColumn("sma150", sma(150)).withColumn("sma200", sma(200))
    vol40 = F.avg("volume").over(last_bars(40))
    return out.select(
        "*", sma(20).alias("sma20"), atr(10).alias("atr10"), atr(14).alias("atr14"), atr(20).alias("atr20"), atr(30).alias("atr30"),
        F.lag("sma200", 20).over(sessions()).alias("sma200_before"),
        F.avg("volume").over(last_bars(5)).alias("vol5"), vol40.alias("vol40"), F.avg("volume").over(last_bars(20)).alias("vol20"),
        F.avg("volume").over(last_bars(50)).alias("vol50"), F.avg("volume").over(last_bars(20, 1)).alias("vol20_before"),
        *(F.max("high").over(last_bars(k)).alias(f"high{k}") for k in (3, 5, 8, 10, 20, 30)),
        *(F.min("low").over(last_bars(k)).alias(f"low{k}") for k in (5, 8, 10, 20, 30)),
        F.max("high").over(last_bars(30, 10)).alias("high30_before10"), F.min("low").over(last_bars(30, 10)).alias("low30_before10"),
        F.lag("close").over(sessions()).alias("prev_close"),
    )


def stage(bars: DataFrame) -> DataFrame:
    """Trend stage per bar of :func:`indicators`: uptrend, decline, basing, topping, or what short histories allow."""
    price, s50, s150, s200 = (F.col(c) for c in ("close", "sma50", "sma150", "sma200"))
    rising = F.when(F.col("n") >= 220, s200 > F.col("sma200_before")).otherwise(price > s200)
    aligned = (price > s50) & (s50 > s150) & (s150 > s200)
    supported = (F.round(pct_from(F.col("low_52w")), 1) >= 25) & (F.round(pct_from(F.col("high_52w")), 1) >= -25)
    known = F.when(aligned & rising & supported, "STAGE_2_UPTREND").when((price < s50) & ((s150 < s200) | (price < s200)), "STAGE_4_DECLINE")
    known = known.when((price > s200) & ~aligned, "STAGE_1_ACCUMULATION").otherwise("STAGE_3_TOPPING")
    return bars.withColumn("stage", F.when(s200.isNotNull(), known).when(price > s50, "STAGE_2_EMERGING").otherwise("UNCERTAIN_STRUCTURE"))


def trend_template(bars: DataFrame) -> DataFrame:
    """Number of the seven trend criteria that hold on a bar, and whether five do."""
    price, s50, s150, s200 = (F.col(c) for c in ("close", "sma50", "sma150", "sma200"))
    has = s200.isNotNull()
    above50 = F.coalesce(price > s50, F.lit(False))
    rising = F.when(F.col("n") >= 220, s200 > F.col("sma200_before")).when(has, price > s200).otherwise(False)
    criteria = [
        F.when(has, (price > s150) & (price > s200)).otherwise(above50), F.when(has, s150 > s200).otherwise(True), rising,
        F.when(has, (s50 > s150) & (s50 > s200)).otherwise(above50), F.coalesce(price > s50, F.lit(True)),
        pct_from(F.col("low_52w")) >= 25, pct_from(F.col("high_52w")) >= -25,
    ]
    count = sum((c.cast("int") for c in criteria[1:]), criteria[0].cast("int"))
    return bars.withColumn("criteria", count).withColumn("template_passed", F.col("criteria") >= 5)
