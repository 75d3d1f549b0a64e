"""Readers and normalisers of vendor shapes: files, feeds, statement tables, free text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Series of the delivery file that are kept, and the columns of scanner rows by position.
SERIES = ("EQ", "BE", "SM", "ST")
SCANNER_FIELDS = ("symbol", "close", "change", "open", "high", "low", "volume", "market_cap", "pe", "debt_to_equity_fq", "debt_to_equity_fy")
LAKHS_PER_CRORE, UNITS_PER_CRORE = 100.0, 1e7
#: Words that look like symbols and are none.
STOP_WORDS = ("THE", "AND", "FOR", "WITH")
#: Days from a period's end to its estimated publication.
QUARTERLY_LAG, ANNUAL_LAG = 45, 60
DIMENSIONS = {
    "growth": ("ORDER_WIN", "CONTRACT_AWARD"), "solvency": ("CREDIT_RATING_UPGRADE", "CREDIT_RATING_DOWNGRADE", "PLEDGE_INCREASE"),
    "governance": ("MANAGEMENT_CHANGE", "REGULATORY_ACTION", "LITIGATION"),
}


def delivery_files(spark: SparkSession, path: str) -> DataFrame:
    """Daily security-delivery CSV files: header names trimmed, equity series kept, ``-`` as 0, turnover in crore; the day is the file name's last eight digits."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select("*", F.col("_metadata.file_name").alias("_file")).toDF(*(c.strip() for c in [*raw.columns, "_file"]))

    def number(name: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(name), "[, ]", "").try_cast("double"), F.lit(0.0))

    return raw.where(F.col("SERIES").isin(*SERIES)).select(
        F.col("SYMBOL").alias("company_id"), F.to_date(F.regexp_extract("_file", r"(\d{8})\D*$", 1), "ddMMyyyy").alias("trading_date"), number("PREV_CLOSE").alias("prev_close"),
        number("OPEN_PRICE").alias("open"), number("HIGH_PRICE").alias("high"), number("LOW_PRICE").alias("low"), number("CLOSE_PRICE").alias("close"),
        number("TTL_TRD_QNTY").cast("long").alias("volume"), (number("TURNOVER_LACS") / LAKHS_PER_CRORE).alias("turnover_cr"), number("DELIV_QTY").cast("long").alias("delivery_qty"), number("DELIV_PER").alias("delivery_pct"),
    )


def session_changes(rows: DataFrame) -> DataFrame:
    """Rows of positive prices with the day's change in percent."""
    return rows.where("prev_close > 0 AND close > 0").withColumn("change_pct", (F.col("close") / F.col("prev_close") - 1) * 100)


def participant_positions(lines: DataFrame) -> DataFrame:
    """Participant open-interest lines (``value``) to one row: long and short share of institutions and clients."""
    parts = F.split("value", ",")
    rows = lines.where(F.size(parts) >= 5).select(F.upper(F.trim(parts[0])).alias("who"), *(F.trim(parts[i]).try_cast("double").alias(n) for i, n in ((1, "long"), (2, "short"), (3, "put"), (4, "call"))))
    out = []
    for who, match in (("fii", "FII"), ("client", "CLIENT"), ("total", "TOTAL")):
        row = F.contains("who", F.lit(match))
        long, short = F.max(F.when(row, F.col("long"))), F.max(F.when(row, F.col("short")))
        out += [(long / F.when(long + short != 0, long + short) * 100).alias(f"{who}_long_pct")]
    put, call = F.max(F.when(F.contains("who", F.lit("TOTAL")), F.col("put"))), F.max(F.when(F.contains("who", F.lit("TOTAL")), F.col("call")))
    return rows.agg(*out, (put / F.when(call != 0, call)).alias("put_call_ratio"))


def scanner_rows(rows: DataFrame) -> DataFrame:
    """Scanner payload ``d`` (array of strings by position) to named columns; quarterly debt before yearly, capitalisation in crore."""
    named = [F.get("d", F.lit(i)).alias(n) if n == "symbol" else F.get("d", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(SCANNER_FIELDS)]
    x = rows.select(*named)
    return x.withColumn("debt_to_equity", F.coalesce("debt_to_equity_fq", "debt_to_equity_fy")).withColumn("market_cap_cr", F.col("market_cap") / UNITS_PER_CRORE)


def new_members(seed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of a seed that are not there yet."""
    return seed.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def statement_tables(pages: DataFrame) -> DataFrame:
    """Tables in ``html`` to long rows ``page_id, label, period, value``: the first row holds periods, the first column labels."""

    def parse(frames):
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                cells = _Cells()
                cells.feed(html or "")
                rows = [r for r in cells.rows if r]
                for row in rows[1:]:
                    out += [(page, row[0], period, value) for period, value in zip(rows[0][1:], row[1:], strict=False)]
            yield pd.DataFrame(out, columns=["page_id", "label", "period", "value"])

    long = pages.select("page_id", "html").mapInPandas(parse, "page_id long, label string, period string, value string")
    return long.withColumn("value", F.regexp_replace("value", "[,% ]", "").try_cast("double"))


def normalised_statements(long: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Long rows to one row per page and period: a field takes the first label that contains one of its aliases, in their order."""
    label = F.lower("label")
    columns = []
    for field, names in aliases.items():
        place = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(names))):
            place = F.when(F.contains(label, F.lit(name)), i).otherwise(place)
        columns.append(F.min_by(F.when(place.isNotNull(), F.col("value")), F.coalesce(place, F.lit(1 << 20))).alias(field))
    return long.groupBy("page_id", "period").agg(*columns)


def with_confidence(keys: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Waterfall over sources by priority: value and the source it came from, ``UNAVAILABLE`` if none has it."""
    out = keys
    for name, source in sources:
        out = out.join(source.select(key, F.struct(F.col(value).alias("value"), F.lit(name).alias("source")).alias(f"_{name}")).where(F.col(value).isNotNull()), key, "left")
    chosen = F.coalesce(*(F.col(f"_{n}") for n, _ in sources))
    return out.select(*keys.columns, chosen["value"].alias(value), F.coalesce(chosen["source"], F.lit("UNAVAILABLE")).alias("source"))


def candle_fault() -> Column:
    """Why a bar is not usable; null for a sound one."""
    open_, high, low, close = (F.col(k) for k in ("open", "high", "low", "close"))
    return (
        F.when(high < low, "LOW_ABOVE_HIGH").when((high < open_) | (high < close), "HIGH_BELOW_OPEN_OR_CLOSE").when((low > open_) | (low > close), "LOW_ABOVE_OPEN_OR_CLOSE").when(F.col("volume") < 0, "NEGATIVE_VOLUME")
    )


def balance_fault(tolerance: float = 0.05) -> Column:
    """Which balance-sheet identity fails by more than the tolerance; null if none does."""

    def off(left: Column, right: Column) -> Column:
        return F.abs(left - right) > tolerance * F.greatest(F.abs(left), F.lit(1.0))

    return (
        F.when(off(F.col("total_assets"), F.col("net_worth") + F.col("total_liabilities")), "ASSETS_DO_NOT_BALANCE")
        .when(off(F.col("ebitda"), F.col("ebit") + F.col("depreciation")), "EBITDA_MISMATCH").when(off(F.col("free_cash_flow"), F.col("operating_cash_flow") - F.col("capex")), "FREE_CASH_FLOW_MISMATCH")
    )


def symbols(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct symbol-like words per document, in order of first appearance."""
    words = docs.select(key, F.posexplode(F.split(F.upper(text), "[^A-Z]+")).alias("pos", "symbol"))
    words = words.where(F.length("symbol").between(3, 5) & ~F.col("symbol").isin(*STOP_WORDS)).groupBy(key, "symbol").agg(F.min("pos").alias("pos"))
    return words.select(key, "symbol", F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("place"))


def publication_dates(rows: DataFrame) -> DataFrame:
    """Publication, estimated from the period's end where the filing date is missing."""
    lag = F.when(F.col("annual"), ANNUAL_LAG).otherwise(QUARTERLY_LAG)
    return rows.withColumn("estimated", F.col("published").isNull()).withColumn("published", F.coalesce("published", F.date_add("period_end", lag)))


def event_dimension(news: DataFrame) -> DataFrame:
    out = F.lit("other")
    for name, kinds in DIMENSIONS.items():
        out = F.when(F.col("event_type").isin(*kinds), name).otherwise(out)
    return news.withColumn("dimension", out)


def latest_sessions(bars: DataFrame, n: int) -> DataFrame:
    """The newest days on which anything traded; the distinct days are few however many bars there are."""
    days = bars.select("trading_date").distinct().orderBy(F.col("trading_date").desc()).limit(n)
    return days.withColumn("age", F.row_number().over(Window.orderBy(F.col("trading_date").desc())))


def corporate_actions(rows: DataFrame) -> DataFrame:
    """Action class and price factor from a subject line."""
    s = F.lower("subject")
    bonus = [F.regexp_extract(s, r"(\d+)\s*:\s*(\d+)", i).try_cast("double") for i in (1, 2)]
    split = [F.regexp_extract(s, r"from\s*rs\.?\s*(\d+).*to\s*rs\.?\s*(\d+)", i).try_cast("double") for i in (1, 2)]
    action = F.when(F.contains(s, F.lit("bonus")), "BONUS").when(F.contains(s, F.lit("split")), "SPLIT").when(F.contains(s, F.lit("dividend")), "DIVIDEND").otherwise("OTHER")
    factor = F.when(action == "BONUS", 1 / (1 + bonus[0] / bonus[1])).when(action == "SPLIT", split[1] / split[0]).otherwise(1.0)
    return rows.withColumn("action", action).withColumn("factor", F.coalesce(factor, F.lit(1.0)))
