"""Screens as predicates: requests and rule lists become one Column that the scan can use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScreenRequest:
    """Thresholds of a screen; a metric that is missing passes."""

    min_growth: float = 0.0
    max_pe: float = 100.0
    max_debt: float = 4.0


PRESETS = {"quality": ScreenRequest(5, 60, 1), "growth": ScreenRequest(20, 80, 3)}


def screen(request: ScreenRequest) -> Column:
    def passes(name: str, condition: Column) -> Column:
        return F.col(name).isNull() | condition

    debt = F.col("financial") | passes("debt", F.col("debt") <= request.max_debt)
    return passes("growth", F.col("growth") >= request.min_growth) & passes("pe", F.col("pe") <= request.max_pe) & (F.col("net_worth") > 0) & debt


def strong_day(change: float = 2.5, turnover: float = 250_000.0, price: float = 15.0) -> Column:
    return (F.col("change") >= change) & (F.col("close") * F.col("volume") >= turnover) & (F.col("close") >= price)


OPERATIONS = {
    "greater": lambda a, b: a > b, "less": lambda a, b: a < b, "egreater": lambda a, b: a >= b, "eless": lambda a, b: a <= b, "equal": lambda a, b: a == b, "nequal": lambda a, b: a != b,
    "in_range": lambda a, b: a.between(*b),
}


def compile_rules(rules: list[dict], columns: list[str]) -> Column:
    """Rules ``{left, operation, right}`` joined by and; ``right`` is a value, a pair for a range, or the name of a column."""

    def one(rule: dict) -> Column:
        right = rule["right"]
        if rule["left"] not in columns or rule["operation"] not in OPERATIONS:
            raise ValueError(f"unknown column or operation: {rule}")
        if isinstance(right, str) and right in columns:
            right = F.col(right)
        return OPERATIONS[rule["operation"]](F.col(rule["left"]), right)

    return reduce(and_, map(one, rules), F.lit(True))


def eligible(companies: DataFrame, key: str, must_have: list[DataFrame]) -> DataFrame:
    """Companies with a row in each of the other tables."""
    for other in must_have:
        companies = companies.join(other, key, "left_semi")
    return companies


def global_places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Place of every row in one total order: ranges are sorted in parallel, counts before a range are added to places within it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("place", (F.col("_k") + F.col("_before")).cast("long")).drop("_part", "_k", "_before")


def assert_unlocked(rows: DataFrame, partition: Column) -> DataFrame:
    """The rows, unless one lies in the locked partition: then writing them is refused."""
    if not rows.where(partition == "LOCKED_OOS").limit(1).isEmpty():
        raise PermissionError("rows of the locked partition must not be written")
    return rows
