"""As-of reads on one timeline: publications and reading dates in one order per company, with state carried along.

A reading date never meets candidates. Both kinds of rows are sorted together
once, running aggregates carry what is known, and the dates keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def carried_periods(statements: DataFrame, dates: DataFrame, period_type: str, limit: int, spare: int = 4) -> DataFrame:
    """Per row of ``dates(company_id, t0)`` what was published by then: ``periods``, the newest ``limit`` periods as structs, newest first, each in its latest vintage.

    The periods of a company are numbered, and ``limit + spare`` slots take turns in holding them: a slot's running maximum by
    (number, publication, vintage) is the newest vintage of the newest of its periods. So a late restatement of an old
    period never replaces a newer one, and ``spare`` periods may be missing among the newest.
    """
    ring = limit + spare
    keys = ("company_id", "period_end", "period_type", "published", "vintage")
    rows = statements.where(c("period_type") == period_type).withColumn("number", F.dense_rank().over(Window.partitionBy("company_id").orderBy("period_end")))
    version = F.struct("number", "period_end", "published", "vintage", *(k for k in statements.columns if k not in keys))
    events = rows.select("company_id", c("published").alias("at"), version.alias("v"), F.lit(None).cast("date").alias("t0"))
    kind = dict(events.dtypes)["v"]
    marks = dates.select("company_id", c("t0").alias("at"), F.lit(None).cast(kind).alias("v"), "t0")
    seen = Window.partitionBy("company_id").orderBy("at", c("t0").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # what is published on the day is known on the day
    newer = F.struct("v.number", "v.published", "v.vintage")
    slots = {f"slot{k}": F.max_by("v", F.when(c("v.number") % ring == k, newer)).over(seen) for k in range(ring)}
    x = events.unionByName(marks).withColumns(slots).where("t0 IS NOT NULL")
    # By number, which is its place behind the newest: slots in turn need no sort.
    newest = F.greatest(*(c(f"slot{k}.number") for k in range(ring)))
    x = x.withColumn("newest", newest).withColumn("held", F.array(*slots))
    back = F.transform(F.sequence(F.lit(0), F.lit(ring - 1)), lambda i: F.get("held", F.pmod(c("newest") - i, F.lit(ring))))
    return x.select("company_id", "t0", F.slice(F.filter(back, lambda p: p["number"] > c("newest") - ring), 1, limit).alias("periods"))


def nearest_within(wanted: DataFrame, known: DataFrame, want: str, at: str, days: int, preceding_only: bool = True) -> DataFrame:
    """``wanted`` plus ``found`` (the day) and the other columns of ``known``: the row of the same day, else the nearest of at most ``days`` days, before or on either side.

    Of a row before and one behind at equal distance the earlier counts. Both tables have ``company_id``; ``known`` has one row a
    day. One timeline in both directions: the last row before and the first behind are running aggregates of either order.
    """
    own, payload = [k for k in wanted.columns], [k for k in known.columns if k not in ("company_id", at)]
    row = F.struct(c(at).alias("found"), *payload)
    kinds = dict(known.select(row.alias("r")).dtypes)["r"]
    w = F.struct(*own)
    kind_w = dict(wanted.select(w.alias("w")).dtypes)["w"]
    both = known.where(c(at).isNotNull()).select("company_id", c(at).alias("_at"), row.alias("_row"), F.lit(None).cast(kind_w).alias("_own")).unionByName(wanted.select("company_id", c(want).alias("_at"), F.lit(None).cast(kinds).alias("_row"), w.alias("_own")))
    ahead = Window.partitionBy("company_id").orderBy("_at", c("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("company_id").orderBy(F.desc("_at"), c("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_before", F.last("_row", ignorenulls=True).over(ahead))
    if not preceding_only:
        x = x.withColumn("_behind", F.last("_row", ignorenulls=True).over(back))
    x = x.where("_own IS NOT NULL")
    gap = lambda r: F.abs(F.datediff(c("_at"), c(f"{r}.found")))
    near = F.when(gap("_before") <= days, c("_before"))
    if not preceding_only:
        behind = F.when(gap("_behind") <= days, c("_behind"))
        near = F.when(near.isNull() | (gap("_behind") < gap("_before")), F.coalesce(behind, near)).otherwise(near)
    return x.withColumn("_near", near).select("_own.*", "_near.found", *(c(f"_near.{k}").alias(k) for k in payload))
