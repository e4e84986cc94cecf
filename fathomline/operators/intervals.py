"""Interval joins: points in closed intervals, by day buckets, by keys alone or by a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_days(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each day that an interval touches."""
    days = F.sequence(F.to_date(start), F.to_date(end))
    return intervals.where(F.col(end) >= F.col(start)).select("*", F.explode(days).alias("_day"))


def range_join(points: DataFrame, intervals: DataFrame, on: list[str], ts: str, start: str, end: str, how: str = "inner", *, by_day: bool = True) -> DataFrame:
    """``points`` in ``intervals`` (both ends included; overlaps give several rows).

    An equi-join on key and day carries the range test as its residual.  Where
    a key has few intervals (``by_day`` false) the key alone will do, and no
    interval is dealt to its days.  Both sides are shuffled: Spark's size check
    doesn't see the days and would send all of them through the driver.
    """
    left, right = points.alias("p"), intervals.where(F.col(end) >= F.col(start)).alias("i")
    if by_day:
        left, right = points.withColumn("_day", F.to_date(ts)).alias("p"), with_days(intervals, start, end).alias("i")
    same = F.col(f"p.{ts}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    for c in [*on, "_day"] if by_day else on:
        same &= F.col(f"p.{c}") == F.col(f"i.{c}")
    joined = left.join(right.hint("merge"), same, how)
    names = [F.col(f"p.{c}") for c in points.columns]
    if how not in ("left_anti", "left_semi"):
        names += [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    return joined.select(*names)


def with_cover(points: DataFrame, intervals: DataFrame, on: list[str], ts: str, start: str, end: str, name: str) -> DataFrame:
    """``points`` with ``name``: does some interval of its key hold it (both ends included)?

    A sweep over starts and points in order, with the latest end so far: a row
    per interval however long it is, which days would not be.
    """
    fine = F.col(end) >= F.col(start)
    for c in on:
        fine &= F.col(c).isNotNull()
    begun = intervals.where(fine).select(*on, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end"))
    rows = points.withColumn("_at", F.col(ts)).withColumn("_kind", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    reach = F.max("_end").over(Window.partitionBy(*on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_reach", reach).where("_kind = 1").select(*points.columns, F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)).alias(name))
