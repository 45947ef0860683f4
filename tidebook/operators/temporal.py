"""Operators over time: as-of joins, clock grids and change points, all as window or range plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, values: list[str], observed_until: Column | None = None) -> DataFrame:
    """left with, of each key, right's ``values`` in force at ``time`` (inclusive, backward).

    One shuffle by key: both sides are united and the last value is carried forward. The values travel in a struct,
    so a null that right states is not skipped. Where ``observed_until`` lies before ``time`` they are null.
    """
    marked = right.select(*on, F.col(time).alias("_t"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    asked = left.select("*", F.col(time).alias("_t"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*on).orderBy(F.col("_t").asc_nulls_last(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = asked.unionByName(marked, allowMissingColumns=True).withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    known = F.col("_in") if observed_until is None else F.when(F.col("_t") <= observed_until, F.col("_in"))
    return joined.select(*left.columns, *[known[v].alias(v) for v in values])


def grid(spans: DataFrame, first: str, last: str, step: int, out: str = "bucket_ms") -> DataFrame:
    """A row for each multiple of ``step`` in [first, last] of every row of ``spans``."""
    start = F.ceil(F.col(first) / step).cast("long") * step
    stop = F.floor(F.col(last) / step).cast("long") * step
    buckets = F.when(start <= stop, F.sequence(start, stop, F.lit(step).cast("long")))
    return spans.select("*", F.explode(buckets).alias(out))


def change_points(series: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before (null equals null)."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*key).orderBy(*order))
    return series.withColumn("_b", before).where("_b IS NULL OR NOT (_b.`" + value + "` <=> `" + value + "`)").drop("_b")
