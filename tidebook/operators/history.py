"""Histories of observed versions: intervals of validity, the state of any day, when a value was first seen, and stream order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: list[str], at: str, order: str, values: list[str]) -> DataFrame:
    """(key, at, value, versions): of each instant the values of its last version, as a struct, and how many versions it has."""
    return versions.groupBy(*key, at).agg(F.max_by(F.struct(*values), order).alias("value"), F.count("*").alias("versions"))


def intervals(versions: DataFrame, key: list[str], at: str, order: str, values: list[str]) -> DataFrame:
    """(key, values, from_ms, to_ms, observations): one row for as long as a key's values stay the same; to_ms is exclusive, null at the end.

    Versions are taken in the order of (at, order); equal neighbours are one interval, nulls equal nulls. Of several versions of
    one instant only the last holds.
    """
    return intervals_of(latest(versions, key, at, order, values), key, at)


def intervals_of(last: DataFrame, key: list[str], at: str) -> DataFrame:
    """:func:`intervals` of what :func:`latest` has found."""
    last = last.withColumnsRenamed({"value": "_v", "versions": "_n"})
    w = Window.partitionBy(*key).orderBy(at)
    turns = last.withColumn("_was", F.lag("_v").over(w)).withColumn("_run", F.sum((F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.col("_v"))).cast("long")).over(w))
    runs = turns.groupBy(*key, "_run").agg(F.min(at).alias("from_ms"), F.min_by("_v", at).alias("_v"), F.sum("_n").alias("observations"))
    ends = F.lead("from_ms").over(Window.partitionBy(*key).orderBy("from_ms"))
    return runs.select(*key, "_v.*", "from_ms", ends.alias("to_ms"), "observations")


def state_at(held: DataFrame, instants: list[int], at: str) -> DataFrame:
    """The intervals in force at each of a list of instants, as rows of (at, and what ``held`` has)."""
    there = F.filter(F.array(*[F.lit(t).cast("long") for t in instants]), lambda t: (t >= F.col("from_ms")) & (F.col("to_ms").isNull() | (t < F.col("to_ms"))))
    return held.withColumn(at, F.explode(there))


def first_seen(versions: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """(key, value, first_ms): when each value of a key was first observed; blank and null ones never are."""
    return versions.where(F.col(value) != "").groupBy(*key, value).agg(F.min(at).alias("first_ms"))


def stream_ordered(deltas: DataFrame, streams: DataFrame, by: list[str]) -> DataFrame:
    """deltas (by, stream, ms, seq) with ``started_ms``: when its stream began, or, of a stream without a row, its first delta there.

    Numbers restart with each stream and streams' names say nothing of time, so (started_ms, stream, seq) is the order of deltas.
    """
    first = F.min("ms").over(Window.partitionBy(*by, "stream"))
    known = streams.groupBy("stream").agg(F.min("started_ms").alias("_started"))
    return deltas.withColumn("_first", first).join(known, "stream", "left").withColumn("started_ms", F.coalesce("_started", "_first")).drop("_first", "_started")


def place(started: Column | str = "started_ms") -> Column:
    """The position of a delta in its market."""
    return F.struct(started, "stream", "seq")
