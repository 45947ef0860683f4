"""Dated exports to the lake: the state and history of markets as of a day, and calibration evidence by the day of its probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators import history
from tidebook.sources import lake
from tidebook.storage import stage_table

DAY = 86_400_000
_DDL = {
    "market_state": "date string, series string, market long, status string, result string, since_ms long, result_first_observed_ms long, fee_type string, fee_multiplier decimal(18,8)",
    "market_state_history": "date string, series string, market long, status string, result string, from_ms long, to_ms long, observations long",
    "probes": "date string, probe_id long, market long, ack_ms long, terminal_state string, censored boolean, fill_ms long, queue long",
    "queue_observations": "date string, probe_id long, seq_no long, queue long, executed long, removed long",
    "counterfactuals": "date string, probe_id long, model long, would_fill boolean, fill_time long, real_outcome string, real_queue_at_entry long, modelled_queue_at_entry long",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def day_of(ms: str) -> F.Column:
    """The UTC day of an instant, as a partition's name."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def market_state(versions: DataFrame, markets: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(state, history) of markets as they were known when ``day`` ended, filed under that day.

    versions: market, observed_ms, version, status, result; markets: market, series, fee_type, fee_multiplier. Only versions up to then
    count; a market that the table of markets lacks is filed under a null series.
    """
    return market_state_of(*observed(versions), markets, day)


def observed(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the states of all days are made of: the last version of each instant, and when each result was first seen."""
    last = history.latest(versions, ["market"], "observed_ms", "version", ["status", "result"])
    return last, history.first_seen(versions, ["market"], "observed_ms", "result").withColumnRenamed("first_ms", "result_first_observed_ms")


def market_state_of(last: DataFrame, seen: DataFrame, markets: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """:func:`market_state` out of what :func:`observed` has found; the day's history is worked out once and stored for both tables."""
    end = last.sparkSession.sql("SELECT unix_millis(CAST(CAST(:d AS DATE) AS TIMESTAMP)) + 86400000 AS ms", {"d": day}).first()["ms"]
    held = history.intervals_of(last.where(F.col("observed_ms") < end), ["market"], "observed_ms")
    named = stage_table(held.join(markets.select("market", "series", "fee_type", "fee_multiplier"), "market", "left").withColumn("date", F.lit(day)), "history")
    known = seen.where(F.col("result_first_observed_ms") < end)
    state = named.where("to_ms IS NULL").withColumnRenamed("from_ms", "since_ms").join(known, ["market", "result"], "left")
    pick = lambda df, name: df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name)])
    return pick(state, "market_state"), pick(named, "market_state_history")


def calibration(probes: DataFrame, readings: DataFrame, modelled: DataFrame) -> dict[str, DataFrame]:
    """The three tables of evidence, each row filed under the day of its probe; rows without a probe belong to no day and are left out."""
    dated = probes.withColumn("date", day_of("ack_ms"))
    own = dated.select("probe_id", "date", F.col("terminal_state").alias("real_outcome"), F.col("queue").alias("real_queue_at_entry"))
    tables = {
        "probes": dated,
        "queue_observations": readings.join(own, "probe_id"),
        "counterfactuals": modelled.withColumnRenamed("queue_at_entry", "modelled_queue_at_entry").join(own, "probe_id"),
    }
    return {name: df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name)]) for name, df in tables.items()}


def export(tables: dict[str, DataFrame], root: str, keys: tuple[str, ...]) -> dict[str, int]:
    """Write tables under ``root``, partitioned and counted back; rows of each. A day that is exported again is replaced and never shrinks."""
    return {name: lake.write_partitioned(df, f"{root}/{name}", schema(name), keys) for name, df in tables.items()}
