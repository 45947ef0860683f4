"""Queries of dated state, exports by day, and the order of streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import scalar as S
from tidebook.operators import history
from tidebook.sources import silver
from tidebook.storage import shared_dir, stage_table
from tidebook.tables import view

#: Days whose state is asked for.
DAYS = ("1995-06-30", "1996-12-31", "1998-12-31")


def market_history(spark: SparkSession, d: str) -> DataFrame:
    """How long each market kept its status and result."""
    return history.intervals(view(spark, d, "versions"), ["market"], "observed_ms", "version", ["status", "result"])


def _markets(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "markets").where("market % 10 <> 9").select("market", S.series_of(F.col("ticker")).alias("series"), "fee_type", "fee_multiplier")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    keys = [k for k in ("date", "series") if k in silver.schema(name).names]
    return spark.read.schema(silver.schema(name)).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").select(*keys, *[c for c in silver.schema(name).names if c not in keys])


def market_state_export(spark: SparkSession, d: str) -> DataFrame:
    """State and history of markets as of three days, written to the lake by day and series and read back; one of the days twice."""
    root = f"{shared_dir(spark)}/silver-{uuid.uuid4().hex}"
    last, seen = (stage_table(df, "observed") for df in silver.observed(view(spark, d, "versions")))
    days = {day: silver.market_state_of(last, seen, _markets(spark, d), day) for day in DAYS}
    for day in (*DAYS, DAYS[1]):
        state, past = days[day]
        silver.export({"market_state": state, "market_state_history": past}, root, ("date", "series"))
    state, past = (_read(spark, root, name) for name in ("market_state", "market_state_history"))
    counts = past.groupBy("date", "market").agg(F.count("*").alias("intervals"), F.sum("observations").alias("observations"))
    return state.join(counts, ["date", "market"])


def calibration_export(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sums of three tables of evidence, by the day of their probe, as the lake holds them."""
    root = f"{shared_dir(spark)}/silver-{uuid.uuid4().hex}"
    tables = silver.calibration(view(spark, d, "probes"), view(spark, d, "readings"), view(spark, d, "modelled"))
    silver.export(tables, root, ("date",))
    measure = {"probes": "queue", "queue_observations": "executed", "counterfactuals": "modelled_queue_at_entry"}
    rows = [_read(spark, root, name).select(F.lit(name).alias("table_name"), "date", F.col(c).alias("v")) for name, c in measure.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("table_name", "date").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def delta_order(spark: SparkSession, d: str) -> DataFrame:
    """Deltas by the start of their stream and its numbers; every third stream has no row of its own."""
    rows = view(spark, d, "recorded").select("delta_id", "market", F.concat(F.lit("s"), F.sha2(F.col("stream").cast("string"), 256)).alias("stream"), "ms", "seq")
    streams = view(spark, d, "recorded").where("stream % 3 > 0").select(F.concat(F.lit("s"), F.sha2(F.col("stream").cast("string"), 256)).alias("stream"), "started_ms")
    ordered = history.stream_ordered(rows, streams, ["market"])
    return ordered.select("delta_id", "market", "started_ms", F.row_number().over(history.Window.partitionBy("market").orderBy(history.place())).alias("place"))


_RUNS = lambda rows, part: f"""SELECT {part} market, status, result, min(observed_ms) AS from_ms, sum(n) AS observations FROM (
    SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY {part} market ORDER BY observed_ms) AS run FROM (
      SELECT *, lag(observed_ms) OVER w IS NULL OR lag(status) OVER w IS DISTINCT FROM status OR lag(result) OVER w IS DISTINCT FROM result AS turn FROM (
        SELECT {part} market, observed_ms, arg_max_null(status, version) AS status, arg_max_null(result, version) AS result, count(*) AS n FROM {rows} GROUP BY {part} market, observed_ms) a WINDOW w AS (PARTITION BY {part} market ORDER BY observed_ms)) b) c GROUP BY {part} market, run, status, result"""  # noqa: E731

ORACLES: dict[str, str] = {
    "market_history": f"SELECT market, status, result, from_ms, lead(from_ms) OVER (PARTITION BY market ORDER BY from_ms) AS to_ms, CAST(observations AS BIGINT) AS observations FROM ({_RUNS('versions', '')}) r",
    "market_state_export": f"""WITH days AS (SELECT unnest({list(DAYS)}) AS date), up AS (SELECT d.date, v.* FROM days d JOIN versions v ON v.observed_ms < epoch_ms(CAST(d.date AS DATE)) + 86400000),
        runs AS ({_RUNS('up', 'date,')}), now AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY date, market ORDER BY from_ms DESC) = 1),
        seen AS (SELECT date, market, result, min(observed_ms) AS first_ms FROM up WHERE result <> '' GROUP BY ALL), counts AS (SELECT date, market, count(*) AS intervals, CAST(sum(observations) AS BIGINT) AS observations FROM runs GROUP BY ALL)
      SELECT n.date, coalesce(split_part(m.ticker, '-', 1), 'unknown') AS series, n.market, n.status, n.result, n.from_ms AS since_ms, s.first_ms AS result_first_observed_ms, m.fee_type, CAST(m.fee_multiplier AS DECIMAL(18,8)) AS fee_multiplier, c.intervals, c.observations
      FROM now n JOIN counts c ON c.date = n.date AND c.market = n.market LEFT JOIN (SELECT * FROM markets WHERE market % 10 <> 9) m ON m.market = n.market LEFT JOIN seen s ON s.date = n.date AND s.market = n.market AND s.result = n.result""",
    "calibration_export": """WITH p AS (SELECT *, strftime(make_timestamp(ack_ms * 1000), '%Y-%m-%d') AS date FROM probes)
      SELECT 'probes' AS table_name, date, count(*) AS n, CAST(sum(queue) AS BIGINT) AS total FROM p GROUP BY date UNION ALL SELECT 'queue_observations', date, count(*), CAST(sum(executed) AS BIGINT) FROM readings r JOIN p ON p.probe_id = r.probe_id GROUP BY date
      UNION ALL SELECT 'counterfactuals', date, count(*), CAST(sum(queue_at_entry) AS BIGINT) FROM modelled m JOIN p ON p.probe_id = m.probe_id GROUP BY date""",
    "delta_order": """WITH x AS (SELECT delta_id, market, seq, 's' || sha256(CAST(stream AS VARCHAR)) AS name, CASE WHEN stream % 3 > 0 THEN started_ms ELSE min(ms) OVER (PARTITION BY market, stream) END AS started_ms FROM recorded)
      SELECT delta_id, market, started_ms, CAST(row_number() OVER (PARTITION BY market ORDER BY started_ms, name, seq) AS INT) AS place FROM x""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (market_history, market_state_export, calibration_export, delta_order)}
