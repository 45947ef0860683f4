"""Queries of a recording's invariants and of its integrity events; oracles count each apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import invariants
from tidebook.storage import stage_table
from tidebook.tables import view

#: Integrity events by what an event shows: a negative level, a gap, a disconnect, or a type that the catalogue lacks.
_TYPE = """CASE WHEN ok IS NOT NULL AND NOT ok THEN 'negative_level_quantity' WHEN event_type = 'error' THEN 'sequence_gap' WHEN event_id % 53 = 0 THEN 'ws_disconnect' WHEN event_id % 59 = 0 THEN 'mystery' END"""
_SEVERITY = "CASE event_id % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 3 THEN 'critical' ELSE CASE WHEN event_id % 7 = 0 THEN 'fatal' ELSE 'warning' END END"


def _recording(spark: SparkSession, d: str) -> invariants.Recording:
    """The given tables as a recording: sequence numbers are a market's events, sessions ten days long."""
    rows = stage_table(view(spark, d, "numbered").withColumn("session", F.floor(F.col("ms") / 864_000_000)), "numbered")
    seeds = view(spark, d, "seeds").select("stream", "market", F.col("snapshot_id").alias("place"), "source", F.when(F.col("n") >= 0, "h").alias("hash"))
    pre = (F.col("post") - F.col("delta")).cast("decimal(24,6)")
    sessions = rows.groupBy("session").agg(F.max("event_id").alias("last"))
    return invariants.Recording(
        frames=view(spark, d, "wire").select(F.struct("stream", "market").alias("session"), F.col("seq").alias("ordinal")),
        gaps=rows.where("event_type = 'error'").select(F.col("event_id").alias("gap_id"), F.when(F.col("event_id") % 5 == 0, "open").otherwise("recovered").alias("status")),
        events=rows.select(F.expr(_TYPE).alias("type"), F.expr(_SEVERITY).alias("severity")).where("type IS NOT NULL"),
        deltas=rows.where("ok IS NOT NULL").select(F.col("session").alias("stream"), "market", F.col("event_id").alias("place"), F.col("ok").alias("applied"), pre.alias("pre"), "post", "delta"),
        snapshots=seeds,
        streams=rows.groupBy("session", F.col("event_type").alias("channel")).agg(F.min("event_id").alias("stream"), (F.max("event_id") % 2 == 0).alias("ended")),
        sessions=sessions.select("session", F.when(F.col("session") % 3 > 0, "sigterm").alias("end_reason")),
        replays=rows.groupBy("market").agg(F.count_if("ok").alias("checked"), F.count_if(F.col("ok") & (F.col("post") >= 0)).alias("matched")),
    )


def soak_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Eight invariants of the recording, with the counts behind each."""
    return invariants.soak(_recording(spark, d))


def integrity_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Integrity events by type and severity; those that the catalogue lacks are marked."""
    events = _recording(spark, d).events
    listed = F.coalesce(F.col("type").isin(*invariants.TYPES) & F.col("severity").isin(*invariants.SEVERITIES), F.lit(False))
    return events.groupBy("type", "severity", invariants.severity_rank(F.col("severity")).alias("rank"), listed.alias("listed")).agg(F.count("*").alias("n"))


_ROWS = f"rows AS (SELECT *, ms // 864000000 AS session, {_TYPE} AS type, {_SEVERITY} AS severity FROM numbered)"
ORACLES: dict[str, str] = {
    "soak_invariants": f"""WITH {_ROWS},
      durable AS (SELECT count(*) AS a, count(*) FILTER (NOT EXISTS (SELECT 1 FROM wire p WHERE p.stream = w.stream AND p.market = w.market AND p.seq = w.seq - 1) AND w.seq > 1) AS b, 0 AS c FROM wire w),
      gaps AS (SELECT count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (event_type = 'error' AND event_id % 5 > 0) AS b, count(*) FILTER (type = 'sequence_gap') AS c FROM rows),
      bare AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM seeds s WHERE s.stream = r.session AND s.market = r.market AND s.source IN ('ws_initial', 'ws_recovery') AND s.snapshot_id <= r.event_id) AS alone FROM rows r WHERE ok),
      seeded AS (SELECT count(*) AS a, count(*) FILTER (alone) AS b, count(DISTINCT session) FILTER (alone) AS c FROM bare),
      subs AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT session, event_type FROM rows) x) AS a, 0 AS b, 0 AS c),
      sums AS (SELECT count(*) AS a, count(*) AS b, 0 AS c FROM rows WHERE ok), own AS (SELECT count(*) AS a, 0 AS b, 0 AS c FROM seeds WHERE source = 'local_materialized'),
      closed AS (SELECT count(DISTINCT session) AS a, count(DISTINCT session) FILTER (session % 3 = 0) AS b, 0 AS c FROM rows), equal AS (SELECT count(*) FILTER (ok) AS a, count(*) FILTER (ok AND post >= 0) AS b, 0 AS c FROM rows),
      said AS (SELECT 'frames durable' AS name, b = 0 AS pass, * FROM durable UNION ALL SELECT 'gaps recovered', a > 0 AND a = b AND a = c, * FROM gaps UNION ALL SELECT 'deltas seeded', b = 0, * FROM seeded UNION ALL SELECT 'no duplicate subscriptions', b = 0, * FROM subs
        UNION ALL SELECT 'arithmetic', a = b, * FROM sums UNION ALL SELECT 'snapshots valid', b = 0, * FROM own UNION ALL SELECT 'sessions closed', a > 1 AND b = 0, * FROM closed UNION ALL SELECT 'replay equal', a > 0 AND a = b, * FROM equal)
      SELECT name, pass, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c FROM said""",
    "integrity_catalogue": f"""WITH {_ROWS} SELECT type, severity, CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 WHEN 'critical' THEN 3 END AS rank, type <> 'mystery' AND severity <> 'fatal' AS listed, count(*) AS n FROM rows WHERE type IS NOT NULL GROUP BY ALL""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (soak_invariants, integrity_catalogue)}
