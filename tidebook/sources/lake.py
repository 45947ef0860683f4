"""The lake: typed contracts, partitioned writes that check themselves, a ledger, archives and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE, SIZE = T.DecimalType(12, 6), T.DecimalType(24, 6)

_DDL = {
    "deltas": "session_id string, ingest_ordinal long, market_ticker string, event_ticker string, series_ticker string, stream_id string, seq long, exchange_ts_ms long, received_at_ms long, side string, price decimal(12,6), delta_count decimal(24,6), pre_count decimal(24,6), post_count decimal(24,6), applied boolean",
    "trades": "trade_id string, session_id string, ingest_ordinal long, market_ticker string, yes_price decimal(12,6), no_price decimal(12,6), count decimal(24,6), taker_outcome_side string, received_at_ms long",
    "snapshots": "session_id string, stream_id string, seq long, market_ticker string, yes_bids array<struct<price: decimal(12,6), size: decimal(24,6)>>, no_bids array<struct<price: decimal(12,6), size: decimal(24,6)>>, received_at_ms long",
}


def schema(name: str) -> T.StructType:
    """The declared types of a table of the lake; a session must be running."""
    return T.StructType.fromDDL(_DDL[name])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df cast to the declared types; an absent column is null."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def contract(df: DataFrame, schema: T.StructType) -> list[str]:
    """Breaches of the declared types; columns that df lacks are ignored, as is an empty table."""
    declared = {f.name: f.dataType for f in schema}
    return [f"{f.name}: {f.dataType.simpleString()} is not {declared[f.name].simpleString()}" for f in df.schema if f.name in declared and f.dataType != declared[f.name]]


def semantic_breaches(deltas: DataFrame) -> DataFrame:
    """(name, n) of rows that break the arithmetic, the price range or the order of ordinals."""
    lagged = deltas.selectExpr("*", "lag(ingest_ordinal) OVER (PARTITION BY session_id ORDER BY received_at_ms, ingest_ordinal) AS prev")
    one = lagged.agg(
        F.count_if(F.expr("applied AND post_count <> pre_count + delta_count")).alias("arithmetic"),
        F.count_if(F.expr("price < 0 OR price > 1")).alias("price_range"),
        F.count_if(F.expr("ingest_ordinal < prev")).alias("order"),
    )
    return one.selectExpr("stack(3, 'arithmetic', arithmetic, 'price_range', price_range, 'order', `order`) AS (name, n)")


def write_partitioned(df: DataFrame, path: str, schema: T.StructType, keys: tuple[str, ...] = ("date", "series"), allow_shrink: bool = False) -> int:
    """Typed Parquet by partition keys (null series as ``unknown``); rows are counted back, and a partition never loses
    rows unless that is allowed. Returns the rows written."""
    spark = df.sparkSession
    placed = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys], *[F.col(c).cast(schema[c].dataType).alias(c) for c in df.columns if c in schema.names and c not in keys])
    counts = {tuple(r[k] for k in keys): r["n"] for r in placed.groupBy(*keys).agg(F.count("*").alias("n")).collect()}  # partitions, not rows
    if not allow_shrink:
        for r in _existing(spark, path, keys):
            part = tuple(str(r[k]) for k in keys)
            if part in counts and counts[part] < r["n"]:
                raise ValueError(f"partition {part} would shrink from {r['n']} to {counts[part]} rows")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)
    found = {tuple(str(r[k]) for k in keys): r["n"] for r in _existing(spark, path, keys)}
    wrong = {k: (n, found.get(k)) for k, n in counts.items() if found.get(k) != n}
    if wrong:
        raise ValueError(f"rows written and read back differ: {wrong}")
    return sum(counts.values())


def _existing(spark: SparkSession, path: str, keys: tuple[str, ...]):
    try:
        return spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("n")).collect()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return []
        raise


def latest(ledger: DataFrame, key: list[str], version: str) -> DataFrame:
    """The ledger's newest row of each key: union and latest wins instead of an upsert."""
    return ledger.groupBy(*key).agg(F.max_by(F.struct(*[c for c in ledger.columns if c not in key]), version).alias("r")).select(*key, "r.*")


def fingerprint(df: DataFrame) -> str:
    """SHA-256 over the sorted files and row counts that df really reads."""
    files = df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    lines = files.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "f", F.col("n").cast("string")))), "\n").alias("t"))
    return lines.select(F.sha2("t", 256).alias("h")).first()["h"]


def run_key(parameters: dict) -> str:
    """The same for equal parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def archive(frames: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """Frames as gzip NDJSON by channel and hour."""
    frames.write.mode("overwrite").partitionBy("channel", "hour").option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").json(path)


def restore(spark: SparkSession, path: str, schema: T.StructType, expected: int | None = None) -> DataFrame:
    """An archive read back; a different row count than ``expected`` is an error."""
    df = spark.read.schema(schema).json(path)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"archive has {n} rows, its manifest {expected}")
    return df
