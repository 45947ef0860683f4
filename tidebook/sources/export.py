"""Scans and exports of the lake: a checked request, lossless text formats, read-back digests, sealing and dropping, bundles."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.sources import lake

#: Tables that may be asked for, and the columns that each filter means there; None where it has no such column.
TABLES: dict[str, dict[str, str | None]] = {
    "deltas": {"time": "received_at_ms", "ticker": "market_ticker", "event": "event_ticker", "series": "series_ticker"},
    "trades": {"time": "received_at_ms", "ticker": "market_ticker", "event": None, "series": None},
    "snapshots": {"time": "received_at_ms", "ticker": "market_ticker", "event": None, "series": None},
    "markets": {"time": None, "ticker": "market_ticker", "event": "event_ticker", "series": "series_ticker"},
    "sessions": {"time": "started_at_ms", "ticker": None, "event": None, "series": None},
    "gaps": {"time": "started_ms", "ticker": None, "event": None, "series": None},
    "book_samples": {"time": "bucket_ts_ms", "ticker": "market_ticker", "event": None, "series": None},
    "probes": {"time": "ack_ms", "ticker": "market_ticker", "event": None, "series": None},
}


@dataclass(frozen=True)
class Request:
    """What of a table is wanted: half-open time, tickers, events, series, days (partition keys), columns, a limit."""

    table: str
    from_ms: int | None = None
    to_ms: int | None = None
    tickers: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    series: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    limit: int | None = field(default=None)


def scan(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of the lake by its declared types, with its partition keys; nothing is inferred from the files."""
    declared = schema or lake.schema(table)
    keys = [T.StructField(k, T.StringType()) for k in ("date", "series") if k not in declared.names]
    return spark.read.schema(T.StructType([*declared.fields, *keys])).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def select(df: DataFrame, request: Request) -> DataFrame:
    """The rows of a request as filters that reach the scan; an unknown table or a filter that it lacks is an error."""
    if request.table not in TABLES:
        raise ValueError(f"unknown table {request.table}")
    columns = TABLES[request.table]

    def named(what: str) -> str:
        column = columns[what]
        if column is None:
            raise ValueError(f"{request.table} has no {what} filter")
        return column

    if request.dates:
        df = df.where(F.col("date").isin(*request.dates))
    for what, values in (("ticker", request.tickers), ("event", request.events), ("series", request.series)):
        if values:
            df = df.where(F.col(named(what)).isin(*values))
    if request.from_ms is not None:
        df = df.where(F.col(named("time")) >= request.from_ms)
    if request.to_ms is not None:
        df = df.where(F.col(named("time")) < request.to_ms)
    if request.columns:
        if missing := set(request.columns) - set(df.columns):
            raise ValueError(f"{request.table} has no {', '.join(sorted(missing))}")
        df = df.select(*request.columns)
    if request.limit is not None:
        if request.limit < 1:
            raise ValueError("a limit is one row or more")
        df = df.limit(request.limit)
    return df


def as_text(df: DataFrame) -> DataFrame:
    """df for text formats without loss: decimals as text, bytes as lower-case hex, nested values as JSON."""

    def spelled(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.lower(F.hex(c)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(f.name)
        return c.alias(f.name)

    return df.select(*[spelled(f) for f in df.schema])


def write_text(df: DataFrame, path: str, kind: str) -> None:
    """CSV with a header, or NDJSON with nulls spelled out."""
    if kind not in ("csv", "ndjson"):
        raise ValueError(f"unknown format {kind}")
    writer = as_text(df).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under path, read back from where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file, problem) of files whose digest or size differs from ``expected`` (file, bytes, sha256), of missing and of extra ones."""
    have = digests(spark, path).withColumnsRenamed({"bytes": "b", "sha256": "s"})
    both = expected.join(have, "file", "full_outer")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("bytes") != F.col("b"), "size").when(F.col("sha256") != F.col("s"), "digest")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


# ---- sealing, archiving and dropping of days

#: States of a day of raw data, each with those that may follow.
NEXT = {"open": ("sealed",), "sealed": ("archived",), "archived": ("verified", "sealed"), "verified": ("dropped",), "dropped": ()}


def moved(ledger: DataFrame, day: str, to: str, rows: int | None = None, version: int = 0) -> DataFrame:
    """The ledger (day, state, sealed_rows, verified_rows, version) with the day in its next state.

    A day is sealed with its row count, verified with the count read back, and dropped only where both agree. A step that
    does not follow is an error.
    """
    found = lake.latest(ledger, ["day"], "version").where(F.col("day") == day).collect()  # one row
    now = found[0].asDict() if found else {"state": "open", "sealed_rows": None, "verified_rows": None, "version": -1}
    if to not in NEXT[now["state"]]:
        raise ValueError(f"{day} is {now['state']}: it cannot become {to}")
    if to in ("sealed", "verified") and rows is None:
        raise ValueError(f"{to} needs a row count")
    sealed = rows if to == "sealed" else now["sealed_rows"]
    checked = rows if to == "verified" else None if to == "sealed" else now["verified_rows"]
    if to == "dropped" and checked != sealed:
        raise ValueError(f"{day} has {sealed} rows sealed and {checked} verified: it stays")
    row = (day, to, sealed, checked, max(version, now["version"] + 1))
    return ledger.unionByName(ledger.sparkSession.createDataFrame([row], ledger.schema))


def expirable(exports: DataFrame) -> DataFrame:
    """Days of exports (day, table, verified) that may expire: there is an export, and all are verified."""
    return exports.groupBy("day").agg(F.count("*").alias("n"), F.min(F.coalesce("verified", F.lit(False))).alias("all")).where("n >= 1 AND all").select("day")


def overdue(ledger: DataFrame, now_ms: int, hours: int) -> DataFrame:
    """Days (day, state, end_ms) past their time that are not verified or dropped."""
    return ledger.where((F.col("end_ms") < now_ms - hours * 3_600_000) & ~F.col("state").isin("verified", "dropped")).select("day", "state")


# ---- result bundles

#: Tables of a run's result.
BUNDLE = ("orders", "fills", "positions", "pnl", "markouts")


def write_bundle(folder: str, parameters: dict, tables: dict[str, DataFrame], summary: dict) -> str:
    """A run's five tables as Parquet with their schemas, empty ones too, and its manifest and summary as JSON.

    The manifest lies under the run's key, so equal parameters name one bundle. Returns the bundle's folder.
    """
    if set(tables) != set(BUNDLE):
        raise ValueError(f"a bundle holds {', '.join(BUNDLE)}")
    spark = next(iter(tables.values())).sparkSession
    key = lake.run_key(parameters)
    path = f"{folder}/run-{key[:12]}"
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        counts[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}").count()
    manifest = {"key": key, "parameters": parameters, "rows": counts, "schemas": {n: df.schema.simpleString() for n, df in tables.items()}}
    manifest["digest"] = hashlib.sha256(json.dumps(manifest, sort_keys=True, default=str).encode()).hexdigest()
    for name, value in (("manifest", manifest), ("summary", summary)):
        text = json.dumps(value, sort_keys=True, default=str)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.json")
    return path


def report(summary: dict, rows: list[dict]) -> str:
    """A run's figures, and a comparison of runs with the same columns, as Markdown."""
    lines = ["# Run", "", *[f"- {k}: {'unknown' if v is None else v}" for k, v in summary.items()]]
    if rows:
        names = list(rows[0])
        lines += ["", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
        lines += ["| " + " | ".join("unknown" if r.get(n) is None else str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"
