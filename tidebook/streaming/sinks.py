"""Several tables from one stream: parents first, one transaction a batch, and a batch that may be run again.

A batch writes each table into a folder of its own number and, when all are there, one mark. Readers see marked batches only, so
a batch that failed half-way shows nothing, and one that runs again overwrites what it had left. Rows that repeat a key of
an earlier batch are left out on reading: of each key the first batch's first row counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.storage import qualified


@dataclass(frozen=True)
class Table:
    """A table of a batch: its rows out of the batch's frames, and the key of which only the first row counts (none: all do)."""

    name: str
    rows: Callable[[DataFrame], DataFrame]
    key: tuple[str, ...] = ()
    order: str = "ordinal"
    parent: str | None = None


def in_order(tables: list[Table]) -> list[Table]:
    """tables with each after its parent; a parent that is missing or a ring of them is an error."""
    known, out = {t.name: t for t in tables}, []

    def put(t: Table, path: tuple[str, ...]) -> None:
        if t.name in path or (t.parent and t.parent not in known):
            raise ValueError(f"no order of tables for {t.name}")
        if t.parent:
            put(known[t.parent], (*path, t.name))
        if t not in out:
            out.append(t)

    for t in tables:
        put(t, ())
    return out


def writer(spark: SparkSession, folder: str, tables: list[Table]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes every table of a batch under ``folder``, in the shared storage."""
    folder = qualified(spark, folder)
    sorted_tables = in_order(tables)

    def write(frames: DataFrame, batch: int) -> None:
        frames.persist()  # read once for each table
        try:
            for t in sorted_tables:
                rows = t.rows(frames)
                if t.key:
                    first = Window.partitionBy(*t.key).orderBy(t.order)
                    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
                rows.write.mode("overwrite").parquet(f"{folder}/{t.name}/batch={batch}")
            spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_marks/batch={batch}")
        finally:
            frames.unpersist()

    return write


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose mark stands."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{qualified(spark, folder)}/_marks")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    done = [s.getPath() for s in files.listStatus(where)]
    success = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in done if files.exists(success(p, "_SUCCESS")))


def table(spark: SparkSession, folder: str, t: Table) -> DataFrame | None:
    """A table's rows of all marked batches, the first of each key; None before the first batch."""
    batches = committed(spark, folder)
    if not batches:
        return None
    root = f"{qualified(spark, folder)}/{t.name}"
    rows = spark.read.option("basePath", root).parquet(*[f"{root}/batch={b}" for b in batches])
    if t.key:
        first = Window.partitionBy(*t.key).orderBy("batch", t.order)
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.drop("batch")


def written(stream: DataFrame, folder: str, tables: list[Table]) -> None:
    """Run a stream over what is there into ``tables`` under ``folder``."""
    spark = stream.sparkSession
    job = stream.writeStream.foreachBatch(writer(spark, folder, tables)).option("checkpointLocation", f"{qualified(spark, folder)}/_state").trigger(availableNow=True).start()
    job.awaitTermination()
