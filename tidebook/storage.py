"""Tables in the folder that driver and executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where the folder is kept for a session that has none set: spark.checkpoint.dir can't be set at run time.
OWN = "spark.tidebook.sharedDir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with its file system named.

    One is made here only where that is unset and the master is local, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get(OWN, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set(OWN, base)
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: without one Spark takes its default file system, other libraries the machine's own disk."""
    if "://" in path:
        return path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete what :func:`stage_table` wrote for these tables; nothing that is still to run may read them."""
    for table in tables:
        spark, path = table.sparkSession, table.staged_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
