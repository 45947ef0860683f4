"""Helpers shared by the training-data operators: shared storage, word expressions, row guards."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.storage import shared_dir, stage_table, unstage  # noqa: F401

#: White space of the word definition: space and U+0009..U+000D.
SPACES = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of text; null text has none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, "[\\x20\\x09-\\x0D]+")
    )


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def batches(df: DataFrame) -> DataFrame:
    """df for an Arrow function: this package's functions travel by value, wherever the driver found them."""
    cloudpickle.register_pickle_by_value(sys.modules["tidebook"])
    return df
