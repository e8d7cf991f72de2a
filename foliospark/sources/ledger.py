"""The table of filing keys already dealt with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "seen string"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Keys of JSON ledger files ({"seen": [...]}). A missing ledger is empty, and a file
    that cannot be parsed counts as empty: everything is then new again."""
    try:
        files = spark.read.schema("seen array<string>").option("multiLine", "true").json(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return empty_ledger(spark)
    return files.select(F.explode("seen").alias("seen")).distinct()


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Sorted distinct keys as a Parquet table; the sort is a range partitioning, so no
    task holds the whole ledger."""
    ledger.select("seen").distinct().orderBy("seen").write.mode("overwrite").parquet(path)


def read_ledger_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return empty_ledger(spark)
