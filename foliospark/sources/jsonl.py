"""JSON Lines tables: pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page per line with a declared schema; blank lines give no row."""
    return spark.read.schema(schemas.PAGE).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8, one object per line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
