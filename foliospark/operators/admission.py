"""Per-caller daily request limits over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.guard import REQUESTS_PER_DAY


def number_requests(requests: DataFrame, slot_seconds: int = 60) -> DataFrame:
    """Adds ``day`` and ``used``: the position of each request of (ip, day) by time.

    One caller may send a third of all requests, so a day is never numbered in one
    window. Requests are counted per short time slot first (combined map-side), the
    slot counts are summed up over the day, and each request is numbered within its
    slot on top of that base.
    """
    slotted = requests.withColumn("day", F.to_date("ts")).withColumn(
        "_slot", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slot_seconds)
    )
    key = ["ip", "day", "_slot"]
    earlier = Window.partitionBy("ip", "day").orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = (
        slotted.groupBy(*key).agg(F.count("*").alias("_n"))
        .select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    within = F.row_number().over(Window.partitionBy(*key).orderBy("ts", "id"))
    return (
        slotted.withColumn("_nth", within).join(bases, key)
        .withColumn("used", F.col("_base") + F.col("_nth"))
        .drop("_slot", "_nth", "_base")
    )


def admit_requests(requests: DataFrame, limit: int = REQUESTS_PER_DAY,
                   slot_seconds: int = 60) -> DataFrame:
    """One decision per request (ip, ts, id): the first ``limit`` of a UTC day pass."""
    return number_requests(requests, slot_seconds).withColumn("allowed", F.col("used") <= limit)


def daily_usage(requests: DataFrame) -> DataFrame:
    """The counter table: requests per (ip, day)."""
    return requests.groupBy("ip", F.to_date("ts").alias("day")).agg(F.count("*").alias("count"))


def prune_usage(usage: DataFrame, cutoff: str) -> DataFrame:
    """Counters from ``cutoff`` (a date) on."""
    return usage.filter(F.col("day") >= F.lit(cutoff).cast("date"))
