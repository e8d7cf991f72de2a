"""Request limits over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions.guard import REQUESTS_PER_DAY
from foliospark.operators.admission import number_requests
from foliospark.session import stored
from foliospark.sources.tables import append_version, compact, earlier_versions, run_of

USAGE = "ip string, day date, count bigint"


def stream_admission(requests: DataFrame, decisions_path: str, usage_path: str, checkpoint: str,
                     limit: int = REQUESTS_PER_DAY) -> StreamingQuery:
    """One decision per request (ip, ts, id), counted in order of arrival.

    Within a batch requests are numbered by event time with the slotted count of the
    batch job, so a caller that sends a third of the traffic is not one task. Counts of
    earlier batches come from the usage table, of which only the days of the batch are read;
    each batch adds its own counts as one version of its run, which makes a retry of the batch
    harmless and lets a new checkpoint go on counting. ``compact_usage`` folds the versions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, checkpoint)
        counts = stored(batch.groupBy("ip", F.to_date("ts").alias("day")).agg(
            F.count("*").alias("count")), "usage")
        days = [r[0] for r in counts.select("day").distinct().collect()]
        before = (
            earlier_versions(spark, usage_path, USAGE, run, batch_id).filter(F.col("day").isin(days))
            .groupBy("ip", "day").agg(F.sum("count").alias("_before"))
        )
        decided = (
            number_requests(batch).join(before, ["ip", "day"], "left")
            .withColumn("used", F.col("used") + F.coalesce("_before", F.lit(0)))
            .withColumn("allowed", F.col("used") <= limit).drop("_before")
        )
        append_version(decided, decisions_path, batch_id, run)
        append_version(counts, usage_path, batch_id, run, by=("day",))

    return (
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def compact_usage(spark: SparkSession, usage_path: str) -> int | None:
    """Folds the usage versions into one, still by day; rows keep the batch they count."""
    return compact(spark, usage_path, USAGE, by=("day",))


def daily_usage_stream(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Running requests per caller and UTC day, for update or append mode. Counts are
    combined before they reach the state."""
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "ip").agg(F.count("*").alias("count"))
        .select("ip", F.to_date("window.start").alias("day"), "count")
    )
