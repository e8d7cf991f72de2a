"""Landed feed files: announcements, symbol master, download probes, raw filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schemas

# A payload is a list of rows (which the reader opens up) or an object with "data".
PAYLOAD = (
    f"{schemas.ANNOUNCEMENT}, data array<struct<"
    f"{schemas.ANNOUNCEMENT.replace(' string', ':string')}>>, _corrupt_record string"
)


def parse_announcements(payloads: DataFrame) -> DataFrame:
    """Announcement rows of readable payloads, batch or stream."""
    bare = F.array(F.struct(*schemas.ANNOUNCEMENT_COLUMNS))
    return payloads.filter("_corrupt_record IS NULL").select(
        F.inline(F.coalesce("data", bare)))


def read_announcement_payloads(spark: SparkSession, path: str,
                               multi_line: bool = True) -> DataFrame:
    return (
        spark.read.schema(PAYLOAD).option("multiLine", str(multi_line).lower())
        .option("mode", "PERMISSIVE").json(path)
    )


def read_announcements(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of all landed payloads; a payload that cannot be read is left out and does
    not stop the others (see ``failed_payloads``)."""
    return parse_announcements(read_announcement_payloads(spark, path, multi_line))


def failed_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, readable): files with a payload that could not be read, and the number of
    its rows that still had a symbol."""
    raw = read_announcement_payloads(spark, path, multi_line).withColumn(
        "file", F.col("_metadata.file_path"))
    return raw.filter("_corrupt_record IS NOT NULL").groupBy("file").agg(
        F.count("symbol").alias("readable"))


def read_symbol_master(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, name) of the quoted CSV; rows that miss either are dropped. The first two
    columns are read by position, since the header names carry stray spaces."""
    table = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    symbol, name = table.columns[:2]
    return (
        table.select(F.trim(F.col(f"`{symbol}`")).alias("symbol"),
                     F.trim(F.col(f"`{name}`")).alias("name"))
        .filter((F.length("symbol") > 0) & (F.length("name") > 0))
    )


def read_probe_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per probed download with its environment label."""
    records = spark.read.schema(schemas.PROBE).option(
        "multiLine", str(multi_line).lower()).json(path)
    return records.select(
        F.col("environment.label").alias("environment"), F.inline("pdf_downloads"))


def read_seed_matches(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per matched announcement of a per-symbol history probe."""
    records = spark.read.schema(schemas.SEED_PROBE).option(
        "multiLine", str(multi_line).lower()).json(path)
    probed = records.select(F.explode("symbols").alias("probed_symbol", "found"))
    return probed.select(
        "probed_symbol", F.col("found.probe.row_count").alias("row_count"),
        F.inline("found.matches"))


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Raw filing files with size, content hash and the PDF check (magic bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
        (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"), "content")


def check_download(content: str, content_type: str):
    """Error text of a downloaded body, null when it is a PDF by bytes or by type."""
    body, kind = F.col(content), F.coalesce(F.col(content_type), F.lit(""))
    return F.when(F.length(body) == 0, F.lit("empty body")).when(
        ~((F.substring(body, 1, 4) == F.lit(b"%PDF")) | kind.startswith("application/pdf")),
        F.concat(F.lit("not a PDF (content-type="), kind, F.lit(")")))
